"""The stemmer as SQL, step by step: a second route to the stems of words."""

from __future__ import annotations

from tidemark.functions.stem import DERIVED, ENDINGS, REMOVED

_VOWELS = "('a', 'e', 'i', 'o', 'u')"


def _mask(w: str, before_first: str) -> str:
    """C or V per letter; ``before_first`` is what a leading y looks at."""
    return f"array_to_string(list_transform(range(1, length({w}) + 1), lambda i: CASE WHEN {w}[i] IN {_VOWELS} THEN 'V' WHEN {w}[i] = 'y' AND (CASE WHEN i > 1 THEN {w}[i - 1] ELSE {before_first} END) NOT IN {_VOWELS} THEN 'V' ELSE 'C' END), '')"


def _measure(w: str) -> str:
    return f"len(regexp_extract_all({_mask(w, f'right({w}, 1)')}, 'VC'))"


def _shape(w: str, end: str) -> str:
    """Whether the letters end in a pattern of C and V; a leading y is a consonant."""
    last = f" AND right({w}, 1) NOT IN ('w', 'x', 'y')" if end == "CVC" else ""
    return f"(suffix({_mask(w, repr('a'))}, '{end}'){last})"


def _swapped(table: tuple[tuple[str, str], ...], more_than: int) -> str:
    """The first suffix that fits decides, whether its base is long enough or not."""
    cases = " ".join(f"WHEN suffix(w, '{x}') THEN struct_pack(base := left(w, length(w) - {len(x)}), more := '{new}')" for x, new in table)
    return f"SELECT word, CASE WHEN x IS NOT NULL AND {_measure('x.base')} > {more_than} THEN x.base || x.more ELSE w END AS w FROM (SELECT word, w, CASE {cases} END AS x FROM {{}})"


def stem_sql(words: str) -> str:
    """``word`` and ``stem`` of a relation with lower-case words in ``word``."""
    cut = lambda k: f"left(w, length(w) - {k})"
    removed = tuple((x, "") for x in REMOVED)
    any_removed = " OR ".join(f"suffix(w, '{x}')" for x in REMOVED)
    return f"""
WITH s0 AS (SELECT word, word AS w FROM {words}),
s1 AS (SELECT word, CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {cut(2)} WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN {cut(1)} ELSE w END AS w FROM s0),
s2 AS (SELECT word, w, CASE WHEN suffix(w, 'eed') THEN NULL WHEN suffix(w, 'ed') THEN {cut(2)} WHEN suffix(w, 'ing') THEN {cut(3)} END AS b FROM s1),
s3 AS (SELECT word, CASE
  WHEN suffix(w, 'eed') THEN CASE WHEN {_measure(cut(3))} > 0 THEN {cut(1)} ELSE w END
  WHEN b IS NULL OR NOT regexp_matches(b, '[aeiou]') THEN w
  WHEN suffix(b, 'at') OR suffix(b, 'bl') OR suffix(b, 'iz') THEN b || 'e'
  WHEN {_shape('b', 'CC')} AND right(b, 1) NOT IN ('l', 's', 'z') THEN left(b, length(b) - 1)
  WHEN {_measure('b')} = 1 AND {_shape('b', 'CVC')} THEN b || 'e' ELSE b END AS w FROM s2),
s4 AS (SELECT word, CASE WHEN suffix(w, 'y') AND regexp_matches({cut(1)}, '[aeiou]') THEN {cut(1)} || 'i' ELSE w END AS w FROM s3),
s5 AS ({_swapped(DERIVED, 0).format('s4')}),
s6 AS ({_swapped(ENDINGS, 0).format('s5')}),
s7 AS (SELECT word, CASE WHEN {_measure(cut(3))} > 1 AND left(right(w, 4), 1) IN ('s', 't') THEN {cut(3)} ELSE w END AS w FROM s6 WHERE suffix(w, 'ion') AND NOT ({any_removed})
  UNION ALL {_swapped(removed, 1).format(f"(SELECT * FROM s6 WHERE NOT (suffix(w, 'ion') AND NOT ({any_removed})))")}),
s8 AS (SELECT word, CASE WHEN suffix(w, 'e') AND ({_measure(cut(1))} > 1 OR ({_measure(cut(1))} = 1 AND NOT {_shape(cut(1), 'CVC')})) THEN {cut(1)} ELSE w END AS w FROM s7)
SELECT word, CASE WHEN suffix(w, 'l') AND {_measure('w')} > 1 AND {_shape('w', 'CC')} THEN {cut(1)} ELSE w END AS stem FROM s8"""

"""Suffix-stripping stemmer with the engine's own shape rules."""

from __future__ import annotations

import re

# Suffix and replacement per step, in the order they are tried.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
DERIVED = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
ENDINGS = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ful", ""), ("ness", ""))
REMOVED = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VOWEL = re.compile("[aeiou]")


def _mask(word: str, first_y_follows_last: bool) -> str:
    """C or V per letter: y is a vowel after a letter other than a, e, i, o, u.

    A y at the start looks at the last letter when syllables are counted, and is a
    consonant when the shape of an ending reaches back to it.
    """
    plain = ["V" if c in "aeiou" else "C" for c in word]
    out = list(plain)
    for i, c in enumerate(word):
        if c == "y" and (i or first_y_follows_last) and plain[i - 1] == "C":
            out[i] = "V"
    return "".join(out)


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _mask(word, True).count("VC")


def two_consonants(word: str) -> bool:
    """Ends in any two consonants, equal or not."""
    return _mask(word, False)[-2:] == "CC"


def short_syllable(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return _mask(word, False)[-3:] == "CVC" and word[-1] not in "wxy"


def _swap(word: str, table: tuple[tuple[str, str], ...], more_than: int | None) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            return base + new if more_than is None or measure(base) > more_than else word
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    base = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x)), None)
    if base is None or not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if two_consonants(base) and not base.endswith(("l", "s", "z")):
        return base[:-1]
    return base + "e" if measure(base) == 1 and short_syllable(base) else base


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    word = _past(_swap(word, PLURALS, None))
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, DERIVED, 0), ENDINGS, 0)
    if word.endswith("ion") and not word.endswith(REMOVED):
        if measure(word[:-3]) > 1 and word[-4] in "st":
            word = word[:-3]
    else:
        word = _swap(word, tuple((x, "") for x in REMOVED), 1)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_syllable(word[:-1])):
            word = word[:-1]
    if word.endswith("l") and measure(word) > 1 and two_consonants(word):
        word = word[:-1]
    return word

"""The term grammar: text to words, numbers, amounts, dates and compounds.

A text is a list of white-space tokens. Every rule looks at the token at one place
and a few after it, and says which terms it emits and how many tokens it uses up;
the first rule that applies wins. The walk over a text is the only sequential part,
and runs in an Arrow UDF over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stem import stem

# Characters cut from both ends of a token, month names.
PUNCTUATION = "[({`)<|&~+^@*?.>;_':]/\\}!=#,\"-"
MONTHS = {
    "january": "01", "jan": "01", "february": "02", "feb": "02", "march": "03", "mar": "03", "april": "04", "apr": "04", "may": "05", "june": "06", "jun": "06",
    "july": "07", "jul": "07", "august": "08", "aug": "08", "september": "09", "sep": "09", "october": "10", "oct": "10", "november": "11", "nov": "11",
    "december": "12", "dec": "12",
}
SCALE = {"million": 1, "billion": 1_000, "trillion": 1_000_000}

_NUMBER = re.compile(r"\d[\d,]*(?:\.[\d,]*)?%?|[\d,.]*/\d+%?|(?=.*\d)[\d,%/]*\.?[\d,%/]*(?:m|bn)", re.ASCII)
_DIGITS = re.compile(r"\d+", re.ASCII)

_EMITTED = [T.StructField(n, t) for n, t in (("term", T.StringType()), ("kind", T.StringType()), ("pos", T.IntegerType()), ("word", T.StringType()))]

Emitted = tuple[str, str, str]  # term, kind (U, L, D for words), lower-case word


def clean(token: str) -> str:
    """Without punctuation at the ends; ``$`` and ``%`` stay."""
    return token.lstrip(PUNCTUATION).rstrip(PUNCTUATION)


def digits(s: str) -> bool:
    """Decimal digits only."""
    return bool(_DIGITS.fullmatch(s))


def floats(s: str) -> bool:
    """Whether Python reads it as a float."""
    try:
        float(s)
    except ValueError:
        return False
    return True


def number(s: str) -> bool:
    """A number, amount, percentage or fraction."""
    s = s.replace("$", "")
    return bool(_NUMBER.fullmatch(s)) and s.count(".") <= 1


def date_term(day: str, month: str, year: str) -> str:
    """YYYY-MM-DD, YYYY-MM or MM-DD; years under 100 are of the 1900s."""
    month = MONTHS.get(month, month)
    if year and 0 < int(year) < 100:
        year = "19" + year
    return "-".join(x for x in (year, month, day.rjust(2, "0") if day else "") if x)


def _text(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


class Walk:
    """One text being read. ``month_first`` also reads ``May 5`` and ``May 1994`` as dates."""

    def __init__(self, text: str, stop: frozenset[str], stemmed: bool, month_first: bool, memo: dict[str, str]) -> None:
        self.raw = text.split()
        self.stop, self.stemmed, self.month_first, self.memo = stop, stemmed, month_first, memo
        self.rules: tuple[Callable[[int, str], tuple[list[Emitted], int] | None], ...] = (self.compound, self.date, self.word, self.amount, self.slashes)

    def at(self, i: int) -> str:
        """The cleaned token at a place, or nothing after the end."""
        return clean(self.raw[i]) if i < len(self.raw) else ""

    def terms(self) -> Iterator[tuple[str, str, int, str]]:
        """(term, kind, position, word) of every emitted term."""
        i = 0
        while i < len(self.raw):
            token, width = self.at(i), 1
            if token[:1].isdigit():
                if len(token) > 2 and token.endswith("th"):
                    token = token[:-2]
                else:
                    token = token.rpartition(")")[2]
            if token:
                for rule in self.rules:
                    if (done := rule(i, token)) is not None:
                        for term, kind, word in done[0]:
                            yield term, kind, i, word
                        width = done[1]
                        break
            i += width

    def _word(self, w: str) -> list[Emitted]:
        low = w.lower()
        if low in self.stop:
            return []
        key = low
        if self.stemmed:
            key = self.memo.get(low)
            if key is None:
                key = self.memo[low] = stem(low)
        kind = "D" if not w[0].isupper() else "L" if w.isupper() else "U"
        return [(key, kind, low)]

    def word(self, i: int, t: str) -> tuple[list[Emitted], int] | None:
        """Letters only."""
        return (self._word(t), 1) if t.isalpha() else None

    def slashes(self, i: int, t: str) -> tuple[list[Emitted], int] | None:
        """Words joined by slashes, each on its own."""
        parts = t.split("/")
        return ([e for p in parts for e in self._word(p)], 1) if all(p.isalpha() for p in parts) else None

    def compound(self, i: int, t: str) -> tuple[list[Emitted], int] | None:
        """Hyphens, ranges, and ``between A and B``."""
        whole = lambda *x: [(y, "", "") for y in x]
        if t in ("between", "Between"):
            a, b = self.at(i + 1), self.at(i + 3)
            if i + 3 < len(self.raw) - 1 and digits(a) and digits(b):
                return whole(f"{a}-{b}", a, b), 1
            return [], 1
        if "-" not in t:
            return None
        if "--" in t:
            return [], 1
        p = t.split("-")
        if (p[0].isalpha() and floats(p[1])) or (p[1].isalpha() and floats(p[0])):
            return whole(t.lower()), 1
        if all(x.isalpha() for x in p):
            return whole(t.lower()) + [e for x in p for e in self._word(x)], 1
        if all(map(floats, p)):
            month = self.at(i + 1).lower()
            if len(p) == 2 and month in MONTHS:
                return whole(*(date_term(x, month, "") for x in p)), 2
            return whole(t, *p), 1
        if t[0] == "$" and t[1:2].isdigit() and p[1].lower() in SCALE:
            value = p[0][1:].replace(",", "")
            if value.replace(".", "", 1).isdigit():
                return whole(_text(float(value) * SCALE[p[1].lower()]) + " M Dollars"), 1
        return [], 1

    def date(self, i: int, t: str) -> tuple[list[Emitted], int] | None:
        """Day or year with a month name after it, and D.M.Y."""
        nxt = self.at(i + 1).lower()
        out = None
        if digits(t) and nxt in MONTHS and 0 < int(t) <= 2800:
            year = self.at(i + 2)
            if int(t) > 31:
                out = date_term("", nxt, t), 2
            elif digits(year) and 0 < int(year) < 2800:
                out = date_term(t, nxt, year), 3
            else:
                out = date_term(t, nxt, ""), 2
        elif self.month_first and t.lower() in MONTHS and digits(nxt) and 0 < int(nxt) <= 2800:
            out = date_term(*((nxt, t.lower(), "") if int(nxt) <= 31 else ("", t.lower(), nxt))), 2
        elif t.count(".") == 2 and all(map(digits, t.split("."))):
            out = date_term(*t.split(".")), 1
        return ([(out[0], "", "")], out[1]) if out else None

    def amount(self, i: int, t: str) -> tuple[list[Emitted], int] | None:
        """Numbers, percentages and sums of money."""
        if not number(t):
            return None
        term, width = self._amount(i, t)
        return ([(term, "", "")] if term else []), width

    def _amount(self, i: int, t: str) -> tuple[str | None, int]:
        width, fraction = 1, ""
        if "/" in self.at(i + 1):
            width, fraction = 2, " " + self.at(i + 1)
        ahead = [self.at(i + width + k) for k in range(3)]
        nxt, raw = ahead[0].lower(), t.replace("$", "")
        plain = raw.replace(",", "").removesuffix("bn").removesuffix("m")
        value = float(plain) if plain.replace(".", "").isdigit() else 0.0
        millions = lambda v: f"{_text(v)}{fraction} M Dollars"
        if "%" in t or nxt in ("percent", "percentage"):
            return raw if "%" in raw else raw + "%", width + (nxt in ("percent", "percentage"))
        if t[0] == "$":
            if nxt in SCALE:
                return millions(value * SCALE[nxt]), width + 1
            return (millions(value / 1e6) if value > 1e6 else f"{raw}{fraction} Dollars"), width
        if nxt in ("m", "bn"):
            if ahead[1].lower() == "dollars":
                return millions(value * (1000 if nxt == "bn" else 1)), width + 2
            return None, width
        if nxt == "dollars":
            return (f"{raw}{fraction} Dollars" if value < 1e6 else millions(value / 1e6)), width + 1
        if nxt in SCALE and ahead[1] == "U.S" and ahead[2].lower() == "dollars":
            return millions(value * SCALE[nxt]), width + 3
        return scaled(value, nxt, fraction), width + (nxt in SCALE or nxt == "thousand")


def scaled(value: float, word: str = "", fraction: str = "") -> str:
    """A number as thousands (K), millions (M) or billions (B)."""
    if value > 1e11 or word == "trillion":
        value = value / 1e11 if value > 1e11 else value
        return (str(int(value) * 1000) if float(value).is_integer() else str(value)) + fraction + "B"
    for limit, name, unit in ((1e9, "billion", "B"), (1e6, "million", "M"), (1e3, "thousand", "K")):
        if value > limit or word == name:
            return _text(value / limit if value > limit else value) + fraction + unit
    return str(int(value)) + fraction


def parse(text: str | None, stop: frozenset[str] = frozenset(), stemmed: bool = False, month_first: bool = False, memo: dict[str, str] | None = None) -> list[tuple[str, str, int, str]]:
    """Every emitted (term, kind, position, word) of a text; nothing for a null."""
    return list(Walk(text, stop, stemmed, month_first, {} if memo is None else memo).terms()) if text else []


def _rows(stop: frozenset[str], stemmed: bool, month_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                owner: list[int] = []
                found: list[tuple[str, str, int, str]] = []
                for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    of = parse(text, stop, stemmed, month_first, memo)
                    found += of
                    owner += [i] * len(of)
                if found:
                    at = pa.array(owner, pa.int32())
                    term, kind, pos, word = zip(*found)
                    cols = [c.take(at) for c in part.columns[:-1]]
                    cols += [pa.array(term, pa.string()), pa.array(kind, pa.string()), pa.array(pos, pa.int32()), pa.array(word, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names[:-1], "term", "kind", "pos", "word"])

    return run


def emitted(df: DataFrame, keep: list[str], text: str, stop: frozenset[str] = frozenset(), stemmed: bool = False, month_first: bool = False) -> DataFrame:
    """One row per emitted term: the columns ``keep``, then term, kind, pos, word."""
    inner = df.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*inner.schema.fields[:-1], *_EMITTED])
    return inner.mapInArrow(_rows(stop, stemmed, month_first), schema)


def stop_set(stop_words: DataFrame | None, limit: int = 20_000) -> frozenset[str]:
    """The stop words as a set; a list longer than ``limit`` is refused, as it is sent to every worker."""
    if stop_words is None:
        return frozenset()
    rows = stop_words.select(F.trim(F.col(stop_words.columns[0])).alias("w")).where("w is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} stop words")
    return frozenset(r["w"] for r in rows)


def stems(words: DataFrame, word: str) -> DataFrame:
    """Distinct words and their stems."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else stem(w))

    return words.select(word).distinct().withColumn("stem", F.pandas_udf(run, "string")(F.col(word)))

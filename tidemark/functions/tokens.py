"""Token functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.grammar import MONTHS, PUNCTUATION

_CLASS = "".join("\\" + c for c in PUNCTUATION)


def split_words(text: Column) -> Column:
    """Tokens between Unicode white space."""
    return F.filter(F.split(text, "(?U)[\\s\\x1c-\\x1f]+"), lambda t: t != "")


def letters(text: Column) -> Column:
    """Maximal runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+"), 0)


def clean_token(token: Column) -> Column:
    """Without punctuation at both ends, keeping at least one trailing character."""
    return F.regexp_replace(F.regexp_replace(token, f"^[{_CLASS}]+", ""), f"(.)[{_CLASS}]+\\z", "$1")


def is_word(token: Column) -> Column:
    """Letters only."""
    return token.rlike("^\\p{L}+\\z")


def is_number(token: Column) -> Column:
    """A number, amount, percentage or fraction."""
    t = F.regexp_replace(token, "\\$", "")
    return t.rlike("^(?:[0-9][0-9,]*(?:\\.[0-9,]*)?%?|[0-9,.]*/[0-9]+%?|[0-9,%/]*\\.?[0-9,%/]*(?:m|bn))\\z") & t.rlike("[0-9]") & ~t.rlike("\\..*\\.")


def month_number(name: Column) -> Column:
    """01 to 12, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in MONTHS.items() for x in p]), F.lower(name))


def short_population(value: Column) -> Column:
    """A population as K, M or B; blank up to a thousand."""

    def text(v: Column) -> Column:
        return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))

    huge = value / 1e11
    big = F.concat(F.when(huge == F.floor(huge), (F.floor(huge) * 1000).cast("string")).otherwise(huge.cast("string")), F.lit("B"))
    return F.when(value > 1e11, big).when(value > 1e9, F.concat(text(value / 1e9), F.lit("B"))).when(value > 1e6, F.concat(text(value / 1e6), F.lit("M"))).when(value > 1e3, F.concat(text(value / 1e3), F.lit("K"))).otherwise("")

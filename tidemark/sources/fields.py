"""Fields of a marked-up document as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.grammar import MONTHS
from tidemark.functions.tokens import _CLASS, month_number, split_words

# Markup left in texts.
MARKUP = ("CELLRULE", "TABLECELL", 'CVJ="C"', 'CHJ="C"', 'CHJ="R"', 'CHJ="L"', "TABLEROW", "ROWRULE")


def between(chunk: Column, tag: str, end: str | None = None) -> Column:
    """What stands between the first ``<tag>`` and the next ``</end>``, else blank."""
    return F.regexp_extract(chunk, f"(?s)<{tag}>(.*?)</{end or tag}>", 1)


def after(chunk: Column, tag: str) -> Column:
    """All that follows the first ``<tag>``, else blank."""
    return F.regexp_extract(chunk, f"(?s)<{tag}>(.*)\\z", 1)


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def doc_number(chunk: Column) -> Column:
    """The document's number without blanks around it."""
    return F.regexp_replace(between(chunk, "DOCNO"), "^\\s+|\\s+\\z", "")


def title(chunk: Column) -> Column:
    """TI, else HEADLINE without its tags, blanks collapsed; blank if neither is there."""
    headline = F.filter(split_words(between(chunk, "HEADLINE")), lambda t: ~t.startswith("<"))
    return F.when(F.contains(chunk, F.lit("<TI>")), _joined(split_words(between(chunk, "TI")))).otherwise(_joined(headline))


def clean_label(token: Column) -> Column:
    """Without punctuation and digits in front, and punctuation at the end."""
    return F.regexp_replace(F.regexp_replace(token, f"^[{_CLASS}\\p{{Nd}}]+", ""), f"(.)[{_CLASS}]+\\z", "$1")


def language(chunk: Column) -> Column:
    """The first word after F P=105, capitalised; ``The`` is none."""
    word = clean_label(F.coalesce(F.get(split_words(after(chunk, "F P=105")), F.lit(0)), F.lit("")))
    shown = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))
    return F.when(shown == "The", "").otherwise(shown)


def city_prefixes(chunk: Column) -> Column:
    """The lower-cased prefixes of one to four words after F P=104, shortest first."""
    words = F.slice(F.transform(split_words(after(chunk, "F P=104")), lambda t: F.lower(t)), 1, 4)
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: _joined(F.slice(words, F.lit(1), n)))).otherwise(F.array().cast("array<string>"))


def _year(token: Column) -> Column:
    y = F.regexp_replace(F.coalesce(token, F.lit("")), "[*,]+\\z", "")
    y = F.when(y.rlike("^[0-9]+\\z"), y).otherwise("")
    return F.when(y.rlike("^0*[1-9][0-9]?\\z") & (F.length(y) <= 2), F.concat(F.lit("19"), y)).otherwise(y)


def _ymd(year: Column, month: Column, day: Column) -> Column:
    day = F.regexp_replace(F.coalesce(day, F.lit("")), ",", "")
    day = F.when(F.length(day) == 1, F.concat(F.lit("0"), day)).otherwise(day)
    return F.concat_ws("-", F.when(year != "", year), month, day)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def date(chunk: Column) -> Column:
    """DATE1 or DATE as YYYY-MM-DD, MM-DD or YYYY; blank if there is none of a known shape."""
    get = lambda a, i: F.get(a, F.lit(i) if isinstance(i, int) else i)

    def date1(one: Column) -> Column:
        first, second = month_number(get(one, 0)), month_number(get(one, 1))
        year = _year(get(one, 2))
        return F.when(first.isNotNull(), _ymd(year, first, get(one, 1))).when(second.isNotNull(), _ymd(year, second, get(one, 0))).when((get(one, 0) == "000") & (get(one, 1) == "000"), year)

    def long(two: Column, at: Column) -> Column:
        return F.when(at > 0, _ymd(_year(get(two, at + 1)), month_number(get(two, at - 1)), get(two, at)))

    def date2(two: Column) -> Column:
        short = get(two, 0)
        # The month may stand anywhere in what follows, which is the whole document.
        at = F.array_position(F.transform(two, lambda t: F.lower(t).isin(*MONTHS)), True).cast("int")
        six = F.concat(F.lit("19"), F.substring(short, 1, 2), F.lit("-"), F.substring(short, 3, 2), F.lit("-"), F.substring(short, 5, 2))
        return F.when(short.rlike("^[0-9]{6}\\z"), six).otherwise(_with(at, lambda a: long(two, a)))

    found = F.when(F.contains(chunk, F.lit("<DATE1>")), _with(split_words(after(chunk, "DATE1")), date1)).when(F.contains(chunk, F.lit("<DATE>")), _with(split_words(after(chunk, "DATE")), date2))
    return F.coalesce(found, F.lit(""))


def text(chunk: Column) -> Column:
    """The document's text without markup, blanks collapsed."""
    t = F.regexp_replace(after(chunk, "TEXT"), "|".join([*MARKUP, "[<>]"]), " ")
    return _joined(split_words(t))


def documents(chunks: DataFrame) -> DataFrame:
    """One row per document of chunks (path, ord, chunk); of a repeated number the last stays.

    The last place of every number is found without the texts, which then need not be sorted.
    """
    c = F.col("chunk")
    numbered = chunks.withColumn("doc_id", doc_number(c)).where("doc_id <> ''")
    last = numbered.groupBy("doc_id").agg(F.max(F.struct("path", "ord")).alias("at")).select(F.col("at.path").alias("path"), F.col("at.ord").alias("ord"))
    kept = numbered.join(last, ["path", "ord"], "left_semi")
    return kept.select("doc_id", "path", "ord", title(c).alias("title"), language(c).alias("language"), date(c).alias("date"), city_prefixes(c).alias("city_prefixes"), text(c).alias("text"))


def with_city(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``docs`` with ``city``: the shortest prefix the gazetteer lists, first letter capital, else blank.

    The gazetteer's distinct names join the few prefixes of every document; Catalyst
    picks the join by the gazetteer's size.
    """
    places = gazetteer.select(F.lower("city").alias("place")).distinct()
    hit = docs.select("doc_id", F.posexplode("city_prefixes").alias("n", "place")).join(places, "place").groupBy("doc_id").agg(F.min_by("place", "n").alias("place"))
    named = F.concat(F.upper(F.substring("place", 1, 1)), F.substr(F.col("place"), F.lit(2)))
    return docs.join(hit, "doc_id", "left").withColumn("city", F.coalesce(named, F.lit(""))).drop("place", "city_prefixes")

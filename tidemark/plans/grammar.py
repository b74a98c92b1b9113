"""The term grammar and field extraction over texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import engine
from tidemark.functions import grammar
from tidemark.functions import tokens as tk
from tidemark.operators import index as ix
from tidemark.runtime import spread, table
from tidemark.sources import corpus, fields


def _count(df: DataFrame, text: Column, month_first: bool = False) -> DataFrame:
    """How often the grammar emits each term for the texts; equal texts are read once."""
    texts = df.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    return grammar.emitted(texts, ["times"], "text", month_first=month_first).groupBy("term").agg(F.sum("times").alias("n"))


def _by_line(*shapes: Column) -> Column:
    """One of the shapes by the line's number."""
    out = shapes[-1]
    for i, c in enumerate(shapes[:-1]):
        out = F.when(F.col("l_linenumber") % len(shapes) == i, c).otherwise(out)
    return out


def _whole(c: str) -> Column:
    return F.floor(F.col(c)).cast("bigint").cast("string")


def money_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts with a dollar sign."""
    return _count(table(spark, sf, "lineitem"), F.concat(F.lit("$"), (F.floor("l_extendedprice") * 37).cast("bigint").cast("string")))


def dollar_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts in millions and billions of dollars, in words."""
    return _count(table(spark, sf, "lineitem"), F.concat(_whole("l_quantity"), F.when(F.col("l_linenumber") % 2 == 0, " million U.S. dollars").otherwise(" bn Dollars")))


def percent_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Percentages in words."""
    return _count(table(spark, sf, "lineitem"), F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" percent")))


def magnitude_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Plain numbers as thousands and millions."""
    return _count(table(spark, sf, "orders"), (F.floor("o_totalprice") * 3).cast("bigint").cast("string"))


def range_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges with both ends."""
    return _count(table(spark, sf, "lineitem"), F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), _whole("l_quantity")))


def between_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges in words."""
    return _count(table(spark, sf, "lineitem"), F.concat(F.lit("between "), F.col("l_linenumber").cast("string"), F.lit(" and "), _whole("l_quantity"), F.lit(" units shipped")))


def hyphen_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Compounds of words, and of a word and a number."""
    return _count(table(spark, sf, "part"), F.concat_ws(" ", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))))


def slash_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Words joined by slashes."""
    return _count(table(spark, sf, "part"), F.concat(F.col("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/"))))


def date_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Full dates, days of a month and months of a year."""
    o = table(spark, sf, "orders")
    shape = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d MMMM")).otherwise(F.date_format("o_orderdate", "yyyy MMMM"))
    return _count(o, shape)


def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, Column, Column]:
    return table(spark, sf, "lineitem"), _whole("l_quantity"), F.col("l_linenumber").cast("string")


def ordinal_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinals before a month, a number behind a bracket, and ordinals that are dropped."""
    t, q, n = _lines(spark, sf)
    return _count(t, _by_line(F.concat(q, F.lit("th May")), F.concat(n, F.lit(")"), q), F.concat(q, F.lit("nd"))))


def float_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Decimals and exponents in compounds and ranges."""
    t, q, _ = _lines(spark, sf)
    return _count(t, _by_line(F.concat(F.lit("Mk-"), q, F.lit(".5")), F.concat(q, F.lit(".5-"), q, F.lit("e2"))))


def dropped_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Double hyphens and mixed compounds, of which nothing is kept."""
    t, q, n = _lines(spark, sf)
    return _count(t, F.concat(F.lit("ships--"), q, F.lit(" B-"), q, F.lit("s "), n, F.lit("x-y"), n, F.lit(" end")))


def day_range_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of days of a month, and ranges of three numbers."""
    t, q, n = _lines(spark, sf)
    return _count(t, _by_line(F.concat(n, F.lit("-"), q, F.lit(" July")), F.concat(n, F.lit("-"), q, F.lit("-"), (F.col("l_orderkey") % 10).cast("string"))))


def scaled_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Dollars with a scale, joined or not, and trillions."""
    t, q, _ = _lines(spark, sf)
    return _count(t, _by_line(F.concat(F.lit("$"), q, F.lit("-million")), F.concat(F.lit("$"), q, F.lit(" billion")), F.concat(F.lit("$"), q, F.lit(" trillion")), F.concat(q, F.lit(" trillion"))))


def dotted_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Dates with dots."""
    t, q, n = _lines(spark, sf)
    return _count(t, F.concat(q, F.lit("."), n, F.lit(".199"), n))


def month_first_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Months before a day or a year, where they are to be read so."""
    t, q, _ = _lines(spark, sf)
    return _count(t, F.concat(F.lit("May "), q), month_first=True)


def fraction_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Fractions and units behind a number, and dollars in words."""
    t, q, _ = _lines(spark, sf)
    return _count(t, _by_line(F.concat(q, F.lit(" 3/4")), F.concat(q, F.lit(" 3/4 Dollars")), F.concat(q, F.lit(" km/h")), F.concat(q, F.lit("000000 Dollars"))))


def unit_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands and billions in words and digits, percentages with the sign, amounts that end in m without dollars."""
    t, q, _ = _lines(spark, sf)
    return _count(t, _by_line(F.concat(q, F.lit(" thousand")), F.concat(q, F.lit(" billion")), F.concat(q, F.lit("000000000")), F.concat(q, F.lit("%")), F.concat(q, F.lit(" m high"))))


def grammar_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of whole documents, stop words left out."""
    stop = grammar.stop_set(table(spark, sf, "stop_words"))
    docs = spread(table(spark, sf, "documents").select("doc_id", F.lit("").alias("path"), F.col("doc_id").alias("ord"), "text"))
    return ix.dictionary(ix.occurrences(docs, stop))


def grammar_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """The same, stemmed."""
    stop = grammar.stop_set(table(spark, sf, "stop_words"))
    docs = spread(table(spark, sf, "documents").select("doc_id", F.lit("").alias("path"), F.col("doc_id").alias("ord"), "text"))
    return ix.dictionary(ix.occurrences(docs, stop, stemmed=True))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select(F.explode(tk.split_words(F.col("text"))).alias("raw"))
    return t.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select(tk.clean_token(F.col("raw")).alias("token"), "n").where("token <> ''").groupBy("token").agg(F.sum("n").alias("n"))


def clean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens without punctuation at their ends."""
    return _tokens(spark, sf)


def word_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that are words."""
    return _tokens(spark, sf).where(tk.is_word(F.col("token")))


def number_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that are numbers."""
    return _tokens(spark, sf).where(tk.is_number(F.col("token")))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Marked-up documents made from every delivery; what it lacks has no tag."""
    d = table(spark, sf, "docs").where("doc_id is not null")
    shown = lambda c, tag, end: F.when(F.col(c).rlike("\\S"), F.concat(F.lit(tag), F.col(c), F.lit(end)))
    body = F.concat_ws(
        "\n", F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id"), F.lit(" </DOCNO>")), F.concat(F.lit("<DATE1> "), F.date_format(F.col("received_at"), "d MMM yyyy"), F.lit("* </DATE1>")),
        shown("title", "<TI>  ", " </TI>"), shown("city", "<F P=104> ", " "), shown("doc_lang", "<F P=105> ", ""), F.concat(F.lit("<TEXT>\nCELLRULE <b>"), F.coalesce("title", F.lit("")), F.lit("</b>\n</TEXT>\n")),
    )
    files = d.select(F.format_string("f%012d", F.col("rec_id")).alias("path"), body.alias("body"))
    return corpus.split_chunks(files)


def sgml_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Number, title, language, date and text of marked-up documents, the last delivery of each."""
    return fields.documents(_chunks(spark, sf)).select("doc_id", "title", "language", "date", "text")


def _whole_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Marked-up documents made from every delivery, with the whole text of its story.

    What a delivery lacks has no tag. Even deliveries are written with TI and DATE1, odd
    ones with HEADLINE and DATE.
    """
    texts = table(spark, sf, "doc_text").where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    d = table(spark, sf, "docs").where("doc_id is not null").join(texts, "doc_id", "left")
    shown = lambda c, tag, end: F.when(F.col(c).rlike("\\S"), F.concat(F.lit(tag), F.col(c), F.lit(end)))
    dated = lambda tag, form, end: F.concat(F.lit(tag), F.date_format("received_at", form), F.lit(end))
    even = F.col("rec_id") % 2 == 0
    body = F.concat_ws(
        "\n", F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id"), F.lit(" </DOCNO>")),
        F.when(even, dated("<DATE1> ", "d MMM yyyy", "* </DATE1>")).otherwise(dated("<DATE> ", "EEEE, MMMM d, yyyy", " </DATE>")),
        F.when(even, shown("title", "<TI>  ", " </TI>")).otherwise(shown("title", "<HEADLINE> <H3> ", " </H3> </HEADLINE>")),
        shown("city", "<F P=104> ", " </F>"), shown("doc_lang", "<F P=105> ", " </F>"),
        F.concat(F.lit("<TEXT>\n"), F.coalesce("text", F.lit("")), F.lit("\n</TEXT>\n")),
    )
    files = d.select(F.format_string("f%012d", F.col("rec_id")).alias("path"), body.alias("body"))
    return corpus.split_chunks(files)


def sgml_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same fields of every story, whatever its last delivery lacks, with its whole text."""
    return fields.documents(_whole_chunks(spark, sf)).select("doc_id", "title", "language", "date", "text")


def doc_date(spark: SparkSession, sf: str) -> DataFrame:
    """Six-digit and long dates of marked-up documents."""
    o = table(spark, sf, "orders")
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyMMdd")).otherwise(F.concat(F.lit("Monday "), F.date_format("o_orderdate", "MMMM d, yyyy")))
    c = F.concat(F.lit("<DOCNO> "), F.col("o_orderkey").cast("string"), F.lit(" </DOCNO> <DATE> "), shown, F.lit(" </DATE>"))
    return o.select("o_orderkey", fields.date(c).alias("date"))


def doc_date1(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of the other field: month or day first, year only, and unreadable years."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.upper(F.date_format("o_orderdate", "MMM d yyyy"))).when(k == 1, F.concat(F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("*"))).when(k == 2, F.date_format("o_orderdate", "'000 000' yyyy")).otherwise(F.date_format("o_orderdate", "d MMM '9?'"))
    return o.select("o_orderkey", fields.date(F.concat(F.lit("<DOCNO> 1 </DOCNO> <DATE1> "), shown, F.lit(" </DATE1>"))).alias("date"))


def story_read(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of one story, found in the corpus by its number."""
    first = table(spark, sf, "docs").agg(F.min("doc_id")).first()[0]
    return fields.documents(engine.read_chunk(_whole_chunks(spark, sf), first)).select("doc_id", "title", "language", "date", "text")


def topics_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Topics read from query files."""
    t = table(spark, sf, "topics")
    body = F.concat(F.lit("<num> Number: "), F.col("query_id"), F.lit("\n<title> "), F.coalesce("title", F.lit("")), F.lit("\n\n<desc> Description:\n"), F.coalesce("descr", F.lit("")), F.lit("\n\n<narr> Narrative:\nnone\n"))
    return t.select(F.explode(corpus.parse_topics(body)).alias("q")).select("q.query_id", "q.title", "q.descr")


def gazetteer_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of every city name."""
    rows = table(spark, sf, "docs").where("trim(city) <> ''").select("city", F.col("desk").alias("iso2"), F.col("rec_id").alias("ord"))
    return corpus.first_places(rows)


def city_country_join(spark: SparkSession, sf: str) -> DataFrame:
    """Places with their countries."""
    places = table(spark, sf, "nation").select(F.col("n_name").alias("city"), F.col("n_regionkey").alias("iso2"))
    countries = table(spark, sf, "region").select(F.col("r_regionkey").alias("iso2"), F.col("r_name").alias("country"), F.lit("").alias("currency"), F.lit("").alias("population"))
    return corpus.gazetteer(places, countries).select("city", "country")


def city_prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    """Cities of documents by the shortest listed prefix; blank where none is listed."""
    d = table(spark, sf, "docs")
    chunk = F.concat(F.lit("<F P=104> "), F.coalesce("city", F.lit("")), F.lit(" reports today"))
    asked = d.select(F.col("rec_id").alias("doc_id"), fields.city_prefixes(chunk).alias("city_prefixes"))
    return fields.with_city(asked, table(spark, sf, "cities")).select(F.col("doc_id").alias("rec_id"), F.lower("city").alias("city"))


def population_format(spark: SparkSession, sf: str) -> DataFrame:
    """Populations in short form."""
    v = (F.floor("s_acctbal") * F.element_at(F.array(F.lit(125), F.lit(1_250_000), F.lit(12_500_000_000)), (F.col("s_suppkey") % 3 + 1).cast("int"))).cast("double")
    return table(spark, sf, "supplier").select("s_suppkey", tk.short_population(v).alias("population"))


def synonym_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Topics with synonyms added to their descriptions."""
    known = spark.createDataFrame([("loan", 1, "credit", 20000), ("loan", 2, "debt", 12000), ("bridge", 1, "span", 9000), ("bridge", 2, "crossing", 30000), ("smelter", 1, "furnace", 15000), ("smelter", 2, "foundry", 8000), ("ban", 3, "embargo", 50000)], "word string, rank int, sim_word string, score bigint")
    return corpus.expand(table(spark, sf, "topics"), known).select("query_id", "title", "descr")


QUERIES = {
    f.__name__: f
    for f in (
        money_terms, dollar_terms, percent_terms, magnitude_terms, range_terms, between_terms, hyphen_terms, slash_terms, date_terms, ordinal_terms, float_terms, dropped_terms, day_range_terms, scaled_terms, dotted_terms, month_first_terms, fraction_terms, unit_terms, grammar_terms, grammar_stemmed, clean_tokens, word_filter,
        number_filter, sgml_fields, sgml_documents, story_read, doc_date, doc_date1, topics_parse, gazetteer_first, city_country_join, city_prefix_match, population_format, synonym_expand,
    )
}

_CUT = "[" + tk._CLASS.replace("'", "''") + "]"
_TOKENS = f"""
WITH t AS (SELECT unnest(string_split_regex(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+')) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT regexp_replace(regexp_replace(t, '^{_CUT}+', ''), '(.){_CUT}+$', '\\1') AS token FROM t),
k AS (SELECT token, count(*) AS n FROM c WHERE token <> '' GROUP BY token)
"""
_SCALED = "CASE WHEN {v} % {d} = 0 THEN CAST({v} // {d} AS VARCHAR) ELSE CAST({v} / {d}e0 AS VARCHAR) END"
_TALLY = "SELECT term, count(*) AS n FROM ({}) GROUP BY term"
_Q = "CAST(floor(l_quantity) AS BIGINT)"
_LINE = f"(SELECT {_Q} AS q, l_linenumber AS n, l_orderkey AS k FROM lineitem)"


def _tally(terms: str) -> str:
    """The count of every term of a list that is made from a line."""
    return f"SELECT term, count(*) AS n FROM (SELECT unnest({terms}) AS term FROM {_LINE}) WHERE term IS NOT NULL GROUP BY term"


_STORY = r"""
WITH texts AS (
  SELECT doc_id, array_to_string(list_filter(string_split_regex(max(text), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> ''), ' ') AS text
  FROM doc_text GROUP BY doc_id)
SELECT doc_id, coalesce(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS title, CASE WHEN w IS NULL OR lower(w) = 'the' THEN '' ELSE upper(w[1]) || lower(w[2:]) END AS language,
  coalesce(strftime(received_at, '%Y-%m-%d'), '') AS date, {text} AS text
FROM (SELECT *, string_split_regex(trim(doc_lang), '\s+')[1] AS w, row_number() OVER (PARTITION BY doc_id ORDER BY rec_id DESC) AS k FROM docs WHERE doc_id IS NOT NULL)
LEFT JOIN texts USING (doc_id) WHERE k = 1"""

ORACLE = {
    "money_terms": _TALLY.format("SELECT CASE WHEN v > 1000000 THEN " + _SCALED.format(v="v", d=1000000) + " || ' M Dollars' ELSE v || ' Dollars' END AS term FROM (SELECT CAST(floor(l_extendedprice) AS BIGINT) * 37 AS v FROM lineitem)"),
    "dollar_terms": _TALLY.format(f"SELECT {_Q} * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 1000 END) || ' M Dollars' AS term FROM lineitem"),
    "percent_terms": _TALLY.format("SELECT CAST(round(l_discount * 100) AS INTEGER) || '%' AS term FROM lineitem"),
    "magnitude_terms": _TALLY.format("SELECT CASE WHEN v > 1000000 THEN " + _SCALED.format(v="v", d=1000000) + " || 'M' WHEN v > 1000 THEN " + _SCALED.format(v="v", d=1000) + " || 'K' ELSE CAST(v AS VARCHAR) END AS term FROM (SELECT CAST(floor(o_totalprice) AS BIGINT) * 3 AS v FROM orders)"),
    "range_terms": _TALLY.format(f"SELECT unnest([l_linenumber || '-' || {_Q}, CAST(l_linenumber AS VARCHAR), CAST({_Q} AS VARCHAR)]) AS term FROM lineitem"),
    "between_terms": _TALLY.format(f"SELECT unnest([l_linenumber || '-' || {_Q}, CAST(l_linenumber AS VARCHAR), CAST({_Q} AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST({_Q} AS VARCHAR), 'and', 'units', 'shipped']) AS term FROM lineitem"),
    "hyphen_terms": _TALLY.format("SELECT unnest(list_concat([replace(p_name, ' ', '-'), replace(lower(p_brand), '#', '-')], string_split(p_name, ' '))) AS term FROM part"),
    "slash_terms": _TALLY.format("SELECT lower(unnest(list_concat([p_type], string_split(p_name, ' ')))) AS term FROM part"),
    "date_terms": _TALLY.format("SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS term FROM orders"),
    "clean_tokens": _TOKENS + "SELECT token, n FROM k",
    "word_filter": _TOKENS + r"SELECT token, n FROM k WHERE regexp_full_match(token, '\p{L}+')",
    "number_filter": _TOKENS + r"SELECT token, n FROM (SELECT token, n, replace(token, '$', '') AS t FROM k) WHERE regexp_full_match(t, '[0-9][0-9,]*(\.[0-9,]*)?%?|[0-9,.]*/[0-9]+%?|[0-9,%/]*\.?[0-9,%/]*(m|bn)') AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '\..*\.')",
    "sgml_fields": _STORY.replace("{text}", r"rtrim('b ' || coalesce(trim(regexp_replace(title, '\s+', ' ', 'g')), '')) || ' /b'"),
    "sgml_documents": _STORY.replace("{text}", "coalesce(text, '')"),
    "story_read": _STORY.replace("{text}", "coalesce(text, '')") + " AND doc_id = (SELECT min(doc_id) FROM docs)",
    "doc_date1": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders",
    "ordinal_terms": _tally("[CASE n % 3 WHEN 0 THEN CASE WHEN q > 31 THEN '19' || q || '-05' ELSE '05-' || lpad(CAST(q AS VARCHAR), 2, '0') END WHEN 1 THEN CAST(q AS VARCHAR) END]"),
    "float_terms": _tally("CASE WHEN n % 2 = 0 THEN ['mk-' || q || '.5'] ELSE [q || '.5-' || q || 'e2', q || '.5', q || 'e2'] END"),
    "dropped_terms": "SELECT 'end' AS term, count(*) AS n FROM lineitem",
    "day_range_terms": _tally("CASE WHEN n % 2 = 0 THEN ['07-0' || n, '07-' || lpad(CAST(q AS VARCHAR), 2, '0')] ELSE [n || '-' || q || '-' || k % 10, CAST(n AS VARCHAR), CAST(q AS VARCHAR), CAST(k % 10 AS VARCHAR)] END"),
    "scaled_terms": _tally("[CASE n % 4 WHEN 0 THEN q || ' M Dollars' WHEN 1 THEN q * 1000 || ' M Dollars' WHEN 2 THEN q * 1000000 || ' M Dollars' ELSE q * 1000 || 'B' END]"),
    "dotted_terms": _tally("['199' || n || '-' || n || '-' || lpad(CAST(q AS VARCHAR), 2, '0')]"),
    "month_first_terms": _tally("[CASE WHEN q > 31 THEN '19' || q || '-05' ELSE '05-' || lpad(CAST(q AS VARCHAR), 2, '0') END]"),
    "fraction_terms": _tally("[CASE n % 4 WHEN 0 THEN q || ' 3/4' WHEN 1 THEN q || ' 3/4 Dollars' WHEN 2 THEN q || ' km/h' ELSE q || ' M Dollars' END]"),
    "unit_terms": _tally("CASE n % 5 WHEN 0 THEN [q || 'K'] WHEN 1 THEN [q || 'B'] WHEN 2 THEN [CASE WHEN q = 1 THEN '1000M' ELSE q || 'B' END] WHEN 3 THEN [q || '%'] ELSE ['m', 'high'] END"),
    "doc_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '19' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders",
    "topics_parse": r"SELECT query_id, trim(regexp_replace(coalesce(title, ''), ' +', ' ', 'g')) AS title, trim(regexp_replace(coalesce(descr, ''), ' +', ' ', 'g')) AS descr FROM topics",
    "gazetteer_first": "SELECT city, iso2 FROM (SELECT lower(city) AS city, desk AS iso2, row_number() OVER (PARTITION BY lower(city) ORDER BY rec_id) AS k FROM docs WHERE trim(city) <> '') WHERE k = 1",
    "city_country_join": "SELECT n_name AS city, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey",
    "city_prefix_match": r"""
WITH w AS (SELECT rec_id, list_filter(string_split_regex(lower(coalesce(city, '') || ' reports today'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM docs),
p AS (SELECT rec_id, n, array_to_string(w[:n], ' ') AS city FROM w, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE n <= len(w))
SELECT rec_id, coalesce(arg_min(city, n) FILTER (city IN (SELECT lower(city) FROM cities)), '') AS city FROM p GROUP BY rec_id""",
    "population_format": "SELECT s_suppkey, CASE WHEN v > 100000000000 THEN CASE WHEN v % 100000000000 = 0 THEN CAST(v // 100000000000 * 1000 AS VARCHAR) ELSE CAST(v / 100000000000e0 AS VARCHAR) END || 'B' WHEN v > 1000000000 THEN " + _SCALED.format(v="v", d=1000000000) + " || 'B' WHEN v > 1000000 THEN " + _SCALED.format(v="v", d=1000000) + " || 'M' WHEN v > 1000 THEN " + _SCALED.format(v="v", d=1000) + " || 'K' ELSE '' END AS population FROM (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) * (CASE s_suppkey % 3 WHEN 0 THEN 125 WHEN 1 THEN 1250000 ELSE 12500000000 END) AS v FROM supplier)",
    "synonym_expand": r"""
WITH s(word, more) AS (VALUES ('loan', 'credit debt'), ('smelter', 'furnace')),
w AS (SELECT query_id, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM (SELECT query_id, string_split_regex(title, '\s+') AS w FROM topics WHERE title IS NOT NULL)),
m AS (SELECT query_id, string_agg(more, ' ' ORDER BY place) AS more FROM w JOIN s USING (word) GROUP BY query_id)
SELECT query_id, title, nullif(concat_ws(' ', descr, more), '') AS descr FROM topics LEFT JOIN m USING (query_id)""",
}

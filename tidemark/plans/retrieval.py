"""Index building and ranked retrieval over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import engine
from tidemark.engine import facet
from tidemark.functions.grammar import stems
from tidemark.operators import index as ix
from tidemark.operators import ranking as rk
from tidemark.plans.stem_sql import stem_sql
from tidemark.runtime import register_written, shared_dir, spread, table
from tidemark.sources import sinks
from tidemark.streaming import incremental

#: The flagship query: its title and what more is said of it.
TITLE, REST = "harbour railway", "prices copper"


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per word of letters, as in the index: doc_id, path, ord, term, kind, pos, word."""
    t = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit("\\p{L}+"), 0)).alias("pos", "t"))
    kind = F.when(~F.col("t").rlike("^\\p{Lu}"), "D").when(F.col("t").rlike("^\\p{Lu}+\\z"), "L").otherwise("U")
    return t.select("doc_id", F.lit("").alias("path"), F.col("doc_id").alias("ord"), F.lower("t").alias("term"), kind.alias("kind"), "pos", F.lower("t").alias("word"))


def _occ(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return ix.postings(_occ(spark, sf))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("city"))
    return d.join(ix.doc_stats(_posts(spark, sf)), "doc_id", "left").na.fill({"max_tf": 1, "length": 0, "n_terms": 0})


def _spoken(c: str) -> Column:
    """Only the words of a text: what is read of it in SQL too."""
    return F.regexp_replace(F.col(c), "[^\\p{L}]+", " ")


#: Indexes built in this session, by folder of the tables.
_BUILT: dict[tuple[str, str], str] = {}


def _build(spark: SparkSession, sf: str) -> engine.Index:
    """The words of all documents as a stored index; every seventh document is of the city Estuary, the others of their source."""
    city = F.when(F.col("doc_id") % 7 == 0, "Estuary").otherwise(F.col("source"))
    docs = table(spark, sf, "documents").select("doc_id", F.lit("").alias("path"), F.col("doc_id").alias("ord"), _spoken("text").alias("text"), F.lit("").alias("title"), F.col("lang").alias("language"), city.alias("city"), F.lit("").alias("date"))
    places = docs.select("city").where("city is not null").distinct().select("city", F.lit("").alias("country"), F.lit("").alias("currency"), F.lit("").alias("population"))
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    register_written(spark, folder)
    built = engine.build(spread(docs), places, table(spark, sf, "stop_words"), folder)
    _BUILT[spark.sparkContext.applicationId, sf] = folder
    return built


def _index(spark: SparkSession, sf: str) -> engine.Index:
    """The stored index of the documents, built when it is first asked for."""
    folder = _BUILT.get((spark.sparkContext.applicationId, sf))
    return engine.load(spark, folder) if folder else _build(spark, sf)


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("0", TITLE, REST)], "query_id string, title string, descr string")


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topics").select("query_id", _spoken("title").alias("title"), _spoken("descr").alias("descr"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("score", "bm25", "cosine") else F.col(c) for c in df.columns])


def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """A new index of all documents: how many documents and terms it has."""
    return _build(spark, sf).summary().select("documents", "terms")


def index_record(spark: SparkSession, sf: str) -> DataFrame:
    """The stored records of three documents, each read by its number."""
    ix_ = _index(spark, sf)
    one, two, three = (ix_.read_doc(i).select("doc_id", "language", "city", F.col("length").cast("bigint").alias("length")) for i in (1, 7, 50))
    return one.unionByName(two).unionByName(three)


def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents for the flagship query, from the stored index."""
    return _rounded(_index(spark, sf).search_topics(_asked(spark)))


def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 of every candidate."""
    index = _index(spark, sf)
    return _rounded(index.scored(index.weighted(_asked(spark)))).select("doc_id", "bm25")


def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of every candidate."""
    index = _index(spark, sf)
    return _rounded(index.scored(index.weighted(_asked(spark)))).select("doc_id", "cosine")


def search_lang_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship query in two languages' labels."""
    return _rounded(_index(spark, sf).search_topics(_asked(spark), languages=["en", "English"]))


def search_city_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship query for documents of two places or naming one of them."""
    return _rounded(_index(spark, sf).search_topics(_asked(spark), cities=["harbor_wire", "Estuary"]))


def query_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted terms of all topics."""
    return _index(spark, sf).weighted(_topics(spark, sf)).select("query_id", "term", "weight")


def batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of every topic, in one plan."""
    return _rounded(_index(spark, sf).search_topics(_topics(spark, sf)))


def result_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The topics that have results."""
    return _index(spark, sf).answered(_topics(spark, sf))


def run_file(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship results as a run file, written under its name and read back."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}.txt"
    register_written(spark, path)
    sinks.write_run(ranked_search(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def postings_tf(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency of every term in every document."""
    return _posts(spark, sf).select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"))


def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per term."""
    return ix.dictionary(_occ(spark, sf)).select("term", "df")


def coll_freq(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences per term."""
    return ix.dictionary(_occ(spark, sf)).select("term", "cf")


def term_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary: how terms are shown, which in capitals, with both frequencies."""
    return ix.dictionary(_occ(spark, sf)).select("term", "display", "is_entity", "cf", "df")


def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Length, distinct terms and highest frequency of every document."""
    return _docs(spark, sf).select("doc_id", F.col("max_tf").cast("bigint").alias("max_tf"), "length", "n_terms")


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Number and mean length of all documents."""
    return _docs(spark, sf).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("length"), 6).alias("mean_length"))


def posting_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Spilled partial postings merged, with the true document frequency."""
    raw = table(spark, sf, "postings").select(F.trim("term").alias("spelling"), "doc_id", "tf").distinct()
    merged = ix.merge_postings(raw.select(F.lower("spelling").alias("term"), "doc_id", F.col("tf").cast("bigint").alias("tf")))
    return merged.select("term", "doc_id", "tf", "df")


def doc_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The last delivery of every story."""
    d = table(spark, sf, "docs").select("doc_id", "rec_id", "received_at", "city", "title", "doc_len")
    return ix.latest(d, "doc_id", ["received_at", "rec_id"]).select("doc_id", "rec_id", "city", "title", "doc_len")


def term_bags(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's bag of terms, written out."""
    bags = ix.term_bags(_posts(spark, sf))
    pairs = F.transform(F.array_sort(F.map_entries("terms")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return bags.select("doc_id", F.cardinality("terms").cast("bigint").alias("n_terms"), F.array_join(pairs, " ").alias("bag"))


def entities_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five most frequent entities of every document."""
    occ = _occ(spark, sf)
    return ix.entities(ix.postings(occ), ix.dictionary(occ)).select("doc_id", "rank", "term", F.col("tf").cast("bigint").alias("tf"))


def stopword_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Term counts without stop words."""
    stop = table(spark, sf, "stop_words").select(F.col("word").alias("term"))
    return _occ(spark, sf).join(stop, "term", "left_anti").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _story_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_text").groupBy("doc_id").agg(F.max("text").alias("text"))


def city_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Where stories name a city of one word: how often and where first and last."""
    m = ix.city_mentions(_words(_story_texts(spark, sf), "doc_id", "text"), table(spark, sf, "cities"))
    return m.select("city", "doc_id", F.size("positions").cast("bigint").alias("n"), F.array_min("positions").cast("bigint").alias("first"), F.array_max("positions").cast("bigint").alias("last"))


def corpus_cities(spark: SparkSession, sf: str) -> DataFrame:
    """Gazetteer rows of cities that stories come from."""
    return ix.corpus_cities(table(spark, sf, "docs"), table(spark, sf, "cities")).select("city", "country", "currency", "population")


def facets_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language labels there are."""
    return facet(table(spark, sf, "documents"), "lang")


def facets_city(spark: SparkSession, sf: str) -> DataFrame:
    """The cities there are."""
    return facet(table(spark, sf, "docs"), "city")


def query_list(spark: SparkSession, sf: str) -> DataFrame:
    """The queries there are."""
    return table(spark, sf, "topics").select("query_id").distinct().orderBy("query_id")


def stem_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Stems of all distinct words."""
    return stems(_occ(spark, sf), "term")


def streamed_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the stories' words, indexed as a stream and merged; of a story's deliveries one counts."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    register_written(spark, base)
    path = f"{sf}/doc_text.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads a folder; the table is one file in it or a folder of parts.
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path if _is_folder(spark, path) else f"{sf}/doc_text*.parquet")
    docs = source.select("doc_id", F.lit("").alias("path"), F.lit(0).alias("ord"), _spoken("text").alias("text"))
    incremental.index_stream(docs, f"{base}/stream", f"{base}/state").awaitTermination()
    return incremental.merged(spark, f"{base}/stream").select("term", "doc_id", "tf", "df")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {
    f.__name__: f
    for f in (
        index_build, index_record, result_queries, ranked_search, bm25_scores, cosine_scores, search_lang_filter, search_city_filter, query_weights, batch_topk, run_file, postings_tf, doc_freq, coll_freq,
        term_dictionary, doc_stats, corpus_stats, posting_merge, doc_merge, term_bags, entities_top5, stopword_anti, city_mentions, corpus_cities, facets_language,
        facets_city, query_list, stem_terms, streamed_postings,
    )
}

_WORDS = r"""
t AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS t FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w FROM documents WHERE text IS NOT NULL)),
occ AS (SELECT doc_id, pos, lower(t) AS term, CASE WHEN NOT regexp_matches(t, '^\p{Lu}') THEN 'D' WHEN regexp_full_match(t, '\p{Lu}+') THEN 'L' ELSE 'U' END AS kind FROM t),
post AS (SELECT term, doc_id, count(*) AS tf, min(pos) AS first_pos FROM occ GROUP BY term, doc_id),
stat AS (SELECT doc_id, greatest(1, max(tf)) AS max_tf, sum(tf) AS length, count(*) AS n_terms FROM post GROUP BY doc_id),
about AS (SELECT d.doc_id, d.lang, d.source, CAST(coalesce(max_tf, 1) AS BIGINT) AS max_tf, CAST(coalesce(length, 0) AS BIGINT) AS length, CAST(coalesce(n_terms, 0) AS BIGINT) AS n_terms FROM documents d LEFT JOIN stat USING (doc_id))"""
_DICT = """,
dict AS (SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df, NOT bool_or(kind = 'D') AND arg_min(kind, (doc_id, pos)) = 'U' AS is_entity FROM occ GROUP BY term)"""
_SCORED = """,
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(length AS DOUBLE)) AS mean FROM about),
f AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
qn AS (SELECT query_id, sqrt(sum(weight * weight)) AS q_norm FROM q JOIN f USING (term) GROUP BY query_id),
r AS (SELECT query_id, doc_id, weight,
  log2((n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * length / mean)) AS b,
  log2(n / df) * tf / max_tf AS w
  FROM post JOIN f USING (term) JOIN q USING (term) JOIN about USING (doc_id), n),
s AS (SELECT query_id, doc_id, sum(b) AS bm25, coalesce(sum(w * weight) / nullif(sqrt(sum(w * w)) * any_value(q_norm), 0), 0) AS cosine FROM r JOIN qn USING (query_id) GROUP BY query_id, doc_id),
z AS (SELECT query_id, doc_id, round(bm25, 6) AS bm25, round(cosine, 6) AS cosine, round(0.7e0 * bm25 + 0.3e0 * cosine, 6) AS score FROM s)"""
_WEIGHTS = [(t, 1.0) for t in TITLE.split()] + [(t, 0.5) for t in REST.split()]
_Q = "WITH q(query_id, term, weight) AS (VALUES " + ", ".join(f"('0', '{t}', {w}e0)" for t, w in _WEIGHTS) + "),"
#: What a search sees: words that are no stop words; ``between`` is read as the start of a range.
_SEEN = _WORDS.replace("FROM t),", "FROM t WHERE t NOT IN ('between', 'Between') AND lower(t) NOT IN (SELECT word FROM stop_words)),").replace("d.source,", "CASE WHEN d.doc_id % 7 = 0 THEN 'Estuary' ELSE d.source END AS city,")
_TOP = """
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z {where}) WHERE rank <= 50"""
_TOPIC = r"""WITH raw AS (
  SELECT query_id, unnest(regexp_extract_all(title, '\p{L}+')) AS t, 1e0 AS weight FROM topics
  UNION ALL SELECT query_id, unnest(regexp_extract_all(descr, '\p{L}+')), 0.5e0 FROM topics),
q AS (SELECT query_id, lower(t) AS term, max(weight) AS weight FROM raw WHERE t NOT IN ('between', 'Between') AND lower(t) NOT IN (SELECT word FROM stop_words) GROUP BY query_id, lower(t))"""

ORACLE = {
    "ranked_search": _Q + _SEEN + _SCORED + _TOP.format(where=""),
    "bm25_scores": _Q + _SEEN + _SCORED + " SELECT doc_id, bm25 FROM z",
    "cosine_scores": _Q + _SEEN + _SCORED + " SELECT doc_id, cosine FROM z",
    "search_lang_filter": _Q + _SEEN + _SCORED + _TOP.format(where="WHERE doc_id IN (SELECT doc_id FROM about WHERE lang IN ('en', 'English'))"),
    "search_city_filter": _Q + _SEEN + _SCORED + _TOP.format(where="WHERE doc_id IN (SELECT doc_id FROM about WHERE city IN ('harbor_wire', 'Estuary')) OR doc_id IN (SELECT doc_id FROM occ WHERE term = 'estuary')"),
    "query_weights": _TOPIC + " SELECT query_id, term, weight FROM q",
    "batch_topk": _TOPIC + "," + _SEEN + _SCORED + _TOP.format(where=""),
    "result_queries": _TOPIC + "," + _SEEN + " SELECT DISTINCT query_id FROM q WHERE term IN (SELECT term FROM post)",
    "index_build": "WITH " + _SEEN + " SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT term) FROM post) AS terms",
    "index_record": "WITH " + _SEEN + " SELECT doc_id, lang AS language, city, length FROM about WHERE doc_id IN (1, 7, 50)",
    "run_file": _Q + _SEEN + _SCORED + " SELECT '0 0 ' || doc_id || ' 1  2 mt' AS line FROM (" + _TOP.format(where="") + ")",
    "postings_tf": "WITH " + _WORDS + " SELECT term, doc_id, tf FROM post",
    "doc_freq": "WITH " + _WORDS + _DICT + " SELECT term, df FROM dict",
    "coll_freq": "WITH " + _WORDS + _DICT + " SELECT term, cf FROM dict",
    "term_dictionary": "WITH " + _WORDS + _DICT + " SELECT term, CASE WHEN is_entity THEN upper(replace(term, 'ß', 'ss')) ELSE term END AS display, is_entity, cf, df FROM dict",
    "doc_stats": "WITH " + _WORDS + " SELECT doc_id, max_tf, length, n_terms FROM about",
    "corpus_stats": "WITH " + _WORDS + " SELECT count(*) AS n_docs, round(avg(CAST(length AS DOUBLE)), 6) AS mean_length FROM about",
    "posting_merge": """
WITH raw AS (SELECT DISTINCT trim(term) AS spelling, doc_id, tf FROM postings),
whole AS (SELECT lower(spelling) AS term, doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM raw GROUP BY 1, 2)
SELECT term, doc_id, tf, count(*) OVER (PARTITION BY term) AS df FROM whole""",
    "doc_merge": "SELECT doc_id, rec_id, city, title, doc_len FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY received_at DESC, rec_id DESC) AS k FROM docs) WHERE k = 1",
    "term_bags": "WITH " + _WORDS + " SELECT doc_id, count(*) AS n_terms, string_agg(term || '=' || tf, ' ' ORDER BY term) AS bag FROM post GROUP BY doc_id",
    "entities_top5": "WITH " + _WORDS + _DICT + """
SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, tf FROM (
  SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, first_pos DESC, term) AS rank FROM post WHERE term IN (SELECT term FROM dict WHERE is_entity)) WHERE rank <= 5""",
    "stopword_anti": "WITH " + _WORDS + " SELECT term, count(*) AS n FROM occ WHERE term NOT IN (SELECT word FROM stop_words) GROUP BY term",
    "city_mentions": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(max(text)), '\p{L}+') AS w FROM doc_text GROUP BY doc_id),
t AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS city FROM d)
SELECT city, doc_id, count(*) AS n, min(pos) AS "first", max(pos) AS "last" FROM t WHERE city IN (SELECT lower(city) FROM cities) GROUP BY city, doc_id""",
    "corpus_cities": "SELECT lower(city) AS city, country, currency, population FROM cities WHERE lower(city) IN (SELECT lower(city) FROM docs)",
    "facets_language": "SELECT DISTINCT lang FROM documents WHERE trim(lang) <> '' AND NOT regexp_full_match(lang, '[0-9]+')",
    "facets_city": "SELECT DISTINCT city FROM docs WHERE trim(city) <> '' AND NOT regexp_full_match(city, '[0-9]+')",
    "query_list": "SELECT DISTINCT query_id FROM topics",
    "stem_terms": "SELECT word AS term, stem FROM (" + stem_sql("(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents)") + ")",
    "streamed_postings": r"""
WITH d AS (SELECT doc_id, max(text) AS text FROM doc_text GROUP BY doc_id),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS t FROM d),
p AS (SELECT lower(t) AS term, doc_id, count(*) AS tf FROM w WHERE t NOT IN ('between', 'Between') GROUP BY 1, 2)
SELECT term, doc_id, tf, count(*) OVER (PARTITION BY term) AS df FROM p""",
}

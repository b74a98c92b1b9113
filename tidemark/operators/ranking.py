"""Ranked retrieval: query weights, candidates, filters, BM25 with cosine, top results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import grammar
from tidemark.operators import batch

# Fixed values of the ranking formula.
BM25_WEIGHT, COSINE_WEIGHT, K, B, SMOOTH, DEPTH = 0.7, 0.3, 1.2, 0.75, 0.5, 50


def weights(title_terms: DataFrame, other_terms: DataFrame) -> DataFrame:
    """query_id, term, weight: 1 for terms of the title, 0.5 for those only in the rest."""
    t = title_terms.select("query_id", F.lower("term").alias("term"), F.lit(1.0).alias("weight"))
    o = other_terms.select("query_id", F.lower("term").alias("term"), F.lit(0.5).alias("weight"))
    return t.unionByName(o).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def query_terms(queries: DataFrame, stop: frozenset[str] = frozenset(), stemmed: bool = False, month_first: bool = False) -> DataFrame:
    """Weighted terms of queries (query_id, title, descr), read like texts."""

    def of(c: str) -> DataFrame:
        return grammar.emitted(queries, ["query_id"], c, stop, stemmed, month_first).select("query_id", "term")

    return weights(of("title"), of("descr"))


def allowed(docs: DataFrame, mentions: DataFrame | None = None, languages: list[str] | None = None, cities: list[str] | None = None) -> DataFrame:
    """The documents of a language and of a city, by their own city or by a mention in the text; no list is no filter."""
    if languages:
        docs = docs.where(F.col("language").isin(languages))
    if cities:
        own = F.col("city").isin(cities)
        if mentions is None:
            return docs.where(own)
        named = mentions.where(F.col("city").isin([c.lower() for c in cities])).select("doc_id", F.lit(True).alias("_named")).distinct()
        docs = docs.join(named, "doc_id", "left").where(own | F.col("_named").isNotNull()).drop("_named")
    return docs


def bm25(n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    """One term's part of the score; negative for terms in more than half of the documents."""
    return F.log2((n - df + SMOOTH) / (df + SMOOTH)) * tf * (K + 1) / (tf + K * (1 - B + B * length / mean))


def cosine_weight(n: Column, df: Column, tf: Column, max_tf: Column) -> Column:
    """A term's weight in a document."""
    return F.log2(n / df) * tf / max_tf


def entries(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings with all that a search needs: key (the lower-cased term), doc_id, tf, df, length, max_tf.

    Made once when an index is built, so that a search joins nothing but its own terms.
    """
    whole = posts.groupBy(F.lower("term").alias("key"), "doc_id").agg(F.sum("tf").cast("double").alias("tf"))
    df = posts.select(F.lower("term").alias("key"), "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("df"))
    about = docs.select("doc_id", F.col("length").cast("double").alias("length"), F.col("max_tf").cast("double").alias("max_tf"))
    return whole.join(df, "key").join(about, "doc_id").select("key", "doc_id", "tf", "df", "length", "max_tf")


def statistics(docs: DataFrame) -> DataFrame:
    """Number and mean length of the whole collection, one row."""
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean"))


def scores(qterms: DataFrame, posts: DataFrame, docs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, bm25, cosine and score of every document with a query term, from plain postings (term, doc_id, tf).

    ``docs`` (doc_id, length, max_tf) is the whole collection, which the statistics
    are taken over; ``candidates`` restricts the results. The postings are cut down to
    the queries' terms before anything is shuffled.
    """
    wanted = qterms.select("term").distinct()
    some = posts.withColumn("term", F.lower("term")).join(wanted, "term", "left_semi")
    return score_entries(qterms, entries(some, docs), statistics(docs), candidates)


def score_entries(qterms: DataFrame, stored: DataFrame, stats: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """The same from ``entries``: one pass over those of the queries' terms, one exchange for the sums per document."""
    found = stored.join(qterms.withColumnRenamed("term", "key"), "key")
    known = found.groupBy("query_id", "key").agg(F.max("weight").alias("weight"))
    norm = known.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("q_norm"))
    if candidates is not None:
        found = found.join(candidates.select("doc_id"), "doc_id", "left_semi")
    whole = stats.select(F.struct("n", "mean").alias("s")).scalar()
    n, mean = whole.getField("n"), whole.getField("mean")
    rows = found.select("query_id", "doc_id", "weight", bm25(n, F.col("df"), F.col("tf"), F.col("length"), mean).alias("b"), cosine_weight(n, F.col("df"), F.col("tf"), F.col("max_tf")).alias("w"))
    sums = rows.groupBy("query_id", "doc_id").agg(F.sum("b").alias("bm25"), F.sum(F.col("w") * F.col("weight")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("d_norm"))
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.col("d_norm") * F.col("q_norm")), F.lit(0.0))
    scored = sums.join(norm, "query_id").select("query_id", "doc_id", "bm25", cosine.alias("cosine"))
    return scored.withColumn("score", BM25_WEIGHT * F.col("bm25") + COSINE_WEIGHT * F.col("cosine"))


def top(scored: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The best documents of every query; scores equal to six places go by doc_id, so that the order of a sum never decides.

    The window is cut per partition before its shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def top_batch(qterms: DataFrame, stored: DataFrame, stats: DataFrame, queries: int, depth: int = DEPTH, candidates: DataFrame | None = None) -> DataFrame:
    """``top`` of ``score_entries`` for many queries, without a row for each query, term and document."""
    return top(batch.best(qterms, stored, stats, queries, depth, (BM25_WEIGHT, COSINE_WEIGHT, K, B, SMOOTH), candidates), depth)


def run_lines(results: DataFrame) -> DataFrame:
    """Results as lines of a run file, in order."""
    return results.orderBy("query_id", "rank").select(F.format_string("%s 0 %s 1  2 mt", F.col("query_id").cast("string"), F.col("doc_id").cast("string")).alias("value"))

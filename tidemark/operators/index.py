"""Building an index: term occurrences, postings, dictionary, document statistics, city mentions, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import grammar
from tidemark.runtime import materialize


def occurrences(docs: DataFrame, stop: frozenset[str] = frozenset(), stemmed: bool = False, month_first: bool = False) -> DataFrame:
    """One row per emitted term: doc_id, path, ord, term, kind, pos, word.

    ``docs`` has doc_id, path, ord and text; (path, ord) is the corpus order.
    """
    return grammar.emitted(docs, ["doc_id", "path", "ord"], "text", stop, stemmed, month_first)


def postings(occ: DataFrame) -> DataFrame:
    """term, doc_id, tf and the first position; hot terms are pre-aggregated within their documents."""
    return occ.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.min("pos").alias("first_pos"))


def merge_postings(parts: DataFrame) -> DataFrame:
    """Partial postings (term, doc_id, tf) of several chunks as one, with the true df.

    The merged rows are written down once and feed both the counts and the result.
    """
    whole = materialize(parts.groupBy("term", "doc_id").agg(F.sum("tf").cast("bigint").alias("tf")), "merged")
    df = whole.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return whole.join(df, "term")


def dictionary(occ: DataFrame) -> DataFrame:
    """term, display, is_entity, cf, df.

    A word is displayed in capitals if it never occurs in lower case and its first
    occurrence in corpus order is capitalised but not all capitals.
    """
    where = F.struct("path", "ord", "pos")
    per = occ.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max(F.col("kind") == "D").alias("low"), F.min_by("kind", where).alias("kind"), F.min(where).alias("at"))
    per = per.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"), F.max("low").alias("low"), F.min_by("kind", "at").alias("kind"))
    entity = (F.col("kind") == "U") & ~F.col("low")
    return per.select("term", F.when(entity, F.upper("term")).otherwise(F.col("term")).alias("display"), entity.alias("is_entity"), "cf", "df")


def doc_stats(posts: DataFrame) -> DataFrame:
    """doc_id, max_tf (at least 1), length, n_terms."""
    return posts.groupBy("doc_id").agg(F.greatest(F.lit(1), F.max("tf")).cast("int").alias("max_tf"), F.sum("tf").cast("bigint").alias("length"), F.count(F.lit(1)).cast("bigint").alias("n_terms"))


def term_bags(posts: DataFrame) -> DataFrame:
    """doc_id and its map of term to tf."""
    return posts.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "tf")))).alias("terms"))


def latest(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last in the given order; with a total order the choice is fixed."""
    rest = [c for c in docs.columns if c != key]
    picked = docs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(key, "r.*").select(docs.columns)


def city_mentions(occ: DataFrame, cities: DataFrame) -> DataFrame:
    """city, doc_id, positions: single words of texts that are a listed city, stop words left out."""
    names = cities.select(F.lower("city").alias("word")).distinct()
    return occ.where("word <> ''").join(names, "word", "left_semi").groupBy(F.col("word").alias("city"), "doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def corpus_cities(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The gazetteer rows of cities that documents come from."""
    used = docs.select(F.lower("city").alias("city")).where("city <> ''").distinct()
    return gazetteer.withColumn("city", F.lower("city")).join(used, "city", "left_semi")


def entities(posts: DataFrame, terms: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, rank, term, tf: the most frequent entities of every document; of equal ones the later first occurrence leads."""
    named = terms.where("is_entity").select("term")
    w = Window.partitionBy("doc_id").orderBy(F.col("tf").desc(), F.col("first_pos").desc(), "term")
    e = posts.where(F.col("term").rlike("^\\p{L}+\\z")).join(named, "term", "left_semi")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("doc_id", "rank", "term", "tf")

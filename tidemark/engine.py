"""The engine's actions: build, load, search, facets, entities, export, reset."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import grammar
from tidemark.operators import index as ix
from tidemark.operators import ranking as rk
from tidemark.runtime import materialize
from tidemark.sources import corpus, fields
from tidemark.sources import sinks

TABLES = ("docs", "postings", "entries", "stats", "terms", "cities", "mentions", "entities", "stop_words")
#: Distinct terms of one query that are pushed down to the scan of the entries; a longer one is joined.
PUSHED_TERMS = 1_000
#: From so many queries on, the documents meet all queries in slices instead of being joined with each.
BATCH_QUERIES = 100


@dataclass
class Index:
    """The tables of one index; all are read lazily."""

    spark: SparkSession
    docs: DataFrame
    postings: DataFrame
    entries: DataFrame
    stats: DataFrame
    terms: DataFrame
    cities: DataFrame
    mentions: DataFrame
    entities: DataFrame
    stop_words: DataFrame
    stem: bool = False
    month_first: bool = False

    def languages(self) -> DataFrame:
        """The languages there are, sorted, without blanks and numbers."""
        return facet(self.docs, "language")

    def city_names(self) -> DataFrame:
        """The documents' cities, sorted."""
        return facet(self.docs, "city")

    def search(self, text: str, **options: object) -> DataFrame:
        """The best documents for one query."""
        return self.search_topics(corpus.ad_hoc(self.spark, text), **options)

    def weighted(self, topics: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
        """query_id, term, weight of topics (query_id, title, descr), read like documents."""
        if synonyms is not None:
            topics = corpus.expand(topics, synonyms)
        return rk.query_terms(topics, grammar.stop_set(self.stop_words), self.stem, self.month_first)

    def scored(self, qterms: DataFrame, languages: list[str] | None = None, cities: list[str] | None = None) -> DataFrame:
        """bm25, cosine and score of every document with a query term, from the stored entries and statistics.

        The entries are sorted by term: of a few terms, which are read first and
        pushed down to the scan, only the row groups that hold them are read.
        """
        some = [r[0] for r in qterms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        stored = self.entries.where(F.col("key").isin(some)) if len(some) <= PUSHED_TERMS else self.entries
        only = rk.allowed(self.docs, self.mentions, languages, cities) if languages or cities else None
        return rk.score_entries(qterms, stored, self.stats, only)

    def search_topics(self, topics: DataFrame, languages: list[str] | None = None, cities: list[str] | None = None, synonyms: DataFrame | None = None, depth: int = rk.DEPTH) -> DataFrame:
        """The best documents of every topic (query_id, title, descr), in one plan."""
        qterms = self.weighted(topics, synonyms)
        queries = topics.select("query_id").limit(BATCH_QUERIES).count()
        if queries < BATCH_QUERIES:
            ranked = rk.top(self.scored(qterms, languages, cities), depth)
        else:
            only = rk.allowed(self.docs, self.mentions, languages, cities) if languages or cities else None
            ranked = rk.top_batch(materialize(qterms, "asked"), self.entries, self.stats, topics.count(), depth, only)
        return ranked.select("query_id", "rank", "doc_id", "score")

    def answered(self, topics: DataFrame) -> DataFrame:
        """The topics that have results, sorted: those with a term that any document has; nothing is scored for it."""
        return query_list(self.weighted(topics).join(self.entries.select(F.col("key").alias("term")).distinct(), "term", "left_semi"))

    def key_entities(self, doc_id: str) -> DataFrame:
        """The key entities of one document."""
        return self.entities.where(F.col("doc_id") == doc_id).orderBy("rank")

    def summary(self) -> DataFrame:
        """How many documents and terms there are, and how many seconds the build took."""
        return self.stats.select(F.col("n").cast("bigint").alias("documents"), "terms", "seconds")

    def read_doc(self, doc_id: str) -> DataFrame:
        """The record of one document; the table is sorted by number, so the filter prunes its files and row groups."""
        return self.docs.where(F.col("doc_id") == doc_id)


def query_list(results: DataFrame) -> DataFrame:
    """The queries there are results for, sorted."""
    return results.select("query_id").distinct().orderBy("query_id")


def read_chunk(raw: DataFrame, doc_id: str) -> DataFrame:
    """The raw chunk of one document of a corpus; a plain search for the number goes before the exact field."""
    return raw.where(F.contains("chunk", F.lit(doc_id)) & (fields.doc_number(F.col("chunk")) == doc_id))


def facet(docs: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, sorted, without blanks and numbers."""
    c = F.col(column)
    return docs.select(c).where(c.isNotNull() & (F.trim(c) != "") & ~c.rlike("^[0-9]+\\z")).distinct().orderBy(column)


def build(docs: DataFrame, gazetteer: DataFrame, stop_words: DataFrame, folder: str, stem: bool = False, month_first: bool = False) -> Index:
    """Index documents (doc_id, path, ord, text, title, language, city, date) into a folder.

    The term occurrences are written once and feed all other tables.
    """
    began = time.monotonic()
    stop = grammar.stop_set(stop_words)
    occ = sinks.write(ix.occurrences(docs, stop, stem, month_first), folder, "occurrences", stem)
    return assemble(docs, occ, gazetteer, stop_words, folder, stem, month_first, began)


def assemble(docs: DataFrame, occ: DataFrame, gazetteer: DataFrame, stop_words: DataFrame, folder: str, stem: bool = False, month_first: bool = False, began: float | None = None) -> Index:
    """All tables of an index from the documents and their term occurrences."""
    began = time.monotonic() if began is None else began
    spark = docs.sparkSession
    posts = sinks.write(ix.postings(occ), folder, "postings", stem, by="term")
    terms = sinks.write(ix.dictionary(occ), folder, "terms", stem, by="term")
    about = docs.drop("text").join(ix.doc_stats(posts), "doc_id", "left").na.fill({"max_tf": 1, "length": 0, "n_terms": 0})
    about = sinks.write(about, folder, "docs", stem, by="doc_id")
    sinks.write(rk.entries(posts, about), folder, "entries", stem, by="key")
    places = sinks.write(ix.corpus_cities(docs, gazetteer), folder, "cities", stem, by="city")
    sinks.write(ix.city_mentions(occ, places), folder, "mentions", stem, by="city")
    sinks.write(ix.entities(posts, terms), folder, "entities", stem)
    sinks.write(stop_words.select(F.col(stop_words.columns[0]).alias("word")), folder, "stop_words", stem)
    n_terms = terms.agg(F.count(F.lit(1))).scalar()
    sinks.write(rk.statistics(about).select("*", n_terms.alias("terms"), F.lit(time.monotonic() - began).alias("seconds")), folder, "stats", stem)
    return load(spark, folder, stem, month_first)


def build_corpus(spark: SparkSession, corpus_folder: str, gazetteer: DataFrame, folder: str, stem: bool = False) -> Index:
    """Index a corpus of marked-up files, with the stop words that lie beside them."""
    docs = fields.with_city(fields.documents(corpus.read_corpus(spark, corpus_folder)), gazetteer)
    return build(docs, gazetteer, corpus.read_stop_words(spark, f"{corpus_folder}/stop_words.txt"), folder, stem)


def load(spark: SparkSession, folder: str, stem: bool = False, month_first: bool = False) -> Index:
    """An index that was built before."""
    return Index(spark, *[sinks.read(spark, folder, t, stem) for t in TABLES], stem=stem, month_first=month_first)


def drop(spark: SparkSession, folder: str, stem: bool = False) -> None:
    """Delete the index of one stem mode; its stop words stay."""
    for t in (*TABLES, "occurrences"):
        if t != "stop_words":
            sinks.remove(spark, folder, t, stem)

"""Indexing a stream of documents.

Every micro-batch writes its documents and their term occurrences into folders of its
own number, so a batch that runs again after a failure replaces what it left. A
document delivered again, in the same batch or a later one, replaces the earlier
record: only the last batch that holds it counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import engine
from tidemark.operators import index as ix


def index_stream(docs: DataFrame, folder: str, checkpoint: str, stop: frozenset[str] = frozenset(), stemmed: bool = False) -> StreamingQuery:
    """Append the documents (doc_id, path, ord, text, other fields) of a stream and their occurrences under ``folder``."""

    def put(batch: DataFrame, number: int) -> None:
        last = f"{folder}/docs/batch={number}"
        ix.latest(batch, "doc_id", ["path", "ord", "text"]).write.mode("overwrite").parquet(last)
        kept = batch.sparkSession.read.schema(batch.schema).parquet(last)
        ix.occurrences(kept, stop, stemmed).write.mode("overwrite").parquet(f"{folder}/occurrences/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The last record of every document, and the occurrences of these records."""
    docs = spark.read.parquet(f"{folder}/docs")
    last = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    kept = ["doc_id", "batch"]
    return docs.join(last, kept, "left_semi").drop("batch"), spark.read.parquet(f"{folder}/occurrences").join(last, kept, "left_semi").drop("batch")


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The postings of the last records as one, with df."""
    return ix.merge_postings(ix.postings(current(spark, folder)[1]).select("term", "doc_id", "tf"))


def publish(spark: SparkSession, folder: str, gazetteer: DataFrame, stop_words: DataFrame, to: str, stem: bool = False) -> engine.Index:
    """A searchable index of all that was streamed in so far: dictionary, documents, mentions and the rest."""
    docs, occ = current(spark, folder)
    return engine.assemble(docs, occ, gazetteer, stop_words, to, stem)

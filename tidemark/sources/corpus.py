"""Readers: corpora, stop words, gazetteers, topics, synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.tokens import short_population


def split_chunks(files: DataFrame) -> DataFrame:
    """(path, ord, chunk) from files (path, body): cut at the closing TEXT tag, without what follows the last."""
    return files.select("path", F.split("body", "</TEXT>", -1).alias("parts")).select("path", F.posexplode(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("ord", "chunk"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' chunks of a corpus folder, read as Latin-1; the stop-word file is not a document."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(~F.col("path").endswith("/stop_words.txt")).select("path", F.decode("content", "ISO-8859-1").alias("body"))
    return split_chunks(files)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).distinct()


def first_places(rows: DataFrame) -> DataFrame:
    """The first row of every city name (city, iso2, ord), lower-cased."""
    return rows.select(F.lower("city").alias("city"), "iso2", "ord").groupBy("city").agg(F.min_by("iso2", "ord").alias("iso2"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """City and country code from the second and sixth column of a quoted CSV file with a header, first row per city."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    c = raw.columns
    rows = raw.select(F.col(f"`{c[1]}`").alias("city"), F.col(f"`{c[5]}`").alias("iso2"), F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("ord"))
    return first_places(rows)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """iso2, country, currency and short population from JSON records."""
    schema = "alpha2Code string, name string, population double, currencies array<struct<code: string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(F.col("alpha2Code").alias("iso2"), F.col("name").alias("country"), F.get("currencies", F.lit(0))["code"].alias("currency"), short_population(F.col("population")).alias("population"))


def gazetteer(places: DataFrame, countries: DataFrame) -> DataFrame:
    """city, country, currency, population."""
    return places.join(countries, "iso2").select("city", "country", "currency", "population")


def parse_topics(body: Column) -> Column:
    """Topics of a whole query file as an array of (query_id, title, descr)."""
    flat = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "\\R", " "), " +", " "))
    every = lambda p: F.regexp_extract_all(body, F.lit(f"(?s){p}"), 1)
    rows = F.arrays_zip(every("Number:(.*?)<title>").alias("n"), every("<title>(.*?)<desc>").alias("t"), every("<desc>(.*?)<narr>").alias("d"))
    return F.transform(rows, lambda r: F.struct(F.regexp_replace(r["n"], "\\s", "").alias("query_id"), flat(r["t"]).alias("title"), flat(F.replace(r["d"], F.lit("Description:"), F.lit(""))).alias("descr")))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """query_id, title, descr of a query file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(parse_topics(F.col("value"))).alias("q")).select("q.*")


def ad_hoc(spark: SparkSession, text: str) -> DataFrame:
    """A single query under the id 0."""
    return spark.createDataFrame([("0", text, None)], "query_id string, title string, descr string")


def expand(queries: DataFrame, synonyms: DataFrame, least: int = 10_000, per_word: int = 2) -> DataFrame:
    """``queries`` with synonyms of the title's words added to the description.

    ``synonyms`` has word, rank (from 1), sim_word and score. Of each word the first
    ``per_word`` are taken in rank order, up to the first with a score under ``least``.
    """
    w = Window.partitionBy("word").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    good = synonyms.where(F.col("rank") <= per_word).withColumn("low", F.min("score").over(w)).where(F.col("low") >= least)
    words = queries.select("query_id", F.posexplode(F.split("title", "\\s+")).alias("at", "word"))
    more = words.join(good, "word").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "rank", "sim_word"))).alias("s")).select("query_id", F.array_join("s.sim_word", " ").alias("more"))
    return queries.join(more, "query_id", "left").withColumn("descr", F.nullif(F.concat_ws(" ", F.col("descr"), F.col("more")), F.lit(""))).drop("more")

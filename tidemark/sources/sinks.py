"""Index tables and run files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranking import run_lines


def _path(folder: str, name: str, stem: bool) -> str:
    return f"{folder.rstrip('/')}/{name}/stem={str(stem).lower()}"


def write(df: DataFrame, folder: str, name: str, stem: bool = False, by: str | None = None) -> DataFrame:
    """Write an index table and read it back; ``by`` sorts it in ranges so that lookups prune files by their bounds."""
    if by:
        df = df.repartitionByRange(F.col(by)).sortWithinPartitions(by)
    df.write.mode("overwrite").parquet(_path(folder, name, stem))
    return df.sparkSession.read.schema(df.schema).parquet(_path(folder, name, stem))


def read(spark: SparkSession, folder: str, name: str, stem: bool = False) -> DataFrame:
    """An index table."""
    return spark.read.parquet(_path(folder, name, stem))


def remove(spark: SparkSession, folder: str, name: str, stem: bool = False) -> None:
    """Delete an index table of one stem mode, wherever it lies."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_path(folder, name, stem))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_run(results: DataFrame, path: str, query_id: str | None = None) -> None:
    """Write the run lines of all queries, or of one, as one text file of that name.

    A run has at most a few lines per query. They are written in parts beside the
    file, put together without passing through the driver's Python, and moved there.
    """
    rows = results if query_id is None else results.where(F.col("query_id") == query_id)
    parts = f"{path.rstrip('/')}.parts"
    run_lines(rows).coalesce(1).write.mode("overwrite").text(parts)
    spark = results.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    (part,) = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    fs.delete(target, True)
    fs.rename(part, target)
    fs.delete(folder, True)

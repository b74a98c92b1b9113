"""Table access and fault-tolerant materialisation."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, dealt out over all of them.

    Only for plans without a shuffle, in front of work that costs much more than moving
    its input; a scan with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def range_parts(df: DataFrame) -> int:
    """Partitions for a range exchange of ``df``: about the advisory size each, at least the session's shuffle partitions.

    The size is Catalyst's estimate from the files read, so nothing is run for it;
    rows take about twice the bytes of their Parquet file. Without an estimate (no
    file behind the plan) the session's number holds.
    """
    conf = df.sparkSession.conf
    least = max(int(conf.get("spark.sql.shuffle.partitions")), 1)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes").lower()).groups()
    target = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    return least if size > 1 << 50 else max(least, min(100_000, -(-2 * size // target)))


#: The folder of sessions that name none, by application; and the tables written, to be deleted at exit.
_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where a session that runs on one machine (master ``local``) names none, as in
    tests, a temporary local folder is created and used for the rest of the
    application; on a cluster that is an error, as executors couldn't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master}")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            register_written(spark, _OWN[app])
        named = _OWN[app]
    return named.rstrip("/")


def register_written(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's process ends."""
    if not _WRITTEN:
        atexit.register(_delete_written)
    _WRITTEN.append((spark.sparkContext._jvm, path))


def _delete_written() -> None:
    for jvm, path in reversed(_WRITTEN):
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        except Exception:  # the gateway is gone: what is left is the cluster's to clean
            return


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage with data every executor can reach again, so a lost executor
    costs a re-read and never a wrong or partial result. Columns keep their names,
    types and order. The table is deleted when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    register_written(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column in ``taken`` has it (ignoring case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name

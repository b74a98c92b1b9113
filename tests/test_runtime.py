"""Materialised tables: the shared folder, names and types, deletion at exit."""

import subprocess
import sys
from pathlib import Path

import pytest

from tidemark import runtime

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
b = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
spark = b.config("spark.checkpoint.dir", {folder!r}).getOrCreate()
from tidemark import runtime
df = runtime.materialize(spark.range(5).select("id", F.array("id").alias("a b")), "t")
assert df.columns == ["id", "a b"] and df.count() == 5
assert runtime.shared_dir(spark) == {folder!r}
class Unset:
    sparkContext = spark.sparkContext
    class conf:
        get = staticmethod(lambda key, default: default)
own = runtime.shared_dir(Unset)
assert own.startswith("file://") and own == runtime.shared_dir(Unset)
print("OWN", own)
"""


def test_shared_folder_and_cleaning(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, folder=f"file://{tmp_path}")], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    own = out.stdout.split("OWN file://")[1].strip()
    assert not Path(own).exists() and not list(tmp_path.glob("tidemark-*"))


def test_cluster_without_a_shared_folder_is_refused(spark):
    class Cluster:
        class sparkContext:
            applicationId, master = "app", "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Cluster)


def test_range_partitions_follow_the_size(spark, tmp_path):
    spark.range(200_000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert runtime.range_parts(df) == least
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        assert runtime.range_parts(df) > 2 * least
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)

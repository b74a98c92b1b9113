"""Exact running sums inside groups, without bringing any group into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import materialize, range_parts


def _running(n_cols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        none = object()
        last, total, tail = none, 0, None
        names = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            names = [*b.schema.names, "_pid", "_run", "_end"]
            g = b.column(0)
            codes = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            change = np.zeros(n, dtype=bool)
            change[1:] = codes[1:] != codes[:-1]
            first = g[0].as_py()
            carry = total if last is not none and last == first else 0
            v = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            cum = np.cumsum(v)
            start = np.concatenate([[0], np.flatnonzero(change)])
            base = np.where(start > 0, cum[start - 1], 0)
            run_no = np.cumsum(change)
            before = cum - v - base[run_no] + np.where(run_no == 0, carry, 0)
            last, total = g[n - 1].as_py(), int(before[-1] + v[-1])
            tail = b.slice(n - 1, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(before), pa.nulls(n, pa.int64())], names=names)
        if tail is not None:
            cols = [tail.column(0), *[pa.nulls(1, t) for t in tail.schema.types[1:]], pa.array([pid], pa.int32()), pa.nulls(1, pa.int64()), pa.array([total], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows before in the same group.

    The rows are range-partitioned and sorted on (group, order); every partition sums
    its rows, and the totals of the group each partition ends with (one row per
    partition) are prefix-summed into offsets. Null groups form a group, a null value
    counts as 0. There are as many ``partitions`` as the data's size asks for.
    """
    rest = [c for c in df.columns if c not in (group, value)]
    inner = df.select(F.col(group), F.coalesce(value, F.lit(0)).cast("bigint").alias(value), *rest)
    keys = [F.col(group).asc_nulls_first(), *[F.col(o) for o in order]]
    ranged = inner.repartitionByRange(partitions or range_parts(df), *keys).sortWithinPartitions(*keys)
    fields = [T.StructField(f.name, f.dataType, True) for f in inner.schema.fields]
    schema = T.StructType([*fields, T.StructField("_pid", T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField("_end", T.LongType())])
    done = materialize(ranged.mapInArrow(_running(len(fields)), schema), "running")
    ends = done.where(F.col("_end").isNotNull())
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    # One row per partition: the unpartitioned window and the broadcast are bounded by the partition count.
    offset = ends.select(F.col(group).alias("_g"), F.lead("_pid").over(Window.orderBy("_pid")).alias("_at"), F.sum("_end").over(w).alias("_off"))
    rows = done.where(F.col("_end").isNull())
    joined = rows.join(F.broadcast(offset), (F.col("_pid") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.select(*df.columns, (F.col("_run") + F.coalesce("_off", F.lit(0))).alias(out))

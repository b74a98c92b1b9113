"""Top N items within every group, by a global range-partitioned sort.

The rows are range-partitioned and sorted on (group, score descending, identifier),
so a group with a third of all rows is spread over as many sort partitions as its
size asks for and never meets in one task. One streaming pass over the sorted
partitions numbers the rows of each group inside its partition and counts the group
a partition ends with; the prefix sums of these counts (at most one per partition)
turn the local numbers into exact global positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import fresh, materialize, range_parts


def best_scores(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """One row per (group, item) with its highest finite score.

    Null, NaN and infinite scores do not count; an item without any finite score
    disappears. Rows with a null group or item are kept as groups or items of their
    own. Exact duplicates and repeated scorings collapse before any sort, with
    partial aggregation on the map side. The result has exactly the three columns.
    """
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    return df.where(finite).groupBy(group, item).agg(F.max(s + F.lit(0.0)).alias(score))


def _number(n_groups: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        none = object()
        last: object = none
        tail, seen = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            change = np.zeros(n, dtype=bool)
            for i in range(n_groups):
                codes = b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            first = tuple(b.column(i)[0].as_py() for i in range(n_groups))
            change[0] = last is none or first != last
            start = np.flatnonzero(change)
            run_no = np.cumsum(change) - 1
            where = np.arange(n)
            pos = np.where(run_no < 0, where + seen + 1, where - (start[run_no] if len(start) else 0) + 1)
            last = tuple(b.column(i)[n - 1].as_py() for i in range(n_groups))
            tail = b.slice(n - 1, 1)
            seen = int(pos[-1])
            keep = pa.array(np.flatnonzero(pos <= limit))
            if len(keep):
                cols = [c.take(keep) for c in b.columns]
                m = len(keep)
                cols += [pa.array(np.full(m, pid, dtype=np.int32)), pa.array(pos[pos <= limit].astype(np.int64)), pa.nulls(m, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "_pid", "_pos", "_cnt"])
        if tail is not None:
            cols = [tail.column(i) if i < n_groups else pa.nulls(1, tail.schema.types[i]) for i in range(tail.num_columns)]
            cols += [pa.array([pid], pa.int32()), pa.nulls(1, pa.int64()), pa.array([seen], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*tail.schema.names, "_pid", "_pos", "_cnt"])

    return run


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank_no", partitions: int | None = None) -> DataFrame:
    """The first ``n`` rows of every group in the given order, with their position.

    ``order`` must be total over the rows that matter (score, then identifier); rows
    equal in all of it are distinct rows and take successive positions. Null group
    values form a group. All columns of ``df`` are kept, also ones named like the
    helpers; ``rank`` is added as int and, if ``df`` has such a column, lengthened
    by ``_``. The sort has ``partitions`` partitions, by default as many as the data's
    size asks for. Groups smaller than ``n`` come out whole; an empty table gives an
    empty result; ``n`` below 1 gives none.
    """
    rank = fresh(rank, df.columns)
    names = df.columns
    rest = [c for c in names if c not in group]
    inner = df.select([F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group)] + [F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(rest)] + [o.alias(f"o{i}") for i, o in enumerate(_keys(order))])
    gs = [f"g{i}" for i in range(len(group))]
    keys = [F.col(g).asc_nulls_first() for g in gs] + [_direct(F.col(f"o{i}"), o) for i, o in enumerate(order)]
    ranged = inner.repartitionByRange(partitions or range_parts(df), *keys)
    kept = ranged.sortWithinPartitions(*keys).drop(*[f"o{i}" for i in range(len(order))])
    fields = [T.StructField(f.name, f.dataType, True) for f in kept.schema.fields]
    schema = T.StructType([*fields, T.StructField("_pid", T.IntegerType()), T.StructField("_pos", T.LongType()), T.StructField("_cnt", T.LongType())])
    numbered = materialize(kept.mapInArrow(_number(len(group), n), schema), "topn")

    ends = numbered.where(F.col("_cnt").isNotNull())
    same = Window.partitionBy(*gs).orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    # One row per sort partition, so the single-partition window and the broadcast are bounded by the partition count.
    offset = ends.select(*[F.col(g).alias(f"e{g}") for g in gs], F.lead("_pid").over(Window.orderBy("_pid")).alias("_at"), F.sum("_cnt").over(same).alias("_off"))
    rows = numbered.where(F.col("_cnt").isNull())
    on = F.col("_pid") == F.col("_at")
    for g in gs:
        on = on & F.col(g).eqNullSafe(F.col(f"e{g}"))
    place = F.col("_pos") + F.coalesce("_off", F.lit(0))
    back = {**{c: f"g{i}" for i, c in enumerate(group)}, **{c: f"v{i}" for i, c in enumerate(rest)}}
    return rows.join(F.broadcast(offset), on, "left").where(place <= n).select(*[F.col(back[c]).alias(c) for c in names], place.cast("int").alias(rank))


def _keys(order: list[Column]) -> list[Column]:
    return [o.key if isinstance(o, Desc) else o for o in order]


def _direct(c: Column, o) -> Column:
    return c.desc_nulls_last() if isinstance(o, Desc) else c.asc_nulls_last()


class Desc:
    """Marks an order key as descending, nulls last."""

    def __init__(self, key: Column) -> None:
        self.key = key

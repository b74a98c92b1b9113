"""Filling containers of fixed capacity: best-fit decreasing with a segment tree.

The items are written down once, which numbers their rows, and dealt into shards of a
bounded number of tokens by a hash of row and identifier, so that a repeated identifier
is spread too; every shard is packed on its own, so no task sees more than its shard
and the number of containers that end up partly empty is at most a few per shard.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialize

#: Tokens packed by one task for one capacity.
SHARD_TOKENS = 4_000_000
#: Rows of the table of capacities, which are parameters.
MOST_SPECS = 1_000


class OpenBins:
    """Open containers by remaining capacity, in a segment tree over the capacities."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, (capacity + 1 - 1).bit_length())
        self.size = self.size if self.size > capacity else self.size * 2
        self.any = bytearray(2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def push(self, remaining: int, bin_no: int) -> None:
        """Open a container with this much room."""
        held = self.bins.setdefault(remaining, [])
        held.append(bin_no)
        if len(held) == 1:
            i = remaining + self.size
            while i and not self.any[i]:
                self.any[i] = 1
                i >>= 1

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (remaining, container) with the least room of at least ``need``."""
        tree, i = self.any, need + self.size
        if not tree[i]:
            while i > 1 and not (i & 1 == 0 and tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        remaining = i - self.size
        held = self.bins[remaining]
        bin_no = held.pop()
        if not held:
            while i and not (i < self.size and (tree[2 * i] or tree[2 * i + 1])):
                tree[i] = 0
                i >>= 1
        return remaining, bin_no


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The container of every item (sizes in any order, each from 1 to capacity) and the number of containers."""
    where = [0] * len(sizes)
    tree, n = OpenBins(capacity), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.pop_tightest(sizes[i])
        if found is None:
            found = capacity, n
            n += 1
        left = found[0] - sizes[i]
        where[i] = found[1]
        if left:
            tree.push(left, found[1])
    return where, n


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "item", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity"].iloc[0])
    pdf["bin"], _ = best_fit_decreasing(pdf["n_tokens"].tolist(), capacity)
    return pdf


def pack(items: DataFrame, item: str, size: str, specs: DataFrame, spec: str = "spec_id", capacity: str = "capacity", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Containers for every row of ``specs``: one row each, with all they hold.

    ``items`` has an identifier and a size in tokens; rows with a null or
    non-positive size are left out, repeated rows are items of their own. An item
    larger than the capacity is cut into pieces that fill a container each, and its
    rest is packed like an item; no other item is divided. Specs with a null or
    non-positive capacity give nothing; each spec id should occur once; more than
    MOST_SPECS rows are refused.

    The same evaluation always has the same containers and identifiers, as they are
    made from the rows as written.

    Columns: spec_id, container_id (unique within the spec), capacity, n_items, used,
    unused, items: array of (item, piece_no from 0, start, n_tokens), start counting
    tokens of the item.
    """
    kept = materialize(items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{size}`").cast("bigint").alias("n")).where("n > 0").withColumn("row", F.monotonically_increasing_id()), "sizes")
    total = kept.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    wanted = specs.select(F.col(f"`{spec}`").alias("spec_id"), F.col(f"`{capacity}`").cast("bigint").alias("capacity")).where("capacity > 0").limit(MOST_SPECS + 1)
    sid, listed = wanted.schema["spec_id"].dataType, wanted.collect()
    if len(listed) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} capacities")
    # Every item is wanted once by every spec: the result has that size.
    choices = [F.struct(F.lit(r["spec_id"]).cast(sid).alias("spec_id"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in listed]
    choices = F.array(*choices) if choices else F.array().cast(f"array<struct<spec_id: {sid.simpleString()}, capacity: bigint>>")
    each = kept.select("row", "item", "n", F.explode(choices).alias("c")).select("row", "item", "n", "c.spec_id", "c.capacity")
    whole = F.floor(F.col("n") / F.col("capacity"))
    full = each.where(F.col("n") >= F.col("capacity")).select("spec_id", "capacity", "row", "item", F.explode(F.sequence(F.lit(0), whole.cast("int") - 1)).alias("piece_no"))
    full = full.select("spec_id", F.concat_ws("-", F.lit("full"), "row", "piece_no").alias("container_id"), "capacity", F.lit(1).alias("n_items"), F.col("capacity").alias("used"), F.lit(0).cast("bigint").alias("unused"), F.array(F.struct("item", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start"), F.col("capacity").alias("n_tokens"))).alias("items"))
    rest = each.select("spec_id", "capacity", "item", whole.cast("int").alias("piece_no"), (whole * F.col("capacity")).cast("bigint").alias("start"), (F.col("n") % F.col("capacity")).alias("n_tokens"), F.pmod(F.xxhash64("item", "row", F.lit("deal")), F.lit(shards)).cast("int").alias("shard")).where("n_tokens > 0")
    kind = rest.schema["item"].dataType.simpleString()
    schema = f"spec_id {sid.simpleString()}, capacity bigint, item {kind}, piece_no int, start bigint, n_tokens bigint, shard int, bin bigint"
    packed = rest.groupBy("spec_id", "shard").applyInPandas(_pack, schema)
    used = F.sum("n_tokens")
    mixed = packed.groupBy("spec_id", "shard", "bin").agg(F.first("capacity").alias("capacity"), F.count(F.lit(1)).cast("int").alias("n_items"), used.alias("used"), (F.first("capacity") - used).alias("unused"), F.sort_array(F.collect_list(F.struct("item", "piece_no", "start", "n_tokens"))).alias("items"))
    mixed = mixed.select("spec_id", F.concat_ws("-", "shard", "bin").alias("container_id"), "capacity", "n_items", "used", "unused", "items")
    return mixed.unionByName(full)

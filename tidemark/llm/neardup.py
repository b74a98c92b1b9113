"""Near-duplicate texts by ball hashing of min-hash fingerprints.

Every fingerprint is a short string of symbols (min-hashes of the text's shingles).
It emits all variants inside its ball: the fingerprint with RADIUS symbols masked.
Two fingerprints whose symbols differ in at most RADIUS places meet in a common
variant, whichever the places are. Pairs that collide are screened by size and by a
bit sketch where they are made, deduplicated and verified exactly on the whole
shingle sets, which are made again from the words of the few texts that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialize

#: Symbols of a fingerprint, how many are masked, and fingerprints of a text.
SYMBOLS, RADIUS, TABLES = 5, 1, 12
#: Min-hashes that give two bits each to a text's sketch, by which colliding pairs are screened.
SKETCH = 64
#: Bits of a variant's key; chance meetings fall to the screen.
KEY_BITS = 32
#: Rows and words worked on at a time: a row's number and 52 bits of a hash share a word.
ROWS, WORDS = 4096, 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_HASH = np.uint64((1 << 52) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(c: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}]+"), 0)


def _parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded rows and words; a longer text is a slice of its own."""
    off = b.column(column).offsets.to_numpy().astype(np.int64)
    lo = 0
    while lo < b.num_rows:
        hi = int(np.searchsorted(off, off[lo] + WORDS, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + ROWS, b.num_rows)
        yield b.slice(lo, hi - lo)
        lo = hi


def shingle_sets(col: pa.ListArray, width: int) -> np.ndarray:
    """The distinct shingles of every row, given its words' hashes, as sorted (row << 52 | hash)."""
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint32).astype(np.uint64)
    n = len(flat) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = _mix(h * _M + flat[k : k + n] + np.uint64(k + 1))
    row = np.repeat(np.arange(len(col)), np.diff(off))[:n]
    inside = np.arange(n) + width <= (off[1:] - off[0])[row]
    s = np.sort((row[inside].astype(np.uint64) << np.uint64(52)) | (h[inside] & _HASH))
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _prints(width: int, used: int, seed: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a, b, c = (rng.integers(1, 2**32, max(used, SKETCH), dtype=np.uint32) | np.uint32(1) for _ in range(3))
        for batch in batches:
            for part in _parts(batch, 1):
                s = shingle_sets(part.column(1), width)
                if not len(s):
                    continue
                row = (s >> np.uint64(52)).astype(np.int64)
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                n = np.diff(np.append(start, len(s)))
                m = _mix(s & _HASH)
                sums = [np.add.reduceat(x, start).view(np.int64) for x in (m, _mix(m ^ _M))]
                lo, hi = m.astype(np.uint32), (m >> np.uint64(32)).astype(np.uint32)
                sig = np.empty((len(start), len(a)), dtype=np.uint32)
                for j in range(len(a)):
                    x = lo * a[j]
                    x += hi * b[j]
                    x ^= x >> np.uint32(15)
                    x *= c[j]
                    sig[:, j] = np.minimum.reduceat(x, start)
                sig = (sig ^ (sig >> np.uint32(13))) * np.uint32(0x85EBCA6B)  # the bits of a minimum aren't even, those of its hash are
                sig ^= sig >> np.uint32(16)
                two = ((sig[:, :SKETCH] >> np.uint32(16)) & np.uint32(3)).astype(np.uint64) << (np.uint64(2) * (np.arange(SKETCH, dtype=np.uint64) % np.uint64(32)))
                sketch = [np.bitwise_or.reduce(two[:, k : k + 32], axis=1).view(np.int64) for k in (0, 32)]
                marks = sig[:, :used].astype(np.uint16).view(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32) * used), pa.array(marks.reshape(-1)))
                some = part.take(pa.array(row[start]))
                cols = [some.column(0), some.column(1), pa.array(n.astype(np.int32)), *map(pa.array, sums), *map(pa.array, sketch), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "words", "n", "h1", "h2", "s1", "s2", "marks"])

    return run


def _verified(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                a, b = (shingle_sets(part.column(k), width) for k in (2, 3))
                both = np.sort(np.concatenate([a, b]))
                count = lambda s: np.bincount((s >> np.uint64(52)).astype(np.int64), minlength=part.num_rows)
                shared = count(both[1:][both[1:] == both[:-1]])
                alike = shared / np.maximum(1, count(a) + count(b) - shared)
                keep = pa.array(np.flatnonzero(alike >= threshold))
                cols = [part.column(0).take(keep), part.column(1).take(keep), pa.array(alike).take(keep)]
                yield pa.RecordBatch.from_arrays(cols, names=["rep_a", "rep_b", "similarity"])

    return run


def most_apart(threshold: float) -> int:
    """Differing two-bit places of a sketch that a pair at the threshold stays under but for one in some 10,000."""
    p = 0.75 * (1 - threshold)
    return math.ceil(SKETCH * p + 3.7 * math.sqrt(SKETCH * p * (1 - p)))


def _apart(x: Column, y: Column) -> Column:
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


class NearDuplicates:
    """Near-duplicate structure of a collection: classes of equal sets, and links between classes.

    ``texts`` has one row per record: a unique non-null ``key`` and a ``text`` (rows
    with a repeated key and equal texts are reduced to one, null keys and texts are
    left out). Texts with fewer than ``width`` words have no shingles and no
    duplicates. Texts whose sets are equal form a class, represented by one of its
    rows; only representatives are fingerprinted, so a third of all rows being copies
    of one text costs one fingerprint. ``links`` has (rep_a, rep_b, similarity), by
    row number, for pairs of at least ``threshold`` (shared over all distinct
    shingles). There is no cap on buckets, candidates or partners; at similarity s a
    pair is missed only if it collides in none of the fingerprints (with the defaults
    0.7 % at 0.6, 0.12 % at 0.65, 0.012 % at 0.7, and less as it rises).
    """

    def __init__(self, texts: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, symbols: int = SYMBOLS, radius: int = RADIUS, tables: int = TABLES) -> None:
        kept = texts.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull())
        hashed = kept.select(F.col(f"`{key}`").alias("id"), F.transform(words(F.col(f"`{text}`")), lambda w: F.hash(w)).alias("words"))
        kind = texts.schema[key].dataType.simpleString()
        prints = hashed.mapInArrow(_prints(width, symbols * tables), f"id {kind}, words array<int>, n int, h1 bigint, h2 bigint, s1 bigint, s2 bigint, marks array<smallint>")
        self.rows = materialize(prints.withColumn("nid", F.monotonically_increasing_id()), "prints")

        # Copies are looked for by the sums over the sets; only classes of several rows are written down.
        same = ["h1", "h2", "n"]
        classes = self.rows.groupBy(*same).agg(F.min("nid").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        classes = materialize(classes, "classes")
        spare = materialize(self.rows.select("id", "nid", *same).join(classes, same).where("nid <> rep").select("id", "nid", "rep"), "copies")
        heads = self.rows.select(F.col("id").alias("head"), F.col("nid").alias("rep")).join(classes.select("rep"), "rep")
        self.heads = heads
        self.copies = spare.join(heads, "rep").where("id <> head").select("id", "rep").distinct()
        self.nodes = self.rows.join(spare.select("nid"), "nid", "left_anti")

        keep = list(combinations(range(symbols), symbols - radius))
        variants = [F.xxhash64(F.lit(t * len(keep) + v), *[F.get("marks", F.lit(t * symbols + p)) for p in places]) for t in range(tables) for v, places in enumerate(keep)]
        keyed = self.nodes.select("nid", "n", "s1", "s2", F.explode(F.array(*variants)).alias("k")).withColumn("k", F.col("k").bitwiseAND(F.lit((1 << KEY_BITS) - 1)))
        side = lambda x: keyed.select("k", *[F.col(c).alias(c + x) for c in ("nid", "n", "s1", "s2")])
        sized = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9)
        close = _apart(F.col("s1a"), F.col("s1b")) + _apart(F.col("s2a"), F.col("s2b")) <= most_apart(threshold)
        # Screened where the pair is made, so that chance collisions are never shuffled.
        candidates = side("a").join(side("b"), "k").where((F.col("nida") < F.col("nidb")) & sized & close).select("nida", "nidb").distinct()
        held = lambda x: self.rows.select(F.col("nid").alias(f"nid{x}"), F.col("words").alias(f"w{x}"))
        pairs = candidates.join(held("a"), "nida").join(held("b"), "nidb").select("nida", "nidb", "wa", "wb")
        self.links = materialize(pairs.mapInArrow(_verified(width, threshold), "rep_a bigint, rep_b bigint, similarity double"), "links")

    def members(self) -> DataFrame:
        """``id`` of every record with shingles and ``rep``, the row that represents its class."""
        return self.nodes.select("id", F.col("nid").alias("rep")).unionByName(self.copies)

    def pairs(self) -> DataFrame:
        """Every pair of records (a < b), with copies expanded: for results that must list them all."""
        several = self.copies.unionByName(self.heads.select(F.col("head").alias("id"), "rep"))
        copies = several.alias("x").join(several.alias("y"), "rep").where(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1.0).alias("similarity"))
        m = self.members()
        x, y = m.select(F.col("id").alias("ia"), F.col("rep").alias("rep_a")), m.select(F.col("id").alias("ib"), F.col("rep").alias("rep_b"))
        across = self.links.join(x, "rep_a").join(y, "rep_b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
        return across.unionByName(copies)

    def groups(self, rounds: int = 50) -> DataFrame:
        """One row per record: ``id``, ``group_id`` (the smallest key of its group) and ``n_links`` of its class.

        Groups are the connected components over the links, found by repeatedly
        linking every class to the smallest one next to it (large star, small star);
        each round is written to the shared folder. It ends when a round leaves the
        number of edges and the sum of their hashes as they were.
        """
        edges, seen = self.links.select("rep_a", "rep_b"), None
        for i in range(rounds):
            both = edges.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).unionByName(edges.select(F.col("rep_b").alias("u"), F.col("rep_a").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select("u", "v", "m")
            star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            edges = materialize(star.select(F.least("u", "v").alias("rep_a"), F.greatest("u", "v").alias("rep_b")).distinct(), f"star{i}")
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("rep_a", "rep_b").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"groups still changed after {rounds} rounds")
        root = edges.groupBy(F.col("rep_b").alias("rep")).agg(F.min("rep_a").alias("root"))
        ends = self.links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        placed = self.members().join(root, "rep", "left").join(ends, "rep", "left").select("id", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
        names = placed.groupBy("root").agg(F.min("id").alias("group_id"))
        return placed.join(names, "root").select("id", "group_id", "n_links")

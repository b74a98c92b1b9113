"""Frequency of every distinct term, counted in burst tries.

Each worker puts its terms into a burst trie: containers hold suffixes with their
counters, and a container that outgrows its limit bursts into a node, so prefixes grow
where the vocabulary is dense. A trie that reaches its limit is written out and begun
anew. What is written and shuffled are the containers: a prefix and the suffixes and
counters below it. The burst points of all workers' tries tell which prefixes hold
much of the vocabulary; terms are routed by the shortest prefix that doesn't, so
matching subtrees of all workers meet, whatever depths they burst at, and are merged
into one trie per prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialize

#: Distinct suffixes a container holds before it bursts.
BURST = 512
#: Rows gathered before they are put into the trie, pre-aggregated.
GATHER = 200_000
#: White space at the ends of a term.
EDGE = " \t\n\x0b\f\r\u00a0"
#: Terms in a worker's trie before it is written out, and terms of a merged subtree aimed at.
FLUSH, SUBTREE = 500_000, 200_000
#: Parts of the vocabulary, at most: a prefix with more than its share of all terms is a node of the routing trie.
MOST_PARTS = 10_000
_SCHEMA = "term string, occurrences bigint, records bigint"
_BOX = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Counters of terms. A node maps the next letter to a node or a container."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.size = 0
        self.top: _Container | _Node = _Container()

    def add(self, term: str, occurrences: int, records: int) -> None:
        """Add to both counters of a term."""
        box, depth, parent = self.top, 0, None
        while isinstance(box, _Node):
            parent = box
            if depth == len(term):
                box.occurrences += occurrences
                box.records += records
                box.ends = True
                return
            letter = term[depth]
            depth += 1
            box = parent.next.get(letter)
            if box is None:
                box = parent.next[letter] = _Container()
        held = box.suffixes.get(suffix := term[depth:])
        if held is None:
            box.suffixes[suffix] = [occurrences, records]
            self.size += 1
            if len(box.suffixes) > self.burst:
                node = self._burst(box)
                if parent is None:
                    self.top = node
                else:
                    parent.next[term[depth - 1]] = node
        else:
            held[0] += occurrences
            held[1] += records

    def _burst(self, box: _Container) -> _Node:
        node = _Node()
        for suffix, (o, r) in box.suffixes.items():
            if not suffix:
                node.occurrences, node.records, node.ends = o, r, True
            else:
                node.next.setdefault(suffix[0], _Container()).suffixes[suffix[1:]] = [o, r]
        return node

    def subtrees(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, suffix counters) of every container, in prefix order."""
        stack: list[tuple[str, object]] = [("", self.top)]
        while stack:
            prefix, box = stack.pop()
            if isinstance(box, _Container):
                yield prefix, box.suffixes
                continue
            if box.ends:
                yield prefix, {"": [box.occurrences, box.records]}
            stack += [(prefix + x, box.next[x]) for x in sorted(box.next, reverse=True)]


class _Container:
    __slots__ = ("suffixes",)

    def __init__(self) -> None:
        self.suffixes: dict[str, list[int]] = {}


class _Node:
    __slots__ = ("ends", "next", "occurrences", "records")

    def __init__(self) -> None:
        self.next: dict = {}
        self.occurrences = self.records = 0
        self.ends = False


def _written(boxes: list[tuple[str, dict[str, list[int]]]]) -> pa.RecordBatch:
    """Containers as rows: prefix, suffixes, both counters."""
    off = pa.array([0, *accumulate(len(x) for _, x in boxes)], pa.int32())
    counts = [c for _, x in boxes for c in x.values()]
    lists = [pa.array([s for _, x in boxes for s in x], pa.string()), *[pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in boxes], pa.string()), *[pa.ListArray.from_arrays(off, x) for x in lists]], names=["prefix", "suffixes", "occurrences", "records"])


def _portions(boxes: Iterator[tuple[str, dict[str, list[int]]]], terms: int = 20_000) -> Iterator[list[tuple[str, dict[str, list[int]]]]]:
    """Containers in lists of a bounded number of terms."""
    held, n = [], 0
    for prefix, suffixes in boxes:
        if suffixes:
            held.append((prefix, suffixes))
            n += len(suffixes)
        if n >= terms:
            yield held
            held, n = [], 0
    if held:
        yield held


def _grow(burst: int = BURST, flush: int = FLUSH):
    """Rows of (term, occurrences, records) to the containers of tries of at most about ``flush`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, rows = BurstTrie(burst), [], 0

        def put() -> None:
            t = pa.Table.from_batches(held).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
            for x in zip(t.column("term").to_pylist(), t.column("occurrences_sum").to_pylist(), t.column("records_sum").to_pylist()):
                trie.add(*x)
            held.clear()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= GATHER:
                put()
                rows = 0
                if trie.size >= flush:
                    yield from map(_written, _portions(trie.subtrees()))
                    trie = BurstTrie(burst)
        if held:
            put()
        yield from map(_written, _portions(trie.subtrees()))

    return run


def route(term: str, dense: frozenset[str]) -> str:
    """The shortest prefix of a term that is not ``dense``, or the term."""
    n = 0
    while n < len(term) and term[:n] in dense:
        n += 1
    return term[:n]


def _rows(batch: pa.RecordBatch, first: int = 0) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns[first:]])


def _routed(dense: frozenset[str]):
    """Containers to containers that lie under one routing prefix each: a container above a split is cut at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, dict[str, list[int]]]] = []
            for prefix, suffixes, occurrences, records in _rows(batch):
                at = route(prefix, dense)
                counters = zip(suffixes, zip(occurrences, records))
                if prefix not in dense:
                    out.append((at, prefix, dict(counters)))
                    continue
                parts: dict[str, dict[str, list[int]]] = {}
                for suffix, c in counters:
                    parts.setdefault(route(prefix + suffix, dense), {})[suffix] = c
                out += [(k, prefix, x) for k, x in parts.items()]
            if out:
                b = _written([(p, x) for _, p, x in out])
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in out], pa.string()), *b.columns], names=["route", *b.schema.names])

    return run


def _merge(burst: int = BURST):
    """Containers sorted by route to the terms and counters of the merged subtrees."""

    def listed(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        for some in _portions(trie.subtrees()):
            counts = [c for _, x in some for c in x.values()]
            terms = pa.array([p + s for p, x in some for s in x], pa.string())
            yield pa.RecordBatch.from_arrays([terms, *[pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]], names=["term", "occurrences", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, BurstTrie(burst)
        for batch in batches:
            for at, prefix, suffixes, occurrences, records in _rows(batch):
                if at != now:
                    yield from listed(trie)
                    now, trie = at, BurstTrie(burst)
                for s, o, r in zip(suffixes, occurrences, records):
                    trie.add(prefix + s, o, r)
        yield from listed(trie)

    return run


def dense_prefixes(boxes: DataFrame, subtree: int = SUBTREE, most_parts: int = MOST_PARTS) -> frozenset[str]:
    """The prefixes under which the workers' tries hold more than a subtree of terms, or than their share of ``most_parts``.

    Every container counts for its prefix and all prefixes of that, so these are the
    nodes of a trie; at each depth there are at most ``most_parts`` of them.
    """
    n = boxes.select("prefix", F.size("suffixes").cast("bigint").alias("n")).groupBy("prefix").agg(F.sum("n").alias("n"))
    # The largest part that need not be split is known only with the total, which comes along with every prefix.
    above = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda i: F.substr(F.col("prefix"), F.lit(1), i))).alias("p"), "n")
    total = n.agg(F.sum("n")).first()[0] or 0
    return frozenset(r["p"] for r in above.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > max(subtree, total // most_parts)).select("p").collect())


def merged(boxes: DataFrame, dense: frozenset[str], burst: int = BURST) -> DataFrame:
    """Containers of all workers routed by prefix and merged: term, occurrences, records."""
    routed = boxes.mapInArrow(_routed(dense), f"route string, {_BOX}")
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(_merge(burst), _SCHEMA)


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """Occurrences and distinct records of every term.

    ``pairs`` has the columns term, record and tf, with one row per spelling, copy
    and delivery; it is first reduced to one row per (term key, record). Of each form
    of a spelling (lower case, upper case, capitalised, mixed) the largest tf in the
    record counts, so copies count once and sources that agree count once; the forms
    add up. A null or non-positive tf counts as one occurrence. Null and blank terms
    and null records are left out. The result has the columns term_key, occurrences
    and records. Extra columns of ``pairs`` are ignored.
    """
    count = F.when(F.col("tf") > 0, F.col("tf")).otherwise(1).cast("int")
    t, first = F.col("term"), F.substring("term", 1, 1)
    form = F.when(t == F.lower(t), 0).when(t == F.upper(t), 1).when((first == F.upper(first)) & (F.substr(t, F.lit(2)) == F.lower(F.substr(t, F.lit(2)))), 2).otherwise(3)
    clean = pairs.select(F.trim("term", F.lit(EDGE)).alias("term"), "record", count.alias("tf")).where("term <> '' and record is not null").select(F.lower("term").alias("key"), "record", "tf", form.alias("form"))
    # One exchange, on the pair; copies collapse before it, so no pair is hot, and a common term is spread over its records.
    forms = clean.groupBy("key", "record").agg(*[F.max(F.when(F.col("form") == k, F.col("tf"))).alias(f"f{k}") for k in range(4)])
    total = sum((F.coalesce(F.col(f"f{k}"), F.lit(0)) for k in range(4)), F.lit(0).cast("bigint"))
    per_record = forms.select(F.col("key").alias("term"), total.alias("occurrences"), F.lit(1).cast("bigint").alias("records"))
    boxes = materialize(per_record.mapInArrow(_grow(), _BOX), "containers")
    return merged(boxes, dense_prefixes(boxes)).withColumnRenamed("term", "term_key")


def mark_terms(freq: DataFrame, n_records: int, rare_at_most: int = 2, common_share: float = 0.155) -> DataFrame:
    """``freq`` with ``mark``: rare for at most ``rare_at_most`` records, common for more than the share of all, else null."""
    return freq.withColumn("mark", F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > F.lit(common_share * n_records), "common"))

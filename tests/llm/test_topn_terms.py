"""Top N, running sums and term counts against brute force."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import prefix, termcount, topn


def _scores(seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(3000):
        q = r.choice(["hot", "hot", "hot", None, "", *[f"q{i}" for i in range(40)]])
        s = r.choice([None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, *[r.randint(-5, 5) / 2 for _ in range(20)]])
        rows.append((q, r.choice([None, "é", "z", *[f"d{i}" for i in range(300)]]), s, r.randint(0, 9)))
    return rows


def test_top_n(spark):
    rows = _scores()
    df = spark.createDataFrame(rows, "query_id string, doc_id string, score double, extra int")
    best = {}
    for q, d, s, _ in rows:
        if s is not None and math.isfinite(s):
            best[q, d] = max(best.get((q, d), -math.inf), s)
    per = defaultdict(list)
    for (q, d), s in best.items():
        per[q].append((-s, d is None, d or "", d))
    want = {(q, k + 1, x[3]) for q, v in per.items() for k, x in enumerate(sorted(v, key=lambda x: (x[0], x[1], x[2].encode()))[:7])}
    b = topn.best_scores(df, "query_id", "doc_id", "score")
    for parts in (1, 3, 50):
        got = topn.top_n(b, ["query_id"], [topn.Desc(F.col("score")), F.col("doc_id")], 7, partitions=parts)
        assert {(r["query_id"], r["rank_no"], r["doc_id"]) for r in got.collect()} == want


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("b", None, 6)], "g string, rank_no int, _pid int")
    got = topn.top_n(df, ["g"], [topn.Desc(F.col("rank_no"))], 5)
    assert got.columns == ["g", "rank_no", "_pid", "rank_no_"]
    assert sorted((r["g"], r["rank_no"], r["_pid"], r["rank_no_"]) for r in got.collect()) == [("a", 1, 5, 1), ("a", 1, 5, 2), ("b", None, 6, 1)]
    assert topn.top_n(df, ["g"], [F.col("rank_no")], 0).count() == 0
    assert topn.top_n(df.where("false"), ["g"], [F.col("rank_no")], 3).count() == 0
    two = topn.top_n(df.withColumn("h", F.lit(1)), ["g", "h"], [F.col("rank_no")], 1)
    assert two.count() == 2


def test_running_sum(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "x", "y", None]), i, r.choice([None, 0, 1, 5, 2**33])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, v bigint")
    want, run = {}, Counter()
    for g, i, v in rows:
        want[i] = run[g]
        run[g] += v or 0
    assert {x["i"]: x["before"] for x in prefix.running_sum(df.repartition(7), "g", ["i"], "v", "before").collect()} == want
    assert prefix.running_sum(df.where("false"), "g", ["i"], "v", "before").count() == 0


def _form(t):
    return 0 if t == t.lower() else 1 if t == t.upper() else 2 if t[0] == t[0].upper() and t[1:] == t[1:].lower() else 3


def test_term_frequencies(spark):
    r = random.Random(2)
    rows = []
    for _ in range(4000):
        t = r.choice(["hot", "HOT ", " Hot", "hOt", None, "", "  ", *[f"Term{r.randint(0, 900)}" for _ in range(6)]])
        rows.append((t, r.choice([None, *[f"r{i}" for i in range(60)]]), r.choice([None, -1, 0, 1, 2, 3]), 1))
    rows.append(("x" * 20_000, "r1", 1, 1))
    tf = {}
    for t, d, n, _ in rows:
        if t and t.strip() and d is not None:
            k = t.strip().lower(), d, _form(t.strip())
            tf[k] = max(tf.get(k, 0), n if n and n > 0 else 1)
    occ, rec = Counter(), defaultdict(set)
    for (t, d, _), n in tf.items():
        occ[t] += n
        rec[t].add(d)
    df = spark.createDataFrame(rows, "term string, record string, tf int, records int")
    got = termcount.term_frequencies(df)
    assert got.columns == ["term_key", "occurrences", "records"]
    assert {x["term_key"]: (x["occurrences"], x["records"]) for x in got.collect()} == {t: (occ[t], len(rec[t])) for t in occ}
    assert termcount.term_frequencies(df.where("false")).count() == 0
    marks = {x["term_key"]: x["mark"] for x in termcount.mark_terms(got, 60).collect()}
    assert all(m == ("rare" if len(rec[t]) <= 2 else "common" if len(rec[t]) > 9.3 else None) for t, m in marks.items())


@settings(max_examples=60)
@given(st.lists(st.tuples(st.text(alphabet="abç", max_size=6), st.integers(1, 9))), st.integers(1, 4))
def test_burst_trie(items, burst):
    trie, want = termcount.BurstTrie(burst), defaultdict(lambda: [0, 0])
    for t, n in items:
        trie.add(t, n, 1)
        want[t][0] += n
        want[t][1] += 1
    got = [(p + s, c) for p, box in trie.subtrees() for s, c in box.items()]
    assert dict(got) == dict(want) and len(got) == len(want)


def _boxes(spark, worker_rows, burst, flush=10**6):
    """The containers of several workers' tries, as one table."""
    parts = []
    for rows in worker_rows:
        b = pa.RecordBatch.from_pydict({"term": [t for t, _ in rows], "occurrences": [n for _, n in rows], "records": [1] * len(rows)}, schema=pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]))
        parts += list(termcount._grow(burst, flush)([b.slice(i, 40) for i in range(0, len(rows), 40)]))
    rows = [r for b in parts for r in b.to_pylist()]
    return spark.createDataFrame([(r["prefix"], r["suffixes"], r["occurrences"], r["records"]) for r in rows], termcount._BOX), {r["prefix"] for r in rows}


def test_subtrees_of_workers_meet_and_merge(spark):
    r = random.Random(7)
    one = [("".join(r.choices("abc", k=r.randint(0, 5))), r.randint(1, 5)) for _ in range(900)]
    two = [("ab" + "".join(r.choices("bcé", k=r.randint(0, 3))), 1) for _ in range(60)] + [("c", 9), ("zebra", 2)]
    boxes, prefixes = _boxes(spark, [one, two, one[:5]], 8)
    # the first worker burst deeper than the others, so containers of nested prefixes must meet
    assert "" in prefixes and any(len(p) > 2 for p in prefixes)
    want = defaultdict(lambda: [0, 0])
    for t, n in [*one, *two, *one[:5]]:
        want[t][0] += n
        want[t][1] += 1
    for subtree in (1, 20, 100, 10**6):
        dense = termcount.dense_prefixes(boxes, subtree)
        assert all(p[:k] in dense for p in dense for k in range(len(p))) and (subtree < 10**6 or not dense)
        got = termcount.merged(boxes, dense, 8).collect()
        assert len(got) == len(want) and {x["term"]: [x["occurrences"], x["records"]] for x in got} == dict(want)


def test_routes_follow_the_vocabulary():
    dense = frozenset({"", "a", "ab"})
    assert [termcount.route(t, dense) for t in ("", "a", "ab", "abc", "abcd", "ax", "b", "bcd")] == ["", "a", "ab", "abc", "abc", "ax", "b", "b"]


def test_tries_are_written_out_at_their_limit(spark):
    rows = [(f"t{i}", 1) for i in range(400)] * 2
    old = termcount.GATHER
    termcount.GATHER = 40
    try:
        boxes, _ = _boxes(spark, [rows], 16, flush=100)
    finally:
        termcount.GATHER = old
    terms = [p + s for p, x in ((r["prefix"], r["suffixes"]) for r in boxes.collect()) for s in x]
    assert len(terms) > len(set(terms)) == 400
    assert {tuple(x) for x in termcount.merged(boxes, frozenset()).collect()} == {(f"t{i}", 2, 2) for i in range(400)}

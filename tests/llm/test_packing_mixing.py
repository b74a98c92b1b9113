"""Packing and mixing against their definitions."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, tokens


@settings(max_examples=80)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_is_the_tightest(sizes):
    where, n = packing.best_fit_decreasing(sizes, 64)
    room, naive = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            room[room.index(min(fits))] -= sizes[i]
        else:
            room.append(64 - sizes[i])
    used = Counter()
    for i, b in enumerate(where):
        used[b] += sizes[i]
    assert n == len(room) and sorted(64 - u for u in used.values()) == sorted(room)


@pytest.mark.parametrize("shard", [10**6, 400])
def test_pack(spark, shard):
    r = random.Random(1)
    rows = [(i, r.choice([None, 0, -3, r.randint(1, 60), r.randint(1, 600)])) for i in range(300)] + [(7, 5), (7, 5), (None, 9)]
    specs = spark.createDataFrame([(1, 100), (2, 250), (3, None), (4, 0)], "spec_id int, capacity int")
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), "doc_id", "n_tokens", specs, shard_tokens=shard).collect()
    for spec, cap in ((1, 100), (2, 250)):
        mine = [c for c in out if c["spec_id"] == spec]
        assert len({c["container_id"] for c in mine}) == len(mine)
        got, pieces = Counter(), Counter()
        for c in mine:
            assert c["used"] == sum(x["n_tokens"] for x in c["items"]) <= cap and c["unused"] == cap - c["used"] and c["n_items"] == len(c["items"])
            for x in c["items"]:
                got[x["item"]] += x["n_tokens"]
                pieces[x["item"]] += 1
        want = Counter()
        for i, n in rows:
            want[i] += n if n and n > 0 else 0
        assert got == +want
        assert all(pieces[i] == -(-n // cap) for i, n in rows if n and n > 0 and i not in (7, None))
        if shard > 1000:
            assert sum(c["unused"] for c in mine) < 1.2 * cap
    assert {c["spec_id"] for c in out} == {1, 2}


def test_pack_empty(spark):
    specs = spark.createDataFrame([(1, 100)], "spec_id int, capacity int")
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), "doc_id", "n_tokens", specs).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([("a b c", 1), (None, 2), ("  \n", 3), ("", 4), ("x" * 30_000, 5), ("<|endoftext|> é", 6)], "text string, n_tokens int")
    got = {r["n_tokens"]: r["n_tokens_"] for r in tokens.token_sizes(df, "text").collect()}
    assert got[1] == 3 and got[2] == got[3] == got[4] == 0 and got[5] > 1000 and got[6] > 2


def _mixture(spark, **options):
    r = random.Random(4)
    docs = [(i, r.choice(["a"] * 8 + ["b"] * 4 + ["c", None, "other"]), r.choice([None, 0, r.randint(5, 60)])) for i in range(3000)] + [(9001, "tiny", 3)]
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("tiny", 0.05, 2), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    m = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, n_tokens int"), "doc_id", "source", "n_tokens", t, **options)
    return docs, t, m


def test_mix(spark):
    docs, t, m = _mixture(spark)
    rows = m.collect()
    sizes = {d: (s, n) for d, s, n in docs}
    assert all((r["source"], r["n_tokens"]) == sizes[r["doc_id"]] and 0 <= r["position"] <= 1 for r in rows)
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    uses = Counter(r["doc_id"] for r in rows)
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    assert all(n <= {"a": 1, "b": 2, "c": 4, "tiny": 2}[sizes[d][0]] for d, n in uses.items())
    got = Counter()
    for r in rows:
        got[r["source"]] += r["n_tokens"]
    assert got["tiny"] == 6
    for s, want in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(got[s] / sum(got.values()) - want) < 0.005
    half = Counter(r["source"] for r in rows if r["position"] < 0.5)
    assert half["c"] / sum(half.values()) < sum(r["source"] == "c" for r in rows) / len(rows)
    s = {r["source"]: r for r in mixing.shares(m, "source", t).collect()}
    assert s["none"]["tokens"] == 0 and s["tiny"]["most_copies"] == 2 and abs(sum(r["reached_share"] for r in s.values()) - 1) < 1e-9


def test_mix_with_a_total_and_empty(spark):
    _, t, m = _mixture(spark, total_tokens=5000)
    assert abs(m.agg(F.sum("n_tokens")).first()[0] - 5000 * 0.9) < 120
    none = mixing.mix(spark.createDataFrame([], "doc_id long, source string, n_tokens int"), "doc_id", "source", "n_tokens", t)
    assert none.count() == 0 and {r["reached_share"] for r in mixing.shares(none, "source", t).collect()} == {0.0}


def test_schedules_are_followed(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 1) for i in range(8000)], "doc_id long, source string, n_tokens int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    points = [("a", 0.0, 1.0), ("a", 0.5, 3.0), ("a", 0.5, 2.0), ("a", 1.0, 0.0), ("b", 0.5, 2.0), ("b", 2.0, 9.0), ("b", None, 9.0), (None, 0.1, 1.0), ("b", 0.2, None)]
    s = spark.createDataFrame(points, "source string, time double, weight double")
    rows = mixing.mix(docs, "doc_id", "source", "n_tokens", t, schedules=s).collect()
    at = sorted(r["position"] for r in rows if r["source"] == "a")
    # the integral of the weights 1 to 3 over the first half is 1, that of 3 to 0 over the second 0.75
    for time, part in ((0.25, (0.25 + 0.125) / 1.75), (0.5, 1 / 1.75), (0.75, (1 + 0.5625) / 1.75)):
        assert abs(sum(x <= time for x in at) / len(at) - part) < 0.002
    b = [r["position"] for r in rows if r["source"] == "b"]
    assert abs(sum(x <= 0.3 for x in b) / len(b) - 0.3) < 0.002 and 0 <= min(b) and max(b) <= 1
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)


def test_a_schedule_may_begin_late(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 1) for i in range(2000)], "doc_id long, source string, n_tokens int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    s = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.6, 0.0), ("a", 0.7, 1.0), ("b", 0.3, 0.0)], "source string, time double, weight double")
    rows = mixing.mix(docs, "doc_id", "source", "n_tokens", t, schedules=s).collect()
    a = [r["position"] for r in rows if r["source"] == "a"]
    assert len(a) == 1000 and min(a) >= 0.6 and max(a) <= 1
    # a schedule without any weight is none
    assert abs(sum(r["position"] <= 0.5 for r in rows if r["source"] == "b") - 500) < 3


def test_repeated_evaluation_and_identifiers(spark):
    rows = [(7, 230)] * 40 + [(i, 90) for i in range(30)]
    specs = spark.createDataFrame([(1, 100)], "spec_id int, capacity int")
    df = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), "doc_id", "n_tokens", specs, shard_tokens=500)
    one, two = (sorted((r["container_id"], r["items"]) for r in df.collect()) for _ in range(2))
    assert one == two and len({x for x, _ in one}) == len(one)

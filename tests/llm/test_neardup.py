"""Near-duplicates against all pairs."""

import random
import re
from itertools import combinations

from tidemark.llm import neardup


def _sets(rows, width):
    out = {}
    for k, t in rows:
        if k is not None and t is not None:
            w = re.findall(r"[^\W_]+", t.lower())
            out[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return out


def _brute(sets, least):
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def _rows(seed=1, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(n):
        if i and r.random() < 0.5:
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randrange(0, 5)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["new"], [w[k].upper() + "!"]])
        else:
            w = r.choices(vocabulary, k=r.randrange(40, 90))
        rows.append((f"d{i:03}", " ".join(w)))
    return rows


def test_all_pairs_and_groups(spark):
    rows = [*_rows(), ("n1", None), (None, "a b c d"), ("e1", ""), ("e2", ""), ("s1", "too short"), ("s2", "too short"), ("u", "É " * 3), ("d000", _rows()[0][1])]
    rows += [(f"copy{i}", rows[0][1].upper()) for i in range(30)]
    sets = _sets(rows, 3)
    want = _brute(sets, 0.6)
    df = spark.createDataFrame(rows, "id string, text string")
    found = neardup.NearDuplicates(df, "id", "text", 3, 0.6)
    got = [(r["a"], r["b"]) for r in found.pairs().collect()]
    assert set(got) == want and len(got) == len(want)

    parent = {k: k for k, s in sets.items() if s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    groups = found.groups().collect()
    assert {r["id"]: r["group_id"] for r in groups} == {k: root(k) for k in parent} and len(groups) == len(parent)


def test_defaults_are_five_words_and_four_fifths(spark):
    rows = _rows(2, 100)
    found = neardup.NearDuplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text")
    assert {(r["a"], r["b"]) for r in found.pairs().collect()} == _brute(_sets(rows, 5), 0.8)


def test_empty_and_long(spark):
    df = spark.createDataFrame([("a", "x " * 40_000), ("b", "x " * 40_001)], "id string, rep string")
    assert neardup.NearDuplicates(df, "id", "rep", 3, 0.6).pairs().count() == 1
    empty = neardup.NearDuplicates(df.where("false"), "id", "rep")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0

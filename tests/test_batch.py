"""Many queries at once: the same results as joining each with its postings, and fewer rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import engine
from tidemark.operators import batch
from tidemark.operators import ranking as rk


def _made(spark, docs, queries, key="bigint"):
    posts = [(t, d, float(n)) for d, words in docs.items() for t, n in words.items()]
    p = spark.createDataFrame(posts, f"term string, doc_id {key}, tf double")
    about = spark.createDataFrame([(d, float(sum(w.values())), float(max(w.values(), default=1))) for d, w in docs.items()], f"doc_id {key}, length double, max_tf double")
    q = spark.createDataFrame([(i, t, w) for i, ts in queries.items() for t, w in ts.items()], "query_id string, term string, weight double")
    return q, rk.entries(p, about), rk.statistics(about)


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("dense, block, depth, key", [(256, 16_384, 5, "bigint"), (3, 40, 5, "string"), (256, 70, 3, "bigint"), (4, 16_384, 500, "string")])
def test_same_as_joined(spark, monkeypatch, dense, block, depth, key):
    monkeypatch.setattr(batch, "DENSE", dense)
    monkeypatch.setattr(batch, "BLOCK_DOCS", block)
    monkeypatch.setattr(batch, "CHUNK", 7)
    monkeypatch.setattr(batch, "SLICE_QUERIES", 20)
    rnd = random.Random(dense)
    words = [f"w{i}" for i in range(30)]
    # "most" is in more than half of the documents and lowers scores; copies have equal scores; document 0 is empty.
    docs = {i: {w: rnd.randint(1, 4) for w in rnd.sample(words, rnd.randint(1, 12))} | ({"most": 1} if i % 5 else {}) for i in range(1, 300)}
    docs |= {i: dict(docs[7]) for i in range(300, 340)} | {0: {}}
    if key == "string":
        docs = {str(d): v for d, v in docs.items()}
    queries = {f"q{i}": {w: rnd.choice((0.5, 1.0)) for w in rnd.sample([*words, "most", "nowhere"], rnd.randint(1, 8))} for i in range(60)}
    queries |= {"lowest": {"most": 1.0}, "none": {"nowhere": 1.0}, "copy": dict(queries["q0"])}
    q, stored, stats = _made(spark, docs, queries, key)
    only = spark.createDataFrame([(d,) for d in docs if int(d) % 3], f"doc_id {key}")
    for some in (None, only):
        want = rk.top(rk.score_entries(q, stored, stats, some), depth)
        assert _rows(rk.top_batch(q, stored, stats, len(queries), depth, some)) == _rows(want)


def test_no_index(spark):
    q, stored, stats = _made(spark, {1: {"a": 1}}, {"q": {"a": 1.0}})
    assert rk.top_batch(q, stored.limit(0), stats.limit(0), 1, 5).count() == 0


def _written(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _index(spark, folder, n_docs):
    docs = spark.range(n_docs).select(F.col("id").alias("doc_id"), F.lit("").alias("path"), F.col("id").alias("ord"), F.concat(F.lit("wheat harbour railway "), F.when(F.col("id") % 3 == 0, "copper").otherwise("zinc")).alias("text"), F.lit("").alias("title"), F.lit("en").alias("language"), F.lit("").alias("city"), F.lit("").alias("date"))
    places = spark.createDataFrame([], "city string, country string, currency string, population string")
    return engine.build(docs, places, spark.createDataFrame([("the",)], "word string"), str(folder))


def test_rows_do_not_multiply(spark, tmp_path):
    index = _index(spark, tmp_path, 3_000)
    topics = spark.createDataFrame([(f"q{i}", "copper wheat", "railway") for i in range(200)], "query_id string, title string, descr string")
    before = _written(spark)
    assert index.search_topics(topics, depth=3).count() == 600
    assert _written(spark) - before < 100_000  # 600,000 pairs of a topic and a document


def test_answered_is_not_scored(spark, tmp_path, monkeypatch):
    index = _index(spark, tmp_path, 10)
    topics = spark.createDataFrame([("q2", "copper", "unheard"), ("q1", "the", "railway"), ("q3", "the", "unheard")], "query_id string, title string, descr string")
    monkeypatch.setattr(rk, "score_entries", None)
    assert [r[0] for r in index.answered(topics).collect()] == ["q1", "q2"]

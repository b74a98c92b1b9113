"""Which sources set the total of a mixture, and that the others are reported."""

import __spark_entry__ as entry
from tidemark.llm import mixing

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("small", 0.15, 2), ("none", 0.05, 9)]


def _shares(spark, **options):
    docs = [(i, "ab"[i % 2], 1 + i % 7) for i in range(4000)] + [(9000 + i, "small", 5) for i in range(6)] + [(9100, "b", 5000), (9101, "b", 6000)]
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m, p = mixing.mix_and_plan(spark.createDataFrame(docs, "doc_id long, source string, n_tokens int"), "doc_id", "source", "n_tokens", t, **options)
    return {r["source"]: r for r in mixing.shares(m, "source", t, p).collect()}


def test_every_source_limits_the_total(spark):
    s = _shares(spark, too_small=0.0)
    assert s["small"]["tokens"] == 60 and {k for k, r in s.items() if r["passed_over"]} == {"none"}
    assert all(abs(s[k]["tokens"] - 400 * w) <= 3.5 for k, w in (("a", 0.5), ("b", 0.3), ("small", 0.15)))


def test_who_falls_short_is_reported(spark):
    s = _shares(spark, too_small=0.1)
    assert {k for k, r in s.items() if r["passed_over"]} == {"small", "none"} and s["small"]["tokens"] == 60 and s["a"]["tokens"] > 4000
    s = _shares(spark, total_tokens=300)
    assert {k for k, r in s.items() if r["passed_over"]} == {"none"} and abs(s["b"]["tokens"] - 90) <= 3.5


def test_no_documents_are_reported(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m, p = mixing.mix_and_plan(spark.createDataFrame([], "doc_id long, source string, n_tokens long"), "doc_id", "source", "n_tokens", t)
    assert all(r["passed_over"] for r in mixing.shares(m, "source", t, p).collect())


def test_small_source_meets_its_share(spark):
    s = {r["source"]: r for r in entry.queries()["p7_shares"](spark, "/root/testdata/sf0.01").collect()}
    assert abs(s["census_extract"]["difference"]) < 0.01 and {k for k, r in s.items() if r["passed_over"]} == {"island_telegraph", "tea_auction"}

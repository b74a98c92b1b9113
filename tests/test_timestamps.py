"""Timestamps against a row-by-row version with the standard library."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timestamps as ts
from tidemark.plans.dates import EDITION

CASES = [
    ("1996-01-20T00:04:53Z", "alp", "1996-01-20T00:04:53.000000Z", "exact"), ("821239560695065", None, "1996-01-10T02:06:00.695065Z", "exact"), ("825153042", None, "1996-02-24T09:10:42.000000Z", "exact"),
    ("199601271931", "alp", "1996-01-27T18:31:00.000000Z", "exact"), ("960113", None, "1996-01-13", "date"), ("961332", None, None, "unresolved"), ("000 000 96", None, "1996", "year"), ("000 000 XX", None, None, "unresolved"),
    ("12 Feb 9?", None, "02-12", "month_day"), ("29 Feb --", None, "02-29", "month_day"), ("30 Feb XX", None, None, "unresolved"), ("31 Feb 96", None, None, "unresolved"), ("11 Jun 96*", None, "1996-06-11", "date"),
    ("190345Z MAR 96", None, "1996-03-19T03:45:00.000000Z", "exact"), ("Jan 12 96 2110 hrs", "alp", "1996-01-12T20:10:00.000000Z", "exact"), ("29 may 1996 07.53 GMT+01:00", None, "1996-05-29T06:53:00.000000Z", "exact"),
    ("1996-01-26T03-05", None, "1996-01-26T08:00:00.000000Z", "exact"), ("1996-10-27T02:35", "alp", "1996-10-27T00:35:00.000000Z", "ambiguous"), ("1998-03-29 02:26:00", "alp", "1998-03-29T01:26:00.000000Z", "nonexistent"),
    ("1997-03-30T02:55:47,5[Europe/Berlin]", None, "1997-03-30T01:55:47.500000Z", "nonexistent"), ("1997-03-30T02:55[Nowhere/Land]", "alp", None, "unresolved"), ("1996-03-04 23:51 COT", None, "1996-03-05T04:51:00.000000Z", "exact"),
    ("1996-03-04 23:51 QQQ", "alp", None, "unresolved"), ("08/05/1996", "gulf", "1996-08-05", "date"), ("08/05/1996", "alp", "1996-05-08", "date"), ("08/18/1996", "alp", None, "unresolved"), ("08/05/1996", None, None, "unresolved"),
    ("23-MAR-1996", None, "1996-03-23", "date"), ("Friday, November 29, 1996, Home Edition", None, "1996-11-29", "date"), ("12 March 1996, 12:05 a.m.", "alp", "1996-03-11T23:05:00.000000Z", "exact"), ("12 March 1996, 12:05 PM", "hub", "1996-03-12T12:05:00.000000Z", "exact"),
    ("12 March 1996, 13:05 PM", "hub", None, "unresolved"), ("1996-01-10T25:00", "hub", None, "unresolved"), ("1996-01-10T10:00", None, None, "unresolved"), ("T12:00Z", None, None, "unresolved"), ("yesterday", "alp", None, "unresolved"), ("May", None, None, "unresolved"),
    ("", None, None, "unresolved"), ("  ", None, None, "unresolved"), (None, "alp", None, "unresolved"), ("x" * 50_000, None, None, "unresolved"), ("5.9.1997", None, "1997-09-05", "date"), ("5.9.97", None, "1997-09-05", "date"),
]
DESKS = [("alp", "Europe/Berlin", "DMY"), ("gulf", "America/Chicago", "MDY"), ("hub", "UTC", "DMY")]


def _run(spark, rows, extra=""):
    docs = spark.createDataFrame(rows, f"rec_id long, doc_date string, desk string{extra}")
    desks = spark.createDataFrame(DESKS, "desk string, tz string, day_order string")
    ab = spark.createDataFrame([("COT", -300), ("CET", 60)], "abbr string, offset_minutes int")
    d = docs.join(desks, "desk", "left")
    return ts.normalize(d, "doc_date", "tz", "day_order", ab, desks.select(F.col("tz").alias("zone")), noise=EDITION)


def test_cases(spark):
    got = {r["rec_id"]: (r["norm_date"], r["date_status"]) for r in _run(spark, [(i, c[0], c[1]) for i, c in enumerate(CASES)]).collect()}
    assert {CASES[i][:2]: v for i, v in got.items()} == {c[:2]: c[2:] for c in CASES}


def test_against_the_standard_library(spark):
    rows, want = [], {}
    t = datetime(1996, 1, 1)
    for i in range(1200):
        desk, zone, _ = DESKS[i % 3]
        t += timedelta(hours=29, minutes=31)
        z = ZoneInfo(zone)
        rows.append((i, t.strftime("%Y-%m-%d %H:%M:%S"), desk))
        # fold=0 is the offset before the change, for skipped and repeated times alike
        want[i] = t.replace(tzinfo=z, fold=0).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    assert {r["rec_id"]: r["norm_date"] for r in _run(spark, rows).collect()} == want


def test_clashing_columns_repeated_rows_and_empty(spark):
    df = _run(spark, [(1, "960113", "alp", "a", "b"), (1, "960113", "alp", "a", "b")], ", norm_date string, date_status string")
    assert df.columns[-2:] == ["norm_date_", "date_status_"] and [r["norm_date_"] for r in df.collect()] == ["1996-01-13"] * 2
    assert _run(spark, []).count() == 0
    odd = _run(spark, [(1, "1996-10-27T02:35", "alp", 7, "b", 8)], ", spans int, _p string, year int")
    assert odd.select("spans", "_p", "year", "norm_date").first()[:] == (7, "b", 8, "1996-10-27T00:35:00.000000Z")


@pytest.mark.parametrize("us", [0, -1, 86_400_000_000 - 1, -86_400_000_000, 1234567890123456, 253402300799999999])
def test_utc_text(spark, us):
    got = spark.range(1).select(ts.utc_text(F.lit(us).cast("bigint")).alias("t")).first()["t"]
    assert got == (datetime(1970, 1, 1) + timedelta(microseconds=us)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")

"""Timestamp normalisation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import timestamps
from tidemark.runtime import table


#: What desks write behind a date and means no date.
EDITION = (r",? \p{L}+ Edition$",)


def p2_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivery's date in one unambiguous form, and how it was reached."""
    desks = table(spark, sf, "desks")
    docs = table(spark, sf, "docs").select("rec_id", "doc_date", "desk")
    habit = docs.join(desks.dropDuplicates(["desk"]), "desk", "left")
    zones = desks.select(F.col("tz").alias("zone"))
    done = timestamps.normalize(habit, "doc_date", "tz", "day_order", table(spark, sf, "tz_abbrevs"), zones, noise=EDITION)
    return done.select("rec_id", "doc_date", "norm_date", "date_status")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The dates that can be resolved."""
    return p2_dates(spark, sf).where("date_status <> 'unresolved'").select("rec_id", "norm_date").distinct()


#: Shapes that mean the same to every desk: day, instant in UTC, seconds since 1970, YYMMDD, D.M.YYYY.
_PLAIN = (r"\d{4}-\d{2}-\d{2}", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z", r"\d{9,10}", r"\d{6}", r"\d{1,2}\.\d{1,2}\.\d{4}")


def p2_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Of these, the dates whose shape means the same to every desk."""
    shape = "^(?:" + "|".join(_PLAIN) + ")$"
    return p2_dates(spark, sf).where(F.col("doc_date").rlike(shape) & (F.col("date_status") != "unresolved")).select("rec_id", "norm_date").distinct()


QUERIES = {"p2_found": p2_found, "p2_dates": p2_dates, "p2_plain": p2_plain}
_DAY, _INSTANT, _SECONDS, _SIX, _DOTS = (f"regexp_full_match(doc_date, '{x}')" for x in _PLAIN)
ORACLE: dict[str, str] = {
    "p2_plain": f"""
SELECT rec_id, norm_date FROM (SELECT rec_id, CASE
  WHEN {_DAY} THEN strftime(try_cast(doc_date AS DATE), '%Y-%m-%d')
  WHEN {_INSTANT} THEN strftime(try_cast(replace(rtrim(doc_date, 'Z'), 'T', ' ') AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%fZ')
  WHEN {_SECONDS} THEN strftime(make_timestamp(CAST(doc_date AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ')
  WHEN {_SIX} THEN strftime(try_cast('19' || doc_date[1:2] || '-' || doc_date[3:4] || '-' || doc_date[5:6] AS DATE), '%Y-%m-%d')
  WHEN {_DOTS} THEN strftime(try_cast(split_part(doc_date, '.', 3) || '-' || split_part(doc_date, '.', 2) || '-' || split_part(doc_date, '.', 1) AS DATE), '%Y-%m-%d')
END AS norm_date FROM docs) WHERE norm_date IS NOT NULL""",
}

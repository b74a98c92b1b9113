"""All named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import dates, grammar, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **grammar.QUERIES, **dates.QUERIES}
ORACLE: dict[str, str] = {**retrieval.ORACLE, **grammar.ORACLE, **dates.ORACLE}

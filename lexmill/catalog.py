"""All queries over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import counting, language, learning, scoring

_PARTS = (counting, scoring, language, learning)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for p in _PARTS for name, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for p in _PARTS for name, s in p.SQL.items()}

"""All queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.plans import analytics, breakouts, features, guard, matrix, patterns, ratings, scores, trading, winners  # noqa: F401  they register their queries
from quantloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["technical_screen"](spark, sf_dir)

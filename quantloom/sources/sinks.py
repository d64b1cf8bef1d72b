"""Sinks that check before they replace."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _move(spark: SparkSession, source: str, target: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(path(source)) and store.rename(path(source), path(target))


def swap(df: DataFrame, path: str, tolerance: float = 0.05, healthy: dict[str, float] | None = None) -> int:
    """Writes `df` beside `path`, checks it and takes its place; the table before is at `path` with `.before`. Returns the rows.

    Refused, with nothing changed: a number of rows that differs from the one before by more than `tolerance`, no rows, or
    a column of `healthy` of which a smaller share than given there is neither null nor zero.
    """
    spark = df.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    new = spark.read.schema(df.schema).parquet(fresh)
    shares = [F.avg(F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0, 1.0).otherwise(0.0)).alias(c) for c in healthy or {}]
    seen = new.agg(F.count(F.lit(1)).alias("_rows"), *shares).first()
    rows = seen["_rows"]
    old = path_rows(spark, path)
    if not rows or (old is not None and abs(rows - old) > tolerance * old):
        raise ValueError(f"{rows} rows in place of {old}")
    if low := [c for c, least in (healthy or {}).items() if seen[c] < least]:
        raise ValueError(f"too few values in {low}")
    if old is not None:
        _move(spark, path, f"{path}.before-{uuid.uuid4().hex}")
    _move(spark, fresh, path)
    return rows


def path_rows(spark: SparkSession, path: str) -> int | None:
    """Rows of a Parquet table, or None if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path).count()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` and those of `old` whose keys it lacks; keys within `new` should be unique."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_place", place).filter("_place = 1").drop("_new", "_place")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose keys `old` lacks: what an append should write."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")

"""Joins in time: what was known, what is nearest, what lies within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: str, left_date: str, right_date: str, forward: bool = False, within: int | None = None) -> DataFrame:
    """Each row of `left` with the row of `right` of the same key that is the last on or before its date (first on or after: `forward`).

    Both sides are sorted into one stream per key, along which the last row of `right` is carried: one shuffle, no range join.
    `within` is the number of days beyond which nothing matches. Columns of `right` but the key must have names of their own;
    of its rows of one key and date any one may match, so they should be unique.
    """
    others = [c for c in right.columns if c != on]
    row = F.struct(*others)
    both = left.select(on, F.col(left_date).alias("_at"), F.lit(1 if not forward else 0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(row.alias("x")).schema["x"].dataType).alias("_right")).unionByName(
        right.select(on, F.col(right_date).alias("_at"), F.lit(0 if not forward else 1).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_left"), row.alias("_right"))
    )
    # Both ways a running aggregate: a frame that ends at the last row would be read again for each row.
    order = (F.desc("_at"), F.desc("_side")) if forward else ("_at", "_side")
    carried = F.last("_right", ignorenulls=True).over(Window.partitionBy(on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_found", carried).filter(F.col("_left").isNotNull())
    if within is not None:
        out = out.withColumn("_found", F.when(F.abs(F.datediff(F.col("_found")[right_date], "_at")) <= within, F.col("_found")))
    return out.select(*(F.col("_left")[c].alias(c) for c in left.columns), *(F.col("_found")[c].alias(c) for c in others))


def by_day(left: DataFrame, right: DataFrame, on: str = "code", date: str = "date") -> DataFrame:
    """Each row of `left` with the row of `right` of the same key and date, if any; `right` has a row a key and date, and few of a key.

    A key's rows of `right` come as one map, by the key alone: rows that are dealt by it, as tables in buckets are, stay where they are.
    """
    others = [c for c in right.columns if c not in (on, date)]
    known = right.filter(F.col(date).isNotNull()).groupBy(on).agg(F.map_from_entries(F.collect_list(F.struct(F.col(date), F.struct(*others)))).alias("_days"))
    return left.join(known, on, "left").withColumn("_days", F.try_element_at("_days", F.col(date))).select(*left.columns, *(F.col("_days")[c].alias(c) for c in others))


def nearest(left: DataFrame, right: DataFrame, on: str, left_date: str, right_date: str, days: int) -> DataFrame:
    """Each row of `left` with the row of `right` at most `days` away that is nearest; the earlier of two. Rows without one stay."""
    names = [c for c in right.columns if c != on]
    before = as_of(left, right.select(on, *(F.col(c).alias(f"_b_{c}") for c in names)), on, left_date, f"_b_{right_date}", within=days)
    both = as_of(before, right.select(on, *(F.col(c).alias(f"_a_{c}") for c in names)), on, left_date, f"_a_{right_date}", forward=True, within=days)
    gap = lambda c: F.coalesce(F.abs(F.datediff(c, left_date)), F.lit(days + 1))
    first = gap(f"_b_{right_date}") <= gap(f"_a_{right_date}")
    return both.select(*left.columns, *(F.when(first, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in names))


def within(intervals: DataFrame, events: DataFrame, on: str, start: str, end: str, date: str) -> DataFrame:
    """Pairs of an interval and an event of the same key in it, both ends included.

    Intervals are dealt to the months they touch, so the join is on key and month, never on the key's whole history.
    """
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    dealt = intervals.filter(F.col(start) <= F.col(end)).withColumn("_month", F.explode(months))
    return dealt.join(events.withColumn("_month", F.trunc(date, "MM")), [on, "_month"]).filter(F.col(date).between(F.col(start), F.col(end))).drop("_month")


def beyond(left: DataFrame, right: DataFrame, on: str, left_date: str, right_date: str, days: int) -> DataFrame:
    """The rows of `left` that have no row of `right` of the same key at most `days` away."""
    other = right.select(F.col(on).alias("_on"), F.col(right_date).alias("_date")).distinct()
    near: Column = (F.col(on) == F.col("_on")) & (F.abs(F.datediff(left_date, "_date")) <= days)
    return left.join(other, near, "left_anti")

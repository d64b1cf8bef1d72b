"""Screening, ranking and data quality."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, history

_OPS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "=": operator.eq, "!=": operator.ne}


def _condition(column: str, spec: Any) -> Column:
    if isinstance(spec, list):
        return reduce(operator.and_, (_condition(column, x) for x in spec), F.lit(True))
    if isinstance(spec, dict) and "op" in spec:
        return _OPS[spec["op"]](F.col(column), F.lit(spec["value"]))
    if isinstance(spec, dict):
        bounds = [F.col(column) >= spec["min"]] if "min" in spec else []
        return reduce(operator.and_, [*bounds, *([F.col(column) <= spec["max"]] if "max" in spec else [])], F.lit(True))
    return F.col(column) == F.lit(spec)


def screen(snapshot: DataFrame, conditions: dict[str, Any], sort: str = "code", descending: bool = False, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Rows that meet all conditions: a value, {min, max}, {op, value} or a list of these per column.

    Conditions on unknown columns are ignored, an unknown sort column is `code`; nulls meet nothing. Ties go by code.
    """
    kept = reduce(lambda df, c: df.filter(_condition(c, conditions[c])), (c for c in conditions if c in snapshot.columns), snapshot)
    by = F.col(sort if sort in snapshot.columns else "code")
    kept = kept.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), "code").offset(offset)
    return kept if limit is None else kept.limit(limit)


def top(snapshot: DataFrame, metric: str, n: int = 20, descending: bool = True) -> DataFrame:
    """The n best rows by a metric that is not null."""
    return snapshot.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric) if descending else F.asc(metric), "code").limit(n)


def active(bars: DataFrame, days: int, least_share: float) -> DataFrame:
    """Codes that traded in the last `days` days before the newest bar, on at least this share of all trading days."""
    calendar = bars.agg(F.max("date").alias("newest"), F.count_distinct("date").alias("all_days"))
    per = bars.groupBy("code").agg(F.max("date").alias("last"), F.count_distinct("date").alias("days"))
    out = per.crossJoin(F.broadcast(calendar)).withColumn("share", F.col("days") / F.col("all_days"))  # one row
    return out.filter((F.datediff("newest", "last") <= days) & (F.col("share") >= least_share)).select("code", "last", "days", "share")


def quality_report(bars: DataFrame, jump: float = 0.2, stale_days: int = 5) -> DataFrame:
    """Per code: rows, nulls, zero prices and volumes, inconsistent bars, jumps, gaps, staleness and a score of 1 less .3 an error and .1 a warning."""
    newest = bars.agg(F.max("date").alias("newest"))
    prices = ("open", "high", "low", "close")
    null = reduce(operator.or_, (F.col(c).isNull() for c in (*prices, "volume")))
    wrong = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = bars.withColumn("ret", change("close")).groupBy("code").agg(
        F.count(F.lit(1)).alias("rows"),
        count(null).alias("nulls"),
        count(reduce(operator.or_, (F.col(c) <= 0 for c in prices))).alias("zero_price"),
        count(F.col("volume") == 0).alias("zero_volume"),
        count(wrong).alias("inconsistent"),
        count(F.abs("ret") > jump).alias("jumps"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    )
    out = per.crossJoin(F.broadcast(newest))  # one row
    cover = F.try_divide("rows", (F.datediff("last", "first") + 1) * 5 / 7)
    errors = F.when(F.col("nulls") > 0.1 * F.col("rows"), 1).otherwise(0) + F.when(F.col("zero_price") > 0, 1).otherwise(0) + F.when(F.col("inconsistent") > 0, 1).otherwise(0)
    warnings = F.when(F.col("zero_volume") > 0.1 * F.col("rows"), 1).otherwise(0) + F.when(F.col("jumps") > 0, 1).otherwise(0) + F.when(cover < 0.8, 1).otherwise(0) + F.when(F.datediff("newest", "last") > stale_days, 1).otherwise(0)
    out = out.withColumns({"coverage": cover, "errors": errors, "warnings": warnings})
    return out.withColumn("score", F.greatest(F.lit(0.0), 1 - 0.3 * F.col("errors") - 0.1 * F.col("warnings"))).drop("newest")


def heal_last_day(bars: DataFrame, actions: DataFrame, limit: float = 0.15) -> DataFrame:
    """Closes of each code's last day that move more than `limit` without a known action take the close before; `healed` says so."""
    w = history()
    last = Window.partitionBy("code")
    marked = bars.withColumns({"before": F.lag("close").over(w), "newest": F.max("date").over(last)}).join(actions.select("code", F.col("date"), F.lit(True).alias("known")).distinct(), ["code", "date"], "left")
    bad = F.coalesce((F.col("date") == F.col("newest")) & (F.abs(F.try_divide("close", "before") - 1) > limit) & F.col("known").isNull(), F.lit(False))
    return marked.withColumns({"healed": bad, "close": F.when(bad, F.col("before")).otherwise(F.col("close"))}).drop("before", "newest", "known")


def compound_alerts(bars: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(code, date, rule) where a rule's SQL condition holds over the bars and their moving() columns; x_before is the bar before."""
    from quantloom.operators.indicators import moving

    frame = moving(bars)
    frame = frame.withColumns({f"{c}_before": F.lag(c).over(history()) for c in ("close", "sma_5", "sma_20", "sma_60", "bb_upper", "bb_lower")})
    hit = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(name)) for name, c in rules.items())))
    return frame.select("code", "date", F.explode(hit).alias("rule"))

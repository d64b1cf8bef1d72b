"""Breakouts, how long signals wait for them, and how signals fare by that wait, by accumulation score and by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import history, lag, last_rows, mean, numbered
from quantloom.operators.indicators import moving
from quantloom.operators.scores import COST

#: Days up to which a bucket of waits goes.
WAITS = (("0-5d", 5), ("5-10d", 10), ("10-20d", 20), ("20-30d", 30))


def breakouts(bars: DataFrame, most: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """(code, date, breakout, ttb) of every bar: whether it breaks out, and after how many bars, fewer than `most`, the next one does. `keep` names columns of the bars to return, too.

    A breakout closes above the upper Bollinger band while the bands widen, against the bar before and their mean of 20 bars, on
    a true range above 1.2 mean ranges and a volume above 1.5 means, both of 20 bars. Bands without a value have no width.
    """
    width = F.coalesce(F.when(F.col("sma_20") > 0, F.col("bb_width")), F.lit(0.0))
    rows = numbered(moving(bars).withColumn("_width", width).withColumn("_range", mean("tr", 20)))
    wider = (F.col("_width") > lag("_width")) & (F.col("_width") > F.avg("_width").over(last_rows(20)))
    hit = (F.col("close") > F.col("bb_upper")) & wider & (F.col("_range") > 0) & (F.col("tr") > 1.2 * F.col("_range")) & (F.col("volume") > 1.5 * F.avg("volume").over(last_rows(20)))
    rows = rows.withColumn("breakout", F.coalesce(hit, F.lit(False)))
    following = F.min(F.when(F.col("breakout"), F.col("_row"))).over(history().rowsBetween(1, most - 1))
    return rows.select("code", "date", "breakout", (following - F.col("_row")).cast("int").alias("ttb"), *keep)


def _net() -> list[Column]:
    net = F.col("d21") - COST
    won, lost = F.sum(F.when(net > 0, net)), F.sum(F.when(net <= 0, net))
    return [F.count(F.lit(1)).alias("signals"), F.avg(net).alias("net_return"), F.avg(F.when(net > 0, 1.0).when(net <= 0, 0.0)).alias("win_rate"), F.try_divide(F.when(lost < 0, F.coalesce(won, F.lit(0.0))), -lost).alias("profit_factor"), F.avg(F.col("busted").cast("double")).alias("busted_rate")]


def wait_buckets(signals: DataFrame) -> DataFrame:
    """Per bucket of ttb, the last for longer waits and none: signals, medians and means of d21 and d30, and the share of d21 above cost."""
    bucket = F.lit("30d+")
    for name, days in reversed(WAITS):
        bucket = F.when(F.col("ttb") <= days, name).otherwise(bucket)
    won = F.avg(F.when(F.col("d21") > COST, 1.0).when(F.col("d21").isNotNull(), 0.0))
    return signals.groupBy(bucket.alias("wait")).agg(F.count(F.lit(1)).alias("signals"), F.median("d21").alias("d21_median"), F.avg("d21").alias("d21_mean"), F.median("d30").alias("d30_median"), F.avg("d30").alias("d30_mean"), won.alias("win_rate"))


def score_strata(signals: DataFrame, at: float = 0.5) -> DataFrame:
    """For signals without an accumulation score (aqs), with one below `at` and from it on: waits, 21-day returns after cost, share that broke down."""
    stratum = F.when(F.col("aqs").isNull(), "none").when(F.col("aqs") < at, "low").otherwise("high")
    return signals.groupBy(stratum.alias("stratum")).agg(*_net(), F.median("ttb").alias("ttb_median"), F.avg("ttb").alias("ttb_mean"), F.median("d21").alias("d21_median"))


def by_year(signals: DataFrame) -> DataFrame:
    """Per year of the signal: signals, 21-day returns after cost, how many broke down."""
    return signals.groupBy(F.year("date").alias("year")).agg(*_net(), F.count(F.when(F.col("busted"), 1)).alias("busted"))

"""What strategies did, window by window: walk-forward tables, drift, exposure with hysteresis, confidence of means."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def walk_forward(trades: DataFrame, months: int = 3, exit_: str = "close_date") -> DataFrame:
    """Per calendar window of `months`: trades of (ret) that close in it, win rate, mean return, and the mean against that of the window before."""
    since = F.year(exit_) * 12 + F.month(exit_) - 1
    start = F.floor(since / months) * months
    day = F.make_date((start / 12).cast("int"), (start % 12 + 1).cast("int"), F.lit(1))
    out = trades.groupBy(day.alias("start")).agg(F.count(F.lit(1)).alias("trades"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("ret").alias("mean_ret"))
    return out.withColumn("efficiency", F.try_divide("mean_ret", F.lag("mean_ret").over(Window.partitionBy(F.lit(1)).orderBy("start"))))  # a row a window


def efficiency(windows: DataFrame) -> DataFrame:
    """One row of walk_forward(): windows, trades, the returns of the first half of the windows and of the rest, and the second over the first (0 where that is none)."""
    w = Window.partitionBy(F.lit(1)).orderBy("start")  # a row a window
    rows = windows.withColumns({"_i": F.row_number().over(w), "_m": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))), "_net": F.col("mean_ret") * F.col("trades")})
    early = F.col("_i") <= F.floor(F.col("_m") / 2)
    half = lambda c: F.coalesce(F.sum(F.when(c, F.col("_net"))), F.lit(0.0))
    out = rows.agg(F.count(F.lit(1)).alias("windows"), F.sum("trades").alias("trades"), half(early).alias("first_half"), half(~early).alias("second_half"))
    return out.withColumn("efficiency", F.coalesce(F.try_divide("second_half", "first_half"), F.lit(0.0)))


def bounds_check(realised: DataFrame, worst_run: int = 3) -> DataFrame:
    """Per code of (code, date, ret, low, high): share within the bounds, longest run below, and whether that is an alarm; a missing return ends a run."""
    w = Window.partitionBy("code").orderBy("date")
    below = F.coalesce(F.col("ret") < F.col("low"), F.lit(False))
    rows = realised.withColumn("below", below).withColumn("island", F.sum(F.when(F.col("below"), 0).otherwise(1)).over(w))
    runs = rows.groupBy("code", "island").agg(F.sum(F.col("below").cast("int")).alias("run"), F.sum(F.when(F.col("ret").between(F.col("low"), F.col("high")), 1).otherwise(0)).alias("inside"), F.count("ret").alias("n"))
    out = runs.groupBy("code").agg(F.try_divide(F.sum("inside"), F.sum("n")).alias("in_bounds"), F.max("run").alias("longest"))
    return out.withColumn("alarm", F.col("longest") >= worst_run)


def exposure(regimes: DataFrame, targets: dict[str, float], days: int = 2, at_once: tuple[str, ...] = ("LOCKDOWN", "CAUTION")) -> DataFrame:
    """Per day of (date, regime) the exposure: a regime's target from its `days`-th day in a row on, at once for those of `at_once`; 1 before any."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # a row a day
    rows = regimes.withColumn("new", F.coalesce(F.col("regime") != F.lag("regime").over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    rows = rows.withColumn("streak", F.row_number().over(Window.partitionBy("run").orderBy("date")))
    target = F.coalesce(*(F.when(F.col("regime") == k, F.lit(v)) for k, v in targets.items()))
    held = F.last(F.when((F.col("streak") >= days) | F.col("regime").isin(*at_once), target), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("date", "regime", "streak", F.coalesce(held, F.lit(1.0)).alias("exposure"))


def mean_interval(values: DataFrame, key: str, column: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Per key the mean of a column and the 2.5 and 97.5 percentiles of `draws` resampled means.

    A mean of n values drawn with replacement is a weighted mean with Poisson weights of one per value. A weight follows
    from the hash of its row, draw and seed, so it does not matter how the rows are partitioned; parts of a key's values
    are combined by sums, so no key has to fit into one task. Rows that are equal in all columns are counted first and get
    the sum of as many weights; above 64 that is drawn from the normal distribution of the same mean and variance.
    """
    cumulative = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])

    salts = np.arange(1, draws + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)

    def uniform(row: np.ndarray, j: int) -> np.ndarray:
        """Numbers in [0, 1), a row a draw, for the j-th copies of rows."""
        h = (row + np.uint64(j * 0xD1342543DE82EF95 % (1 << 64)))[None, :] ^ salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53

    def weigh(batches):
        for batch in batches:
            for k, own in batch.groupby("key"):
                for at in range(0, len(own), 1024):
                    some = own.iloc[at : at + 1024]
                    row, copies = some["row"].to_numpy().astype(np.uint64), some["copies"].to_numpy()
                    w = np.zeros((draws, len(some)))
                    for j in range(min(int(copies.max()), 64)):
                        w += np.where((copies > j) & (copies <= 64), np.searchsorted(cumulative, uniform(row, j), side="right"), 0)
                    if (many := copies > 64).any():
                        z = sum(uniform(row[many], 64 + j) for j in range(12)) - 6
                        w[:, many] = np.maximum(0.0, copies[many] + np.sqrt(copies[many]) * z)
                    yield pd.DataFrame({"key": k, "draw": np.arange(draws, dtype="int32"), "total": w @ some["x"].to_numpy(), "weight": w.sum(axis=1).astype(float)})

    rows = values.filter(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("double").alias("x"), F.xxhash64(F.lit(seed), *values.columns).alias("row"))
    once = rows.groupBy("key", "x", "row").agg(F.count(F.lit(1)).alias("copies"))
    drawn = once.mapInPandas(weigh, f"key {dict(rows.dtypes)['key']}, draw int, total double, weight double").groupBy("key", "draw").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("m"))
    ends = drawn.groupBy("key").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rows.groupBy("key").agg(F.avg("x").alias("mean"), F.count("x").alias("n")).join(ends, "key").withColumnRenamed("key", key)

"""Scores of signals held against what came after them, and the order in which signals are worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import history

#: Share of a round trip that fees and taxes take.
COST = 0.005855


def past_value(rows: DataFrame, horizon: int = 20, number: str | None = None) -> DataFrame:
    """`rows` (code, date, signal, d<horizon>: every bar) with ev and cases: mean outcome and number of the code's BUY bars whose outcome is known by then.

    With `number`, a column that counts the bars of a code, bars may be missing; those without a BUY change nothing.
    """
    known = F.when(F.col("signal") == "BUY", F.col(f"d{horizon}"))
    w = history().rowsBetween(Window.unboundedPreceding, -horizon) if number is None else history(order=number).rangeBetween(Window.unboundedPreceding, -horizon)
    return rows.withColumns({"ev": F.avg(known).over(w), "cases": F.count(known).over(w)})


def outcomes() -> list[Column]:
    """What score_groups() tells of a group: from d5, d20, gain_5 and loss_5."""
    net = lambda x: F.avg(x) - COST
    wins, losses = F.sum(F.when(F.col("d5") > 0, F.col("d5"))), F.sum(F.when(F.col("d5") <= 0, F.col("d5")))
    rate = lambda x: F.avg(F.when(F.col(x) > 0, 1.0).when(F.col(x) <= 0, 0.0))
    return [
        F.count(F.lit(1)).alias("signals"), F.count("d5").alias("count_5"), F.count("d20").alias("count_20"), rate("d5").alias("win_rate_5"), rate("d20").alias("win_rate_20"), F.avg("d5").alias("return_5"), F.avg("d20").alias("return_20"),
        net("d5").alias("net_5"), net("d20").alias("net_20"), F.avg("gain_5").alias("gain_5"), F.avg("loss_5").alias("loss_5"), F.try_divide(wins, F.abs(losses)).alias("profit_factor"),
    ]


def score_groups(scored: DataFrame, thresholds: tuple[int, ...] = (40, 60, 80)) -> DataFrame:
    """A row for all signals, for those of at least each threshold, for each grade and each regime: outcomes(), share of all, and lift of win rate and return over all.

    `scored` has sqs, grade, regime, d5, d20, gain_5 and loss_5. Groups without signals have no row; a group without gains or
    losses has no profit factor.
    """
    names = [F.lit("all"), *(F.when(F.col("sqs") >= t, F.lit(f"sqs_{t}")) for t in thresholds), F.concat(F.lit("grade_"), "grade"), F.concat(F.lit("regime_"), "regime")]
    rows = scored.select("d5", "d20", "gain_5", "loss_5", F.explode(F.array_compact(F.array(*names))).alias("group"))
    groups = rows.groupBy("group").agg(*outcomes())
    one = Window.partitionBy(F.lit(1))  # A row a group.
    of_all = lambda x: F.max(F.when(F.col("group") == "all", F.col(x))).over(one)
    return groups.withColumns({"share": F.col("signals") / of_all("signals"), "lift_win_rate": F.col("win_rate_5") - of_all("win_rate_5"), "lift_return": F.col("return_5") - of_all("return_5")})


def score_summary(scored: DataFrame) -> DataFrame:
    """One row: least, greatest, mean and percentiles of sqs, and the counts of ten equal bins from 0 to 100."""
    bins = F.least(F.floor(F.col("sqs") / 10), F.lit(9))
    at = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    counts = F.array(*(F.count(F.when(bins == i, 1)) for i in range(10)))
    return scored.agg(F.count("sqs").alias("signals"), F.min("sqs").alias("low"), F.max("sqs").alias("high"), F.avg("sqs").alias("mean"), *(F.percentile("sqs", F.lit(p)).alias(k) for k, p in at.items()), F.array_join(counts.cast("array<string>"), ",").alias("histogram"))


def period_metrics(scored: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Per grade and horizon: known outcomes d<n>, share of gains, mean before and after cost, median, best and worst."""
    spans = F.explode(F.array(*(F.struct(F.lit(n).alias("days"), F.col(f"d{n}").alias("ret")) for n in horizons))).alias("x")
    rows = scored.select("grade", spans).select("grade", "x.*").filter("ret IS NOT NULL")
    gained = F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    return rows.groupBy("grade", "days").agg(F.count(F.lit(1)).alias("count"), gained.alias("win_rate"), F.avg("ret").alias("avg_return"), (F.avg("ret") - COST).alias("net_return"), F.median("ret").alias("median_return"), F.max("ret").alias("best"), F.min("ret").alias("worst"))


def cumulative_curve(scored: DataFrame, of: str = "d5") -> DataFrame:
    """(code, date, sqs, grade, ret, net, cumulative): running sum of net outcomes in order of dates, then codes.

    Days are added up first, so that only a row a day is put in one order; within a day the sum goes on from the day before.
    """
    rows = scored.select("code", "date", "sqs", "grade", F.col(of).alias("ret"), (F.col(of) - COST).alias("net")).filter("ret IS NOT NULL")
    days = rows.groupBy("date").agg(F.sum("net").alias("day"))
    before = F.coalesce(F.sum("day").over(Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    within = F.sum("net").over(Window.partitionBy("date").orderBy("code").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within).join(days.select("date", before.alias("before")), "date").select("code", "date", "sqs", "grade", "ret", "net", (F.col("before") + F.col("within")).alias("cumulative"))


def action_tag(today: Column) -> Column:
    """What to do about a signal: columns is_live, trailing_phase, date and phase. Held ones first, then those of today, then those near a breakout."""
    held = F.coalesce("is_live", F.lit(False))
    return F.when(held & (F.col("trailing_phase") >= 2), "trailing").when(held, "held").when(F.col("date") == today, "new").when(F.col("phase").isin("BETA", "GAMMA_READY"), "try").otherwise("watch")

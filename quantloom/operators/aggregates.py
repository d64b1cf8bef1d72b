"""Aggregations over trades, flows and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.quantiles import quantiles


def _with_result(trades: DataFrame) -> DataFrame:
    return trades.withColumn("pnl", F.col("proceeds") - F.col("cost")).withColumn("ret", F.try_divide("pnl", "cost"))


def trade_stats(trades: DataFrame, *by: str) -> DataFrame:
    """Trades, win rate, average win and loss, profit factor (999 without a loss) and expectancy, per group or overall."""
    t = _with_result(trades)
    won, lost = F.col("pnl") > 0, F.col("pnl") <= 0
    wins, losses = F.sum(F.when(won, F.col("pnl")).otherwise(0.0)), -F.sum(F.when(lost, F.col("pnl")).otherwise(0.0))
    return t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg(F.when(won, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(F.when(won, F.col("pnl"))).alias("avg_win"),
        F.avg(F.when(lost, F.col("pnl"))).alias("avg_loss"),
        F.coalesce(F.try_divide(wins, losses), F.lit(999.0)).alias("profit_factor"),
        F.avg("pnl").alias("expectancy"),
        F.max_by("trade_id", F.struct("pnl", -F.col("trade_id"))).alias("best_trade"),
        F.min_by("trade_id", F.struct("pnl", "trade_id")).alias("worst_trade"),
    )


def tag_performance(trades: DataFrame, tags: str = "tag") -> DataFrame:
    """trade_stats() of each of a trade's comma-separated tags."""
    split = trades.withColumn("tag", F.explode(F.split(tags, ","))).withColumn("tag", F.trim("tag")).filter("tag <> ''")
    return trade_stats(split, "tag").select("tag", "trades", "win_rate", "expectancy")


def holding_brackets(trades: DataFrame, edges: tuple[int, ...] = (0, 30, 60, 90)) -> DataFrame:
    """Trades and win rate by half-open brackets of days held."""
    days = F.datediff("close_date", "open_date")
    bracket = F.lit(None).cast("int")
    for edge in edges:
        bracket = F.when(days >= edge, F.lit(edge)).otherwise(bracket)
    return trade_stats(trades.withColumn("bracket", bracket).filter("bracket is not null"), "bracket").select("bracket", "trades", "win_rate")


def exit_barometer(trades: DataFrame, sectors: DataFrame) -> DataFrame:
    """Trades and mean return by sector and tag, by sector, and overall, in one pass; null stands for all."""
    return _with_result(trades).join(sectors, "code").rollup("sector", "tag").agg(F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("mean_ret"))


def horizon_stats(forward: DataFrame, horizons: list[str], cost: float = 0.004) -> DataFrame:
    """Per horizon, net of cost: mean, median, deviation, win rate, share above 2 %, quantiles, average win and loss, expectancy."""
    long = forward.unpivot(["code", "date"], horizons, "horizon", "gross").filter("gross is not null").withColumn("ret", F.col("gross") - cost)
    win = F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    up, down = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") <= 0, F.col("ret")))
    out = long.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.min("ret").alias("min"), F.max("ret").alias("max"), win.alias("win_rate"), F.avg(F.when(F.col("ret") > 0.02, 1.0).otherwise(0.0)).alias("hit_rate"), up.alias("avg_win"), down.alias("avg_loss")
    )
    out = out.join(F.broadcast(quantiles(long, "horizon", "ret", {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95)})), "horizon")  # a row a horizon
    return out.withColumn("expectancy", F.col("win_rate") * F.coalesce("avg_win", F.lit(0.0)) + (1 - F.col("win_rate")) * F.coalesce("avg_loss", F.lit(0.0)))


def longest_runs(bars: DataFrame, worst: float = -0.05) -> DataFrame:
    """Per code the longest run of days whose return is below `worst`; a missing return ends a run."""
    w = Window.partitionBy("code").orderBy("date")
    marked = bars.withColumn("hit", F.coalesce(F.try_divide("close", F.lag("close").over(w)) - 1 < worst, F.lit(False)))
    island = marked.withColumn("island", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(w)).filter("hit")
    runs = island.groupBy("code", "island").agg(F.count(F.lit(1)).alias("length"), F.min("date").alias("start"))
    return runs.groupBy("code").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("runs"), F.min_by("start", F.struct(-F.col("length"), "start")).alias("longest_start"))


def distribution(values: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """Histogram of a column: bucket (0 and bins + 1 lie outside), its count and share."""
    out = values.filter(F.col(column).isNotNull()).groupBy(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # bins + 2 rows


def recency_weighted(forward: DataFrame, column: str, today, half_life_days: float = 730.0) -> DataFrame:
    """Per code the mean of a column, weighted by 2 to the minus age over half-life; weights of missing values count, too."""
    weight = F.pow(F.lit(2.0), -F.datediff(F.lit(today), "date") / F.lit(half_life_days))
    rows = forward.withColumn("w", weight)
    return rows.groupBy("code").agg(F.try_divide(F.sum(F.col("w") * F.col(column)), F.sum("w")).alias("weighted_mean"), F.count(column).alias("n"))


def broker_scores(flows: DataFrame, forward: DataFrame, sectors: DataFrame, horizon: str = "d21", least: int = 15) -> DataFrame:
    """Brokers' net-buy days judged by what followed: win rate times payoff, concentration over sectors and bias to one."""
    bought = flows.filter("buy > sell").join(forward.select("code", "date", F.col(horizon).alias("ret")), ["code", "date"]).filter("ret is not null").join(sectors, "code")
    per = bought.groupBy("broker", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("ret") > 0, 1).otherwise(0)).alias("wins"), F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)).alias("gain"), F.sum(F.when(F.col("ret") <= 0, F.col("ret")).otherwise(0.0)).alias("loss")
    )
    share = per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("broker")))
    out = share.groupBy("broker").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("gain").alias("gain"), F.sum("loss").alias("loss"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top_share"))
    payoff = F.try_divide(F.try_divide("gain", "wins"), F.abs(F.try_divide(F.col("loss"), F.col("n") - F.col("wins"))))
    return out.filter(F.col("n") >= least).select("broker", "n", (F.col("wins") / F.col("n")).alias("win_rate"), ((F.col("wins") / F.col("n")) * payoff).alias("score"), "hhi", (F.col("top_share") > 0.5).alias("one_sector"))


def broker_features(flows: DataFrame) -> DataFrame:
    """Per code and day: concentration of the buying, share of the three largest buyers, net-buy ratio of the five largest, buyers less sellers."""
    w = Window.partitionBy("code", "date")
    ranked = flows.withColumns({"total": F.sum("buy").over(w), "turnover": F.sum(F.col("buy") + F.col("sell")).over(w), "place": F.row_number().over(w.orderBy(F.desc("buy"), "broker"))})
    share = F.try_divide("buy", "total")
    return ranked.groupBy("code", "date").agg(
        F.sum(share * share).alias("hhi"),
        F.sum(F.when(F.col("place") <= 3, share)).alias("top3_share"),
        F.sum(F.when(F.col("place") <= 5, F.try_divide(F.col("buy") - F.col("sell"), "turnover"))).alias("net_buy_5"),
        (F.sum(F.when(F.col("buy") > F.col("sell"), 1).otherwise(0)) - F.sum(F.when(F.col("buy") < F.col("sell"), 1).otherwise(0))).alias("buyer_spread"),
    )

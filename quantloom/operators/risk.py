"""Risk of codes and portfolios: value at risk, drawdown, beta, liquidity, attribution."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, history, last_rows


def value_at_risk(bars: DataFrame, confidence: float = 0.95, least: int = 20) -> DataFrame:
    """Per code: historical and parametric value at risk of a day's return, and the mean return beyond the historical one."""
    returns = bars.withColumn("ret", change("close")).filter("ret is not null")
    cut = returns.withColumn("cut", F.percentile("ret", F.lit(1 - confidence)).over(Window.partitionBy("code")))
    z = NormalDist().inv_cdf(1 - confidence)
    out = cut.groupBy("code").agg(
        F.count("ret").alias("days"), F.max("cut").alias("var_hist"), (F.avg("ret") + z * F.stddev_samp("ret")).alias("var_param"), F.avg(F.when(F.col("ret") <= F.col("cut"), F.col("ret"))).alias("cvar")
    )
    return out.filter(F.col("days") >= least)


def var_breaches(bars: DataFrame, window: int = 250, confidence: float = 0.95) -> DataFrame:
    """Per code: days judged by the value at risk of the window before them, breaches, and their share."""
    w = history().rowsBetween(-window, -1)
    returns = bars.select("code", "date", change("close").alias("ret")).filter("ret is not null")
    judged = returns.withColumn("var", F.when(F.count("ret").over(w) >= window, F.percentile("ret", F.lit(1 - confidence)).over(w))).filter("var is not null")
    hit = F.sum(F.when(F.col("ret") < F.col("var"), 1).otherwise(0))
    return judged.groupBy("code").agg(F.count(F.lit(1)).alias("days"), hit.alias("breaches"), (hit / F.count(F.lit(1))).alias("breach_rate"))


def drawdown(bars: DataFrame) -> DataFrame:
    """Per code: greatest drawdown, ulcer index, bars since the peak at the end."""
    w = history().rowsBetween(Window.unboundedPreceding, 0)
    peaks = bars.withColumn("peak", F.max("close").over(w)).withColumn("dd", F.try_divide("close", "peak") - 1).withColumn("_row", F.row_number().over(history()))
    peaks = peaks.withColumn("at", F.max(F.when(F.col("close") == F.col("peak"), F.col("_row"))).over(w))
    return peaks.groupBy("code").agg(F.min("dd").alias("max_drawdown"), F.sqrt(F.avg(F.col("dd") * F.col("dd") * 10000)).alias("ulcer"), (F.max("_row") - F.max("at")).alias("bars_since_peak"))


def _with_index(bars: DataFrame, index: DataFrame) -> DataFrame:
    base = index.withColumn("code", F.lit(0)).select("date", change("close").alias("mkt"))
    own = bars.select("code", "date", change("close").alias("ret"))
    return own.join(base, "date").filter("ret is not null and mkt is not null")


def alpha_beta(bars: DataFrame, index: DataFrame) -> DataFrame:
    """Per code against the index: beta, daily alpha, r2, betas of rising and falling days, capture of both."""
    both = _with_index(bars, index)
    up, down = F.col("mkt") > 0, F.col("mkt") < 0
    on = lambda c, x: F.when(c, F.col(x))
    return both.groupBy("code").agg(
        F.regr_slope("ret", "mkt").alias("beta"),
        F.regr_intercept("ret", "mkt").alias("alpha"),
        F.regr_r2("ret", "mkt").alias("r2"),
        F.regr_slope(on(up, "ret"), on(up, "mkt")).alias("up_beta"),
        F.regr_slope(on(down, "ret"), on(down, "mkt")).alias("down_beta"),
        F.try_divide(F.avg(on(up, "ret")), F.avg(on(up, "mkt"))).alias("up_capture"),
        F.try_divide(F.avg(on(down, "ret")), F.avg(on(down, "mkt"))).alias("down_capture"),
    )


def liquidity(bars: DataFrame, order: float = 1000.0, share: float = 0.1, window: int = 20) -> DataFrame:
    """Per code on its last day: average volume, days to sell `order`, square-root impact, relative spread, and their 40/40/20 score."""
    w = last_rows(window)
    own = bars.withColumn("lr", F.ln(F.try_divide("close", F.lag("close").over(history()))))
    last = own.withColumns(
        {"adv": F.avg("volume").over(w), "sigma": F.stddev_pop("lr").over(w), "spread": F.avg(F.try_divide(F.col("high") - F.col("low"), "close")).over(w), "_n": F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))}
    ).filter("_n = 1")
    out = last.select("code", "date", "adv", F.try_divide(F.lit(order), F.col("adv") * share).alias("days_to_sell"), (F.col("sigma") * F.sqrt(F.try_divide(F.lit(order), "adv"))).alias("impact"), "spread")
    part = lambda x, worst: F.greatest(F.lit(0.0), 1 - F.col(x) / worst) * 100
    return out.withColumn("score", 0.4 * part("days_to_sell", 10.0) + 0.4 * part("impact", 0.5) + 0.2 * part("spread", 1.0))


def brinson(weights: DataFrame) -> DataFrame:
    """Allocation, selection and interaction per sector of (sector, wp, rp, wb, rb): portfolio and benchmark weights and returns."""
    total = weights.withColumn("bench", F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy(F.lit(1))))  # a row a sector
    return total.select(
        "sector",
        ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("bench"))).alias("allocation"),
        (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"),
        ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"),
    )


def concentration(positions: DataFrame, issue_limit: float = 0.2, sector_limit: float = 0.4) -> DataFrame:
    """(code, sector, value): shares of the portfolio and whether they break their limits."""
    whole = F.sum("value").over(Window.partitionBy(F.lit(1)))  # a portfolio's positions
    out = positions.withColumns({"share": F.col("value") / whole, "sector_share": F.sum("value").over(Window.partitionBy("sector")) / whole})
    return out.withColumns({"issue_breach": F.col("share") > issue_limit, "sector_breach": F.col("sector_share") > sector_limit})


def equity_metrics(curve: DataFrame, rf: float = 0.015) -> DataFrame:
    """Per code of an equity curve (code, date, equity): returns, volatility, drawdown, Sharpe, Sortino and Calmar ratios."""
    w = history()
    out = curve.withColumns({"ret": F.try_divide("equity", F.lag("equity").over(w)) - 1, "peak": F.max("equity").over(w)})
    excess = F.col("ret") - rf / 252
    agg = out.groupBy("code").agg(
        (F.try_divide(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1).alias("total_return"),
        F.count("ret").alias("days"),
        F.stddev_samp("ret").alias("sd"),
        F.avg(excess).alias("mean_excess"),
        F.stddev_samp(F.when(excess < 0, excess)).alias("down_sd"),
        F.min(F.try_divide("equity", "peak") - 1).alias("max_drawdown"),
    )
    annual = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), F.lit(252.0) / F.greatest("days", F.lit(1))) - 1)
    agg = agg.withColumn("annual_return", annual)
    return agg.withColumns({"sharpe": F.try_divide("mean_excess", "sd") * F.sqrt(F.lit(252.0)), "sortino": F.try_divide("mean_excess", "down_sd") * F.sqrt(F.lit(252.0)), "calmar": F.try_divide("annual_return", F.abs("max_drawdown"))}).drop("mean_excess", "down_sd")

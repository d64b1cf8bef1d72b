"""Portfolios: returns, stress, heat, factors, sectors that move together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, lag
from quantloom.operators.indicators import recursive

#: Scenario, shock to the market, shock to the largest holding.
SCENARIOS = (
    ("COVID_2020", -0.285, None),
    ("RATE_HIKE_2022", -0.22, None),
    ("TAIWAN_STRAIT_2022", -0.05, None),
    ("TECH_BUBBLE_2000", -0.30, None),
    ("MARKET_CRASH_10", -0.10, None),
    ("SINGLE_LIMIT_DOWN", 0.0, -0.10),
    ("RATE_SHOCK", -0.05, None),
    ("BLACK_SWAN", -0.20, None),
)


def composite_signals(bars: DataFrame, buy: float = 0.3, sell: float = -0.3, confirm: int = 2) -> DataFrame:
    """Six scores between -1 and 1, their weighted sum, and the signal after the trend, volume and confirmation filters.

    A buy needs the 20-bar average at or above the 60-bar one, volume at or above its 5-bar average, and `confirm` bars in a row that
    would buy. A score whose inputs are missing is 0.
    """
    read = ("sma_5", "sma_20", "sma_60", "vol_5", "vol_ratio", "bb_upper", "bb_lower", "rsi", "macd", "macd_signal", "macd_hist", "k", "d")
    frame = recursive(bars.select("code", "date", "high", "low", "close", "volume"), only=read)
    side = lambda yes: F.when(yes, 0.5).otherwise(-0.5)
    known = lambda value, *of: F.when(F.greatest(*(F.col(c).isNull() for c in of)) if len(of) > 1 else F.col(of[0]).isNull(), 0.0).otherwise(value)
    up, busy = F.col("close") > F.col("sma_5"), F.col("vol_ratio") > 1
    width = F.col("bb_upper") - F.col("bb_lower")
    scores = {
        "score_ma": known(side(F.col("sma_5") > F.col("sma_20")) + side(F.col("sma_20") > F.col("sma_60")), "sma_5", "sma_20", "sma_60"),
        "score_rsi": known(F.greatest(F.least((50 - F.col("rsi")) / 20, F.lit(1.0)), F.lit(-1.0)), "rsi"),
        "score_macd": known(side(F.col("macd") > F.col("macd_signal")) + side(F.col("macd_hist") > 0), "macd", "macd_signal"),
        "score_kd": known(side(F.col("k") > F.col("d")) + F.when(F.col("k") < 20, 0.5).when(F.col("k") > 80, -0.5).otherwise(0.0), "k", "d"),
        "score_bb": known(F.when(F.abs(width) < 1e-10, 0.0).otherwise(1 - 2 * F.try_divide(F.col("close") - F.col("bb_lower"), width)), "bb_upper", "bb_lower"),
        "score_volume": known(F.when(up & busy, 0.5).when(~up & ~busy, 0.3).when(~up & busy, -1.0).otherwise(0.0), "vol_ratio", "sma_5"),
    }
    weights = {"score_ma": 0.2, "score_rsi": 0.2, "score_macd": 0.2, "score_kd": 0.2, "score_bb": 0.1, "score_volume": 0.1}
    frame = frame.withColumns(scores).withColumn("composite", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)))
    frame = frame.withColumn("raw_signal", F.when(F.col("composite") >= buy, "BUY").when(F.col("composite") <= sell, "SELL").otherwise("HOLD"))
    run = F.sum(F.when(F.col("raw_signal") == "BUY", 1).otherwise(0)).over(Window.partitionBy("code").orderBy("date").rowsBetween(1 - confirm, 0))
    # A bar whose window is not full yet is not held back for want of confirmation.
    full = F.row_number().over(Window.partitionBy("code").orderBy("date")) >= confirm
    stop = (F.col("sma_20") < F.col("sma_60")) | (F.col("volume") < F.col("vol_5")) | (full & (run < confirm))
    signal = F.when((F.col("raw_signal") == "BUY") & F.coalesce(stop, F.lit(False)), "HOLD").otherwise(F.col("raw_signal"))
    return frame.select("code", "date", *scores, "composite", "raw_signal", signal.alias("signal"))


def portfolio_returns(bars: DataFrame, weights: DataFrame) -> DataFrame:
    """Daily returns of (code, weight), weights made to add up to 1, on days on which every code has one."""
    held = weights.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1)))).withColumn("codes", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # a portfolio
    own = bars.join(F.broadcast(held.select("code")), "code", "left_semi").select("code", "date", change("close").alias("ret")).filter("ret is not null")
    day = own.join(F.broadcast(held), "code").groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.count(F.lit(1)).alias("n"), F.first("codes").alias("codes"))
    return day.filter("n = codes").select("date", "ret")


def stress_test(spark: SparkSession, holdings: DataFrame, betas: DataFrame, scenarios: tuple = SCENARIOS) -> DataFrame:
    """Per scenario what (code, value) loses by its betas (1 where missing), and the code that loses most; ties by code."""
    shocks = F.broadcast(spark.createDataFrame(scenarios, "scenario string, market double, largest double"))
    whole = Window.partitionBy(F.lit(1))  # a portfolio's holdings
    held = holdings.join(betas, "code", "left").withColumns({"share": F.col("value") / F.sum("value").over(whole), "top": F.col("value") == F.max("value").over(whole)})
    hit = held.crossJoin(shocks)  # eight rows
    loss = F.round(F.col("share") * F.when(F.col("top") & F.col("largest").isNotNull(), F.col("largest")).otherwise(F.coalesce("beta", F.lit(1.0)) * F.col("market")), 6)
    return hit.withColumn("loss", loss).groupBy("scenario").agg(F.round(F.sum("loss"), 4).alias("portfolio_pnl"), F.min(F.struct("loss", "code")).alias("worst")).select("scenario", "portfolio_pnl", F.col("worst.code").alias("worst_code"), F.col("worst.loss").alias("worst_pnl"))


def heat(positions: DataFrame, correlations: DataFrame) -> DataFrame:
    """Per sector of (code, sector, risk): raw heat, heat after the penalty for the three closest pairs, its share, and the portfolio's zone."""
    top = correlations.orderBy(F.desc("corr"), "code_a", "code_b").limit(3).agg(F.avg("corr").alias("top3"))
    penalty = F.when(F.col("top3") >= 0.7, 1.5).when(F.col("top3") >= 0.5, 1.25).otherwise(1.0)
    per = positions.groupBy("sector").agg(F.sum("risk").alias("raw")).crossJoin(F.broadcast(top))  # one row
    per = per.withColumn("heat", F.col("raw") * penalty).withColumn("total", F.sum("heat").over(Window.partitionBy(F.lit(1))))
    zone = F.when(F.col("total") < 0.03, "cool").when(F.col("total") < 0.06, "warm").when(F.col("total") < 0.10, "hot").otherwise("over")
    return per.select("sector", "raw", "heat", F.try_divide("heat", "total").alias("share"), zone.alias("zone"))


def sector_days(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector, date, ret): daily returns of each sector, weighted by the volume of the day before."""
    own = bars.withColumns({"ret": change("close"), "weight": lag("volume")}).filter("ret is not null").join(sectors, "code")
    return own.groupBy("sector", "date").agg(F.try_divide(F.sum(F.col("ret") * F.col("weight")), F.sum("weight")).alias("ret"))


def sector_pairs(days: DataFrame) -> DataFrame:
    """(sector_a, sector_b, date, x, y): the returns of each pair of sectors on the days both have."""
    a, b = days.alias("a"), days.alias("b")
    both = a.join(b, (F.col("a.date") == F.col("b.date")) & (F.col("a.sector") < F.col("b.sector")))
    return both.select(F.col("a.sector").alias("sector_a"), F.col("b.sector").alias("sector_b"), F.col("a.date").alias("date"), F.col("a.ret").alias("x"), F.col("b.ret").alias("y"))


def sector_correlations(bars: DataFrame, sectors: DataFrame, window: int = 90) -> DataFrame:
    """Per day the correlation of each pair of sectors' volume-weighted returns over the last `window` days both have."""
    w = Window.partitionBy("sector_a", "sector_b").orderBy("date").rowsBetween(1 - window, 0)
    return sector_pairs(sector_days(bars, sectors)).select("sector_a", "sector_b", "date", F.when(F.count(F.lit(1)).over(w) >= window, F.corr("x", "y").over(w)).alias("corr"))


def _uniform(draw: Column, place: Column) -> Column:
    """A number in (0, 1] that hangs on the draw and the place only: congruences modulo a prime, two of them quadratic."""
    prime = F.lit((1 << 31) - 1)
    x = (draw * 1000003 + place * 7919 + 1) % prime
    x = (x * x + draw) % prime
    x = (x * 48271 + place) % prime
    return (x * x % prime + 1) / prime


def frontier(spark: SparkSession, returns: DataFrame, draws: int = 3000, days: int = 60, rf: float = 0.015) -> DataFrame:
    """draw, ret, vol, sharpe (of a year) and best of `draws` portfolios of (asset, date, ret) with weights drawn at random.

    Means and covariances are those of the last `days` days on which every asset has a return. `returns` is a portfolio's,
    so its assets, and their pairs, are few. best marks the greatest Sharpe ratio (ties: the first draw).
    """
    held = returns.filter("ret IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date")))
    assets = held.select("asset").distinct()
    whole = held.crossJoin(F.broadcast(assets.agg(F.count(F.lit(1)).alias("all")))).filter(F.col("n") == F.col("all"))  # one row
    recent = whole.select("date").distinct().orderBy(F.desc("date")).limit(days)
    rows = whole.join(F.broadcast(recent), "date", "left_semi").select("asset", "date", "ret")
    means = rows.groupBy("asset").agg((F.avg("ret") * 252).alias("mean"))
    other = rows.select(F.col("asset").alias("other"), "date", F.col("ret").alias("ret_b"))
    cov = rows.join(other, "date").groupBy("asset", "other").agg((F.covar_samp("ret", "ret_b") * 252).alias("cov"))
    placed = assets.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("asset")))  # a portfolio's assets
    drawn = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(placed)).withColumn("u", _uniform(F.col("draw"), F.col("place").cast("long")))
    weights = drawn.select("draw", "asset", (F.col("u") / F.sum("u").over(Window.partitionBy("draw"))).alias("w"))
    gain = weights.join(F.broadcast(means), "asset").groupBy("draw").agg(F.sum(F.col("w") * F.col("mean")).alias("ret"))
    also = weights.select("draw", F.col("asset").alias("other"), F.col("w").alias("w_b"))
    risk = weights.join(F.broadcast(cov), "asset").join(also, ["draw", "other"]).groupBy("draw").agg(F.sqrt(F.greatest(F.sum(F.col("w") * F.col("w_b") * F.col("cov")), F.lit(0.0))).alias("vol"))
    out = gain.join(risk, "draw").withColumn("sharpe", F.coalesce(F.try_divide(F.col("ret") - rf, "vol"), F.lit(0.0)))
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("sharpe"), "draw")) == 1  # the draws
    return out.select("draw", "ret", "vol", "sharpe", best.alias("best"))


def factor_exposure(bars: DataFrame, index: DataFrame, days: int = 20) -> DataFrame:
    """Per code the least-squares loadings of its returns on the market and on the market's momentum, and the intercept.

    The normal equations of two factors are sums, so they add up in one aggregation and are solved per code.
    """
    base = index.withColumn("code", F.lit(0)).withColumn("mkt", change("close")).withColumn("mom", F.lag(change("close", days)).over(Window.partitionBy("code").orderBy("date"))).filter("mkt is not null and mom is not null")
    own = bars.select("code", "date", change("close").alias("ret")).filter("ret is not null").join(base.select("date", "mkt", "mom"), "date")
    s = own.groupBy("code").agg(*(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in (("mkt", "mkt"), ("mkt", "mom"), ("mom", "mom"), ("mkt", "ret"), ("mom", "ret"))), *(F.avg(c).alias(f"m_{c}") for c in ("mkt", "mom", "ret")))
    det = F.col("mkt_mkt") * F.col("mom_mom") - F.col("mkt_mom") * F.col("mkt_mom")
    s = s.withColumns({"market": F.try_divide(F.col("mkt_ret") * F.col("mom_mom") - F.col("mom_ret") * F.col("mkt_mom"), det), "momentum": F.try_divide(F.col("mom_ret") * F.col("mkt_mkt") - F.col("mkt_ret") * F.col("mkt_mom"), det)})
    return s.select("code", "market", "momentum", (F.col("m_ret") - F.col("market") * F.col("m_mkt") - F.col("momentum") * F.col("m_mom")).alias("alpha"))


def kelly(trades: DataFrame, breadth: float = 1.0) -> DataFrame:
    """Half the Kelly share of (code, ret), scaled by market breadth, never below 0."""
    win, loss = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.abs(F.avg(F.when(F.col("ret") <= 0, F.col("ret"))))
    out = trades.groupBy("code").agg(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("p"), F.try_divide(win, loss).alias("payoff"))
    return out.withColumn("share", F.greatest(F.lit(0.0), (F.col("p") - F.try_divide(1 - F.col("p"), "payoff")) / 2 * breadth))


def rebalance(holdings: DataFrame, targets: DataFrame, prices: DataFrame, lot: int = 1000) -> DataFrame:
    """Lots to buy (or sell, below 0) to go from (code, shares) to (code, weight) at the prices' value; whole lots, towards zero."""
    both = holdings.join(targets, "code", "full_outer").join(prices, "code").select("code", F.coalesce("shares", F.lit(0)).alias("shares"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "price")
    value = F.sum(F.col("shares") * F.col("price")).over(Window.partitionBy(F.lit(1)))  # a portfolio
    gap = F.try_divide(value * F.col("weight"), "price") - F.col("shares")
    return both.select("code", "shares", "weight", F.when(gap >= 0, F.floor(gap / lot)).otherwise(F.ceil(gap / lot)).cast("long").alias("lots"))

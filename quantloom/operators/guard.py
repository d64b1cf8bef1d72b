"""States of the market and of a signal: guard levels, six regimes, quality scores, sector heat, labels, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, history, lag, mean
from quantloom.operators.indicators import MOVING, RECURSIVE, moving, recursive


def _clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def market_guard(index: DataFrame, breadth: DataFrame) -> DataFrame:
    """Per day of the index (date, open, close, volume) from its 200th on: level, its name, exposure and triggers.

    `breadth` is (date, above_sma, falling_days). LOCKDOWN (2, nothing new) below the 200-day average with under a fifth of
    the codes above their own; CAUTION (1, half) below the 20-day average, after five falling days of the advance-decline
    line, or on an opening gap below -3 % on twice the volume of the 20 days before; else NORMAL (0, all).
    """
    w = Window.partitionBy("code").orderBy("date")
    rows = index.withColumn("code", F.lit(0))
    before = F.avg("volume").over(w.rowsBetween(-20, -1))
    rows = rows.withColumns({"ma20": mean("close", 20), "ma200": mean("close", 200), "gap": F.try_divide("open", lag("close")) - 1, "busy": F.col("volume") > 2 * before})
    rows = rows.filter("ma200 IS NOT NULL").join(breadth.select("date", F.coalesce("above_sma", F.lit(0.0)).alias("above"), "falling_days"), "date", "left")
    lock = (F.col("close") < F.col("ma200")) & (F.col("above") < 0.2)
    tests = (("below_ma20", F.col("close") < F.col("ma20")), ("falling_line", F.col("falling_days") >= 5), ("gap", (F.col("gap") < -0.03) & F.col("busy")))
    caution = F.concat_ws(";", *(F.when(c, F.lit(k)) for k, c in tests))
    rows = rows.withColumn("triggers", F.when(lock, "lockdown").otherwise(caution)).withColumn("level", F.when(lock, 2).when(F.col("triggers") != "", 1).otherwise(0))
    name, share = (F.get(F.array(*map(F.lit, x)), F.col("level")) for x in (("NORMAL", "CAUTION", "LOCKDOWN"), (1.0, 0.5, 0.0)))
    return rows.select("date", "level", name.alias("state"), share.alias("exposure"), "triggers")


#: Regimes in the order in which ties go, and the share of a full position in each.
REGIMES = (("bull_trending", 1.0), ("bull_volatile", 0.7), ("bear_trending", 0.3), ("bear_volatile", 0.1), ("range_quiet", 0.5), ("range_volatile", 0.3))


def six_regimes(bars: DataFrame) -> DataFrame:
    """Per code on its last day, with 60 bars at least: the best-scoring of six regimes, its share of all points, its position share, all points."""
    rows = recursive(bars.withColumns({"n": F.row_number().over(history()), "ret_20d": F.try_divide("close", lag("close", 19)) - 1}), last=60, only=("sma_20", "sma_60", "rsi", "macd_hist", "adx", "atr"))
    rows = rows.withColumn("range", F.try_divide("atr", "close"))
    rows = rows.withColumns({"median_range": F.percentile("range", F.lit(0.5)).over(Window.partitionBy("code")), "slope": (F.col("macd_hist") - F.lag("macd_hist", 4).over(history())) / 4, "_back": F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))})
    rows = rows.filter("_back = 1 AND n >= 60").withColumns({"adx": F.coalesce(F.round("adx", 2), F.lit(20.0)), "rsi": F.coalesce(F.round("rsi", 2), F.lit(50.0)), "vol": F.coalesce(F.round(F.try_divide("range", "median_range"), 2), F.lit(1.0))})
    trend, strong, busy = F.col("adx") >= 22, F.col("adx") >= 30, F.col("vol") > 1.15
    over20, over60 = F.round(F.col("close") / F.col("sma_20") - 1, 4), F.round(F.col("sma_20") / F.col("sma_60") - 1, 4)
    bull = ((over20 > 0) & (over60 > 0)) | (F.col("rsi") > 55)
    bear = ((over20 < 0) & (over60 < 0)) | (F.col("rsi") < 45)
    slope = F.round(F.coalesce("slope", F.lit(0.0)), 4)
    middle = F.col("rsi").between(40, 60)
    plus = lambda *parts: sum((F.when(c, v).otherwise(0.0) for c, v in parts), F.lit(0.0))
    points = {
        "bull_trending": F.when(trend & bull, plus((F.lit(True), 3.0), (~busy, 1.5), (slope > 0, 1.0), (strong, 1.0))).otherwise(0.0),
        "bull_volatile": F.when(bull & busy, plus((F.lit(True), 2.5), (trend, 1.5), (F.col("rsi") > 70, 1.0))).otherwise(0.0),
        "bear_trending": F.when(trend & bear, plus((F.lit(True), 3.0), (~busy, 1.5), (slope < 0, 1.0), (strong, 1.0))).otherwise(0.0),
        "bear_volatile": F.when(bear & busy, plus((F.lit(True), 2.5), (trend, 1.5), (F.col("rsi") < 30, 1.0))).otherwise(0.0),
        "range_quiet": F.when(~trend, plus((F.lit(True), 2.0), (~busy, 2.0), (middle, 1.0))).otherwise(0.0),
        "range_volatile": F.when(~trend & busy, plus((F.lit(True), 3.0), (middle, 0.5))).otherwise(0.0),
    }
    rows = rows.withColumns(points).withColumn("best", F.array_max(F.array(*(F.struct(F.col(k).alias("points"), F.lit(-i).alias("order"), F.lit(k).alias("regime"), F.lit(v).alias("share")) for i, (k, v) in enumerate(REGIMES)))))
    total = sum((F.col(k) for k, _ in REGIMES), F.lit(0.0))
    return rows.select("code", "date", F.col("best.regime").alias("regime"), F.coalesce(F.round(F.try_divide(F.col("best.points"), total), 3), F.lit(0.5)).alias("confidence"), F.col("best.share").alias("position"), *points)


def growth_score(yoy: Column) -> Column:
    """0 to 95 for a year-on-year change in percent; 50 where it is unknown."""
    out = F.when(yoy.isNull(), 50.0).when(yoy > 50, 95.0)
    # From this change on, its points, and the change over which 15 more are earned.
    for low, points, span in ((20, 80, 30), (10, 65, 10), (0, 50, 10)):
        out = out.when(yoy > low, points + (yoy - low) / span * 15)
    return out.when(yoy > -10, 35 + yoy / 10 * 15).when(yoy > -20, 20 + (yoy + 10) / 10 * 15).otherwise(F.greatest(F.lit(5.0), 10 + (yoy + 20) / 20 * 10))


def institution_score(ratio: Column) -> Column:
    """10 to 95 for net buying over volume; 50 where it is unknown."""
    return F.when(ratio.isNull(), 50.0).when(ratio >= 0.2, 95.0).when(ratio >= 0, 50 + ratio / 0.2 * 45).when(ratio >= -0.2, F.greatest(F.lit(10.0), 50 + ratio / 0.2 * 40)).otherwise(10.0)


def expected_score(ev: Column, n: Column, cost: float = 0.005855) -> Column:
    """0 to 100 for an expected value before `cost` over n cases, drawn to 40 where they are few."""
    net = ev - cost
    base = F.when(net >= 0.03, 100.0).when(net >= 0, 50 + net / 0.03 * 50).when(net >= -0.02, F.greatest(F.lit(0.0), 50 + net / 0.02 * 50)).otherwise(0.0)
    sure = F.least(F.lit(1.0), n / 20)
    return F.when(ev.isNull() | (n < 3), 40.0).otherwise(base * sure + 40 * (1 - sure))


#: Points of a strategy in a regime, of a sector's momentum on top of its heat, and of a signal's maturity.
REGIME_POINTS = {"bull": {"V4": 95, "V5": 50, "Adaptive": 80}, "sideways": {"V4": 45, "V5": 85, "Adaptive": 75}, "bear": {"V4": 20, "V5": 60, "Adaptive": 50}}
MOMENTUM_POINTS = {"surge": 30, "heating": 20, "stable": 0, "cooling": -20}
MATURITY_POINTS = {"Structural Shift": 95, "Trend Formation": 70, "Speculative Spike": 30}
PREFERRED = {"Trend Preferred (V4)": ("V4",), "Trend Only (V4)": ("V4",), "Volatility Preferred (V5)": ("V5",), "Reversion Only (V5)": ("V5",), "Balanced": ("V4", "V5", "Adaptive")}


def _points(of: Column, table: dict[str, float], other: float) -> Column:
    return F.coalesce(*(F.when(of == k, F.lit(float(v))) for k, v in table.items()), F.lit(other))


def signal_quality(signals: DataFrame) -> DataFrame:
    """`signals` with the points of eight dimensions, sqs and grade.

    Reads fitness, strategy, regime, ev, cases, heat, momentum, maturity, inst_ratio, valuation (points or null) and yoy. Where
    neither valuation nor yoy is known, the other six share the weight.
    """
    fits = F.lit(False)
    for tag, kinds in PREFERRED.items():
        fits = fits | ((F.col("fitness") == tag) & F.col("strategy").isin(*kinds))
    known = F.col("fitness").isin(*PREFERRED)
    parts = {
        "s_fitness": F.when(F.coalesce(~known, F.lit(True)), 50.0).when(fits, 100.0).when(F.col("fitness") == "Balanced", 80.0).otherwise(20.0),
        "s_regime": F.coalesce(*(F.when((F.col("regime") == r) & (F.col("strategy") == s), F.lit(float(v))) for r, row in REGIME_POINTS.items() for s, v in row.items()), F.lit(50.0)),
        "s_ev": expected_score(F.col("ev"), F.col("cases")),
        "s_heat": F.when(F.col("heat").isNull(), 50.0).otherwise(_clip(F.least(F.lit(70.0), F.col("heat") * 100) + _points(F.col("momentum"), MOMENTUM_POINTS, 0.0), 0.0, 100.0)),
        "s_maturity": _points(F.col("maturity"), MATURITY_POINTS, 40.0),
        "s_inst": institution_score(F.col("inst_ratio")),
        "s_valuation": F.coalesce("valuation", F.lit(50.0)),
        "s_growth": growth_score(F.col("yoy")),
    }
    # Fixed values.
    all_eight = {"s_inst": 0.2, "s_growth": 0.15, "s_fitness": 0.15, "s_valuation": 0.1, "s_regime": 0.1, "s_ev": 0.1, "s_heat": 0.1, "s_maturity": 0.1}
    six = {"s_fitness": 0.25, "s_regime": 0.2, "s_ev": 0.15, "s_heat": 0.1, "s_maturity": 0.1, "s_inst": 0.2}
    weighed = lambda w: sum((F.col(k) * v for k, v in w.items()), F.lit(0.0))
    out = signals.withColumns(parts).withColumn("sqs", F.when(F.col("valuation").isNotNull() | F.col("yoy").isNotNull(), weighed(all_eight)).otherwise(weighed(six)))
    return out.withColumn("grade", F.when(F.col("sqs") >= 80, "diamond").when(F.col("sqs") >= 60, "gold").when(F.col("sqs") >= 40, "silver").otherwise("noise"))


def energy_penalty(bars: DataFrame) -> DataFrame:
    """Per bar the factor that exhaustion (true range above 2.5 average ranges of 20 bars: 0.8) and thin volume (below 1.5 averages of 5 bars: 0.9) leave."""
    rows = moving(bars).withColumns({"range": F.try_divide("tr", mean("tr", 20)), "volume_ratio": F.try_divide("volume", "vol_5")})
    hot, thin = F.coalesce(F.col("range") > 2.5, F.lit(False)), F.coalesce(F.col("volume_ratio") < 1.5, F.lit(False))
    return rows.select("code", "date", hot.alias("overheat"), thin.alias("thin"), (F.when(hot, 0.8).otherwise(1.0) * F.when(thin, 0.9).otherwise(1.0)).alias("factor"))


def priority(signals: DataFrame) -> DataFrame:
    """`signals` with priority: 0.3 strength + 0.25 quality + 0.2 phase + 0.15 peer alpha + 0.1 liquidity, each from 0 to 100 with a default where it is missing."""
    phase = _points(F.col("phase"), {"BETA": 100, "ALPHA": 60, "GAMMA_READY": 80}, 0.0)
    part = lambda c, other: F.coalesce(_clip(F.col(c), 0.0, 100.0), F.lit(other))
    peer = _clip((F.coalesce("peer_alpha", F.lit(1.0)) - 0.5) * 40, 0.0, 100.0)
    return signals.withColumn("priority", 0.3 * part("strength", 50.0) + 0.25 * part("quality", 50.0) + 0.2 * phase + 0.15 * peer + 0.1 * part("liquidity", 50.0))


def sector_heat(latest: DataFrame) -> DataFrame:
    """Per sector and, with a null `industry` for all, per industry of it: codes, BUY codes and their share; for sectors also the
    share weighed by maturity, mean volume ratio of BUY codes, and the leader (best score above 0.6, then longest uptrend, then least code).

    Reads code, sector, industry, signal, maturity, vol_ratio, uptrend_days and inst_score (-5 to 5, or null).
    """
    weight = _points(F.col("maturity"), {"Speculative Spike": 1.0, "Trend Formation": 1.5, "Structural Shift": 2.0}, 1.0)
    buy = F.col("signal") == "BUY"
    inst = F.coalesce(_clip((F.col("inst_score") + 5) / 10, 0.0, 1.0), F.lit(0.5))
    score = F.round((weight - 1) * 0.4 + inst * 0.4 + F.coalesce(_clip(F.col("vol_ratio") - 1, 0.0, 1.0), F.lit(0.0)) * 0.2, 3)
    rows = latest.withColumns({"buy": buy, "weight": weight, "score": F.when(buy, score)})
    leader = F.max(F.when(F.col("score") > 0.6, F.struct("score", "uptrend_days", F.negate("code").alias("negated"), "code")))
    n, bought = F.count(F.lit(1)), F.count(F.when(F.col("buy"), 1))
    out = rows.groupingSets([["sector"], ["sector", "industry"]], "sector", "industry").agg(
        n.alias("codes"), bought.alias("buys"), (bought / n).alias("heat"), (F.sum(F.when(F.col("buy"), F.col("weight")).otherwise(0.0)) / n).alias("weighted_heat"), F.coalesce(F.avg(F.when(F.col("buy") & (F.col("vol_ratio") > 0), F.col("vol_ratio"))), F.lit(0.0)).alias("avg_buy_volume"), leader.alias("leader")
    )
    return out.select("sector", "industry", "codes", "buys", "heat", "weighted_heat", "avg_buy_volume", F.col("leader.code").alias("leader"), F.col("leader.score").alias("leader_score"))


def hot_sectors(mutations: DataFrame, top: int = 10) -> DataFrame:
    """The `top` sectors by positive and negative z: counts of both (two at least), and which outweighs the other by half."""
    up, down = F.count(F.when(F.col("z") > 0, 1)), F.count(F.when(F.col("z") < 0, 1))
    out = mutations.groupBy("sector").agg(up.alias("stealth"), down.alias("distribution")).withColumn("total", F.col("stealth") + F.col("distribution")).filter("total >= 2")
    kind = F.when(F.col("stealth") > F.col("distribution") * 1.5, "stealth_heavy").when(F.col("distribution") > F.col("stealth") * 1.5, "distribution_heavy").otherwise("mixed")
    return out.withColumn("signal", kind).orderBy(F.desc("total"), "sector").limit(top)


def assessment(bars: DataFrame) -> DataFrame:
    """Per code on its last day: order of the averages, direction and strength of the trend, and momentum by four votes."""
    return assessed(recursive(bars, last=10, only=(*MOVING, *RECURSIVE)))


def assessed(frame: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """assessment() of the last bars of each code, ten at least, that have their indicators; `keep` names columns to return, too."""
    rows = frame.withColumns({"slope": F.try_divide("sma_20", F.lag("sma_20", 9).over(history())) - 1, "short": F.try_divide("close", F.lag("close", 4).over(history())) - 1, "_back": F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))})
    rows = rows.filter("_back = 1")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    adx, slope, short = zero(F.col("adx")), zero(F.col("slope")), zero(F.col("short"))
    order = F.when((F.col("sma_5") > F.col("sma_20")) & (F.col("sma_20") > F.col("sma_60")), "bullish").when((F.col("sma_5") < F.col("sma_20")) & (F.col("sma_20") < F.col("sma_60")), "bearish").otherwise("tangled")
    raw = F.when((slope > 0.01) & (adx > 25), "strong_up").when(slope > 0.003, "up").when((slope < -0.01) & (adx > 25), "strong_down").when(slope < -0.003, "down").otherwise("flat")
    trend = F.when(raw.isin("strong_up", "up") & (short < -0.05), "flat").when(raw.isin("strong_down", "down") & (short > 0.05), "flat").otherwise(raw)
    vote = lambda a, b: F.when(zero(F.col(a)) > (zero(F.col(b)) if isinstance(b, str) else b), 1).otherwise(-1)
    votes = vote("plus_di", "minus_di") + vote("rsi", F.lit(50.0)) + vote("macd", "macd_signal") + vote("k", "d")
    momentum = F.when(votes >= 3, "strong_bull").when(votes >= 1, "bull").when(votes >= -1, "neutral").when(votes >= -3, "bear").otherwise("strong_bear")
    return rows.select("code", "date", order.alias("averages"), trend.alias("trend"), F.when(adx > 30, "strong").when(adx > 18, "middle").otherwise("weak").alias("strength"), votes.alias("votes"), momentum.alias("momentum"), *keep)


def round_levels(price: Column) -> Column:
    """Round prices near `price`: three steps down to three up, by a step that grows with it; positive ones only."""
    step = F.when(price < 50, 5).when(price < 200, 10).when(price < 500, 25).when(price < 2000, 50).otherwise(100)
    return F.filter(F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda i: (F.floor(price / step) + i) * step), lambda x: x > 0)


def full_snapshot(bars: DataFrame, sectors: DataFrame, scan: DataFrame, growth: DataFrame) -> DataFrame:
    """The latest bar of each code with all indicators, trend, its sector, strength rating and its industry's growth: what a screener reads."""
    rows = recursive(bars.withColumn("change_pct", change("close")), last=1, only=(*MOVING, *RECURSIVE))
    rows = rows.join(sectors, "code", "left").join(scan.select("code", "rs_ratio", "rating"), "code", "left").join(F.broadcast(growth), "industry", "left")
    trend = F.when(F.col("sma_20") > F.col("sma_60"), "up").when(F.col("sma_20") < F.col("sma_60"), "down").otherwise("flat")
    return rows.withColumn("trend", trend)


def alert_frame(bars: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """All indicators of each bar and, as x_before, those of the bar before: what alert conditions read. With `rules`, only what they name."""
    before = ("close", "sma_5", "sma_20", "sma_60", "bb_upper", "bb_lower", "macd", "macd_signal", "k", "d", "rsi", "adx")
    named = None if rules is None else set(re.findall(r"\w+", " ".join(rules.values()).lower()))
    only = tuple(c for c in (*MOVING, *RECURSIVE, *(f"{c}_before" for c in before)) if named is None or c in named)
    return recursive(bars.withColumn("change_pct", change("close")), only=only)


def alerts(frame: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(code, date, rule) where a rule's condition over alert_frame() holds; crosses compare with the bar before."""
    hit = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(name)) for name, c in rules.items())))
    return frame.select("code", "date", F.explode(hit).alias("rule"))


def cross(up: str, down: str) -> str:
    """The condition that one column of alert_frame() rises above another."""
    return f"{up}_before <= {down}_before AND {up} > {down}"



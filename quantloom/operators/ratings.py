"""Reports of a code's last day: conditions, conflicts, price targets, the overall rating with the trace of what changed it, broker reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, deviation, history, lag, last_rows
from quantloom.operators.guard import assessed
from quantloom.operators.indicators import moving, recursive

#: Ratings from the worst to the best, and the least score of each but the worst.
RATINGS = ("strong_sell", "sell", "neutral", "buy", "strong_buy")
LEAST = (-4.0, -1.0, 3.0, 6.0)
TREND_POINTS = {"strong_up": 2, "up": 1, "flat": 0, "down": -1, "strong_down": -2}
MOMENTUM_POINTS = {"strong_bull": 2, "bull": 1, "neutral": 0, "bear": -1, "strong_bear": -2}
SPANS = (("3M", 63), ("6M", 126), ("1Y", 252))


def nearest_levels(bars: DataFrame, points: DataFrame) -> DataFrame:
    """(code, support, resistance, resistance_far) of levels (code, price): the nearest below and above the last close, and the nearest 2 % above it."""
    last = bars.groupBy("code").agg(F.max_by("close", "date").alias("close"))
    price, close = F.col("price"), F.col("close")
    out = last.join(points.select("code", "price"), "code").groupBy("code")
    return out.agg(F.max(F.when(price < close, price)).alias("support"), F.min(F.when(price > close, price)).alias("resistance"), F.min(F.when(price >= close * 1.02, price)).alias("resistance_far"))


def technical_report(bars: DataFrame, near: DataFrame) -> DataFrame:
    """guard.assessment() with labels of volume, volatility and risk, and the conflicts between indicators.

    `near` is nearest_levels(); a code without a support has one 7 % below its close, without a resistance one 5 % above.
    volume_trend compares averages of 5 and 20 bars; accumulation counts busy rising and falling bars of 20; volatility is the
    level of the average range over the close; risk_reward is the way up over the way down, 0 where there is none.
    """
    year = F.when(F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date"))) <= 252, F.col("close"))
    busy = F.col("volume") > F.coalesce(F.nullif(F.col("vol_5"), F.lit(0.0)), F.lit(1.0))
    rows = moving(bars).withColumns({"ret": change("close"), "_year": year, "_busy": busy})
    count = lambda c: F.count(F.when(c & F.col("_busy"), 1)).over(last_rows(20))
    rows = rows.withColumns({
        "hv_20": deviation("ret", 20), "hv_60": deviation("ret", 60), "_peak": F.max("_year").over(history()), "peak": F.max("close").over(history()),
        "up_bars": count(F.col("close") > F.col("open")), "down_bars": count(F.col("close") < F.col("open")), "close_4": lag("close", 4), "volume_4": lag("volume", 4), "turnover": F.avg(F.col("close") * F.col("volume")).over(last_rows(20)),
    })
    rows = rows.withColumn("max_drawdown", F.min(F.try_divide("_year", "_peak") - 1).over(history()))
    frame = recursive(rows, last=10).withColumn("hist_2", lag("macd_hist", 2))
    kept = "close volume vol_5 vol_20 vol_ratio hv_20 hv_60 peak max_drawdown up_bars down_bars close_4 volume_4 turnover atr bb_upper bb_lower bb_width bb_pct adx rsi macd macd_signal macd_hist hist_2 k d".split()
    rows = assessed(frame, tuple(kept)).join(near, "code", "left")
    close = F.col("close")
    support, resistance = F.coalesce("support", close * 0.93), F.coalesce("resistance", close * 1.05)
    surge = F.when((F.col("vol_5") > 0) & (F.col("vol_20") > 0), F.col("vol_5") / F.col("vol_20")).otherwise(1.0)
    more = F.col("up_bars") - F.col("down_bars")
    rows = rows.withColumns({
        "volume_trend": F.when(surge > 1.3, "rising").when(surge < 0.7, "shrinking").otherwise("steady"), "accumulation": F.when(more > 3, "accumulation").when(more < -3, "distribution").otherwise("neutral"),
        "range_pct": F.coalesce(F.try_divide("atr", "close"), F.lit(0.0)), "hv_20": F.coalesce(F.col("hv_20") * F.sqrt(F.lit(252.0)), F.lit(0.0)), "hv_60": F.coalesce(F.col("hv_60") * F.sqrt(F.lit(252.0)), F.lit(0.0)),
        "band_width": F.coalesce("bb_width", F.lit(0.0)), "band_position": F.coalesce("bb_pct", F.lit(0.5)), "drawdown": F.try_divide("close", "peak") - 1,
        "risk_reward": F.greatest(F.lit(0.0), F.when(close > support, (resistance - close) / (close - support)).otherwise(0.0)), "adx": F.coalesce("adx", F.lit(0.0)), "rsi": F.coalesce("rsi", F.lit(50.0)),
    })
    rows = rows.withColumn("volatility", F.when(F.col("range_pct") > 0.04, "high").when(F.col("range_pct") > 0.02, "middle").otherwise("low"))
    return rows.withColumn("conflicts", conflicts())


def conflicts() -> Column:
    """Names of the conflicts that hold, over columns of technical_report(): MACD against KD either way, a shrinking histogram, little reward, overbought in an uptrend, price against volume."""
    macd, signal, k, d = (F.coalesce(c, F.lit(0.0)) for c in ("macd", "macd_signal", "k", "d"))
    bull, bear = (macd > signal) & (macd > 0), (macd < signal) & (macd < 0)
    rose, fell = F.col("close") > F.col("close_4"), F.col("close") < F.col("close_4")
    rules = {
        "macd_up_kd_down": bull & (k < d),
        "macd_down_kd_up": bear & (k > d),
        "histogram_shrinks": bull & (F.col("macd_hist") < F.col("hist_2")),
        "little_reward": F.col("risk_reward") < 0.5,
        "overbought": (F.col("averages") == "bullish") & (F.col("rsi") > 70),
        "rise_without_volume": rose & (F.col("volume") < F.col("volume_4") * 0.7),
        "fall_on_volume": fell & (F.col("volume") > F.col("volume_4") * 1.3),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))


def price_targets(report: DataFrame, levels: DataFrame, analysts: DataFrame | None = None) -> DataFrame:
    """(code, timeframe, scenario, target, upside, confidence): bull, base and bear of three, six and twelve months.

    `report` is technical_report(), `levels` levels.retracements(), `analysts` (code, analysts, mean, high, low) is heeded from two
    analysts on, each number where it is less than three times the close, for six and twelve months. A code without levels takes shares of its close.
    """
    level = lambda kind, ratio: F.max(F.when((F.col("kind") == kind) & (F.col("ratio") == ratio), F.col("level")))
    drawn = levels.groupBy("code").agg(F.first("direction").alias("direction"), level("extension", 1.272).alias("ext_short"), level("extension", 1.618).alias("ext_long"), level("retracement", 0.5).alias("back_short"), level("retracement", 0.786).alias("back_long"))
    rows = report.join(drawn, "code", "left")
    said = [f"_{c}" for c in ("mean", "high", "low")]
    if analysts is None:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in said})
    else:
        some = F.col("analysts") >= 2
        rows = rows.join(analysts.select("code", "analysts", *(F.col(c[1:]).alias(c) for c in said)), "code", "left")
        rows = rows.withColumns({c: F.when(some & (F.col(c) > 0) & (F.abs(F.col(c) / F.col("close") - 1) < 2), F.col(c)) for c in said})
    close, spread = F.col("close"), F.col("range_pct")
    rises, falls = F.col("trend").isin("strong_up", "up"), F.col("trend").isin("strong_down", "down")
    strong = rises & (F.col("adx") > 25)
    made = []
    for name, days in SPANS:
        scale, far = (days / 14) ** 0.5, name == "1Y"
        drawn_up = F.coalesce("ext_long" if far else "ext_short", close * (1.25 if far else 1.15))
        drawn_up = F.when(drawn_up < close * 1.01, close * (1 + spread * F.when(strong, 1.5).otherwise(1.0) * scale)).otherwise(drawn_up)
        drawn_down = F.coalesce(F.when(F.col("direction") == "uptrend", F.col("back_long" if far else "back_short")), close * 0.85)
        bull = F.least(drawn_up * 0.4 + close * (1 + spread * 2 * scale) * 0.3 + F.coalesce("resistance_far", close * 1.05) * 0.3, close * 2)
        bear = F.greatest(drawn_down * 0.4 + close * (1 - spread * 2 * scale) * 0.3 + F.coalesce("support", close * 0.93) * 0.3, close * 0.5)
        if name != "3M":
            share, middle = (0.3, 0.35) if far else (0.2, 0.25)
            bull = F.when(F.col("_high") > close, bull * (1 - share) + F.col("_high") * share).otherwise(bull)
            bear = F.when(F.col("_low").isNotNull(), bear * (1 - share) + F.col("_low") * share).otherwise(bear)
        made.append(F.struct(F.lit(name).alias("timeframe"), bull.alias("bull"), bear.alias("bear"), F.lit(None if name == "3M" else middle).cast("double").alias("middle")))
    rows = rows.select("code", "close", "adx", "_mean", strong.alias("strong"), rises.alias("rises"), falls.alias("falls"), F.explode(F.array(*made)).alias("x")).select("*", "x.*")
    share = F.when(F.col("strong"), 0.6).when(F.col("rises"), 0.55).when(F.col("falls"), 0.4).otherwise(0.5)
    base = F.col("bull") * share + F.col("bear") * (1 - share)
    base = F.when(F.col("_mean").isNotNull() & F.col("middle").isNotNull(), base * (1 - F.col("middle")) + F.col("_mean") * F.col("middle")).otherwise(base)
    rows = rows.withColumns({"base": base, "top": F.greatest("bull", "bear"), "bottom": F.least("bull", "bear")})
    rows = rows.withColumn("base", F.when(F.col("base") > F.col("top"), F.col("top") * 0.95).otherwise(F.col("base")))
    rows = rows.withColumn("base", F.when(F.col("base") < F.col("bottom"), F.col("bottom") * 1.05).otherwise(F.col("base")))
    sure = F.when(F.col("adx") > 25, "high").when(F.col("adx") > 18, "middle").otherwise("low")
    scenario = lambda name, target, confidence: F.struct(F.lit(name).alias("scenario"), F.col(target).alias("target"), confidence.alias("confidence"))
    all_three = F.explode(F.array(scenario("bull", "top", F.lit("middle")), scenario("base", "base", sure), scenario("bear", "bottom", F.lit("middle")))).alias("s")
    return rows.select("code", "close", "timeframe", all_three).select("code", "timeframe", "s.scenario", "s.target", (F.try_divide("s.target", "close") - 1).alias("upside"), "s.confidence")


def _points(of: str, table: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(F.col(of) == k, F.lit(float(v))) for k, v in table.items()), F.lit(0.0))


_TRACE = "array<struct<code:string,severity:string,before:string,after:string,cap:string,threshold:double,actual:double>>"


def overall_rating(rows: DataFrame) -> DataFrame:
    """`rows` with scores of three dimensions, score, raw_rating, rating and overrides, the trace of what changed the rating.

    Reads trend, momentum, signal, composite, rsi, risk_reward, conflicts (names), upside (of three months' base target), fundamental (-5 to 5),
    inst_score (-5 to 5), visibility, turnover (mean of 20 days), regime, biotech, runway and total_runway (quarters). Missing numbers
    are neutral. Gates lower the rating in this order, each judging what the one before left: nobody trades and little turnover (one
    step), institutions that sell, cash for less than four or eight quarters, a bear market, conflicts, an overbought RSI.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rsi, reward, composite, upside = F.coalesce("rsi", F.lit(50.0)), F.coalesce("risk_reward", F.lit(1.0)), zero("composite"), zero("upside")
    n, inst, biotech = F.coalesce(F.size("conflicts"), F.lit(0)), zero("inst_score"), F.coalesce("biotech", F.lit(False))
    tech = [
        _points("trend", TREND_POINTS), _points("signal", {"BUY": 2, "SELL": -2}), F.when(composite > 0.3, 1.0).when(composite < -0.3, -1.0).otherwise(0.0), _points("momentum", MOMENTUM_POINTS),
        F.when(rsi < 30, 1.0).when(rsi > 70, -1.0).otherwise(0.0), F.when(reward > 2, 1.0).when(reward < 0.3, -3.0).when(reward < 0.5, -2.0).when(reward < 0.8, -1.0).otherwise(0.0), -F.least(n * 0.5, F.lit(2.0)),
    ]
    fund = zero("fundamental") * 0.4 + F.when(upside > 0.1, 2.0).when(upside > 0.05, 1.0).when(upside < -0.05, -2.0).when(upside < 0, -1.0).otherwise(0.0)
    out = rows.withColumns({"tech": sum(tech, F.lit(0.0)), "fund": fund, "inst": inst})
    out = out.withColumn("score", F.col("tech") + F.col("fund") + F.col("inst") * F.when(biotech, 0.3).otherwise(0.25) * 4)
    level = sum((F.when(F.col("score") >= x, 1).otherwise(0) for x in LEAST), F.lit(0))
    name = lambda i: F.get(F.array(*map(F.lit, RATINGS)), i)
    out = out.withColumns({"_level": level, "overrides": F.array().cast(_TRACE)}).withColumn("raw_rating", name(F.col("_level")))
    ghost, thin = F.coalesce(F.col("visibility") == "ghost_town", F.lit(False)), F.col("turnover") < 10_000_000
    known = F.col("runway").isNotNull() | F.col("total_runway").isNotNull()
    own, total = F.coalesce("runway", F.lit(99.0)), F.coalesce("total_runway", F.lit(99.0))
    cash = F.when(biotech, F.least(own, total)).otherwise(own)
    now = F.col("_level")
    # Code, severity, condition, the level it caps at (None: one step down), threshold, the value that met it.
    gates = (
        ("ghost_town", "soft_cap", ghost & thin, None, 10_000_000.0, F.col("turnover")),
        ("institutions_sell", "hard_cap", ~ghost & (inst < -2), 2, -2.0, inst),
        ("cash_critical", "hard_cap", known & (cash < 4), 1, 4.0, cash),
        ("cash_warning", "hard_cap", known & (cash >= 4) & (cash < 8), 2, 8.0, cash),
        ("bear_market", "soft_cap", F.col("regime") == "bear", 3, 0.0, F.lit(0.0)),
        ("conflict", "soft_cap", n > 0, 3, 0.0, n),
        ("overbought", "soft_cap", rsi > 70, 3, 70.0, rsi),
    )
    for code, severity, holds, cap, threshold, actual in gates:
        to = F.greatest(now - 1, F.lit(0)) if cap is None else F.lit(cap)
        hit = F.coalesce(holds, F.lit(False)) & (F.lit(True) if cap is None else now > cap)
        entry = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), name(now).alias("before"), name(to).alias("after"), name(to).alias("cap"), F.lit(threshold).alias("threshold"), actual.cast("double").alias("actual"))
        out = out.withColumns({"overrides": F.when(hit, F.concat("overrides", F.array(entry).cast(_TRACE))).otherwise(F.col("overrides")), "_level": F.when(hit, to).otherwise(now)})
    return out.withColumn("rating", name(now)).drop("_level")


def broker_reversal(brokers: DataFrame, days: int = 20, least_streak: int = 3, least_z: float = 0.6, bonus: float = 15.0) -> DataFrame:
    """Per code of broker_day(): feature_score from its last day, whether institutions accumulate by its last `days` days, and both as score (0 to 100).

    Parts that are missing give their weight to the others; with one part or none there is no score. Accumulation takes a streak of
    net buying and a purity `least_z` deviations above its mean, known for five days at least; it adds `bonus`.
    """
    back = Window.partitionBy("code").orderBy(F.desc("date"))
    rows = brokers.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= days)
    last = lambda c: F.max(F.when(F.col("_back") == 1, F.col(c))).alias(c)
    purity_day = F.when(F.col("purity").isNotNull(), F.col("date"))
    out = rows.groupBy("code").agg(
        F.max("date").alias("date"), last("streak"), last("purity"), last("net_momentum_5d"), last("net_buy_ratio"), F.count("purity").alias("n"), F.avg("purity").alias("mean"), F.stddev_samp("purity").alias("sd"), F.max_by("purity", purity_day).alias("current")
    )
    clip = lambda x, high=100.0: F.greatest(F.lit(0.0), F.least(F.lit(high), x))
    # The part, its points and weight.
    parts = (("streak", F.col("streak") * 10.0, 0.3), ("purity", F.col("purity"), 0.25), ("net_momentum_5d", (F.col("net_momentum_5d") + 1) * 50, 0.25), ("net_buy_ratio", F.col("net_buy_ratio") * 100, 0.2))
    known = lambda value: sum((F.when(F.col(c).isNotNull(), value(x, w)).otherwise(0.0) for c, x, w in parts), F.lit(0.0))
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c, _, _ in parts), F.lit(0))
    out = out.withColumn("feature_score", F.when(missing < 3, known(lambda x, w: clip(x) * w) / known(lambda _, w: F.lit(w))))
    spread = F.col("sd") > 1e-9 * F.abs("mean")  # Equal values have no spread, whatever the last digits say.
    out = out.withColumn("purity_z", F.when(F.col("n") >= 5, F.when(spread, (F.col("current") - F.col("mean")) / F.col("sd")).otherwise(0.0)))
    streak = F.coalesce("streak", F.lit(0))
    out = out.withColumn("accumulates", F.coalesce((streak >= least_streak) & (F.col("purity_z") > least_z), F.lit(False)))
    sure = F.when(streak > 0, F.least(F.lit(1.0), streak / (2.0 * least_streak))).otherwise(0.0) * 0.5 + clip(F.col("purity_z") / 2, 1.0) * 0.5
    score = F.least(F.lit(100.0), F.col("feature_score") + F.when(F.col("accumulates"), bonus).otherwise(0.0))
    return out.select("code", "date", "streak", "feature_score", "purity_z", "accumulates", F.when(F.col("n") >= 5, sure * 100).otherwise(0.0).alias("confidence"), F.when(F.col("feature_score").isNotNull(), score).alias("score"))

"""Signals: rules over indicators, row by row once the indicators stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, history, lag, last_rows, numbered, run_length
from quantloom.operators.indicators import moving, recursive


def uptrend_days(bars: DataFrame) -> DataFrame:
    """moving() with the number of bars in a row whose 20-bar average is above the 60-bar one, and its maturity class."""
    out = numbered(moving(bars)).withColumn("_up", F.col("sma_20") > F.col("sma_60"))
    out = out.withColumn("uptrend_days", run_length("_up")).drop("_up", "_row")
    return out.withColumn("maturity", F.when(F.col("uptrend_days") == 0, "none").when(F.col("uptrend_days") <= 7, "early").when(F.col("uptrend_days") <= 15, "confirmed").otherwise("mature"))


def trend_signals(bars: DataFrame, min_days: int = 10, min_adx: float = 18.0, min_volume: float = 500.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """BUY, SELL or HOLD of the trend-following rules, in their order, with the kind of entry.

    SELL when the averages cross down with sellers leading. Gates: a lasting uptrend, its strength, buyers leading, a
    moderate RSI and enough volume. BUY near support after an up close, else on momentum. `keep` names indicators or columns of the bars to return, too.
    """
    shown = ("code", "date", "open", "high", "low", "close", "volume")
    own = (*shown, *(c for c in keep if c in bars.columns and c not in shown))
    read = ("sma_5", "sma_20", "sma_60", "vol_5", "roc_12", "uptrend_days", "close_before", "rsi", "plus_di", "minus_di", "adx", "atr")
    frame = recursive(bars.select(*own), only=tuple(dict.fromkeys(c for c in (*read, *keep) if c not in own)))
    distance = F.try_divide("close", "sma_20") - 1
    gate = (F.col("uptrend_days") >= min_days) & (F.col("adx") >= min_adx) & (F.col("plus_di") > F.col("minus_di")) & F.col("rsi").between(30, 80) & (F.col("volume") >= 0.7 * F.col("vol_5")) & (F.col("volume") >= min_volume)
    support = distance.between(-0.02, 0.05) & (F.col("close") > F.col("close_before"))
    momentum = (F.col("close") > F.col("sma_20")) & (F.col("sma_5") > F.col("sma_20")) & (F.col("sma_20") > F.col("sma_60")) & (F.col("roc_12") > 2)
    sell = (F.col("sma_20") < F.col("sma_60")) & (F.col("minus_di") > F.col("plus_di"))
    kind = F.when(sell, "exit").when(~F.coalesce(gate, F.lit(False)), None).when(support, "support").when(momentum, "momentum")
    return frame.select(*shown, "atr", *keep, kind.alias("kind"), F.when(kind == "exit", "SELL").when(kind.isNotNull(), "BUY").otherwise("HOLD").alias("signal"))


def reversion_signals(bars: DataFrame) -> DataFrame:
    """BUY, SELL or HOLD of the mean-reversion rules: back at the middle band or hot sells; quiet and oversold, or far below the average, buys."""
    frame = recursive(bars, shares={"rsi_low": ("rsi", 60, 0.15)}, only=("sma_20", "bb_upper", "bb_lower", "vol_5", "rsi", "adx"))
    z = F.try_divide(F.col("close") - F.col("sma_20"), (F.col("bb_upper") - F.col("sma_20")) / 2)
    sell = (F.col("close") >= F.col("sma_20")) | (F.col("rsi") >= 70)
    quiet = (F.col("adx") < 25) & (F.col("close") <= F.col("bb_lower") * 1.005) & (F.col("rsi") <= F.least(F.lit(30.0), "rsi_low")) & (F.col("volume") < 0.7 * F.col("vol_5"))
    far = (z < -1.5) & (F.col("adx") < 35) & (F.col("rsi") < 45)
    return frame.select("code", "date", "close", F.when(sell, "SELL").when(quiet | far, "BUY").otherwise("HOLD").alias("signal"), (F.try_divide("close", "sma_20") - 1 < -0.05).alias("bias"))


def four_regimes(rows: DataFrame) -> DataFrame:
    """`rows` (code, date, close, adx) with regime: a trend from an ADX of 25 on, explosive above 0.3 of yearly deviation of 60 returns; else a range, volatile above 0.25. Without an ADX it is a quiet range."""
    rows = rows.withColumn("_ret", change("close")).withColumn("_sd", F.stddev_samp("_ret").over(last_rows(60)) * F.sqrt(F.lit(252.0)))
    trend = F.when(F.col("_sd") > 0.3, "trend_explosive").otherwise("trend_mild")
    regime = F.when(F.col("adx") >= 25, trend).when(F.col("adx").isNotNull() & (F.col("_sd") > 0.25), "range_volatile").otherwise("range_quiet")
    return rows.withColumn("regime", regime).drop("_ret", "_sd")


#: Regime, weights of the trend and of the reversion signal.
BLEND = (("trend_explosive", 0.9, 0.1), ("trend_mild", 0.8, 0.2), ("range_volatile", 0.2, 0.8), ("range_quiet", 0.3, 0.7))


def blend(rows: DataFrame) -> DataFrame:
    """`rows` (trend, reversion: BUY, HOLD or SELL; regime, confidence, bias) with composite and signal.

    A signal counts 1, 0 or -1, the trend's times its confidence, a reversion's BUY with its bias confirmed 1.2; weights are those
    of the regime, else halves. BUY from 0.5 on, SELL up to -0.5. Missing signals count 0, a missing confidence 1.
    """
    side = lambda c: F.when(F.col(c) == "BUY", 1.0).when(F.col(c) == "SELL", -1.0).otherwise(0.0)
    a = b = F.lit(0.5)
    for name, x, y in BLEND:
        a, b = F.when(F.col("regime") == name, x).otherwise(a), F.when(F.col("regime") == name, y).otherwise(b)
    back = side("reversion") * F.when(F.coalesce("bias", F.lit(False)) & (F.col("reversion") == "BUY"), 1.2).otherwise(1.0)
    composite = F.round(a * side("trend") * F.coalesce("confidence", F.lit(1.0)) + b * back, 9)
    out = rows.withColumn("composite", composite)
    return out.withColumn("signal", F.when(F.col("composite") >= 0.5, "BUY").when(F.col("composite") <= -0.5, "SELL").otherwise("HOLD"))


def institution_score(nets: DataFrame, codes: DataFrame) -> DataFrame:
    """Per code of `codes` a score from -5 to 5 of (code, date, foreign_net, trust_net, dealer_net, total_net), streak and dominant force.

    Up to one point each for all nets of 3 days, the foreign ones of 5, a last day above three times the mean; half for trusts that
    bought on each of 5 days; half for a streak of 3 days, one and a half from 5 on; all with the sign of the buying. Fewer
    than 3 days earn no such points; a code without days has -3 ('ghost_town'). Missing nets count as 0.
    """
    names = ("foreign_net", "trust_net", "dealer_net", "total_net")
    back = Window.partitionBy("code").orderBy(F.desc("date"))
    rows = nets.select("code", "date", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names)).withColumns({"back": F.row_number().over(back), "side": F.signum("total_net")})
    rows = rows.withColumn("last_side", F.first("side").over(back))
    of = lambda n, c: F.when(F.col("back") <= n, F.col(c))
    trust = F.signum(of(5, "trust_net"))
    out = rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("days"), F.sum(of(3, "total_net")).alias("net3"), *(F.sum(of(5, c)).alias(f"{c}5") for c in names[:3]), F.min(trust).alias("trust_low"), F.max(trust).alias("trust_high"),
        F.min(F.when((F.col("side") != F.col("last_side")) | (F.col("side") == 0), F.col("back"))).alias("stop"), F.max("last_side").alias("direction"), F.avg(F.abs("total_net")).alias("mean"), F.max(of(1, "total_net")).alias("last"),
    )
    run = F.coalesce(F.col("stop") - 1, F.col("days"))
    enough = F.col("days") >= 3
    points = [
        F.when(enough, F.signum("net3")).otherwise(0.0),
        F.when(enough, F.signum("foreign_net5")).otherwise(0.0),
        F.when(enough & (F.col("trust_low") > 0), 0.5).when(enough & (F.col("trust_high") < 0), -0.5).otherwise(0.0),
        F.col("direction") * F.when(F.col("run") >= 5, 1.5).when(F.col("run") >= 3, 0.5).otherwise(0.0),
        F.when((F.col("days") >= 5) & (F.col("mean") > 0) & (F.abs("last") > 3 * F.col("mean")), F.signum("last")).otherwise(0.0),
    ]
    out = out.withColumn("run", run).withColumn("score", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), sum(points, F.lit(0.0)))))
    a, b, c = (F.abs(f"{x}5") for x in names[:3])
    force = F.when(enough, F.when((a >= b) & (a >= c), "foreign").when(b >= c, "trust").otherwise("dealer"))
    all_codes = codes.select("code").distinct().join(out, "code", "left")
    return all_codes.select("code", F.coalesce("score", F.lit(-3.0)).alias("score"), F.coalesce(F.col("run") * F.col("direction"), F.lit(0.0)).cast("int").alias("streak"), force.alias("dominant"), F.when(F.col("days").isNull(), "ghost_town").otherwise("active").alias("visibility"))


def limit_moves(bars: DataFrame, limit: float = 0.1, tolerance: float = 0.005, split: float = 0.35) -> DataFrame:
    """Days that hint at a corporate action: moves at the limit, opening gaps, split-like ratios, days without volume."""
    out = bars.withColumns({"ret": change("close"), "gap": F.try_divide("open", lag("close")) - 1, "ratio": F.try_divide(F.greatest("close", lag("close")), F.least("close", lag("close")))})
    near = F.abs(F.col("ratio") - F.round("ratio")) < 0.05
    kind = F.when(F.col("volume") == 0, "no_volume").when((F.abs("ret") >= split) & near & (F.round("ratio") >= 2), "split").when(F.abs(F.abs("ret") - limit) <= tolerance, "limit").when(F.abs("gap") > limit, "gap")
    return out.withColumn("kind", kind).filter("kind is not null").select("code", "date", "ret", "gap", "kind")


def adjustment_factors(actions: DataFrame) -> DataFrame:
    """(code, ex_date, close_before, cash, share_dividend) with the product of all factors from that date on, by which earlier prices are multiplied."""
    factor = F.try_divide(F.col("close_before") - F.col("cash"), "close_before") / (1 + F.col("share_dividend") / 10)
    ahead = history("code", "ex_date").rowsBetween(0, 2**31 - 1)
    return actions.withColumn("factor", F.exp(F.sum(F.ln(F.when(factor > 0, factor))).over(ahead)))


def trailing_stop(bars: DataFrame, entries: DataFrame, risk: float = 0.07) -> DataFrame:
    """Per open position (code, entry_date, entry) and bar: phase and stop of the four-phase trailing stop.

    Phase 0 stands at the initial risk, 1 at the entry from one risk of gain on, 2 and 3 two and one and a half average
    ranges below the highest high from one and a half and two risks on. Stops never fall.
    """
    held = moving(bars).select("code", "date", "high", "close", "atr_14").join(entries, "code").filter(F.col("date") >= F.col("entry_date"))
    w = F.max("high").over(_position())
    held = held.withColumn("top", w).withColumn("gain", F.try_divide(F.col("top") - F.col("entry"), F.col("entry") * risk))
    phase = F.when(F.col("gain") >= 2, 3).when(F.col("gain") >= 1.5, 2).when(F.col("gain") >= 1, 1).otherwise(0)
    level = F.when(phase == 3, F.col("top") - 1.5 * F.col("atr_14")).when(phase == 2, F.col("top") - 2 * F.col("atr_14")).when(phase == 1, F.col("entry")).otherwise(F.col("entry") * (1 - risk))
    out = held.withColumns({"phase": phase, "level": F.greatest(level, F.col("entry") * (1 - risk))})
    return out.withColumn("stop", F.max("level").over(_position())).select("code", "entry_date", "date", "close", "top", "phase", "stop")


def _position():
    from pyspark.sql import Window

    return Window.partitionBy("code", "entry_date").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)

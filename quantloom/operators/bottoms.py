"""Bottoms: accumulation phases and reversals, from swings of prices that are folded in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import history
from quantloom.operators.indicators import recursive

_POINT = "array<struct<i:int,x:double>>"


def swings(values: Column, half: int, highs: bool = False) -> Column:
    """Swing points (i, x) of an array of doubles: the least (greatest: `highs`) of `half` values on both sides, in order.

    Of points less than `half` apart the first counts, and moves to the next one that is beyond it.
    """
    n = F.size(values)
    extreme = F.array_max if highs else F.array_min
    beyond = (lambda x, y: x > y) if highs else (lambda x, y: x < y)
    point = lambda i: F.struct(i.alias("i"), F.get(values, i).alias("x"))
    places = F.when(n >= 2 * half + 1, F.sequence(F.lit(half), n - half - 1)).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: F.get(values, i) == extreme(F.slice(values, i - half + 1, 2 * half + 1)))
    none = F.array().cast(_POINT)

    def add(kept: Column, i: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        moved = F.when(beyond(F.get(values, i), last["x"]), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(point(i)))).otherwise(kept)
        return F.when((F.size(kept) > 0) & (i - last["i"] < half), moved).otherwise(F.array_append(kept, point(i)).cast(_POINT))

    return F.aggregate(found, none, add)


def _rising(prices: Column, factor: float) -> Column:
    """Each price is at least the one before it times `factor`."""
    later = F.slice(prices, 2, F.greatest(F.size(prices) - 1, F.lit(0)))
    return F.forall(F.zip_with(later, prices, lambda y, x: (y >= x * factor) | y.isNull()), lambda ok: ok)


def _last(x: Column, n: int) -> Column:
    return F.slice(x, F.greatest(F.size(x) - n, F.lit(0)) + 1, n)


def higher_lows(prices: Column, least: int = 3, uplift: float = 1.005, tolerance: float = 0.98) -> Column:
    """Whether an array of swing lows rises: its last `least`; or as many of those from the end on that are lower than the one after
    them; or, of its second half, the deepest and all after it that hold it but for 2 %, the last of them clearly above it."""
    n = F.size(prices)
    strict = _rising(_last(prices, least), uplift)
    descent = lambda kept, x: F.when((F.size(kept) < least) & (x < F.get(kept, F.size(kept) - 1)), F.array_append(kept, x)).otherwise(kept)
    picked = F.aggregate(F.reverse(F.slice(prices, 1, F.greatest(n - 1, F.lit(0)))), _last(prices, 1), descent)
    chosen = (F.size(picked) >= least) & _rising(F.reverse(picked), uplift)
    second = F.slice(prices, F.floor(n / 2).cast("int") + 1, n)
    after = F.slice(second, F.array_position(second, F.array_min(second)).cast("int"), F.size(second))
    held = F.concat(F.slice(after, 1, 1), F.filter(F.slice(after, 2, F.size(after)), lambda x: x >= F.get(after, F.lit(0)) * tolerance))
    support = F.when((n >= 4) & (F.size(after) >= least), (F.size(held) >= least) & (F.get(held, F.size(held) - 1) > F.get(held, F.lit(0)) * uplift)).otherwise(False)
    return F.when(n >= least, F.coalesce(strict | chosen | support, F.lit(False))).otherwise(False)


#: Points of the conditions of an accumulation, of the price's place, and what a long base costs.
POINTS = {"higher_lows": 25, "volume_test": 20, "confirmed": 20, "low_adx": 15, "strong": 10, "smart_money": 10}
IN_RANGE, TOO_LONG = 10, 15


def accumulation(
    bars: DataFrame,
    ratings: DataFrame | None = None,
    scores: DataFrame | None = None,
    year: int = 252,
    least_bars: int = 60,
    least_volume: float = 100_000.0,
    half: int = 8,
    spike: float = 2.5,
    quiet: float = 0.7,
    base: int = 60,
) -> DataFrame:
    """Per code the phase of an accumulation on its last day, its score and what both follow from.

    Judged are the last `year` bars, and of those the correction: from the highest high on, 200 bars at most; all if that
    leaves fewer than 30. higher_lows: higher_lows() of its swing lows. volume_test: a rising bar of `spike` times the
    volume of 20 bars; floor is the least low of such bars, below which a close invalidates. confirmed: in 5 to 10 bars
    after the last test volume falls below `quiet` of the usual, and no low gives up half of the test's gain (5 % at least).
    low_adx: below 25 on 20 of the last 30 bars. strong: a rating of 70 (`ratings`: code, rating). smart_money: a
    score of 0.5 (`scores`: code, score; a row a code each). in_range: 20 to 45 % below the high. `reason` is 'history' or
    'volume' where too little is known; such codes have phase NONE and score 0.
    """
    w, back = history(), F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    whole = Window.partitionBy("code")
    rows = recursive(bars).withColumn("_back", back).filter(F.col("_back") <= year)
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(whole), "top": F.max("high").over(whole)})
    rows = rows.withColumn("peak", F.min(F.when(F.col("high") == F.col("top"), F.col("i"))).over(whole))
    rows = rows.withColumn("start", F.greatest("peak", F.col("n") - 200)).withColumn("from", F.when(F.col("n") - F.col("start") < 30, 0).otherwise(F.col("start")))
    inside = F.col("i") >= F.col("from")
    month = w.rowsBetween(-19, 0)
    usual = F.when(F.col("i") - F.col("from") >= 19, F.avg("volume").over(month))
    rows = rows.withColumn("usual", usual).withColumn("ratio", F.when(F.col("usual") > 0, F.col("volume") / F.col("usual")))
    rows = rows.withColumn("test", F.coalesce(inside & (F.col("ratio") >= spike) & (F.col("close") > F.col("open")), F.lit(False)))
    rows = rows.withColumn("tested", F.max(F.when(F.col("test"), F.col("i"))).over(whole))
    after = (F.col("i") > F.col("tested")) & (F.col("i") <= F.col("tested") + 10)
    energy = (F.col("i") >= F.col("start")) & (F.col("_back") <= 30)
    at_test = lambda x: F.max(F.when(F.col("i") == F.col("tested"), x))
    one = rows.groupBy("code").agg(
        *(F.max(c).alias(c) for c in ("n", "top", "peak", "start", "date")), F.max_by("close", "i").alias("close"), F.avg(F.when(F.col("_back") <= 20, F.col("volume"))).alias("volume"),
        F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("i", "low")))), lambda x: x["low"]).alias("lows"), F.count(F.when(F.col("test"), 1)).alias("tests"), F.round(F.min(F.when(F.col("test"), F.col("low"))), 2).alias("floor"),
        F.count(F.when(after, 1)).alias("days"), F.avg(F.when(after, F.col("ratio"))).alias("test_volume"), F.min(F.when(after, F.col("low"))).alias("lowest"), at_test(F.col("close")).alias("test_close"), at_test((F.col("close") - F.col("open")) / F.col("open")).alias("gain"),
        F.count(F.when(energy & (F.col("adx") < 25), 1)).alias("adx_days"), F.max_by("adx", "i").alias("adx"),
    )
    none = lambda name: F.lit(None).cast("double").alias(name)
    one = one.join(ratings.select("code", "rating"), "code", "left") if ratings is not None else one.select("*", none("rating"))
    one = one.join(scores.select("code", F.col("score").alias("aqs")), "code", "left") if scores is not None else one.select("*", none("aqs"))
    points = F.transform(swings(F.col("lows"), half), lambda p: p["x"])
    down = 1 - F.col("close") / F.col("top")
    pullback = (F.col("test_close") - F.col("lowest")) / F.col("test_close")
    true = lambda c: F.coalesce(c, F.lit(False))
    one = one.withColumn("swing_lows", points).withColumns({
        "higher_lows": higher_lows(F.col("swing_lows")), "volume_test": F.col("tests") > 0, "pullback": F.when(F.col("days") >= 5, pullback),
        "confirmed": true((F.col("days") >= 5) & (F.col("test_volume") < quiet) & (pullback <= F.greatest(F.col("gain") * 0.5, F.lit(0.05)))),
        "low_adx": (F.col("n") - F.col("start") >= 20) & (F.col("adx_days") >= 20), "strong": true(F.col("rating") >= 70), "smart_money": true(F.col("aqs") >= 0.5), "in_range": true(down.between(0.2, 0.45)),
        "below_high": down, "base_days": F.col("n") - 1 - F.col("peak"), "invalidated": true(F.col("close") < F.col("floor")),
        "reason": F.when(F.col("n") < least_bars, "history").when(F.col("volume") < least_volume, "volume"),
    })
    met = sum((F.col(c).cast("int") for c in POINTS), F.lit(0))
    total = sum((F.when(F.col(c), p).otherwise(0) for c, p in POINTS.items()), F.lit(0)) + F.when(F.col("in_range"), IN_RANGE).otherwise(0)
    total = F.when(F.col("base_days") > base, F.greatest(total - TOO_LONG, F.lit(0))).otherwise(total)
    phase = F.when(F.col("invalidated"), "INVALIDATED").when((met >= 4) & F.col("confirmed"), F.when(F.col("aqs").isNotNull() & ~F.col("smart_money"), "ALPHA").otherwise("BETA")).when((met >= 2) & F.col("higher_lows"), "ALPHA").otherwise("NONE")
    known = F.col("reason").isNull()
    return one.select(
        "code", "date", F.when(known, phase).otherwise("NONE").alias("phase"), F.when(known & ~F.col("invalidated"), F.least(total, F.lit(100))).otherwise(0).alias("score"), *POINTS, "in_range", "invalidated",
        F.size("swing_lows").alias("swing_lows"), "tests", "floor", "test_volume", "pullback", "adx", "adx_days", "below_high", "base_days", "reason",
    )


#: Scores of the phases of a reversal, of a point of spread and of a window that rises.
PHASES = {"STRONG": 80.0, "WATCH": 50.0, "NONE": 0.0}
PER_POINT, PER_WINDOW = 5.0, 33.0


def reversals(bars: DataFrame, broker_scores: DataFrame | None = None, windows: tuple[int, ...] = (20, 40, 60), half: int = 5, spread: float = 2.0, tolerance: float = 0.005, bonus: float = 0.1) -> DataFrame:
    """Per code the phase of a reversal on its last day: STRONG where swings rise and prices and RSI diverge, WATCH where they only rise.

    Divergence is looked for in the last 60 closes and their RSI: a lower second of the last two swing lows on an RSI that is higher
    by more than `spread` (bullish), else a higher second swing high on a lower RSI (bearish). A window of the last n closes
    rises if its last three swing lows, or two, do not fall by more than `tolerance`; windows longer than the history do not
    count. A phase is worth its points and `bonus` of a positive score of `broker_scores` (code, score; a row a code), 100
    at most. Codes of fewer than 20 bars have phase NONE, of fewer than 25 no windows.
    """
    longest = max(60, *windows)
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    rows = recursive(bars.select("code", "date", "high", "low", "close")).withColumns({"_back": back, "n": F.count(F.lit(1)).over(Window.partitionBy("code"))}).filter(F.col("_back") <= longest)
    bar = F.array_sort(F.collect_list(F.struct("date", "close", "rsi")))
    one = rows.groupBy("code").agg(F.max("n").alias("n"), F.max("date").alias("date"), bar.alias("bars"))
    last = lambda c, n: F.transform(_last(F.col("bars"), n), lambda x: x[c])
    one = one.withColumns({"closes": last("close", 60), "rsis": last("rsi", 60)}).withColumns({"dips": swings(F.col("closes"), half), "peaks": swings(F.col("closes"), half, highs=True)})
    known = (F.col("n") >= 20) & (F.size(F.array_compact("rsis")) >= 20)

    def gap(points: str, sign: int) -> Column:
        """How much the RSI has risen (fallen: -1) between the last two swings while the price fell (rose), where that is more than the least spread."""
        a, b = (F.get(F.col(points), F.size(points) - k) for k in (2, 1))
        moved = (F.get("rsis", b["i"]) - F.get("rsis", a["i"])) * sign
        return F.when((F.size(points) >= 2) & ((b["x"] - a["x"]) * sign < 0) & (moved > spread), moved)

    def rises(n: int) -> Column:
        lows = F.transform(swings(last("close", n), half), lambda p: p["x"])
        return (F.col("n") >= max(n, 25)) & (F.size(lows) >= 2) & _rising(_last(lows, 3), 1 - tolerance)

    one = one.withColumns({"up": F.when(known, gap("dips", 1)), "down": F.when(known, gap("peaks", -1)), "rising": F.array_compact(F.array(*(F.when(rises(n), n) for n in windows)))})
    one = one.withColumns({"direction": F.when(F.col("up").isNotNull(), "bullish").when(F.col("down").isNotNull(), "bearish"), "rsi_spread": F.coalesce("up", "down"), "n_rising": F.size("rising")})
    phase = F.when((F.col("n") < 20) | (F.col("n_rising") == 0), "NONE").when(F.col("direction").isNotNull(), "STRONG").otherwise("WATCH")
    one = one.withColumns({"phase": phase, "rsi_score": F.coalesce(F.least(F.lit(100.0), F.col("rsi_spread") * PER_POINT), F.lit(0.0)), "rising_score": F.when(F.col("n_rising") == len(windows), 100.0).otherwise(F.least(F.lit(100.0), F.col("n_rising") * PER_WINDOW))})
    points = F.coalesce(*(F.when(F.col("phase") == k, F.lit(v)) for k, v in PHASES.items()))
    if broker_scores is not None:
        one = one.join(broker_scores.select("code", F.col("score").alias("_bonus")), "code", "left")
        points = F.when((points > 0) & (F.col("_bonus") > 0), F.least(F.lit(100.0), F.round(points + F.col("_bonus") * bonus, 1))).otherwise(points)
    return one.select("code", "date", "phase", points.alias("score"), "direction", "rsi_spread", "rsi_score", F.array_join(F.transform("rising", lambda x: x.cast("string")), ",").alias("rising"), "rising_score")

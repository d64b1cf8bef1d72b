"""Price levels: performance over spans, swing points, retracements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import deviation, history, mean

#: Fixed values.
SPANS = (("1w", 5), ("1m", 21), ("3m", 63), ("6m", 126), ("1y", 252))
RETRACEMENTS = (0.236, 0.382, 0.5, 0.618, 0.786)
EXTENSIONS = (1.0, 1.272, 1.618, 2.0)


def performance(bars: DataFrame, year: int = 252) -> DataFrame:
    """Per code on its last day: change over each span (0 where the history is too short), extremes of a year with their first days, distance to them."""
    back = Window.partitionBy("code").orderBy(F.desc("date"))
    rows = bars.withColumns({"n": F.row_number().over(back)} | {f"p_{name}": F.lead("close", n).over(back) for name, n in SPANS})
    last = rows.filter("n = 1").select("code", "date", "close", *(F.coalesce(F.try_divide("close", f"p_{name}") - 1, F.lit(0.0)).alias(f"change_{name}") for name, _ in SPANS))
    ends = rows.filter(F.col("n") <= year).groupBy("code").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("date", F.struct("high", "n")).alias("high_date"), F.min_by("date", F.struct("low", -F.col("n"))).alias("low_date")
    )
    return last.join(ends, "code").withColumns({"from_high": F.try_divide("close", "high") - 1, "from_low": F.try_divide("close", "low") - 1})


_POINTS = "array<struct<at:bigint,date:date,price:double>>"


def _merged(near: int, top: bool):
    """A fold over a side's points in order: of those closer than `near` bars the more extreme. Prices that are no numbers replace none."""

    def merge(kept, x):
        end = F.get(kept, F.size(kept) - 1)
        more = (x["price"] > end["price"]) if top else (x["price"] < end["price"])
        more = more & ~F.isnan(x["price"]) & ~F.isnan(end["price"])
        close = (F.size(kept) > 0) & (x["at"] - end["at"] < near)
        return F.when(close & more, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).when(close, kept).otherwise(F.array_append(kept, x))

    return merge


def swings(bars: DataFrame, window: int = 15, near: int = 10) -> DataFrame:
    """(code, side, date, price, at): bars that are the extreme of `window` bars on both sides; of those closer than `near` bars the more extreme."""
    w = history()
    around = w.rowsBetween(-window, window)
    rows = bars.withColumns({"at": F.row_number().over(w).cast("long"), "n": F.count(F.lit(1)).over(around), "top": F.max("high").over(around), "bottom": F.min("low").over(around)}).filter(F.col("n") == 2 * window + 1)
    ends = F.array_compact(F.array(F.when(F.col("high") == F.col("top"), F.struct(F.lit("high").alias("side"), F.col("high").alias("price"))), F.when(F.col("low") == F.col("bottom"), F.struct(F.lit("low").alias("side"), F.col("low").alias("price")))))
    found = rows.select("code", "date", "at", F.explode(ends).alias("x")).select("code", "x.side", "date", F.col("x.price").cast("double").alias("price"), "at")
    points = found.groupBy("code", "side").agg(F.sort_array(F.collect_list(F.struct("at", "date", "price"))).cast(_POINTS).alias("points"))
    fold = lambda top: F.aggregate("points", F.array().cast(_POINTS), _merged(near, top))
    kept = points.select(F.col("code").cast("long").alias("code"), "side", F.explode(F.when(F.col("side") == "high", fold(True)).otherwise(fold(False))).alias("x"))
    return kept.select("code", "side", "x.date", "x.price", "x.at")


def retracements(bars: DataFrame, points: DataFrame, last: int = 5) -> DataFrame:
    """Per code the levels between its recent swing high and low, from the side the price is nearer to: (code, direction, kind, ratio, level)."""
    place = F.row_number().over(Window.partitionBy("code", "side").orderBy(F.desc("at")))
    recent = points.withColumn("n", place).filter(F.col("n") <= last).groupBy("code").agg(F.max(F.when(F.col("side") == "high", F.col("price"))).alias("top"), F.min(F.when(F.col("side") == "low", F.col("price"))).alias("bottom"))
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    whole = bars.withColumn("n", back).groupBy("code").agg(F.max_by("close", "date").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.min(F.when(F.col("n") <= 120, F.col("low"))).alias("half_year_low"))
    both = whole.join(recent, "code", "left").withColumns({"top": F.coalesce("top", "high"), "bottom": F.coalesce("bottom", "low")})
    flat = F.col("top") <= F.col("bottom")
    both = both.withColumns({"top": F.when(flat, F.col("high")).otherwise(F.col("top")), "bottom": F.when(flat, F.col("low")).otherwise(F.col("bottom"))})
    over = F.col("close") > F.col("top") * 1.02
    both = both.withColumns({"bottom": F.when(over, F.when(F.col("high") <= F.col("half_year_low"), F.col("low")).otherwise(F.col("half_year_low"))).otherwise(F.col("bottom")), "top": F.when(over, F.col("high")).otherwise(F.col("top"))})
    span, up = F.col("top") - F.col("bottom"), F.col("close") - F.col("bottom") > (F.col("top") - F.col("bottom")) * 0.5
    back_ = [F.struct(F.lit("retracement").alias("kind"), F.lit(r).alias("ratio"), F.when(up, F.col("top") - span * r).otherwise(F.col("bottom") + span * r).alias("level")) for r in RETRACEMENTS]
    on = [F.struct(F.lit("extension").alias("kind"), F.lit(r).alias("ratio"), F.when(up, F.col("bottom") + span * r).otherwise(F.col("top") - span * r).alias("level")) for r in EXTENSIONS]
    return both.select("code", F.when(up, "uptrend").otherwise("downtrend").alias("direction"), F.explode(F.array(*back_, *on)).alias("x")).select("code", "direction", "x.*")


_LEVELS = "array<struct<price:double,sources:array<string>,strength:int>>"


def support_resistance(bars: DataFrame, points: DataFrame, days: int = 250, near: float = 0.015, last: int = 10, most: int = 5) -> DataFrame:
    """(code, kind, price, sources, strength): the `most` levels nearest below and above the last close of each code.

    Levels are the `last` swing highs and lows of swings(), averages of 20, 60, 120 and 240 closes, Bollinger bands and round
    prices. From the lowest on, a level within `near` of the one kept before joins it. Strength, from 1 to 3, is the
    greatest number of bars of the last `days`, but for the first and the last, that turned within `near` of a member. Levels
    within 0.2 % of the close are neither.
    """
    back = Window.partitionBy("code").orderBy(F.desc("date"))
    averages = {f"ma{n}": mean("close", n) for n in (20, 60, 120, 240)}
    rows = bars.withColumns(averages | {"sd": deviation("close", 20), "step": F.col("close") - F.lag("close").over(history()), "back": F.row_number().over(back)})
    recent = rows.filter(F.col("back") <= days)
    turned = F.when((F.col("back") > 1) & (F.col("back") < F.count(F.lit(1)).over(Window.partitionBy("code"))), F.struct("low", "high", "step"))
    turns = recent.withColumn("turn", turned).groupBy("code").agg(F.collect_list("turn").alias("turns"))
    place = F.row_number().over(Window.partitionBy("code", "side").orderBy(F.desc("at")))
    swung = points.withColumn("n", place).filter(F.col("n") <= last).groupBy("code").agg(F.collect_list("price").alias("swings"))
    close = F.col("close")
    width = F.when(close < 50, 5).when(close < 200, 10).when(close < 500, 25).when(close < 2000, 50).otherwise(100)
    level = lambda x, source: F.struct(x.cast("double").alias("price"), F.lit(source).alias("source"))
    fixed = [level(F.col(c), c) for c in averages] + [level(F.col("ma20") + 2 * F.col("sd"), "bb"), level(F.col("ma20") - 2 * F.col("sd"), "bb")]
    fixed += [level((F.floor(close / width) + i) * width, "round") for i in range(-3, 4)]
    one = rows.filter("back = 1").join(turns, "code").join(swung, "code", "left")
    drawn = F.transform(F.coalesce("swings", F.array().cast("array<double>")), lambda x: level(x, "swing"))
    known = F.array_sort(F.filter(F.concat(F.array(*fixed), drawn), lambda x: x["price"] > 0))

    def strength(x):
        close_to = lambda y: F.abs(y - x["price"]) / x["price"] < near
        turn = lambda t: (close_to(t["low"]) & (t["step"] > 0)) | (close_to(t["high"]) & (t["step"] < 0))
        return F.least(F.size(F.filter("turns", turn)), F.lit(3))

    judged = F.transform(known, lambda x: F.struct(x["price"].alias("price"), F.array(x["source"]).alias("sources"), F.greatest(strength(x), F.lit(1)).alias("strength")))

    def join(kept, x):
        top = F.get(kept, F.size(kept) - 1)
        merged = F.struct(top["price"].alias("price"), F.array_union(top["sources"], x["sources"]).alias("sources"), F.greatest(top["strength"], x["strength"]).alias("strength"))
        fits = (F.size(kept) > 0) & (F.abs(top["price"] - x["price"]) / x["price"] < near)
        return F.when(fits, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(merged))).otherwise(F.array_append(kept, x))

    # In two steps, so that strengths are not worked out again at every step of the fold.
    joined = one.select("code", "close", judged.alias("judged")).withColumn("kept", F.aggregate("judged", F.array().cast(_LEVELS), join))
    out = joined.select("code", "close", F.explode("kept").alias("x")).select("code", "close", "x.price", F.array_join(F.array_sort("x.sources"), "+").alias("sources"), "x.strength")
    kind = F.when(F.col("price") < close * 0.998, "support").when(F.col("price") > close * 1.002, "resistance")
    order = F.row_number().over(Window.partitionBy("code", "kind").orderBy(F.abs(F.col("price") - close), "price"))
    return out.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("_n", order).filter(F.col("_n") <= most).select("code", "kind", "price", "sources", "strength")

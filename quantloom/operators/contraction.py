"""Volatility contraction: bases that get shallower while volume dries up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, history

_BASES = "array<struct<start:int,stop:int,high:double,low:double,depth:double>>"


def contractions(bars: DataFrame, lookback: int = 120, least_days: int = 15, least_volume: float = 500000.0, deepest: float = 0.35, limit: float = 0.095, quiet: float = 0.5, tight: float = 0.01) -> DataFrame:
    """Per code: bases, ghost_days, spring_days, score (0 to 100), pivot, breakout, and the reason why there is no pattern, or null.

    Among the last `lookback` bars a base goes from a swing high (the greatest high of 3 bars on both sides) to the first swing low
    after it that ends no other base; it lasts 5 days, is over 1 % deep and has no move above `limit`. Of the bases in
    order, those shallower than the last one kept stay. Ghost days have less than `quiet` of the 20-bar volume; a spring is a run of
    ghost days with a range below `tight`; both count in the last base. The reasons, in their order: history,
    volume, bases, depth, decay, duration. A code's window is one array of at most `lookback` bars.
    """
    wing, shortest = 3, max(5, least_days // 3)
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    rows = bars.withColumns({"move": F.abs(change("close")), "back": back}).filter(F.col("back") <= lookback)
    w = history()
    around, month = w.rowsBetween(-wing, wing), w.rowsBetween(-19, 0)
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("code")), "usual": F.when(F.count("volume").over(month) >= 10, F.avg("volume").over(month))})
    big = F.coalesce((F.col("move") > limit) & (F.col("i") > 0), F.lit(False))
    inner = (F.col("i") >= wing) & (F.col("i") < F.col("n") - wing) & ~big
    ghost = F.coalesce((F.col("usual") > 0) & (F.col("volume") < quiet * F.col("usual")), F.lit(False))
    narrow = F.when(F.col("high") > 0, (F.col("high") - F.col("low")) / F.col("high")).otherwise(0.0) < tight
    rows = rows.withColumns({"big": big, "top": inner & (F.col("high") == F.max("high").over(around)), "bottom": inner & (F.col("low") == F.min("low").over(around)), "ghost": ghost, "spring": ghost & narrow})
    bar = F.struct("i", "high", "low", "big", "top", "bottom", "ghost", "spring")
    one = rows.groupBy("code").agg(F.array_sort(F.collect_list(bar)).alias("bars"), F.count(F.lit(1)).alias("n"), *(F.max_by(c, "date").alias(c) for c in ("close", "volume", "usual")), F.avg(F.when(F.col("back") <= 20, F.col("volume"))).alias("mean_volume"))
    one = one.withColumns({"tops": F.filter("bars", lambda x: x["top"]), "bottoms": F.filter("bars", lambda x: x["bottom"]), "bigs": F.transform(F.filter("bars", lambda x: x["big"]), lambda x: x["i"])})

    def add(found, top):
        low = F.get(F.filter("bottoms", lambda x: (x["i"] > top["i"]) & ~F.exists(found, lambda y: y["stop"] == x["i"])), F.lit(0))
        depth = F.when(top["high"] > 0, (top["high"] - low["low"]) / top["high"]).otherwise(0.0)
        calm = ~F.exists("bigs", lambda i: (i >= top["i"]) & (i <= low["i"]))
        base = F.struct(top["i"].alias("start"), low["i"].alias("stop"), top["high"].alias("high"), low["low"].alias("low"), depth.alias("depth"))
        return F.when(low.isNotNull() & calm & (low["i"] - top["i"] >= shortest) & (depth > 0.01), F.array_append(found, base)).otherwise(found)

    shallower = lambda kept, x: F.when((F.size(kept) == 0) | (x["depth"] < F.get(kept, F.size(kept) - 1)["depth"]), F.array_append(kept, x)).otherwise(kept)
    one = one.withColumn("raw", F.aggregate("tops", F.array().cast(_BASES), add)).withColumn("kept", F.aggregate("raw", F.array().cast(_BASES), shallower))
    first, final = F.get("kept", F.lit(0)), F.get("kept", F.size("kept") - 1)
    one = one.withColumns({"first": first, "final": F.when(F.size("kept") > 0, final), "bases": F.size("kept")})
    inside = F.filter("bars", lambda x: (x["i"] >= F.col("final.start")) & (x["i"] <= F.col("final.stop")))
    runs = F.aggregate("inside", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct(F.when(x["spring"], s["now"] + 1).otherwise(0).alias("now"), F.when(x["spring"], F.greatest(s["most"], s["now"] + 1)).otherwise(s["most"]).alias("most")))
    one = one.withColumn("inside", inside).withColumns({"ghost_days": F.size(F.filter("inside", lambda x: x["ghost"])), "spring_days": runs["most"]})
    closer = F.greatest(F.lit(0), F.least(F.lit(20), F.floor(20 * (1 - F.try_divide(F.col("final.depth"), F.col("first.depth")))).cast("int")))
    points = F.when(F.col("bases") >= 3, 50).when(F.col("bases") >= 2, 30).otherwise(0) + F.when(F.col("bases") >= 2, F.coalesce(closer, F.lit(0))).otherwise(0) + F.least(F.lit(15), F.col("ghost_days") * 5)
    points = F.when((F.col("ghost_days") == 0) & (points > 50), 50).otherwise(points) + F.when(F.col("spring_days") >= 2, 15).otherwise(0)
    reason = (
        F.when(F.col("n") < lookback, "history").when(F.coalesce("usual", "mean_volume") < least_volume, "volume").when(F.size("raw") < 2, "bases")
        .when(F.get("raw", F.lit(0))["depth"] > deepest, "depth").when(F.col("bases") < 2, "decay").when(F.col("final.stop") - F.col("first.start") < least_days, "duration")
    )
    one = one.withColumns({"reason": reason, "score": F.least(points, F.lit(100))})
    found = lambda c, other=None: F.when(F.col("reason").isNull(), c).otherwise(F.lit(other))
    breakout = F.coalesce((F.col("close") > F.col("final.high")) & (F.col("usual") > 0) & (F.col("volume") > 2 * F.col("usual")), F.lit(False))
    return one.select("code", found(F.col("bases"), 0).alias("bases"), found(F.col("ghost_days"), 0).alias("ghost_days"), found(F.col("spring_days"), 0).alias("spring_days"), found(F.col("score"), 0).alias("score"), found(F.col("final.high")).alias("pivot"), found(breakout, False).alias("breakout"), "reason")

"""Relative strength and cross-sections: what a code does against all others of its day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, history, lag, last_rows, mean, rank_pct


def strength(bars: DataFrame) -> DataFrame:
    """code, date, rs (.6 of the 100 bars before the last 25 and .4 of the 20 before the last 5), rs_pct of the day, rs_roc over 20 bars."""
    t0, t1, t2 = lag("close", 125), lag("close", 25), lag("close", 5)
    out = bars.select("code", "date", "close", (F.pow(F.try_divide(t1, t0), F.lit(0.6)) * F.pow(F.try_divide(t2, t1), F.lit(0.4))).alias("rs"))
    return out.withColumns({"rs_pct": rank_pct("rs") * 100, "rs_roc": change("rs", 20)})


def strength_scan(bars: DataFrame, short: int = 4, mid: int = 24, long: int = 124) -> DataFrame:
    """The latest ratio of every code with enough positive closes (its own start 124 bars back) and its rating among all.

    Ratings have one decimal, rounded as DOUBLEs are in SQL: ten times the rating to the nearest whole number, halves up, over ten.
    """
    w = Window.partitionBy("code").orderBy(F.desc("date"))
    back = {f"p{n}": F.lead("close", n).over(w) for n in (short, mid, long)}
    last = bars.withColumns(back | {"_n": F.row_number().over(w)}).filter("_n = 1")
    ok = last.filter(" and ".join(f"p{n} > 0" for n in (short, mid, long)))
    ratio = F.pow(F.col(f"p{mid}") / F.col(f"p{long}"), F.lit(0.6)) * F.pow(F.col(f"p{short}") / F.col(f"p{mid}"), F.lit(0.4))
    return ok.select("code", "date", ratio.alias("rs_ratio"), F.lit(1).alias("one")).withColumn("rating", F.round(rank_pct("rs_ratio", "one") * 100 * 10) / 10).drop("one")


def sector_strength(scan: DataFrame, sectors: DataFrame, diamond: float = 90.0) -> DataFrame:
    """Per sector: median ratio, codes, codes rated at least `diamond` and their share."""
    named = scan.join(sectors, "code")
    top = F.sum(F.when(F.col("rating") >= diamond, 1).otherwise(0))
    return named.groupBy("sector").agg(F.percentile("rs_ratio", F.lit(0.5)).alias("median_rs"), F.count(F.lit(1)).alias("codes"), top.alias("diamonds"), (top / F.count(F.lit(1))).alias("diamond_share"))


def peer_alpha(scan: DataFrame, sectors: DataFrame) -> DataFrame:
    """Each code's ratio against its sector's median."""
    named = scan.join(sectors, "code")
    return named.select("code", "sector", "rs_ratio", F.try_divide("rs_ratio", F.percentile("rs_ratio", F.lit(0.5)).over(Window.partitionBy("sector"))).alias("peer_alpha"))


def breadth(bars: DataFrame) -> DataFrame:
    """Per day: advances, declines, share of codes above their 20-bar average, the advance-decline line, and days it has fallen in a row."""
    marked = bars.withColumns({"ret": change("close"), "sma": mean("close", 20)})
    day = marked.groupBy("date").agg(
        F.sum(F.when(F.col("ret") > 0, 1).otherwise(0)).alias("advances"),
        F.sum(F.when(F.col("ret") < 0, 1).otherwise(0)).alias("declines"),
        F.avg(F.when(F.col("sma").isNotNull(), F.when(F.col("close") > F.col("sma"), 1.0).otherwise(0.0))).alias("above_sma"),
    )
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # one row a day
    day = day.withColumn("net", F.col("advances") - F.col("declines")).withColumns({"ad_line": F.sum("net").over(w), "_row": F.row_number().over(w)})
    since = F.max(F.when(F.col("net") >= 0, F.col("_row"))).over(w)
    return day.withColumn("falling_days", F.col("_row") - F.coalesce(since, F.lit(0))).drop("_row", "net")


def industry_features(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Per code and day: 20-bar return, its sector's median, the excess over it (at most 5 either way), the sector's rank by rows."""
    named = bars.withColumn("ret_20", change("close", 20)).join(sectors, "code")
    out = with_sector_days(named, sector_days(named))
    return out.select("code", "date", "sector", "ret_20", "sector_momentum", "sector_rs", peer_excess("ret_20").alias("peer_alpha"))


def with_sector_days(named: DataFrame, days: DataFrame) -> DataFrame:
    """Rows (date, sector) with the columns of sector_days(), which is a row a day and sector, whatever the number of codes."""
    other = days.withColumnsRenamed({"date": "_date", "sector": "_sector"})
    return named.join(F.broadcast(other), F.col("date").eqNullSafe(F.col("_date")) & F.col("sector").eqNullSafe(F.col("_sector")), "left").drop("_date", "_sector")


def peer_excess(ret: str) -> Column:
    """What a return exceeds its sector_momentum by, at most 5 either way."""
    excess = F.col(ret) - F.col("sector_momentum")
    return F.when(excess.isNotNull(), F.greatest(F.least(excess, F.lit(5.0)), F.lit(-5.0)))  # least() passes over nulls


def sector_days(named: DataFrame) -> DataFrame:
    """A row a day and sector of (code, date, sector, ret_20): sector_momentum (the median), sector_rs (its rank by rows, as rank_pct() has it) and sector_concentration (the sector's share of the day's codes).

    Only the returns are shuffled, once, by day and sector; ranks of all rows follow from the sectors' medians and numbers of rows.
    """
    days = named.groupBy("date", "sector").agg(F.percentile("ret_20", F.lit(0.5)).alias("sector_momentum"), F.count(F.lit(1)).alias("n"))
    day = Window.partitionBy("date")
    rows = F.when(F.col("sector_momentum").isNotNull(), F.col("n"))
    upto, ties, known = F.sum(rows).over(day.orderBy(F.col("sector_momentum").asc_nulls_last())), F.sum(rows).over(Window.partitionBy("date", "sector_momentum")), F.sum(rows).over(day)
    rank = F.when(F.col("sector_momentum").isNotNull(), (upto - ties + 1 + (ties - 1) / 2) / known)
    return days.select("date", "sector", "sector_momentum", rank.alias("sector_rs"), (F.col("n") / F.sum("n").over(day)).alias("sector_concentration"))


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (3, 7, 21, 30, 90), keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns over the next n bars, and the greatest gain and loss within the next 5 and 20; `keep` names columns of the bars to return, too."""
    w = history()
    out = {f"d{n}": F.try_divide(F.lead("close", n).over(w), F.col("close")) - 1 for n in horizons}
    for n in (5, 20):
        ahead = w.rowsBetween(1, n)
        out |= {f"gain_{n}": F.try_divide(F.max("high").over(ahead), F.col("close")) - 1, f"loss_{n}": F.try_divide(F.min("low").over(ahead), F.col("close")) - 1}
    return bars.select("code", "date", *keep, *(x.alias(k) for k, x in out.items()))


def regime(index: DataFrame, fast: int = 20, slow: int = 60) -> DataFrame:
    """Per day of an index: bull, bear or sideways by its averages, and the multiplier that position sizes take."""
    one = index.withColumn("code", F.lit(0))
    out = one.select("date", "close", mean("close", fast).alias("fast"), mean("close", slow).alias("slow"))
    bull, bear = (F.col("close") > F.col("fast")) & (F.col("fast") > F.col("slow")), (F.col("close") < F.col("fast")) & (F.col("fast") < F.col("slow"))
    return out.withColumns({"regime": F.when(bull, "bull").when(bear, "bear").otherwise("sideways"), "multiplier": F.when(bull, 1.0).when(bear, 0.3).otherwise(0.6)})


def correlations(bars: DataFrame, members: DataFrame, least: int = 60) -> DataFrame:
    """Correlation of daily returns of each pair of `members` (code: a portfolio's codes) with enough common days."""
    returns = bars.join(F.broadcast(members.select("code").distinct()), "code", "left_semi").select("code", "date", change("close").alias("ret")).filter("ret is not null")
    a, b = returns.alias("a"), returns.alias("b")
    pairs = a.join(b, (F.col("a.date") == F.col("b.date")) & (F.col("a.code") < F.col("b.code")))
    out = pairs.groupBy(F.col("a.code").alias("code_a"), F.col("b.code").alias("code_b")).agg(F.corr("a.ret", "b.ret").alias("corr"), F.count(F.lit(1)).alias("days"))
    return out.filter(F.col("days") >= least)


__all__ = ["strength", "strength_scan", "sector_strength", "peer_alpha", "breadth", "industry_features", "with_sector_days", "peer_excess", "sector_days", "forward_returns", "regime", "correlations", "last_rows"]

"""Sectors that move together: correlations out of line, buckets of coupled sectors, and what may still enter them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quantloom.operators.portfolio import sector_days, sector_pairs

#: Days of the structural, flash and historical windows.
STRUCTURAL, FLASH, HISTORY = 90, 15, 756
#: A correlation is out of line from so many deviations on, or above so much; a flash is a gap of so much.
ALERT_Z, ALERT_CORR, FLASH_GAP = 1.5, 0.95, 0.20
#: Gap that counts for the market as a whole, shares of pairs that raise the level.
SYSTEMIC_GAP, ELEVATED, SYSTEMIC = 0.15, 0.20, 0.50
#: Share of a portfolio that a sector may have, and how much more a bucket.
SECTOR_CAP, BUCKET_FACTOR = 0.20, 1.2


def _rolling(days: WindowSpec, n: int) -> Column:
    """Correlation of x and y over the last n rows, null before there are as many.

    Sums over n rows are differences of running sums, which cost the same at any n; returns are small, so little is lost.
    """
    running = days.rowsBetween(Window.unboundedPreceding, 0)

    def total(c: Column) -> Column:
        whole = F.sum(c).over(running)
        return whole - F.coalesce(F.sum(c).over(days.rowsBetween(Window.unboundedPreceding, -n)), F.lit(0.0))

    x, y = F.col("x"), F.col("y")
    sx, sy = total(x), total(y)
    spread = F.sqrt(F.greatest((n * total(x * x) - sx * sx) * (n * total(y * y) - sy * sy), F.lit(0.0)))
    return F.when(F.row_number().over(days) >= n, F.try_divide(n * total(x * y) - sx * sy, spread))


def couplings(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """A row a pair of sectors: correlations over the last STRUCTURAL and FLASH days both have, mean and deviation of the
    structural one over HISTORY days, z, spike (flash less structural), alert ('absolute_extreme', 'zscore_spike' or null) and flash_alert.

    A pair without STRUCTURAL days has the correlation of those it has; one without FLASH days has no flash. A pair's rows
    are as many as days.
    """
    pair = Window.partitionBy("sector_a", "sector_b")
    rows = sector_pairs(sector_days(bars, sectors)).filter("x IS NOT NULL AND y IS NOT NULL")
    rows = rows.withColumns({"rolled": _rolling(pair.orderBy("date"), STRUCTURAL), "back": F.row_number().over(pair.orderBy(F.desc("date")))})
    last = lambda n, c: F.when(F.col("back") <= n, F.col(c))
    known = last(HISTORY - STRUCTURAL + 1, "rolled")
    out = rows.groupBy("sector_a", "sector_b").agg(
        F.corr(last(STRUCTURAL, "x"), last(STRUCTURAL, "y")).alias("structural"),
        F.when(F.count(F.lit(1)) >= FLASH, F.corr(last(FLASH, "x"), last(FLASH, "y"))).alias("flash"),
        F.count(known).alias("n"), F.avg(known).alias("m"), F.stddev_samp(known).alias("s"),
    )
    out = out.withColumns({"mean": F.when(F.col("n") < 2, F.col("structural")).otherwise(F.col("m")), "sd": F.when(F.col("n") < 2, 0.0).otherwise(F.col("s"))})
    out = out.withColumns({"z": F.when(F.col("sd") > 0.01, (F.col("structural") - F.col("mean")) / F.col("sd")).otherwise(0.0), "spike": F.col("flash") - F.col("structural")})
    alert = F.when(F.col("structural") > ALERT_CORR, "absolute_extreme").when(F.col("structural").isNotNull() & (F.col("z") > ALERT_Z), "zscore_spike")
    return out.select("sector_a", "sector_b", "structural", "flash", "mean", "sd", "z", "spike", alert.alias("alert"), F.coalesce(F.col("spike") > FLASH_GAP, F.lit(False)).alias("flash_alert"))


def systemic(pairs: DataFrame) -> DataFrame:
    """One row of couplings(): share of pairs whose flash correlation is above the structural one by SYSTEMIC_GAP, its level, and whether stops tighten."""
    out = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("spike") > SYSTEMIC_GAP, 1)).alias("spiking"))
    out = out.withColumn("score", F.coalesce(F.try_divide("spiking", "pairs"), F.lit(0.0)))
    level = F.when(F.col("score") > SYSTEMIC, "systemic").when(F.col("score") > ELEVATED, "elevated").otherwise("normal")
    return out.select("pairs", "spiking", "score", level.alias("level"), (F.col("score") > SYSTEMIC).alias("tighten_stops"))


def buckets(pairs: DataFrame, sectors: DataFrame) -> DataFrame:
    """sector, bucket (the least member), members, cap: sectors that alerts of couplings() connect, directly or not.

    The links of some dozens of sectors are one array, so what a sector reaches grows in one fold, a step a sector.
    """
    linked = pairs.filter(F.col("alert").isNotNull() | F.col("flash_alert")).select(F.col("sector_a").alias("a"), F.col("sector_b").alias("b"))
    links = linked.union(linked.select("b", "a")).agg(F.collect_set(F.struct("a", "b")).alias("links"))
    nodes = sectors.select("sector").distinct()
    rows = nodes.crossJoin(F.broadcast(links)).crossJoin(F.broadcast(nodes.agg(F.count(F.lit(1)).cast("int").alias("n"))))  # one row each
    step = lambda have, _: F.array_union(have, F.transform(F.filter("links", lambda x: F.array_contains(have, x["a"])), lambda x: x["b"]))
    rows = rows.withColumn("members", F.array_sort(F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array("sector"), step)))
    return rows.select("sector", F.get("members", F.lit(0)).alias("bucket"), F.array_join("members", ",").alias("members"), F.lit(round(SECTOR_CAP * BUCKET_FACTOR, 3)).alias("cap"))


def entries(asked: DataFrame, weights: DataFrame, held: DataFrame) -> DataFrame:
    """`asked` (sector, weight) with bucket, the portfolio's weight in it, its cap and whether the entry is allowed.

    `weights` is the portfolio's (sector, weight), `held` what buckets() gives; a sector of no bucket is judged alone, against SECTOR_CAP.
    """
    per = weights.join(F.broadcast(held), "sector").groupBy("bucket").agg(F.sum("weight").alias("in_bucket"))
    own = weights.groupBy("sector").agg(F.sum("weight").alias("alone"))
    out = asked.join(F.broadcast(held.select("sector", "bucket", "cap")), "sector", "left").join(F.broadcast(per), "bucket", "left").join(F.broadcast(own), "sector", "left")
    current = F.coalesce(F.when(F.col("bucket").isNull(), F.col("alone")).otherwise(F.col("in_bucket")), F.lit(0.0))
    cap = F.coalesce("cap", F.lit(SECTOR_CAP))
    return out.select("sector", "weight", "bucket", current.alias("current"), cap.alias("cap"), (current + F.col("weight") <= cap).alias("allowed"))

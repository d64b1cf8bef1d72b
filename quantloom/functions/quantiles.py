"""Exact quantiles of large groups, none of which meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Approximate quantiles are off by at most one in so many ranks; a bracket reaches several such errors to both sides.
ACCURACY, ERRORS = 10_000, 5


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """`by` and a column a name in `shares`: the exact, interpolated quantiles of a column of doubles, as percentile() gives them, for few groups of any size.

    percentile() holds all different values of a group in one task. Here approximate quantiles bracket each wanted one; what lies
    below a bracket is counted, and only the different values inside, a thousandth of the group, are put in order.
    """
    names = list(shares)
    known = rows.select(F.col(by).alias("_by"), F.col(value).alias("_x")).filter("_x IS NOT NULL")
    ends = [max(p - ERRORS / ACCURACY, 0.0) for p in shares.values()] + [min(p + ERRORS / ACCURACY, 1.0) for p in shares.values()]
    near = known.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", ends, ACCURACY).alias("_e"))
    small = F.col("_n") <= ACCURACY  # A bracket of so few may lack the neighbour of a rank.
    low = lambda i, p: F.when(small | F.lit(p <= ERRORS / ACCURACY), F.col("_min")).otherwise(F.get("_e", F.lit(i)))
    high = lambda i, p: F.when(small | F.lit(p >= 1 - ERRORS / ACCURACY), F.col("_max")).otherwise(F.get("_e", F.lit(len(names) + i)))
    brackets = near.select("_by", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), low(i, p).alias("low"), high(i, p).alias("high"), (F.lit(p) * (F.col("_n") - 1)).alias("rank")) for i, (k, p) in enumerate(shares.items())))).alias("b")).select("_by", "b.*")
    # Few rows: a group's brackets. What is below one counts as one value of it.
    met = known.join(F.broadcast(brackets.withColumnRenamed("_by", "_of")), F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_x") <= F.col("high")))
    counts = met.groupBy("_by", "name", "rank", F.when(F.col("_x") >= F.col("low"), F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("_by", "name").orderBy(F.asc_nulls_first("_x"))
    placed = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.struct("upto", F.col("_x").alias("x"))))["x"]
    found = placed.groupBy("_by", "name").agg(F.first("rank").alias("rank"), at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
    part = F.col("rank") - F.floor("rank")
    exact = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    found = found.withColumn("q", exact)
    return found.groupBy(F.col("_by").alias(by)).agg(*(F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in names))

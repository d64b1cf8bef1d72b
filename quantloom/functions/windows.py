"""Window and scalar helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def history(key: str = "code", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_rows(n: int, key: str = "code", order: str = "date") -> WindowSpec:
    """The current row and the n - 1 before it."""
    return history(key, order).rowsBetween(1 - n, 0)


def full(n: int, value: Column, of: str, key: str = "code", order: str = "date") -> Column:
    """`value` where the last n rows all have `of`, else null."""
    return F.when(F.count(of).over(last_rows(n, key, order)) >= n, value)


def mean(x: str, n: int) -> Column:
    return full(n, F.avg(x).over(last_rows(n)), x)


def deviation(x: str, n: int) -> Column:
    return full(n, F.stddev_samp(x).over(last_rows(n)), x)


def lag(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(history())


def change(x: str, n: int = 1) -> Column:
    """Relative change against n rows before; null where that is null or zero."""
    return F.try_divide(F.col(x), lag(x, n)) - 1


def rank_pct(x: str, by: str = "date") -> Column:
    """Rank as a share of the values that are not null, ties at their average; null stays null."""
    w = Window.partitionBy(by)
    below = F.rank().over(w.orderBy(F.col(x).asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(by, x))
    return F.when(F.col(x).isNotNull(), (below + (ties - 1) / 2) / F.count(x).over(w))


def run_length(condition: str, key: str = "code", order: str = "date") -> Column:
    """Rows since `condition` (a boolean column) last failed, this one included; 0 where it fails."""
    w = history(key, order)
    since = F.max(F.when(~F.coalesce(F.col(condition), F.lit(False)), F.col("_row"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.col("_row") - F.coalesce(since, F.lit(0))


def numbered(df: DataFrame, key: str = "code", order: str = "date") -> DataFrame:
    """`df` with _row, which run_length() reads."""
    return df.withColumn("_row", F.row_number().over(history(key, order)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, for results that are compared: as SQL rounds a DOUBLE, by scaling it, not by its decimal text."""
    scaled = lambda c: F.col(c) * 10.0**digits
    kept = lambda c: F.when(F.abs(scaled(c)) < float("inf"), F.round(scaled(c)) / 10.0**digits).otherwise(F.col(c))
    return df.select(*(kept(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

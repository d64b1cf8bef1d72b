"""Positions from trades: sales matched with purchases, first in first out or at the average cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Commission of both sides and tax on sales.
COMMISSION, TAX = 0.001425, 0.003


def _results(entry: Column, leave: Column, quantity: Column, opened: Column, closed: Column, shares: int) -> dict[str, Column]:
    """What a closed position brought; null while it is open."""
    cost, value = entry * quantity * shares, leave * quantity * shares
    commission, tax = (cost + value) * COMMISSION, value * TAX
    return {"pnl": value - cost, "net_pnl": value - cost - commission - tax, "return_pct": F.try_divide(leave, entry) - 1, "days_held": F.datediff(closed, opened)}


def fifo(trades: DataFrame, shares: int = 1) -> DataFrame:
    """Matched parts of purchases and sales: code, entry_date, entry_price, exit_date, exit_price, quantity and results; open parts have no exit.

    `trades` is (code, date, seq, side 1 or -1, quantity, price), in order of date and seq. A sale takes from what is held,
    the oldest first; what it sells beyond that is left out. Holdings that cannot fall below zero are running sums less
    their running least, so there is no loop: purchases and sales become intervals along the code's quantity, and each piece
    between two neighbouring ends belongs to the next purchase and the next sale to end. One sort a code, no range join.
    """
    w = Window.partitionBy("code").orderBy("date", "seq", "side")
    bought, sold = F.when(F.col("side") > 0, F.col("quantity")).otherwise(0), F.when(F.col("side") < 0, F.col("quantity")).otherwise(0)
    rows = trades.filter("side <> 0 AND quantity > 0").withColumn("_net", F.sum(bought - sold).over(w))
    beyond = F.greatest(-F.min("_net").over(w), F.lit(0))
    rows = rows.withColumns({"_in": F.sum(bought).over(w), "_out": F.sum(sold).over(w) - beyond})
    rows = rows.withColumn("_taken", F.col("_out") - F.coalesce(F.lag("_out").over(w), F.lit(0)))
    side = F.struct("date", "price")
    ends = rows.filter("side > 0 OR _taken > 0").select(
        "code", F.when(F.col("side") > 0, F.col("_in")).otherwise(F.col("_out")).alias("_end"), "side", "date", "seq", F.when(F.col("side") > 0, side).alias("_buy"), F.when(F.col("side") < 0, side).alias("_sell")
    )
    along = Window.partitionBy("code").orderBy("_end", "side", "date", "seq")
    # What comes next is what came last from the other end: a frame that ends at the last row would be read again for each row.
    ahead = Window.partitionBy("code").orderBy(*(F.desc(c) for c in ("_end", "side", "date", "seq"))).rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.withColumns({"quantity": F.col("_end") - F.coalesce(F.lag("_end").over(along), F.lit(0)), "b": F.last("_buy", ignorenulls=True).over(ahead), "s": F.last("_sell", ignorenulls=True).over(ahead)}).filter("quantity > 0")
    out = pieces.select("code", F.col("b.date").alias("entry_date"), F.col("b.price").alias("entry_price"), F.col("s.date").alias("exit_date"), F.col("s.price").alias("exit_price"), "quantity")
    return out.withColumns(_results(F.col("entry_price"), F.col("exit_price"), F.col("quantity"), F.col("entry_date"), F.col("exit_date"), shares))


def average_cost(trades: DataFrame, shares: int = 1) -> DataFrame:
    """Positions by average cost: a row a sale, as far as anything is held, and one for what is left of a code; columns as of fifo().

    Purchases join one holding, whose mean price is each sale's entry price and whose first day its entry date, until nothing is left.
    Each trade hangs on those before it, so a code's trades are folded in order, as one array.
    """
    row = F.struct("date", "seq", "side", F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"))
    codes = trades.filter("side <> 0 AND quantity > 0").groupBy("code").agg(F.array_sort(F.collect_list(row)).alias("x"))
    part = "struct<entry_date:date,entry_price:double,exit_date:date,exit_price:double,quantity:double>"
    start = F.struct(F.lit(0.0).alias("held"), F.lit(0.0).alias("cost"), F.lit(None).cast("date").alias("first"), F.array().cast(f"array<{part}>").alias("out"))

    def add(s: Column, t: Column) -> Column:
        more = F.struct((s["held"] + t["quantity"]).alias("held"), (s["cost"] + t["quantity"] * t["price"]).alias("cost"), F.when(s["held"] == 0, t["date"]).otherwise(s["first"]).alias("first"), s["out"].alias("out"))
        taken, mean = F.least(t["quantity"], s["held"]), s["cost"] / s["held"]
        sale = F.struct(s["first"].alias("entry_date"), mean.alias("entry_price"), t["date"].alias("exit_date"), t["price"].alias("exit_price"), taken.alias("quantity"))
        left = s["held"] - taken
        less = F.struct(left.alias("held"), F.when(left > 0, mean * left).otherwise(0.0).alias("cost"), F.when(left > 0, s["first"]).alias("first"), F.array_append(s["out"], sale).alias("out"))
        return F.when(t["side"] > 0, more).when(s["held"] > 0, less).otherwise(s)

    def done(s: Column) -> Column:
        rest = F.struct(s["first"].alias("entry_date"), (s["cost"] / s["held"]).alias("entry_price"), F.lit(None).cast("date").alias("exit_date"), F.lit(None).cast("double").alias("exit_price"), s["held"].alias("quantity"))
        return F.when(s["held"] > 0, F.array_append(s["out"], rest)).otherwise(s["out"])

    out = codes.select("code", F.explode(F.aggregate("x", start, add, done)).alias("p")).select("code", "p.*")
    return out.withColumns(_results(F.col("entry_price"), F.col("exit_price"), F.col("quantity"), F.col("entry_date"), F.col("exit_date"), shares))

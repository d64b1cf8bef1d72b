"""Market tables of the model, derived from the star schema: bars, index, sectors, broker flows, fundamentals, trades, ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.snapshots import bucketed


def tick_order() -> Column:
    """Order of the ticks of a day in one number, which aggregates by hash: order (below 2**44), line (below 8), part.

    Rows that repeat an order's line, part and day are the same tick.
    """
    shift = lambda x, n: F.shiftleft(F.col(x).cast("long"), n)
    return shift("l_orderkey", 19) + shift("l_linenumber", 16) + F.pmod("l_partkey", F.lit(1 << 16))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, open, high, low, close, volume: a line item is a tick of its supplier.

    A day has hardly more than one tick of a code, so ticks go to their code first: they are shuffled once, for the days and
    for all windows by code.
    """
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    return _bars(_ticks(lines).repartition("code"))


def _ticks(lines: DataFrame) -> DataFrame:
    price = F.when(F.col("l_quantity") > 0, F.col("l_extendedprice") / F.col("l_quantity"))
    return lines.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), price.alias("p"), F.col("l_quantity").alias("size"), tick_order().alias("at"), *(c for c in lines.columns if not c.startswith("l_")))


def _bars(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("code", "date").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("size").alias("volume"))


def _flows(lines: DataFrame) -> DataFrame:
    return lines.groupBy("code", "broker", "date").agg(*_traded())


def _traded() -> list[Column]:
    return [F.sum(F.when(F.col("sold"), 0.0).otherwise(F.col("size"))).alias("buy"), F.sum(F.when(F.col("sold"), F.col("size")).otherwise(0.0)).alias("sell")]


def bar_sums() -> dict[str, Column]:
    """A bar from what the brokers of its day traded, see by_code()."""
    return {"open": F.min_by("_open", "_first"), "high": F.max("_high"), "low": F.min("_low"), "close": F.max_by("_close", "_last"), "volume": F.sum("_volume")}


def by_code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """bars() and broker_flows() from one table of all lines in buckets of codes, built once a session.

    What a query makes of them by code, however much, is shuffled no more: windows and aggregates meet in the bucket. Joins do,
    too, but only by code alone: those by code and date would be dealt anew. So the flows have what a day's bar is made of
    besides (bar_sums(); nothing for days without a tick), and other tables come by joins.by_day().
    """

    def build() -> DataFrame:
        lines = table(spark, sf_dir, "lineitem").withColumns({"broker": F.col("l_partkey") % 20, "sold": F.col("l_returnflag") == "R"})
        return _ticks(lines)

    lines = bucketed(spark, "lines", sf_dir, "code", "date", build)
    traded = F.col("size") > 0
    at, size = F.when(traded, F.col("at")), F.when(traded, F.col("size"))
    own = {"_open": F.min_by("p", at), "_first": F.min(at), "_high": F.max("p"), "_low": F.min("p"), "_close": F.max_by("p", at), "_last": F.max(at), "_volume": F.sum(size)}
    flows = lines.groupBy("code", "broker", "date").agg(*_traded(), *(x.alias(c) for c, x in own.items()))
    return _bars(lines.filter("size > 0")), flows


def index_bars(frame: DataFrame) -> DataFrame:
    """date, close, volume of the equally weighted index of all codes."""
    return frame.groupBy("date").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, industry, sector; at most one row a supplier."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    groups = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.join(F.broadcast(groups), suppliers["s_nationkey"] == groups["n_nationkey"]).select(F.col("s_suppkey").alias("code"), "industry", "sector")


def broker_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, broker, date, buy, sell: returned items are sales."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), (F.col("l_partkey") % 20).alias("broker"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("size"), (F.col("l_returnflag") == "R").alias("sold"))
    return _flows(lines)


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """industry, quarter_end, available_date (46 days later) and revenue."""
    orders, customer, nation = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    sold = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy("c_nationkey", F.date_trunc("quarter", "o_orderdate").alias("quarter")).agg(F.sum("o_totalprice").alias("revenue"))
    end = F.date_sub(F.add_months(F.to_date("quarter"), 3), 1)
    named = sold.join(F.broadcast(nation), sold["c_nationkey"] == nation["n_nationkey"])
    return named.select(F.col("n_name").alias("industry"), end.alias("quarter_end"), F.date_add(end, 46).alias("available_date"), "revenue")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, code, open_date, close_date, cost, proceeds, tag: an order is a position that its last shipment closes."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    closed = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("code"), F.to_date(F.max("l_shipdate")).alias("close_date"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("proceeds"))
    return orders.join(closed, orders["o_orderkey"] == closed["l_orderkey"]).select(
        F.col("o_orderkey").alias("trade_id"), "code", F.to_date("o_orderdate").alias("open_date"), "close_date", F.col("o_totalprice").alias("cost"), "proceeds", F.col("o_orderpriority").alias("tag")
    )


#: The same tables as DuckDB reads them.
SQL = """
ticks AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, * FROM lineitem WHERE l_quantity > 0),
bars AS (
  SELECT code, date, first(p ORDER BY l_orderkey, l_linenumber, l_partkey % 65536) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY l_orderkey, l_linenumber, l_partkey % 65536) AS close, sum(l_quantity) AS volume
  FROM ticks GROUP BY code, date),
idx AS (SELECT date, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY date),
sectors AS (
  SELECT s_suppkey AS code, n_name AS industry, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
flows AS (
  SELECT l_suppkey AS code, l_partkey % 20 AS broker, CAST(l_shipdate AS DATE) AS date, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS buy,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS sell FROM lineitem GROUP BY ALL),
fundamentals AS (
  SELECT n_name AS industry, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, CAST(q + INTERVAL 3 MONTH + INTERVAL 45 DAY AS DATE) AS available_date, revenue
  FROM (SELECT c_nationkey, date_trunc('quarter', o_orderdate) AS q, sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  JOIN nation ON c_nationkey = n_nationkey),
trades AS (
  SELECT o_orderkey AS trade_id, code, CAST(o_orderdate AS DATE) AS open_date, close_date, o_totalprice AS cost, proceeds, o_orderpriority AS tag
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS code, CAST(max(l_shipdate) AS DATE) AS close_date, sum(l_extendedprice * (1 - l_discount)) AS proceeds
                    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)
"""

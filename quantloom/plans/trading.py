"""Positions from line items, and ranks in moving windows, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import history, numbered, run_length
from quantloom.operators import indicators, matching
from quantloom.plans.queries import _MOVING, _RET, _W, _full, query
from quantloom.sources import market
from quantloom.streaming import heat


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a trade of its supplier: returned ones are sales."""
    side = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return market.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), market.tick_order().alias("seq"), side.alias("side"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    ).filter("quantity > 0")


_TRADED = """lt AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, (l_orderkey, l_linenumber, l_partkey % 65536) AS seq, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_quantity::BIGINT AS q, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_quantity::BIGINT > 0),
ln AS (SELECT *, sum(side * q) OVER w AS net, sum(CASE WHEN side > 0 THEN q ELSE 0 END) OVER w AS bought, sum(CASE WHEN side < 0 THEN q ELSE 0 END) OVER w AS sold FROM lt WINDOW w AS (PARTITION BY code ORDER BY date, seq, side)),
lo AS (SELECT *, sold - greatest(-min(net) OVER (PARTITION BY code ORDER BY date, seq, side), 0) AS done FROM ln),
ls AS (SELECT *, coalesce(lag(done) OVER (PARTITION BY code ORDER BY date, seq, side), 0) AS before, max(done) OVER (PARTITION BY code) AS all_sold FROM lo),
lb AS (SELECT code, date, price, bought - q AS a, bought AS b, all_sold FROM ls WHERE side > 0), lz AS (SELECT code, date, price, before AS a, done AS b FROM ls WHERE side < 0 AND done > before),
lm AS (SELECT x.code, x.date AS entry_date, x.price AS entry_price, y.date AS exit_date, y.price AS exit_price, least(x.b, y.b) - greatest(x.a, y.a) AS quantity FROM lb x JOIN lz y ON x.code = y.code AND x.a < y.b AND y.a < x.b
  UNION ALL SELECT code, date, price, NULL, NULL, b - greatest(a, all_sold) FROM lb WHERE b > all_sold)"""


@query(
    "fifo_positions",
    f"""{_TRADED} SELECT code, entry_date, round(entry_price, 9) AS entry_price, exit_date, round(exit_price, 9) AS exit_price, quantity::BIGINT AS quantity, round(quantity * (exit_price - entry_price), 9) AS pnl,
    round(quantity * (exit_price - entry_price) - quantity * (exit_price + entry_price) * 0.001425::DOUBLE - quantity * exit_price * 0.003::DOUBLE, 9) AS net_pnl, round(exit_price / entry_price - 1, 9) AS return_pct, (exit_date - entry_date)::INTEGER AS days_held FROM lm""",
    digits=9,
    dates=("entry_date", "exit_date"),
)
def fifo_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fifo(line_trades(spark, sf_dir))


@query("average_cost_positions", digits=6)
def average_cost_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades folded in order are beyond SQL; tests hold them against a loop."""
    return matching.average_cost(line_trades(spark, sf_dir))


@query(
    "volatility_guard",
    f"""{_RET}, vm AS (SELECT *, abs(ret) AS move FROM ret),
vr AS (SELECT code, date, close, {_full("avg(move)", "move", 20)} AS atr, CASE WHEN count(close) OVER w >= 10 THEN avg(close) OVER w END AS average, row_number() {_W} AS i FROM vm WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)),
vk AS (SELECT a.code, a.i, CASE WHEN any_value(a.atr) IS NOT NULL AND count(b.atr) >= 60 THEN (count(*) FILTER (b.atr < a.atr) + (count(*) FILTER (b.atr = a.atr) + 1) / 2) / count(b.atr) END AS rank_pct FROM vr a JOIN vr b ON a.code = b.code AND b.i BETWEEN a.i - 251 AND a.i GROUP BY a.code, a.i)
SELECT code, date, round(rank_pct, 9) AS rank_pct, coalesce(rank_pct > 0.9 AND close < average, false) AS guarded FROM vr JOIN vk USING (code, i)""",
    digits=9,
    dates=("date",),
)
def volatility_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.volatility_guard(market.bars(spark, sf_dir)).select("code", "date", "rank_pct", "guarded")


def heat_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan a month: each code's last bar is a BUY above its average of 20 bars; weights follow from how long it has been there."""
    rows = numbered(indicators.moving(market.bars(spark, sf_dir))).withColumn("_up", F.col("close") > F.col("sma_20"))
    rows = rows.withColumn("run", run_length("_up")).withColumn("ts", F.trunc("date", "MM").cast("timestamp"))
    # The next bar of the code tells a month's last one, in the order that the windows have.
    rows = rows.filter("sma_20 IS NOT NULL").withColumn("_next", F.lead("ts").over(history()))
    rows = rows.filter(F.col("_next").isNull() | (F.col("_next") != F.col("ts"))).join(market.sectors(spark, sf_dir), "code")
    maturity = F.when(F.col("run") > 15, "Structural Shift").when(F.col("run") > 7, "Trend Formation").when(F.col("run") > 0, "Speculative Spike")
    weight = F.when(F.col("run") > 15, 2.0).when(F.col("run") > 7, 1.5).when(F.col("run") > 0, 1.0).otherwise(0.0)
    return rows.select("code", "sector", "ts", F.when(F.col("run") > 0, "BUY").otherwise("HOLD").alias("signal"), maturity.alias("maturity"), weight.alias("weight"), "vol_ratio")


def sector_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat_scans(spark, sf_dir).groupBy("sector", "ts").agg(F.avg("weight").alias("heat"), F.coalesce(F.avg(F.when((F.col("signal") == "BUY") & (F.col("vol_ratio") > 0), F.col("vol_ratio"))), F.lit(0.0)).alias("volume"))


_HEATS = f"""{_MOVING}, hn AS (SELECT *, row_number() {_W} AS i FROM mv),
hr AS (SELECT *, i - coalesce(max(CASE WHEN NOT coalesce(close > sma_20, false) THEN i END) {_W}, 0) AS run, date_trunc('month', date)::DATE AS ts FROM hn),
hl AS (SELECT hr.*, sector, CASE WHEN run > 15 THEN 'Structural Shift' WHEN run > 7 THEN 'Trend Formation' WHEN run > 0 THEN 'Speculative Spike' END AS maturity, CASE WHEN run > 15 THEN 2.0::DOUBLE WHEN run > 7 THEN 1.5::DOUBLE WHEN run > 0 THEN 1 ELSE 0 END AS weight
  FROM hr JOIN sectors USING (code) WHERE sma_20 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, ts ORDER BY date DESC) = 1)"""


_HEAT_STEPS = f"""{_HEATS}, hs AS (SELECT sector, ts, avg(weight) AS heat, coalesce(avg(vol_ratio) FILTER (run > 0 AND vol_ratio > 0), 0) AS volume FROM hl GROUP BY sector, ts), hb AS (SELECT *, lag(heat) OVER (PARTITION BY sector ORDER BY ts) AS b FROM hs)"""
_MOMENTUM = """CASE WHEN b IS NULL THEN 'new' WHEN round(heat - b, 9) >= 0.1 AND round(heat / greatest(b, 0.05::DOUBLE), 9) >= 2 AND volume >= 1.2 THEN 'surge' WHEN round(heat - b, 9) >= 0.1 THEN 'heating' WHEN round(heat - b, 9) <= -0.1 THEN 'cooling' ELSE 'stable' END"""


@query(
    "heat_changes",
    f"""{_HEAT_STEPS}
SELECT sector, ts::VARCHAR AS month, round(heat, 9) AS heat, round(coalesce(heat - b, 0), 9) AS delta, round(CASE WHEN b IS NULL THEN 0 ELSE heat / greatest(b, 0.05::DOUBLE) END, 9) AS jump, {_MOMENTUM} AS momentum FROM hb""",
    digits=9,
)
def heat_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat.heat_changes(sector_scans(spark, sf_dir)).withColumn("month", F.to_date("ts").cast("string")).drop("ts")


@query(
    "maturity_rises",
    f"""{_HEATS}, hm AS (SELECT code, ts, run, coalesce(maturity, 'N/A') AS m, CASE WHEN run > 15 THEN 3 WHEN run > 7 THEN 2 WHEN run > 0 THEN 1 ELSE 0 END AS r FROM hl),
hp AS (SELECT *, lag(m) OVER w AS b, lag(r) OVER w AS br FROM hm WINDOW w AS (PARTITION BY code ORDER BY ts)) SELECT code, ts::VARCHAR AS month, b AS "from", m AS "to" FROM hp WHERE run > 0 AND r > br""",
)
def maturity_rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat.maturity_rises(heat_scans(spark, sf_dir)).withColumn("month", F.to_date("ts").cast("string")).drop("ts")

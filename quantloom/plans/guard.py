"""States of the market, scores, snapshots and alerts over the driver's tables, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import history
from quantloom.operators import guard, relative, screener
from quantloom.plans.queries import _MOVING, _REC, _RET, _SCAN, _W, _full, query
from quantloom.sources import market, tables

_BREADTH = f"""bm AS (SELECT *, {_full("avg(close)", "close", 20)} AS sma FROM ret),
bd AS (SELECT date, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) AS down, avg(CASE WHEN sma IS NOT NULL THEN CASE WHEN close > sma THEN 1.0 ELSE 0.0 END END) AS above FROM bm GROUP BY date),
br AS (SELECT date, above, i - coalesce(max(CASE WHEN up >= down THEN i END) OVER (ORDER BY date), 0) AS falling FROM (SELECT *, row_number() OVER (ORDER BY date) AS i FROM bd))"""


@query(
    "market_guard",
    f"""{_RET}, {_BREADTH}, ix AS (SELECT date, avg(open) AS open, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY date),
g AS (SELECT *, row_number() OVER w AS n, avg(close) OVER (ORDER BY date ROWS 19 PRECEDING) AS ma20, avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) AS ma200, open / nullif(lag(close) OVER w, 0) - 1 AS gap,
  volume > 2 * avg(volume) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS busy FROM ix WINDOW w AS (ORDER BY date)),
t AS (SELECT g.date, coalesce(close < ma200 AND coalesce(above, 0) < 0.2, false) AS lock, concat_ws(';', CASE WHEN close < ma20 THEN 'below_ma20' END, CASE WHEN falling >= 5 THEN 'falling_line' END, CASE WHEN gap < -0.03 AND busy THEN 'gap' END) AS caution FROM g LEFT JOIN br USING (date) WHERE n >= 200),
l AS (SELECT date, CASE WHEN lock THEN 'lockdown' ELSE caution END AS triggers, CASE WHEN lock THEN 2 WHEN caution <> '' THEN 1 ELSE 0 END::INTEGER AS level FROM t)
SELECT date, level, CASE level WHEN 2 THEN 'LOCKDOWN' WHEN 1 THEN 'CAUTION' ELSE 'NORMAL' END AS state, CASE level WHEN 2 THEN 0 WHEN 1 THEN 0.5 ELSE 1 END::DOUBLE AS exposure, triggers FROM l""",
    dates=("date",),
)
def market_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    index = frame.groupBy("date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"), F.sum("volume").alias("volume"))
    return guard.market_guard(index, relative.breadth(frame))


_SIX = f"""{_MOVING}, {_REC},
h0 AS (SELECT *, atr / nullif(close, 0) AS rng, macd - macd_signal AS hist, row_number() {_W} AS n FROM mv JOIN rec USING (code, date)),
h1 AS (SELECT *, median(rng) OVER (PARTITION BY code ORDER BY date ROWS 59 PRECEDING) AS mid, (hist - lag(hist, 4) {_W}) / 4 AS slope0, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM h0),
h AS (SELECT code, date, coalesce(round(adx, 2), 20) AS adx, coalesce(round(rsi, 2), 50) AS rsi, coalesce(round(rng / nullif(mid, 0), 2), 1) AS vol, round(coalesce(slope0, 0), 4) AS slope, round(close / sma_20 - 1, 4) AS o20, round(sma_20 / sma_60 - 1, 4) AS o60 FROM h1 WHERE back = 1 AND n >= 60),
f AS (SELECT *, adx >= 22 AS tr, adx >= 30 AS st, vol > 1.15 AS hv, (o20 > 0 AND o60 > 0) OR rsi > 55 AS bull, (o20 < 0 AND o60 < 0) OR rsi < 45 AS bear, rsi BETWEEN 40 AND 60 AS md FROM h),
s AS (SELECT code, date, CASE WHEN tr AND bull THEN 3 + CASE WHEN hv THEN 0 ELSE 1.5 END + CASE WHEN slope > 0 THEN 1 ELSE 0 END + CASE WHEN st THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS bull_trending,
  CASE WHEN bull AND hv THEN 2.5 + CASE WHEN tr THEN 1.5 ELSE 0 END + CASE WHEN rsi > 70 THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS bull_volatile,
  CASE WHEN tr AND bear THEN 3 + CASE WHEN hv THEN 0 ELSE 1.5 END + CASE WHEN slope < 0 THEN 1 ELSE 0 END + CASE WHEN st THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS bear_trending,
  CASE WHEN bear AND hv THEN 2.5 + CASE WHEN tr THEN 1.5 ELSE 0 END + CASE WHEN rsi < 30 THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS bear_volatile,
  CASE WHEN NOT tr THEN 2 + CASE WHEN hv THEN 0 ELSE 2 END + CASE WHEN md THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS range_quiet, CASE WHEN NOT tr AND hv THEN 3 + CASE WHEN md THEN 0.5 ELSE 0 END ELSE 0 END::DOUBLE AS range_volatile FROM f),
b AS (SELECT *, greatest(bull_trending, bull_volatile, bear_trending, bear_volatile, range_quiet, range_volatile) AS best, bull_trending + bull_volatile + bear_trending + bear_volatile + range_quiet + range_volatile AS total FROM s),
six AS (SELECT *, CASE best WHEN bull_trending THEN 'bull_trending' WHEN bull_volatile THEN 'bull_volatile' WHEN bear_trending THEN 'bear_trending' WHEN bear_volatile THEN 'bear_volatile' WHEN range_quiet THEN 'range_quiet' ELSE 'range_volatile' END AS regime FROM b)"""


@query(
    "six_regimes",
    _SIX
    + """ SELECT code, date, regime, coalesce(round(best / nullif(total, 0), 3), 0.5) AS confidence, CASE regime WHEN 'bull_trending' THEN 1 WHEN 'bull_volatile' THEN 0.7 WHEN 'bear_trending' THEN 0.3 WHEN 'bear_volatile' THEN 0.1 WHEN 'range_quiet' THEN 0.5 ELSE 0.3 END::DOUBLE AS position,
    bull_trending, bull_volatile, bear_trending, bear_volatile, range_quiet, range_volatile FROM six""",
    dates=("date",),
)
def six_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.six_regimes(market.bars(spark, sf_dir))


_GROWTH_SQL = """CASE WHEN yoy IS NULL THEN 50 WHEN yoy > 50 THEN 95 WHEN yoy > 20 THEN 80 + (yoy - 20) / 30 * 15 WHEN yoy > 10 THEN 65 + (yoy - 10) / 10 * 15 WHEN yoy > 0 THEN 50 + yoy / 10 * 15 WHEN yoy > -10 THEN 35 + yoy / 10 * 15
  WHEN yoy > -20 THEN 20 + (yoy + 10) / 10 * 15 ELSE greatest(5, 10 + (yoy + 20) / 20 * 10) END"""


@query(
    "energy_penalty",
    _MOVING
    + f""", e AS (SELECT code, date, coalesce(tr / nullif({_full("avg(tr)", "tr", 20)}, 0) > 2.5, false) AS overheat, coalesce(volume / nullif(vol_5, 0) < 1.5, false) AS thin FROM mv)
SELECT code, date, overheat, thin, round((CASE WHEN overheat THEN 0.8 ELSE 1 END * CASE WHEN thin THEN 0.9 ELSE 1 END)::DOUBLE, 6) AS factor FROM e""",
    dates=("date",),
)
def energy_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.energy_penalty(market.bars(spark, sf_dir))


#: assessments as judged, with all indicators.
_JUDGED = f"""{_MOVING}, {_REC},
a0 AS (SELECT *, sma_20 / nullif(lag(sma_20, 9) {_W}, 0) - 1 AS slope0, close / nullif(lag(close, 4) {_W}, 0) - 1 AS short0, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM mv JOIN rec USING (code, date)),
a AS (SELECT *, coalesce(adx, 0) AS x, coalesce(slope0, 0) AS slope, coalesce(short0, 0) AS short FROM a0 WHERE back = 1),
r AS (SELECT *, CASE WHEN slope > 0.01 AND x > 25 THEN 'strong_up' WHEN slope > 0.003 THEN 'up' WHEN slope < -0.01 AND x > 25 THEN 'strong_down' WHEN slope < -0.003 THEN 'down' ELSE 'flat' END AS raw,
  (CASE WHEN coalesce(plus_di, 0) > coalesce(minus_di, 0) THEN 1 ELSE -1 END + CASE WHEN coalesce(rsi, 0) > 50 THEN 1 ELSE -1 END + CASE WHEN coalesce(macd, 0) > coalesce(macd_signal, 0) THEN 1 ELSE -1 END + CASE WHEN coalesce(k, 0) > coalesce(d, 0) THEN 1 ELSE -1 END)::INTEGER AS votes FROM a),
judged AS (SELECT * EXCLUDE (votes), CASE WHEN sma_5 > sma_20 AND sma_20 > sma_60 THEN 'bullish' WHEN sma_5 < sma_20 AND sma_20 < sma_60 THEN 'bearish' ELSE 'tangled' END AS averages,
  CASE WHEN raw IN ('strong_up', 'up') AND short < -0.05 THEN 'flat' WHEN raw IN ('strong_down', 'down') AND short > 0.05 THEN 'flat' ELSE raw END AS trend, CASE WHEN x > 30 THEN 'strong' WHEN x > 18 THEN 'middle' ELSE 'weak' END AS strength, votes,
  CASE WHEN votes >= 3 THEN 'strong_bull' WHEN votes >= 1 THEN 'bull' WHEN votes >= -1 THEN 'neutral' WHEN votes >= -3 THEN 'bear' ELSE 'strong_bear' END AS momentum FROM r)"""


@query("assessments", _JUDGED + " SELECT code, date, averages, trend, strength, votes, momentum FROM judged", dates=("date",))
def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.assessment(market.bars(spark, sf_dir))


_GROWTH = """gy AS (SELECT industry, (revenue / nullif(lag(revenue, 4) OVER (PARTITION BY industry ORDER BY quarter_end), 0) - 1) * 100 AS revenue_yoy, row_number() OVER (PARTITION BY industry ORDER BY quarter_end DESC) AS back FROM fundamentals)"""


def _growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each industry's last quarter against that of the year before, in percent."""
    from pyspark.sql import Window

    w = Window.partitionBy("industry").orderBy("quarter_end")
    rows = market.fundamentals(spark, sf_dir).withColumns({"revenue_yoy": (F.try_divide("revenue", F.lag("revenue", 4).over(w)) - 1) * 100, "_back": F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("quarter_end")))})
    return rows.filter("_back = 1").select("industry", "revenue_yoy")


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    return guard.full_snapshot(frame, market.sectors(spark, sf_dir), relative.strength_scan(frame), _growth(spark, sf_dir))


_SNAP = f"""{_MOVING}, {_REC}, {_SCAN}, {_GROWTH},
sn AS (SELECT mv.*, rec.* EXCLUDE (code, date), mv.close / nullif(mv.before, 0) - 1 AS change_pct FROM (SELECT *, lag(close) {_W} AS before FROM mv) mv JOIN rec USING (code, date) QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
full_snap AS (SELECT sn.*, sector, sectors.industry, rs_ratio, rating, revenue_yoy, CASE WHEN sma_20 > sma_60 THEN 'up' WHEN sma_20 < sma_60 THEN 'down' ELSE 'flat' END AS trend FROM sn LEFT JOIN sectors USING (code) LEFT JOIN scan USING (code) LEFT JOIN gy ON gy.industry = sectors.industry AND gy.back = 1)"""


@query(
    "full_snapshot",
    _SNAP + " SELECT code, date, round(close, 4) AS close, round(change_pct, 4) AS change_pct, round(rsi, 4) AS rsi, round(adx, 4) AS adx, round(k, 4) AS k, trend, sector, industry, rating, round(revenue_yoy, 4) AS revenue_yoy FROM full_snap",
    digits=4,
    dates=("date",),
)
def full_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).select("code", "date", "close", "change_pct", "rsi", "adx", "k", "trend", "sector", "industry", "rating", "revenue_yoy")


@query(
    "technical_screen",
    _SNAP + " SELECT code, sector, round(rsi, 4) AS rsi, round(adx, 4) AS adx, rating, trend FROM full_snap WHERE rsi BETWEEN 35 AND 75 AND adx > 5 AND rating >= 20 AND trend <> 'flat' AND revenue_yoy > -90 ORDER BY rating DESC, code LIMIT 40",
    digits=4,
)
def technical_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {"rsi": {"min": 35, "max": 75}, "adx": [{"op": ">", "value": 5}], "rating": {"min": 20}, "trend": {"op": "!=", "value": "flat"}, "revenue_yoy": [{"op": ">", "value": -90}]}
    return screener.screen(_snapshot(spark, sf_dir), conditions, "rating", True, 40).select("code", "sector", "rsi", "adx", "rating", "trend")


_LAGS = ", ".join(f"lag({c}) {_W} AS {c}_b" for c in ("close", "sma_5", "sma_20", "bb_upper", "bb_lower", "macd", "macd_signal", "k", "d"))
_RULES = {
    "macd_up": guard.cross("macd", "macd_signal"),
    "macd_down": guard.cross("macd_signal", "macd"),
    "kd_up": guard.cross("k", "d"),
    "kd_down": guard.cross("d", "k"),
    "averages_up": guard.cross("sma_5", "sma_20"),
    "rsi_high_and_trending": "rsi > 60 AND adx > 15",
    "rsi_low_or_band": "rsi < 40 OR (close < bb_lower AND close_before >= bb_lower_before)",
    "moved_on_volume": "abs(change_pct) > 0.5 AND volume > 1.5 * vol_20",
}


@query(
    "indicator_alerts",
    f"""{_MOVING}, {_REC}, al AS (SELECT *, close / nullif(lag(close) {_W}, 0) - 1 AS change_pct, {_LAGS} FROM mv JOIN rec USING (code, date))
SELECT code, date, 'macd_up' AS rule FROM al WHERE macd_b <= macd_signal_b AND macd > macd_signal UNION ALL SELECT code, date, 'macd_down' FROM al WHERE macd_signal_b <= macd_b AND macd_signal > macd
UNION ALL SELECT code, date, 'kd_up' FROM al WHERE k_b <= d_b AND k > d UNION ALL SELECT code, date, 'kd_down' FROM al WHERE d_b <= k_b AND d > k UNION ALL SELECT code, date, 'averages_up' FROM al WHERE sma_5_b <= sma_20_b AND sma_5 > sma_20
UNION ALL SELECT code, date, 'rsi_high_and_trending' FROM al WHERE rsi > 60 AND adx > 15 UNION ALL SELECT code, date, 'rsi_low_or_band' FROM al WHERE rsi < 40 OR (close < bb_lower AND close_b >= bb_lower_b)
UNION ALL SELECT code, date, 'moved_on_volume' FROM al WHERE abs(change_pct) > 0.5 AND volume > 1.5 * vol_20""",
    dates=("date",),
)
def indicator_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.alerts(guard.alert_frame(market.bars(spark, sf_dir), _RULES), _RULES)


@query(
    "chain_positions",
    "p AS (SELECT sector AS chain, code, (row_number() OVER (PARTITION BY sector ORDER BY code) - 1) / greatest(count(*) OVER (PARTITION BY sector) - 1, 1) AS place FROM sectors) SELECT chain, code, round(place, 6) AS position FROM p",
)
def chain_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = market.sectors(spark, sf_dir).groupBy(F.col("sector").alias("chain")).agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return tables.chain_positions(chains)


@query(
    "statement_pivot",
    """l AS (SELECT code, date, CASE broker % 4 WHEN 0 THEN 'revenue' WHEN 1 THEN 'cost' WHEN 2 THEN 'profit' ELSE 'other' END AS type, buy AS value, broker FROM flows)
SELECT code, date, round(first(value ORDER BY broker) FILTER (type = 'revenue'), 4) AS revenue, round(first(value ORDER BY broker) FILTER (type = 'cost'), 4) AS cost, round(first(value ORDER BY broker) FILTER (type = 'profit'), 4) AS profit FROM l WHERE type <> 'other' GROUP BY code, date""",
    digits=4,
    dates=("date",),
)
def statement_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brokers' buying as long statements: three types of figures, and others that are not asked for."""
    kind = F.get(F.array(*(F.lit(x) for x in ("revenue", "cost", "profit", "other"))), (F.col("broker") % 4).cast("int"))
    long = market.broker_flows(spark, sf_dir).select("code", "date", kind.alias("type"), F.col("buy").alias("value"), F.col("broker").alias("order"))
    return tables.statements(long, ["code", "date"], ["revenue", "cost", "profit"])


@query("long_series", "n AS (SELECT code, count(*) AS n FROM bars GROUP BY code) SELECT code, date, round(close, 6) AS close FROM bars JOIN n USING (code) WHERE n > 100", dates=("date",))
def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.long_series(market.bars(spark, sf_dir), 100).select("code", "date", "close")


@query("instrument_lookup", "SELECT s_suppkey AS code, s_name AS name FROM supplier WHERE s_suppkey::VARCHAR LIKE '1%' OR s_suppkey::VARCHAR LIKE '0005%' OR lower(s_name) LIKE '%1%' OR lower(s_name) LIKE '%0005%' ORDER BY code LIMIT 20")
def instrument_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tables.lookup(market.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")), ("1", "0005"))
    return both.orderBy("code").limit(20)


@query(
    "forward_fill",
    f"""o AS (SELECT code, date, close, volume % 7 = 0 AS gap FROM bars), r AS (SELECT code, date, CASE WHEN gap THEN NULL ELSE lead(close, 5) {_W} / close - 1 END AS d5, lead(close, 5) {_W} / close - 1 AS fresh FROM o), x AS (SELECT max(date) AS newest FROM bars)
SELECT code, date, round(CASE WHEN date >= newest - INTERVAL 280 DAY THEN coalesce(d5, fresh) ELSE d5 END, 6) AS d5 FROM r, x""",
    dates=("date",),
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward returns with gaps, of which those of the last 280 days are filled from the bars."""
    frame = market.bars(spark, sf_dir)
    fresh = frame.select("code", "date", (F.lead("close", 5).over(history()) / F.col("close") - 1).alias("d5"), "volume")
    old = fresh.select("code", "date", F.when(F.col("volume") % 7 != 0, F.col("d5")).alias("d5"))
    newest = frame.agg(F.date_sub(F.max("date"), 280)).first()[0]
    return tables.back_fill(old, fresh.filter(F.col("date") >= newest), ["code", "date"], ["d5"])


@query(
    "signal_updates",
    """s AS (SELECT trade_id, cost AS stop, 'active' AS status FROM trades), u AS (SELECT trade_id, proceeds AS stop, CASE WHEN proceeds > cost THEN 'realized' END AS status FROM trades WHERE trade_id % 3 = 0)
SELECT s.trade_id, round(greatest(s.stop, u.stop), 2) AS stop, coalesce(u.status, s.status) AS status FROM s LEFT JOIN u USING (trade_id)""",
    digits=2,
)
def signal_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops only rise; a status changes where a new one is known."""
    rows = market.trades(spark, sf_dir)
    old = rows.select("trade_id", F.col("cost").alias("stop"), F.lit("active").alias("status"))
    new = rows.filter("trade_id % 3 = 0").select("trade_id", F.col("proceeds").alias("stop"), F.when(F.col("proceeds") > F.col("cost"), "realized").alias("status"))
    return tables.update(old, new, ["trade_id"], {"stop": "greatest(old, new)", "status": "coalesce(new, old)"})


@query("extended_matrix", "SELECT code, date, round(close, 6) AS close FROM bars", dates=("date",))
def extended_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars up to 1998 extended by those from 1997 on: the overlap counts once."""
    frame = market.bars(spark, sf_dir).select("code", "date", "close")
    return tables.extend(frame.filter("date < DATE '1998-01-01'"), frame.filter("date >= DATE '1997-01-01'"), ["code", "date"])


@query(
    "as_of_strict",
    """d AS (SELECT DISTINCT code, date, industry FROM bars JOIN sectors USING (code)), j AS (SELECT d.code, d.date, f.revenue FROM d LEFT JOIN fundamentals f ON f.industry = d.industry AND f.available_date = d.date)
SELECT code, date, round(last_value(revenue IGNORE NULLS) OVER (PARTITION BY code ORDER BY date), 2) AS revenue FROM j""",
    digits=2,
    dates=("date",),
)
def as_of_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that become known on a day without a bar of the code are lost, unlike in point_in_time."""
    rows = market.bars(spark, sf_dir).select("code", "date").join(market.sectors(spark, sf_dir).select("code", "industry"), "code")
    known = market.fundamentals(spark, sf_dir).select("industry", F.col("available_date").alias("date"), "revenue")
    return tables.carried(rows, known, ["industry", "date"], ["revenue"]).select("code", "date", "revenue")

"""The operators over the driver's tables, and SQL that states the same results independently."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import rounded
from quantloom.operators import aggregates, attention, backtest, cases, fundamental, indicators, joins, levels, monitoring, portfolio, relative, risk, screener, signals, similarity
from quantloom.sources import market
from quantloom.streaming import quotes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _plain(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded and dates as text, which compare alike in every engine."""
    return rounded(df, digits).select(*(F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, digits: int = 6, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query; SQL goes on from the model's tables in market.SQL. `dates` are the date columns of its result."""

    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _plain(f(spark, sf_dir), digits)
        if sql is not None:
            whole = f"WITH {market.SQL.strip()}{', ' if sql.lstrip()[:6] != 'SELECT' else ' '}{sql.strip()}"
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({texts}) FROM ({whole})" if dates else whole
        return f

    return register


#: Trailing windows of n rows in SQL; null unless all n have a value.
def _full(expr: str, of: str, n: int) -> str:
    w = f"OVER (PARTITION BY code ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({of}) {w} >= {n} THEN {expr} {w} END"


_W = "OVER (PARTITION BY code ORDER BY date)"
_RET = f"ret AS (SELECT *, close / nullif(lag(close) {_W}, 0) - 1 AS ret FROM bars)"
_MOVING = f"""tr AS (
  SELECT *, greatest(high - low, abs(high - lag(close) {_W}), abs(low - lag(close) {_W})) AS tr FROM bars),
mv0 AS (
  SELECT *, {_full("avg(close)", "close", 5)} AS sma_5, {_full("avg(close)", "close", 20)} AS sma_20, {_full("avg(close)", "close", 60)} AS sma_60,
         {_full("stddev_samp(close)", "close", 20)} AS sd_20, {_full("avg(volume)", "volume", 5)} AS vol_5, {_full("avg(volume)", "volume", 20)} AS vol_20,
         (close / nullif(lag(close, 12) {_W}, 0) - 1) * 100 AS roc_12, {_full("avg(tr)", "tr", 14)} AS atr_14 FROM tr),
mv AS (
  SELECT *, sma_20 + 2 * sd_20 AS bb_upper, sma_20 - 2 * sd_20 AS bb_lower, 4 * sd_20 / nullif(sma_20, 0) AS bb_width,
         (close - sma_20 + 2 * sd_20) / nullif(4 * sd_20, 0) AS bb_pct, atr_14 / nullif(close, 0) AS atr_pct, volume / nullif(vol_5, 0) AS vol_ratio FROM mv0)"""


@query("bars", "SELECT code, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars", dates=("date",))
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.bars(spark, sf_dir)


@query(
    "moving_indicators",
    _MOVING
    + """ SELECT code, date, round(sma_5, 6) AS sma_5, round(sma_20, 6) AS sma_20, round(sma_60, 6) AS sma_60, round(bb_upper, 6) AS bb_upper, round(bb_lower, 6) AS bb_lower,
    round(bb_width, 6) AS bb_width, round(bb_pct, 6) AS bb_pct, round(vol_ratio, 6) AS vol_ratio, round(roc_12, 6) AS roc_12, round(tr, 6) AS tr, round(atr_pct, 6) AS atr_pct FROM mv""",
    dates=("date",),
)
def moving_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.moving(market.bars(spark, sf_dir)).select("code", "date", "sma_5", "sma_20", "sma_60", "bb_upper", "bb_lower", "bb_width", "bb_pct", "vol_ratio", "roc_12", "tr", "atr_pct")


@query(
    "macd",
    """n AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM bars),
m AS (
  SELECT a.code, a.date, a.i, sum(CASE WHEN b.i = 1 THEN pow(11.0 / 13, a.i - b.i) ELSE 2.0 / 13 * pow(11.0 / 13, a.i - b.i) END * b.close)
         - sum(CASE WHEN b.i = 1 THEN pow(25.0 / 27, a.i - b.i) ELSE 2.0 / 27 * pow(25.0 / 27, a.i - b.i) END * b.close) AS macd
  FROM n a JOIN n b ON a.code = b.code AND b.i <= a.i GROUP BY a.code, a.date, a.i),
s AS (
  SELECT a.code, a.date, any_value(a.macd) AS macd, sum(CASE WHEN b.i = 1 THEN pow(0.8, a.i - b.i) ELSE 0.2 * pow(0.8, a.i - b.i) END * b.macd) AS macd_signal
  FROM m a JOIN m b ON a.code = b.code AND b.i <= a.i GROUP BY a.code, a.date)
SELECT code, date, round(macd, 4) AS macd, round(macd_signal, 4) AS macd_signal FROM s""",
    digits=4,
    dates=("date",),
)
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.recursive(market.bars(spark, sf_dir)).select("code", "date", "macd", "macd_signal")


@query(
    "rsi",
    f"""n AS (SELECT code, date, close - lag(close) {_W} AS step, row_number() {_W} AS i FROM bars),
g AS (SELECT code, date, i, coalesce(greatest(step, 0), 0) AS gain, coalesce(greatest(-step, 0), 0) AS loss FROM n),
e AS (
  SELECT a.code, a.date, a.i, sum(pow(13.0 / 14, a.i - b.i) * b.gain) AS gain, sum(pow(13.0 / 14, a.i - b.i) * b.loss) AS loss, sum(pow(13.0 / 14, a.i - b.i)) AS w
  FROM g a JOIN g b ON a.code = b.code AND b.i <= a.i GROUP BY a.code, a.date, a.i)
SELECT code, date, round(CASE WHEN i >= 14 THEN 100 - 100 / (1 + (gain / w) / CASE WHEN loss = 0 THEN 1e-10 ELSE loss / w END) END, 4) AS rsi FROM e""",
    digits=4,
    dates=("date",),
)
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.recursive(market.bars(spark, sf_dir)).select("code", "date", "rsi")


#: Recursions in closed form: each value is a weighted sum of all before it.
_REC = f"""x0 AS (
  SELECT *, row_number() {_W} AS i, close - lag(close) {_W} AS step, high - lag(high) {_W} AS up, lag(low) {_W} - low AS down,
         greatest(high - low, coalesce(abs(high - lag(close) {_W}), 0), coalesce(abs(low - lag(close) {_W}), 0)) AS tr,
         max(high) OVER (PARTITION BY code ORDER BY date ROWS 8 PRECEDING) AS top, min(low) OVER (PARTITION BY code ORDER BY date ROWS 8 PRECEDING) AS bottom FROM bars),
x AS (
  SELECT *, coalesce(greatest(step, 0), 0) AS gain, coalesce(greatest(-step, 0), 0) AS loss, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m,
         CASE WHEN i >= 9 THEN (close - bottom) / CASE WHEN top = bottom THEN 1e-10 ELSE top - bottom END * 100 END AS raw FROM x0),
y0 AS (
  SELECT a.code, a.date, a.i, sum(pow(13.0 / 14, a.i - b.i) * b.gain) / sum(pow(13.0 / 14, a.i - b.i)) AS gain, sum(pow(13.0 / 14, a.i - b.i) * b.loss) / sum(pow(13.0 / 14, a.i - b.i)) AS loss,
         sum(pow(13.0 / 14, a.i - b.i) * b.p) / sum(pow(13.0 / 14, a.i - b.i)) AS p, sum(pow(13.0 / 14, a.i - b.i) * b.m) / sum(pow(13.0 / 14, a.i - b.i)) AS m, sum(pow(13.0 / 14, a.i - b.i) * b.tr) / sum(pow(13.0 / 14, a.i - b.i)) AS tr,
         sum(CASE WHEN b.i = 1 THEN pow(13.0 / 15, a.i - b.i) ELSE 2.0 / 15 * pow(13.0 / 15, a.i - b.i) END * b.tr) AS atr,
         sum(CASE WHEN b.i = 1 THEN pow(11.0 / 13, a.i - b.i) ELSE 2.0 / 13 * pow(11.0 / 13, a.i - b.i) END * b.close)
         - sum(CASE WHEN b.i = 1 THEN pow(25.0 / 27, a.i - b.i) ELSE 2.0 / 27 * pow(25.0 / 27, a.i - b.i) END * b.close) AS macd,
         CASE WHEN a.i >= 9 THEN pow(2.0 / 3, a.i - 8) * 50 + sum(CASE WHEN b.i >= 9 THEN pow(2.0 / 3, a.i - b.i) / 3 * b.raw END) END AS k
  FROM x a JOIN x b ON a.code = b.code AND b.i <= a.i GROUP BY a.code, a.date, a.i),
y1 AS (
  SELECT *, CASE WHEN i >= 14 THEN 100 - 100 / (1 + gain / CASE WHEN loss = 0 THEN 1e-10 ELSE loss END) END AS rsi, CASE WHEN i >= 14 THEN 100 * p / CASE WHEN tr = 0 THEN 1e-10 ELSE tr END END AS plus_di,
         CASE WHEN i >= 14 THEN 100 * m / CASE WHEN tr = 0 THEN 1e-10 ELSE tr END END AS minus_di FROM y0),
y2 AS (SELECT *, 100 * abs(plus_di - minus_di) / CASE WHEN plus_di + minus_di = 0 THEN 1e-10 ELSE plus_di + minus_di END AS dx FROM y1),
rec AS (
  SELECT a.code, a.date, any_value(a.rsi) AS rsi, any_value(a.macd) AS macd, sum(CASE WHEN b.i = 1 THEN pow(0.8, a.i - b.i) ELSE 0.2 * pow(0.8, a.i - b.i) END * b.macd) AS macd_signal, any_value(a.k) AS k,
         CASE WHEN a.i >= 9 THEN pow(2.0 / 3, a.i - 8) * 50 + sum(CASE WHEN b.i >= 9 THEN pow(2.0 / 3, a.i - b.i) / 3 * b.k END) END AS d, any_value(a.plus_di) AS plus_di, any_value(a.minus_di) AS minus_di,
         CASE WHEN a.i >= 27 THEN sum(CASE WHEN b.i >= 14 THEN pow(13.0 / 14, a.i - b.i) * b.dx END) / sum(CASE WHEN b.i >= 14 THEN pow(13.0 / 14, a.i - b.i) END) END AS adx, any_value(a.atr) AS atr
  FROM y2 a JOIN y2 b ON a.code = b.code AND b.i <= a.i GROUP BY a.code, a.date, a.i)"""


@query(
    "recursive_indicators",
    _REC
    + """ SELECT code, date, round(rsi, 4) AS rsi, round(macd, 4) AS macd, round(macd_signal, 4) AS macd_signal, round(macd - macd_signal, 4) AS macd_hist, round(k, 4) AS k, round(d, 4) AS d, round(plus_di, 4) AS plus_di,
    round(minus_di, 4) AS minus_di, round(adx, 4) AS adx, round(atr, 4) AS atr FROM rec""",
    digits=4,
    dates=("date",),
)
def recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.recursive(market.bars(spark, sf_dir)).select("code", "date", "rsi", "macd", "macd_signal", "macd_hist", "k", "d", "plus_di", "minus_di", "adx", "atr")


@query(
    "squeeze",
    _MOVING
    + f""", k AS (
  SELECT *, {_full("avg(tr)", "tr", 20)} AS atr_20,
         CASE WHEN count(bb_width) OVER (PARTITION BY code ORDER BY date ROWS 119 PRECEDING) >= 30 THEN quantile_cont(bb_width, 0.1) OVER (PARTITION BY code ORDER BY date ROWS 119 PRECEDING) END AS low_width FROM mv),
q AS (SELECT code, date, coalesce(bb_width <= low_width AND bb_upper < sma_20 + 1.5 * atr_20 AND bb_lower > sma_20 - 1.5 * atr_20, false) AS squeeze FROM k)
SELECT code, date, squeeze, coalesce(lag(squeeze) {_W}, false) AND NOT squeeze AS release FROM q""",
    dates=("date",),
)
def squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.squeeze(market.bars(spark, sf_dir)).select("code", "date", "squeeze", "release")


@query(
    "volume_patterns",
    _RET
    + f""", v AS (
  SELECT *, CASE WHEN count(volume) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING) >= 3 THEN avg(volume) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING) END AS vol_5,
         max(high) OVER (PARTITION BY code ORDER BY date ROWS 9 PRECEDING) AS high_10 FROM ret),
b AS (
  SELECT *, coalesce(volume >= 2 * vol_5 AND ret >= 0.015 AND coalesce(abs(close - open) / nullif(high - low, 0), 0) >= 0.5, false) AS breakout,
         coalesce(volume <= 0.6 * vol_5 AND close / nullif(high_10, 0) - 1 >= -0.03 AND close / nullif(high_10, 0) - 1 < 0, false) AS pullback FROM v)
SELECT code, date, breakout, pullback, pullback AND coalesce(bool_or(breakout) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), false) AS sequence FROM b""",
    dates=("date",),
)
def volume_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.volume_patterns(market.bars(spark, sf_dir)).select("code", "date", "breakout", "pullback", "sequence")


@query(
    "normalised_features",
    """z AS (
  SELECT code, date, volume, count(volume) OVER w AS n, avg(volume) OVER w AS m, stddev_samp(volume) OVER w AS s FROM bars
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS 251 PRECEDING))
SELECT code, date, round(coalesce(CASE WHEN n >= 60 THEN greatest(least((volume - m) / nullif(s, 0), 5), -5) END, 0), 6) AS z_volume FROM z""",
    dates=("date",),
)
def normalised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.normalised(market.bars(spark, sf_dir), ["volume"]).select("code", "date", "z_volume")


_RS = f"""rs0 AS (
  SELECT code, date, lag(close, 125) {_W} AS t0, lag(close, 25) {_W} AS t1, lag(close, 5) {_W} AS t2 FROM bars),
rs AS (SELECT code, date, pow(t1 / t0, 0.6) * pow(t2 / t1, 0.4) AS rs FROM rs0),
rk AS (
  SELECT *, CASE WHEN rs IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY rs NULLS LAST) + (count(rs) OVER (PARTITION BY date, rs) - 1) / 2.0) / count(rs) OVER (PARTITION BY date) * 100 END AS rs_pct,
         rs / nullif(lag(rs, 20) {_W}, 0) - 1 AS rs_roc FROM rs)"""


@query("relative_strength", _RS + " SELECT code, date, round(rs, 6) AS rs, round(rs_pct, 6) AS rs_pct, round(rs_roc, 6) AS rs_roc FROM rk", dates=("date",))
def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.strength(market.bars(spark, sf_dir)).select("code", "date", "rs", "rs_pct", "rs_roc")


_SCAN = """sc0 AS (
  SELECT code, date, row_number() OVER w AS n, lead(close, 4) OVER w AS p4, lead(close, 24) OVER w AS p24, lead(close, 124) OVER w AS p124 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date DESC)),
sc1 AS (SELECT code, date, pow(p24 / p124, 0.6) * pow(p4 / p24, 0.4) AS rs_ratio FROM sc0 WHERE n = 1 AND p4 > 0 AND p24 > 0 AND p124 > 0),
scan AS (SELECT *, round((rank() OVER (ORDER BY rs_ratio) + (count(*) OVER (PARTITION BY rs_ratio) - 1) / 2.0) / count(*) OVER () * 100, 1) AS rating FROM sc1)"""


@query("strength_scan", _SCAN + " SELECT code, date, round(rs_ratio, 6) AS rs_ratio, rating FROM scan", dates=("date",))
def strength_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.strength_scan(market.bars(spark, sf_dir)).select("code", "date", "rs_ratio", "rating")


@query(
    "sector_strength",
    _SCAN
    + """ SELECT sector, round(quantile_cont(rs_ratio, 0.5), 6) AS median_rs, count(*) AS codes, sum(CASE WHEN rating >= 90 THEN 1 ELSE 0 END)::BIGINT AS diamonds,
    round(sum(CASE WHEN rating >= 90 THEN 1 ELSE 0 END) / count(*), 6) AS diamond_share FROM scan JOIN sectors USING (code) GROUP BY sector""",
)
def sector_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.sector_strength(relative.strength_scan(market.bars(spark, sf_dir)), market.sectors(spark, sf_dir))


@query("peer_alpha", _SCAN + " SELECT code, sector, round(rs_ratio, 6) AS rs_ratio, round(rs_ratio / quantile_cont(rs_ratio, 0.5) OVER (PARTITION BY sector), 6) AS peer_alpha FROM scan JOIN sectors USING (code)")
def peer_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.peer_alpha(relative.strength_scan(market.bars(spark, sf_dir)), market.sectors(spark, sf_dir))


@query(
    "market_breadth",
    _RET
    + f""", m AS (SELECT *, {_full("avg(close)", "close", 20)} AS sma FROM ret),
d AS (
  SELECT date, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS advances, sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) AS declines,
         avg(CASE WHEN sma IS NOT NULL THEN CASE WHEN close > sma THEN 1.0 ELSE 0.0 END END) AS above_sma FROM m GROUP BY date),
r AS (SELECT *, sum(advances - declines) OVER (ORDER BY date) AS ad_line, row_number() OVER (ORDER BY date) AS i FROM d)
SELECT date, advances::BIGINT AS advances, declines::BIGINT AS declines, round(above_sma, 6) AS above_sma, ad_line::BIGINT AS ad_line,
       (i - coalesce(max(CASE WHEN advances >= declines THEN i END) OVER (ORDER BY date), 0))::BIGINT AS falling_days FROM r""",
    dates=("date",),
)
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relative.breadth(market.bars(spark, sf_dir))
    return out.withColumn("falling_days", F.col("falling_days").cast("long"))


@query(
    "industry_features",
    f"""r AS (SELECT code, date, close / nullif(lag(close, 20) {_W}, 0) - 1 AS ret_20 FROM bars),
s AS (SELECT r.*, sector, quantile_cont(ret_20, 0.5) OVER (PARTITION BY date, sector) AS sector_momentum FROM r JOIN sectors USING (code)),
f AS (
SELECT code, date, sector, round(ret_20, 6) AS ret_20, round(sector_momentum, 6) AS sector_momentum,
       round(CASE WHEN sector_momentum IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY sector_momentum NULLS LAST) + (count(sector_momentum) OVER (PARTITION BY date, sector_momentum) - 1) / 2.0)
             / count(sector_momentum) OVER (PARTITION BY date) END, 6) AS sector_rs,
       round(greatest(least(CASE WHEN ret_20 IS NULL THEN NULL ELSE ret_20 - sector_momentum END, 5), -5), 6) AS peer_alpha FROM s)
SELECT * FROM f WHERE ret_20 IS NOT NULL""",
    dates=("date",),
)
def industry_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.industry_features(market.bars(spark, sf_dir), market.sectors(spark, sf_dir)).filter("ret_20 is not null")


@query(
    "forward_returns",
    """ SELECT code, date, round(lead(close, 3) OVER w / close - 1, 6) AS d3, round(lead(close, 21) OVER w / close - 1, 6) AS d21, round(lead(close, 90) OVER w / close - 1, 6) AS d90,
       round(max(high) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / close - 1, 6) AS gain_5,
       round(min(low) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / close - 1, 6) AS loss_20
FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)""",
    dates=("date",),
)
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.forward_returns(market.bars(spark, sf_dir)).select("code", "date", "d3", "d21", "d90", "gain_5", "loss_20")


@query(
    "market_regime",
    """r AS (
  SELECT date, close, CASE WHEN count(*) OVER f >= 20 THEN avg(close) OVER f END AS fast, CASE WHEN count(*) OVER s >= 60 THEN avg(close) OVER s END AS slow FROM idx
  WINDOW f AS (ORDER BY date ROWS 19 PRECEDING), s AS (ORDER BY date ROWS 59 PRECEDING))
SELECT date, round(close, 6) AS close, round(fast, 6) AS fast, round(slow, 6) AS slow,
       CASE WHEN close > fast AND fast > slow THEN 'bull' WHEN close < fast AND fast < slow THEN 'bear' ELSE 'sideways' END AS regime,
       CASE WHEN close > fast AND fast > slow THEN 1.0 WHEN close < fast AND fast < slow THEN 0.3 ELSE 0.6 END::DOUBLE AS multiplier FROM r""",
    dates=("date",),
)
def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.regime(market.index_bars(market.bars(spark, sf_dir)))


@query(
    "correlations",
    _RET
    + """ SELECT a.code AS code_a, b.code AS code_b, round(corr(a.ret, b.ret), 6) AS corr, count(*) AS days FROM ret a JOIN ret b ON a.date = b.date AND a.code < b.code
WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND a.code <= 20 AND b.code <= 20 GROUP BY ALL HAVING count(*) >= 60""",
)
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio of twenty codes: the feature is the matrix of a portfolio."""
    frame = market.bars(spark, sf_dir)
    return relative.correlations(frame, frame.select("code").distinct().filter("code <= 20"))


@query(
    "point_in_time",
    """b AS (SELECT code, date, industry FROM bars JOIN sectors USING (code)),
f AS (SELECT industry, available_date, quarter_end, revenue FROM fundamentals)
SELECT b.code, b.date, b.industry, f.quarter_end, f.available_date, round(f.revenue, 2) AS revenue FROM b ASOF LEFT JOIN f ON b.industry = f.industry AND b.date >= f.available_date""",
    digits=2,
    dates=("date", "quarter_end", "available_date"),
)
def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An industry's statements are dealt to its codes first, so that no industry's whole list of bars is one sorted task."""
    named = market.sectors(spark, sf_dir).select("code", "industry")
    known = market.fundamentals(spark, sf_dir).join(named, "industry").select("code", "quarter_end", "available_date", "revenue")
    rows = market.bars(spark, sf_dir).select("code", "date").join(named, "code")
    return joins.as_of(rows, known, "code", "date", "available_date").select("code", "date", "industry", "quarter_end", "available_date", "revenue")


@query(
    "next_bar",
    """ SELECT t.trade_id, t.code, t.open_date, CASE WHEN date_diff('day', t.open_date, b.date) <= 5 THEN b.date END AS date, round(CASE WHEN date_diff('day', t.open_date, b.date) <= 5 THEN b.close END, 6) AS close
FROM trades t ASOF LEFT JOIN bars b ON t.code = b.code AND t.open_date <= b.date""",
    dates=("date", "open_date"),
)
def next_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = market.trades(spark, sf_dir).select("trade_id", "code", "open_date")
    return joins.as_of(positions, market.bars(spark, sf_dir).select("code", "date", "close"), "code", "open_date", "date", forward=True, within=5)


@query(
    "nearest_bar",
    """c AS (
  SELECT t.trade_id, t.code, t.open_date, b.date, b.close, row_number() OVER (PARTITION BY t.trade_id ORDER BY abs(date_diff('day', t.open_date, b.date)), b.date) AS n
  FROM trades t JOIN bars b ON t.code = b.code AND b.date BETWEEN t.open_date - INTERVAL 10 DAY AND t.open_date + INTERVAL 10 DAY)
SELECT t.trade_id, t.code, t.open_date, c.date, round(c.close, 6) AS close FROM trades t LEFT JOIN c ON t.trade_id = c.trade_id AND c.n = 1""",
    dates=("date", "open_date"),
)
def nearest_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = market.trades(spark, sf_dir).select("trade_id", "code", "open_date")
    return joins.nearest(positions, market.bars(spark, sf_dir).select("code", "date", "close"), "code", "open_date", "date", 10)


@query(
    "events_within_trades",
    """m AS (SELECT code, date, volume FROM bars WHERE volume >= 60)
SELECT t.trade_id, t.code, m.date, round(m.volume, 6) AS volume FROM trades t JOIN m ON t.code = m.code AND m.date BETWEEN t.open_date AND t.close_date""",
    dates=("date",),
)
def events_within_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = market.bars(spark, sf_dir).filter("volume >= 60").select("code", "date", "volume")
    return joins.within(market.trades(spark, sf_dir), events, "code", "open_date", "close_date", "date").select("trade_id", "code", "date", "volume")


@query(
    "control_group",
    """m AS (SELECT code, date FROM bars WHERE volume >= 90)
SELECT code, date FROM bars b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.code = b.code AND abs(date_diff('day', m.date, b.date)) <= 30)""",
    dates=("date",),
)
def control_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    return joins.beyond(frame.select("code", "date"), frame.filter("volume >= 90").select("code", F.col("date").alias("at")), "code", "date", "at", 30)


_STATS = """count(*) AS trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(CASE WHEN pnl > 0 THEN pnl END), 2) AS avg_win, round(avg(CASE WHEN pnl <= 0 THEN pnl END), 2) AS avg_loss,
  round(coalesce(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END), 0), 999), 6) AS profit_factor, round(avg(pnl), 2) AS expectancy"""
_PNL = "p AS (SELECT *, proceeds - cost AS pnl, (proceeds - cost) / nullif(cost, 0) AS ret FROM trades)"


@query(
    "trade_stats",
    _PNL
    + f""" SELECT code, {_STATS}, first(trade_id ORDER BY pnl DESC, trade_id) AS best_trade, first(trade_id ORDER BY pnl, trade_id) AS worst_trade FROM p GROUP BY code""",
)
def trade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.trade_stats(market.trades(spark, sf_dir), "code")
    return out.withColumns({c: F.round(c, 2) for c in ("avg_win", "avg_loss", "expectancy")})


@query("tag_performance", _PNL + " SELECT tag, count(*) AS trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(pnl), 2) AS expectancy FROM p GROUP BY tag")
def tag_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.tag_performance(market.trades(spark, sf_dir)).withColumn("expectancy", F.round("expectancy", 2))


@query(
    "holding_brackets",
    _PNL
    + """, h AS (SELECT *, date_diff('day', open_date, close_date) AS days FROM p)
SELECT CASE WHEN days >= 90 THEN 90 WHEN days >= 60 THEN 60 WHEN days >= 30 THEN 30 ELSE 0 END::INTEGER AS bracket, count(*) AS trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate
FROM h WHERE days >= 0 GROUP BY ALL""",
)
def holding_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.holding_brackets(market.trades(spark, sf_dir))


@query("exit_barometer", _PNL + " SELECT sector, tag, count(*) AS trades, round(avg(ret), 6) AS mean_ret FROM p JOIN sectors USING (code) GROUP BY ROLLUP (sector, tag)")
def exit_barometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.exit_barometer(market.trades(spark, sf_dir), market.sectors(spark, sf_dir))


_FORWARD = """fw AS (SELECT code, date, lead(close, 3) OVER w / close - 1 AS d3, lead(close, 21) OVER w / close - 1 AS d21 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))"""


@query(
    "horizon_stats",
    _FORWARD
    + """, l AS (SELECT 'd3' AS horizon, d3 - 0.004 AS ret FROM fw WHERE d3 IS NOT NULL UNION ALL SELECT 'd21', d21 - 0.004 FROM fw WHERE d21 IS NOT NULL)
SELECT horizon, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_pop(ret), 6) AS sd, round(min(ret), 6) AS min, round(max(ret), 6) AS max, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
       round(avg(CASE WHEN ret > 0.02 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(quantile_cont(ret, 0.05), 6) AS p5, round(quantile_cont(ret, 0.5), 6) AS p50, round(quantile_cont(ret, 0.95), 6) AS p95 FROM l GROUP BY horizon""",
)
def horizon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.horizon_stats(relative.forward_returns(market.bars(spark, sf_dir)), ["d3", "d21"])
    return out.select("horizon", "n", "mean", "sd", "min", "max", "win_rate", "hit_rate", "p5", "p50", "p95")


@query(
    "longest_runs",
    _RET
    + f""", m AS (SELECT *, coalesce(ret < -0.05, false) AS hit FROM ret), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) {_W} AS island FROM m),
r AS (SELECT code, island, count(*) AS length, min(date) AS start FROM i WHERE hit GROUP BY ALL)
SELECT code, max(length) AS longest, count(*) AS runs, first(start ORDER BY length DESC, start) AS longest_start FROM r GROUP BY code""",
    dates=("longest_start",),
)
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.longest_runs(market.bars(spark, sf_dir))


@query(
    "return_distribution",
    _RET
    + """, b AS (SELECT CASE WHEN ret < -1 THEN 0 WHEN ret >= 1 THEN 21 ELSE floor((ret + 1) / 0.1) + 1 END::INTEGER AS bucket FROM ret WHERE ret IS NOT NULL)
SELECT bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY bucket""",
)
def return_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distribution(relative.forward_returns(market.bars(spark, sf_dir), (1,)), "d1", -1.0, 1.0)


@query(
    "recency_weighted",
    _FORWARD + " SELECT code, round(sum(pow(2.0, -date_diff('day', date, DATE '2000-01-01') / 730.0) * d21) / sum(pow(2.0, -date_diff('day', date, DATE '2000-01-01') / 730.0)), 6) AS weighted_mean, count(d21) AS n FROM fw GROUP BY code",
)
def recency_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.recency_weighted(relative.forward_returns(market.bars(spark, sf_dir)), "d21", dt.date(2000, 1, 1))


@query(
    "broker_scores",
    _FORWARD
    + """, b AS (SELECT broker, sector, d21 AS ret FROM flows JOIN fw USING (code, date) JOIN sectors USING (code) WHERE buy > sell AND d21 IS NOT NULL),
p AS (SELECT broker, sector, count(*) AS n, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) AS gain, sum(CASE WHEN ret <= 0 THEN ret ELSE 0 END) AS loss FROM b GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY broker) AS share FROM p)
SELECT broker, sum(n)::BIGINT AS n, round(sum(wins) / sum(n), 6) AS win_rate, round(sum(wins) / sum(n) * (sum(gain) / nullif(sum(wins), 0)) / abs(sum(loss) / nullif(sum(n) - sum(wins), 0)), 6) AS score,
       round(sum(share * share), 6) AS hhi, max(share) > 0.5 AS one_sector FROM s GROUP BY broker HAVING sum(n) >= 15""",
)
def broker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    return aggregates.broker_scores(market.broker_flows(spark, sf_dir), relative.forward_returns(frame), market.sectors(spark, sf_dir))


@query(
    "broker_features",
    """r AS (
  SELECT *, buy / nullif(sum(buy) OVER (PARTITION BY code, date), 0) AS share, (buy - sell) / nullif(sum(buy + sell) OVER (PARTITION BY code, date), 0) AS net,
         row_number() OVER (PARTITION BY code, date ORDER BY buy DESC, broker) AS place FROM flows)
SELECT code, date, round(sum(share * share), 6) AS hhi, round(sum(CASE WHEN place <= 3 THEN share END), 6) AS top3_share, round(sum(CASE WHEN place <= 5 THEN net END), 6) AS net_buy_5,
       sum(sign(buy - sell))::BIGINT AS buyer_spread FROM r GROUP BY code, date""",
    dates=("date",),
)
def broker_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.broker_features(market.broker_flows(spark, sf_dir))


@query(
    "value_at_risk",
    _RET
    + """, c AS (SELECT code, ret, quantile_cont(ret, 0.05) OVER (PARTITION BY code) AS cut FROM ret WHERE ret IS NOT NULL)
SELECT code, count(ret) AS days, round(max(cut), 6) AS var_hist, round(avg(ret) - 1.6448536269514722 * stddev_samp(ret), 6) AS var_param, round(avg(CASE WHEN ret <= cut THEN ret END), 6) AS cvar FROM c GROUP BY code HAVING count(ret) >= 20""",
)
def value_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.value_at_risk(market.bars(spark, sf_dir))


@query(
    "var_breaches",
    _RET
    + """, r AS (SELECT * FROM ret WHERE ret IS NOT NULL),
v AS (SELECT code, ret, count(*) OVER w AS n, quantile_cont(ret, 0.05) OVER w AS var FROM r WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))
SELECT code, count(*) AS days, sum(CASE WHEN ret < var THEN 1 ELSE 0 END)::BIGINT AS breaches, round(sum(CASE WHEN ret < var THEN 1 ELSE 0 END) / count(*), 6) AS breach_rate FROM v WHERE n >= 250 GROUP BY code""",
)
def var_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.var_breaches(market.bars(spark, sf_dir))


@query(
    "drawdown",
    """p AS (SELECT code, date, close, max(close) OVER w AS peak, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, round(min(close / peak - 1), 6) AS max_drawdown, round(sqrt(avg(pow((close / peak - 1) * 100, 2))), 6) AS ulcer, (max(i) - max(CASE WHEN close = peak THEN i END))::BIGINT AS bars_since_peak FROM p GROUP BY code""",
)
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.drawdown(market.bars(spark, sf_dir)).withColumn("bars_since_peak", F.col("bars_since_peak").cast("long"))


@query(
    "alpha_beta",
    _RET
    + """, m AS (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS mkt FROM idx),
b AS (SELECT code, ret, mkt FROM ret JOIN m USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL)
SELECT code, round(regr_slope(ret, mkt), 6) AS beta, round(regr_intercept(ret, mkt), 6) AS alpha, round(regr_r2(ret, mkt), 6) AS r2,
       round(regr_slope(CASE WHEN mkt > 0 THEN ret END, CASE WHEN mkt > 0 THEN mkt END), 6) AS up_beta, round(regr_slope(CASE WHEN mkt < 0 THEN ret END, CASE WHEN mkt < 0 THEN mkt END), 6) AS down_beta,
       round(avg(CASE WHEN mkt > 0 THEN ret END) / avg(CASE WHEN mkt > 0 THEN mkt END), 6) AS up_capture, round(avg(CASE WHEN mkt < 0 THEN ret END) / avg(CASE WHEN mkt < 0 THEN mkt END), 6) AS down_capture FROM b GROUP BY code""",
)
def alpha_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    return risk.alpha_beta(frame, market.index_bars(frame))


@query(
    "liquidity",
    f"""l AS (SELECT *, ln(close / lag(close) {_W}) AS lr FROM bars),
a AS (
  SELECT code, date, avg(volume) OVER w AS adv, stddev_pop(lr) OVER w AS sigma, avg((high - low) / nullif(close, 0)) OVER w AS spread, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM l
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)),
x AS (SELECT code, date, adv, 1000 / nullif(adv * 0.1, 0) AS days_to_sell, sigma * sqrt(1000 / nullif(adv, 0)) AS impact, spread FROM a WHERE n = 1)
SELECT code, date, round(adv, 6) AS adv, round(days_to_sell, 6) AS days_to_sell, round(impact, 6) AS impact, round(spread, 6) AS spread,
       round(40 * greatest(0, 1 - days_to_sell / 10) + 40 * greatest(0, 1 - impact / 0.5) + 20 * greatest(0, 1 - spread), 6) AS score FROM x""",
    dates=("date",),
)
def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.liquidity(market.bars(spark, sf_dir))


_BRINSON = """w AS (SELECT sector, sum(cost) AS v, sum(proceeds) / sum(cost) - 1 AS r, sum(CASE WHEN tag = '1-URGENT' THEN cost ELSE 0 END) AS pv, sum(CASE WHEN tag = '1-URGENT' THEN proceeds ELSE 0 END) / nullif(sum(CASE WHEN tag = '1-URGENT' THEN cost ELSE 0 END), 0) - 1 AS pr
  FROM trades JOIN sectors USING (code) GROUP BY sector),
s AS (SELECT sector, pv / sum(pv) OVER () AS wp, pr AS rp, v / sum(v) OVER () AS wb, r AS rb FROM w), b AS (SELECT *, sum(wb * rb) OVER () AS bench FROM s)
SELECT sector, round((wp - wb) * (rb - bench), 6) AS allocation, round(wb * (rp - rb), 6) AS selection, round((wp - wb) * (rp - rb), 6) AS interaction FROM b"""


@query("brinson_attribution", _BRINSON)
def brinson_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    all_ = Window.partitionBy(F.lit(1))
    urgent = lambda c: F.sum(F.when(F.col("tag") == "1-URGENT", F.col(c)).otherwise(0.0))
    per = market.trades(spark, sf_dir).join(market.sectors(spark, sf_dir), "code").groupBy("sector").agg(
        F.sum("cost").alias("v"), (F.sum("proceeds") / F.sum("cost") - 1).alias("rb"), urgent("cost").alias("pv"), (F.try_divide(urgent("proceeds"), urgent("cost")) - 1).alias("rp")
    )
    return risk.brinson(per.select("sector", (F.col("pv") / F.sum("pv").over(all_)).alias("wp"), "rp", (F.col("v") / F.sum("v").over(all_)).alias("wb"), "rb"))


@query("concentration", "v AS (SELECT code, sector, sum(cost) AS value FROM trades JOIN sectors USING (code) GROUP BY ALL) SELECT code, sector, round(value / sum(value) OVER (), 6) AS share, round(sum(value) OVER (PARTITION BY sector) / sum(value) OVER (), 6) AS sector_share, value / sum(value) OVER () > 0.02 AS issue_breach, sum(value) OVER (PARTITION BY sector) / sum(value) OVER () > 0.25 AS sector_breach FROM v")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = market.trades(spark, sf_dir).join(market.sectors(spark, sf_dir), "code").groupBy("code", "sector").agg(F.sum("cost").alias("value"))
    return risk.concentration(held, 0.02, 0.25).select("code", "sector", "share", "sector_share", "issue_breach", "sector_breach")


@query(
    "equity_metrics",
    """e AS (SELECT code, date, close AS equity, close / nullif(lag(close) OVER w, 0) - 1 AS ret, max(close) OVER w AS peak FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
m AS (
  SELECT code, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, count(ret) AS days, stddev_samp(ret) AS sd, avg(ret - 0.015 / 252) AS mx, stddev_samp(CASE WHEN ret < 0.015 / 252 THEN ret - 0.015 / 252 END) AS dsd,
         min(equity / peak - 1) AS max_drawdown FROM e GROUP BY code)
SELECT code, round(total_return, 6) AS total_return, days, round(sd, 6) AS sd, round(max_drawdown, 6) AS max_drawdown, round(pow(1 + total_return, 252.0 / days) - 1, 6) AS annual_return, round(mx / sd * sqrt(252), 6) AS sharpe,
       round(mx / dsd * sqrt(252), 6) AS sortino, round((pow(1 + total_return, 252.0 / days) - 1) / abs(max_drawdown), 6) AS calmar FROM m""",
)
def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.equity_metrics(market.bars(spark, sf_dir).select("code", "date", F.col("close").alias("equity")))


@query(
    "quality_report",
    _RET
    + """, n AS (SELECT max(date) AS newest FROM bars),
p AS (
  SELECT code, count(*) AS rows, count(CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 1 END) AS nulls, count(CASE WHEN least(open, high, low, close) <= 0 THEN 1 END) AS zero_price, count(CASE WHEN volume = 0 THEN 1 END) AS zero_volume,
         count(CASE WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 1 END) AS inconsistent, count(CASE WHEN abs(ret) > 0.2 THEN 1 END) AS jumps, min(date) AS first, max(date) AS last FROM ret GROUP BY code),
c AS (SELECT *, rows / ((date_diff('day', first, last) + 1) * 5 / 7) AS coverage FROM p, n),
e AS (SELECT *, ((nulls > 0.1 * rows)::INTEGER + (zero_price > 0)::INTEGER + (inconsistent > 0)::INTEGER) AS errors, ((zero_volume > 0.1 * rows)::INTEGER + (jumps > 0)::INTEGER + (coverage < 0.8)::INTEGER + (date_diff('day', last, newest) > 5)::INTEGER) AS warnings FROM c)
SELECT code, rows, nulls, zero_price, zero_volume, inconsistent, jumps, first, last, round(coverage, 6) AS coverage, errors::INTEGER AS errors, warnings::INTEGER AS warnings, round(greatest(0, 1 - 0.3::DOUBLE * errors - 0.1::DOUBLE * warnings), 6) AS score FROM e""",
    dates=("first", "last"),
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = "code rows nulls zero_price zero_volume inconsistent jumps first last coverage errors warnings".split()
    return screener.quality_report(market.bars(spark, sf_dir)).select(*shown, F.col("score").cast("double").alias("score"))


_SNAPSHOT = _MOVING + ", snap AS (SELECT mv.*, sector FROM mv JOIN sectors USING (code) QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)"


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest bar of each code with its indicators and sector."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    return indicators.moving(market.bars(spark, sf_dir)).withColumn("_n", newest).filter("_n = 1").drop("_n").join(market.sectors(spark, sf_dir), "code")


@query(
    "screener",
    _SNAPSHOT + " SELECT code, date, sector, round(close, 6) AS close, round(vol_ratio, 6) AS vol_ratio, round(bb_pct, 6) AS bb_pct FROM snap WHERE close >= 1000 AND close <= 90000 AND vol_ratio > 0.2 AND sector <> 'ASIA' ORDER BY vol_ratio DESC, code LIMIT 30",
    dates=("date",),
)
def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {"close": {"min": 1000, "max": 90000}, "vol_ratio": [{"op": ">", "value": 0.2}], "sector": {"op": "!=", "value": "ASIA"}, "unknown": 1}
    return screener.screen(snapshot(spark, sf_dir), conditions, "vol_ratio", True, 30).select("code", "date", "sector", "close", "vol_ratio", "bb_pct")


@query(
    "compound_alerts",
    _MOVING
    + f""", l AS (SELECT *, lag(close) {_W} AS close_before, lag(sma_20) {_W} AS sma_before, lag(bb_lower) {_W} AS low_before FROM mv)
SELECT code, date, 'cross_up' AS rule FROM l WHERE close_before <= sma_before AND close > sma_20 UNION ALL SELECT code, date, 'below_band' FROM l WHERE close < bb_lower AND close_before >= low_before
UNION ALL SELECT code, date, 'busy' FROM l WHERE vol_ratio > 2 AND roc_12 > 50""",
    dates=("date",),
)
def compound_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"cross_up": "close_before <= sma_20_before AND close > sma_20", "below_band": "close < bb_lower AND close_before >= bb_lower_before", "busy": "vol_ratio > 2 AND roc_12 > 50"}
    return screener.compound_alerts(market.bars(spark, sf_dir), rules)


@query("active_universe", "c AS (SELECT max(date) AS newest, count(DISTINCT date) AS n FROM bars), p AS (SELECT code, max(date) AS last, count(*) AS days FROM bars GROUP BY code) SELECT code, last, days, round(days / n, 6) AS share FROM p, c WHERE date_diff('day', last, newest) <= 30 AND days / n >= 0.2", dates=("last",))
def active_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screener.active(market.bars(spark, sf_dir), 30, 0.2)


@query(
    "limit_moves",
    f"""r AS (SELECT *, lag(close) {_W} AS before FROM bars),
x AS (SELECT *, close / before - 1 AS ret, open / before - 1 AS gap, greatest(close, before) / least(close, before) AS ratio FROM r WHERE before IS NOT NULL),
k AS (SELECT *, CASE WHEN volume = 0 THEN 'no_volume' WHEN abs(ret) >= 0.35 AND abs(ratio - round(ratio)) < 0.05 AND round(ratio) >= 2 THEN 'split' WHEN abs(abs(ret) - 0.1) <= 0.005 THEN 'limit' WHEN abs(gap) > 0.1 THEN 'gap' END AS kind FROM x)
SELECT code, date, round(ret, 6) AS ret, round(gap, 6) AS gap, kind FROM k WHERE kind IS NOT NULL""",
    dates=("date",),
)
def limit_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.limit_moves(market.bars(spark, sf_dir))


_UPTREND = f"""ut0 AS (SELECT mv.*, row_number() {_W} AS i, coalesce(sma_20 > sma_60, false) AS up FROM mv),
ut AS (SELECT *, i - coalesce(max(CASE WHEN NOT up THEN i END) {_W}, 0) AS uptrend_days, lag(close) {_W} AS before FROM ut0)"""
_SIGNALS = """ts AS (
  SELECT *, CASE WHEN coalesce(sma_20 < sma_60 AND minus_di > plus_di, false) THEN 'exit'
    WHEN NOT coalesce(uptrend_days >= 2 AND adx >= 5 AND plus_di > minus_di AND rsi BETWEEN 30 AND 80 AND volume >= 0.7 * vol_5 AND volume >= 10, false) THEN NULL
    WHEN close / nullif(sma_20, 0) - 1 BETWEEN -0.02 AND 0.05 AND close > before THEN 'support' WHEN close > sma_20 AND sma_5 > sma_20 AND sma_20 > sma_60 AND roc_12 > 2 THEN 'momentum' END AS kind FROM ut JOIN rec USING (code, date))"""
_TREND = f"{_UPTREND}, {_REC}, {_SIGNALS}"


@query("trend_signals", _MOVING + ", " + _TREND + " SELECT code, date, kind, CASE WHEN kind = 'exit' THEN 'SELL' WHEN kind IS NOT NULL THEN 'BUY' ELSE 'HOLD' END AS signal FROM ts", dates=("date",))
def trend_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.trend_signals(market.bars(spark, sf_dir), min_days=2, min_adx=5.0, min_volume=10.0).select("code", "date", "kind", "signal")


#: Reversion signals as reverted; goes on from _MOVING and _REC.
_REVERSION = """rv AS (
  SELECT *, CASE WHEN count(rsi) OVER w >= 60 THEN quantile_cont(rsi, 0.15) OVER w END AS rsi_low, (close - sma_20) / nullif((bb_upper - sma_20) / 2, 0) AS z FROM mv JOIN rec USING (code, date)
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS 59 PRECEDING)),
reverted AS (SELECT code, date, close, CASE WHEN close >= sma_20 OR rsi >= 70 THEN 'SELL'
    WHEN (adx < 25 AND close <= bb_lower * 1.005 AND rsi <= least(30, coalesce(rsi_low, 30)) AND volume < 0.7 * vol_5) OR (z < -1.5 AND adx < 35 AND rsi < 45) THEN 'BUY' ELSE 'HOLD' END AS signal,
  close / nullif(sma_20, 0) - 1 < -0.05 AS bias FROM rv)"""


@query("reversion_signals", f"{_MOVING}, {_REC}, {_REVERSION} SELECT code, date, round(close, 6) AS close, signal, bias FROM reverted", dates=("date",))
def reversion_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.reversion_signals(market.bars(spark, sf_dir))


@query("backtest_trades")
def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.results(backtest.run(signals.trend_signals(market.bars(spark, sf_dir), min_days=2, min_adx=5.0, min_volume=10.0)))


@query("backtest_summary")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.summary(backtest.results(backtest.run(signals.trend_signals(market.bars(spark, sf_dir), min_days=2, min_adx=5.0, min_volume=10.0))), "reason")


@query(
    "uptrend_maturity",
    _MOVING
    + f""", u AS (SELECT code, date, coalesce(sma_20 > sma_60, false) AS up, row_number() {_W} AS i FROM mv),
d AS (SELECT code, date, (i - coalesce(max(CASE WHEN NOT up THEN i END) {_W}, 0))::INTEGER AS uptrend_days FROM u)
SELECT code, date, uptrend_days, CASE WHEN uptrend_days = 0 THEN 'none' WHEN uptrend_days <= 7 THEN 'early' WHEN uptrend_days <= 15 THEN 'confirmed' ELSE 'mature' END AS maturity FROM d""",
    dates=("date",),
)
def uptrend_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.uptrend_days(market.bars(spark, sf_dir)).select("code", "date", "uptrend_days", "maturity")


@query(
    "nearest_vectors",
    """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM q, v WHERE q.vec_id <> v.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM s WHERE similarity > 0)
SELECT query_id, vec_id, similarity, place::INTEGER AS place FROM p WHERE place <= 10""",
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of queries, every twentieth vector, against all vectors."""
    vectors = market.table(spark, sf_dir, "embeddings")
    return similarity.nearest_vectors(vectors, vectors.filter("vec_id % 20 = 0"), 10)


@query(
    "episodes",
    """e AS (
  SELECT code, date, max(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND 62 FOLLOWING) / close - 1 AS gain_near,
         max(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND 251 FOLLOWING) / close - 1 AS gain_far FROM bars)
SELECT code, date, round(gain_near, 6) AS gain_near, round(gain_far, 6) AS gain_far FROM e WHERE gain_near >= 0.5 AND gain_far >= 1""",
    dates=("date",),
)
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.episodes(market.bars(spark, sf_dir))


@query(
    "spaced_episodes",
    """e AS (
  SELECT code, date FROM (SELECT code, date, max(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND 62 FOLLOWING) / close - 1 AS gain_near,
         max(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND 251 FOLLOWING) / close - 1 AS gain_far FROM bars) WHERE gain_near >= 0.5 AND gain_far >= 1),
f AS (SELECT code, list_reduce(list_prepend([], list_transform(list(date ORDER BY date), lambda d: [d])), lambda k, d: CASE WHEN len(k) = 0 OR date_diff('day', k[-1], d[1]) > 60 THEN k || d ELSE k END) AS kept FROM e GROUP BY code)
SELECT code, unnest(kept) AS date FROM f""",
    dates=("date",),
)
def spaced_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.spaced(similarity.episodes(market.bars(spark, sf_dir)).select("code", "date"), 60)


@query("shape_matches")
def shape_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.shape_matches(market.bars(spark, sf_dir), [1.0, 1.2, 1.1, 1.4, 1.3, 1.6, 1.5, 1.8, 1.7, 2.0])


@query(
    "daily_attention",
    """a AS (
  SELECT doc_id % 20 AS code, DATE '2024-01-01' + (doc_id % 60)::INTEGER AS date, source, 1 + doc_id % 3 AS mentions,
         sign(contains(lower(text), 'the')::INTEGER + contains(lower(text), 'licensed')::INTEGER - contains(lower(text), 'der')::INTEGER - contains(lower(text), 'token')::INTEGER) AS polarity FROM documents),
m AS (SELECT *, CASE dayofweek(date) WHEN 6 THEN date + 2 WHEN 0 THEN date + 1 ELSE date END AS day FROM a)
SELECT code, day AS date, count(*) AS articles, count(DISTINCT source) AS sources, round(avg(polarity), 6) AS mean_polarity, round(avg(CASE WHEN mentions > 1 THEN 1.0 ELSE 0.0 END), 6) AS co_mention FROM m GROUP BY code, day""",
    dates=("date",),
)
def daily_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = market.table(spark, sf_dir, "documents")
    news = docs.select((F.col("doc_id") % 20).alias("code"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 60).cast("int")).alias("date"), "source", (1 + F.col("doc_id") % 3).alias("mentions"), attention.polarity(F.col("text"), ("the", "licensed"), ("der", "token")).alias("polarity"))
    return attention.daily_attention(news)


@query(
    "tick_bars",
    """d AS (SELECT DISTINCT event_id, user_id AS code, ts, value AS price FROM events)
SELECT code, time_bucket(INTERVAL 1 DAY, ts) AS start, round(first(price ORDER BY ts, event_id), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(last(price ORDER BY ts, event_id), 6) AS close, count(*) AS ticks FROM d GROUP BY ALL""",
)
def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.ohlc(quotes.quotes(market.table(spark, sf_dir, "events")))


@query(
    "quote_sessions",
    """t AS (SELECT user_id AS code, ts, value AS price, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY, true)::INTEGER AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY code ORDER BY ts) AS session FROM t)
SELECT code, min(ts) AS start, count(*) AS ticks, round(sum(price), 6) AS turnover FROM s GROUP BY code, session""",
)
def quote_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.sessions(quotes.quotes(market.table(spark, sf_dir, "events")))


@query(
    "entry_scan",
    _MOVING
    + _RS.replace("rs0 AS", ", rs0 AS", 1)
    + """, l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM mv JOIN rk USING (code, date))
SELECT code, date, round(close, 6) AS close, round(sma_20, 6) AS sma_20, round(vol_ratio, 6) AS vol_ratio, round(rs_pct, 6) AS rs_pct FROM l
WHERE n = 1 AND close > sma_20 AND close <= sma_20 * 1.5 AND rs_pct IS NOT NULL ORDER BY rs_pct DESC, code LIMIT 20""",
    dates=("date",),
)
def entry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest bars a little above their 20-bar average, the strongest twenty."""
    from pyspark.sql import Window

    frame = market.bars(spark, sf_dir)
    both = indicators.moving(frame).join(relative.strength(frame).drop("close"), ["code", "date"])
    last = both.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).filter("_n = 1")
    near = last.filter((F.col("close") > F.col("sma_20")) & (F.col("close") <= F.col("sma_20") * 1.5))
    return screener.top(near, "rs_pct").select("code", "date", "close", "sma_20", "vol_ratio", "rs_pct")


@query("composite_signals")
def composite_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.composite_signals(market.bars(spark, sf_dir))


@query(
    "portfolio_returns",
    _RET
    + """, w AS (SELECT code, weight / sum(weight) OVER () AS weight, count(*) OVER () AS codes FROM (SELECT code, sum(cost) AS weight FROM trades WHERE code <= 3 GROUP BY code))
SELECT date, round(sum(weight * ret), 6) AS ret FROM ret JOIN w USING (code) WHERE ret IS NOT NULL GROUP BY date HAVING count(*) = any_value(codes)""",
    dates=("date",),
)
def portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio of three codes, weighted by what was paid."""
    weights = market.trades(spark, sf_dir).filter("code <= 3").groupBy("code").agg(F.sum("cost").alias("weight"))
    return portfolio.portfolio_returns(market.bars(spark, sf_dir), weights)


@query(
    "stress_test",
    _RET
    + """, m AS (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS mkt FROM idx),
b AS (SELECT code, round(regr_slope(ret, mkt), 6) AS beta FROM ret JOIN m USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY code),
h AS (SELECT code, sum(cost) AS value FROM trades GROUP BY code),
x AS (SELECT h.code, value / sum(value) OVER () AS share, value = max(value) OVER () AS top, coalesce(beta, 1) AS beta FROM h LEFT JOIN b ON h.code = b.code),
s(scenario, market, largest) AS (VALUES ('COVID_2020', -0.285::DOUBLE, NULL::DOUBLE), ('RATE_HIKE_2022', -0.22, NULL), ('TAIWAN_STRAIT_2022', -0.05, NULL), ('TECH_BUBBLE_2000', -0.30, NULL),
  ('MARKET_CRASH_10', -0.10, NULL), ('SINGLE_LIMIT_DOWN', 0.0, -0.10), ('RATE_SHOCK', -0.05, NULL), ('BLACK_SWAN', -0.20, NULL)),
l AS (SELECT scenario, code, round(share * CASE WHEN top AND largest IS NOT NULL THEN largest ELSE beta * market END, 6) AS loss FROM x, s)
SELECT scenario, round(sum(loss), 4) AS portfolio_pnl, first(code ORDER BY loss, code) AS worst_code, min(loss) AS worst_pnl FROM l GROUP BY scenario""",
)
def stress_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    betas = risk.alpha_beta(frame, market.index_bars(frame)).select("code", F.round("beta", 6).alias("beta"))
    return portfolio.stress_test(spark, market.trades(spark, sf_dir).groupBy("code").agg(F.sum("cost").alias("value")), betas)


@query(
    "portfolio_heat",
    _RET
    + """, c AS (SELECT a.code AS code_a, b.code AS code_b, corr(a.ret, b.ret) AS corr FROM ret a JOIN ret b ON a.date = b.date AND a.code < b.code WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND b.code <= 10 GROUP BY ALL HAVING count(*) >= 60),
t AS (SELECT avg(corr) AS top3 FROM (SELECT corr FROM c ORDER BY corr DESC LIMIT 3)),
p AS (SELECT sector, sum(0.004::DOUBLE + code * 0.0001::DOUBLE) AS raw FROM sectors WHERE code <= 10 GROUP BY sector),
h AS (SELECT sector, raw, raw * CASE WHEN top3 >= 0.7 THEN 1.5 WHEN top3 >= 0.5 THEN 1.25 ELSE 1 END AS heat FROM p, t), s AS (SELECT *, sum(heat) OVER () AS total FROM h)
SELECT sector, round(raw, 6) AS raw, round(heat, 6) AS heat, round(heat / total, 6) AS share, CASE WHEN total < 0.03 THEN 'cool' WHEN total < 0.06 THEN 'warm' WHEN total < 0.10 THEN 'hot' ELSE 'over' END AS zone FROM s""",
)
def portfolio_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio of ten codes with made-up risks."""
    held = market.sectors(spark, sf_dir).filter("code <= 10")
    return portfolio.heat(held.select("code", "sector", (0.004 + F.col("code") * 0.0001).alias("risk")), relative.correlations(market.bars(spark, sf_dir), held))


@query(
    "sector_correlations",
    f"""r AS (SELECT code, date, close / nullif(lag(close) {_W}, 0) - 1 AS ret, lag(volume) {_W} AS weight FROM bars),
d AS (SELECT sector, date, sum(ret * weight) / nullif(sum(weight), 0) AS ret FROM r JOIN sectors USING (code) WHERE ret IS NOT NULL GROUP BY ALL),
p AS (SELECT a.sector AS sector_a, b.sector AS sector_b, a.date, a.ret AS x, b.ret AS y FROM d a JOIN d b ON a.date = b.date AND a.sector < b.sector)
SELECT sector_a, sector_b, date, round(CASE WHEN count(*) OVER w >= 90 THEN corr(x, y) OVER w END, 6) AS corr FROM p WINDOW w AS (PARTITION BY sector_a, sector_b ORDER BY date ROWS 89 PRECEDING)""",
    dates=("date",),
)
def sector_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.sector_correlations(market.bars(spark, sf_dir), market.sectors(spark, sf_dir))


@query(
    "factor_exposure",
    _RET
    + """, f0 AS (SELECT date, close / nullif(lag(close) OVER w, 0) - 1 AS mkt, close / nullif(lag(close, 20) OVER w, 0) - 1 AS m20 FROM idx WINDOW w AS (ORDER BY date)),
f AS (SELECT date, mkt, lag(m20) OVER (ORDER BY date) AS mom FROM f0),
o AS (SELECT code, ret, mkt, mom FROM ret JOIN f USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL AND mom IS NOT NULL),
s AS (SELECT code, covar_pop(mkt, mkt) AS aa, covar_pop(mkt, mom) AS ab, covar_pop(mom, mom) AS bb, covar_pop(mkt, ret) AS ar, covar_pop(mom, ret) AS br, avg(mkt) AS ma, avg(mom) AS mb, avg(ret) AS mr FROM o GROUP BY code),
l AS (SELECT *, (ar * bb - br * ab) / (aa * bb - ab * ab) AS market, (br * aa - ar * ab) / (aa * bb - ab * ab) AS momentum FROM s)
SELECT code, round(market, 6) AS market, round(momentum, 6) AS momentum, round(mr - market * ma - momentum * mb, 6) AS alpha FROM l""",
)
def factor_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    return portfolio.factor_exposure(frame, market.index_bars(frame))


@query("kelly_shares", _PNL + " , k AS (SELECT code, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN ret > 0 THEN ret END) / nullif(abs(avg(CASE WHEN ret <= 0 THEN ret END)), 0) AS payoff FROM p GROUP BY code) SELECT code, round(p, 6) AS p, round(payoff, 6) AS payoff, round(greatest(0, (p - (1 - p) / nullif(payoff, 0)) / 2), 6) AS share FROM k")
def kelly_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = market.trades(spark, sf_dir).withColumn("ret", F.try_divide(F.col("proceeds") - F.col("cost"), "cost"))
    return portfolio.kelly(closed)


@query(
    "case_search",
    """c AS (SELECT vec_id % 40 AS code, DATE '2020-01-01' + (vec_id * 3)::INTEGER AS date, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT * FROM c ORDER BY date DESC, code LIMIT 1),
s AS (SELECT c.code, c.date, greatest(0, least(list_cosine_similarity(c.v, q.v), 1)) AS similarity, date_diff('day', c.date, q.date) AS age FROM c, q WHERE c.code <> q.code AND c.date < q.date),
b AS (SELECT code, date, similarity, similarity * pow(2.0, -age / 730.0) AS score FROM s WHERE similarity >= 0.05 ORDER BY score DESC, code, date LIMIT 30),
o AS (SELECT *, row_number() OVER (PARTITION BY code, date_trunc('month', date) ORDER BY score DESC, date) AS n FROM b)
SELECT code, date, round(similarity, 6) AS similarity, round(score, 6) AS score FROM o WHERE n = 1 ORDER BY score DESC, code, date LIMIT 10""",
    dates=("date",),
)
def case_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("code"), F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("vec_id") * 3).cast("int")).alias("date"), F.col("embedding").alias("vector"))
    return cases.search(rows, rows.orderBy(F.desc("date"), "code"), least=0.05)


@query(
    "label_profile",
    """l AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings), m AS (SELECT label, place, avg(x) AS mean, count(*) AS n FROM l GROUP BY ALL)
SELECT label, max(n) AS n, array_to_string((list(place ORDER BY abs(round(mean, 9)) DESC, place DESC))[1:3], ',') AS top_places, max(n) >= 30 AS confident FROM m GROUP BY label""",
)
def label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.profile(market.table(spark, sf_dir, "embeddings"), "label", "embedding")


@query("vector_clusters")
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.clusters(market.table(spark, sf_dir, "embeddings"), 8)


@query(
    "trailing_stops",
    _MOVING
    + """, e AS (SELECT code, min(date) AS entry_date, first(close ORDER BY date) AS entry FROM mv WHERE atr_14 IS NOT NULL GROUP BY code),
h AS (SELECT mv.code, entry_date, date, close, entry, atr_14, max(high) OVER (PARTITION BY mv.code ORDER BY date) AS top FROM mv JOIN e ON mv.code = e.code AND date >= entry_date),
p AS (SELECT *, CASE WHEN (top - entry) / (entry * 0.07) >= 2 THEN 3 WHEN (top - entry) / (entry * 0.07) >= 1.5 THEN 2 WHEN (top - entry) / (entry * 0.07) >= 1 THEN 1 ELSE 0 END AS phase FROM h),
l AS (SELECT *, greatest(CASE phase WHEN 3 THEN top - 1.5 * atr_14 WHEN 2 THEN top - 2 * atr_14 WHEN 1 THEN entry ELSE entry * 0.93 END, entry * 0.93) AS level FROM p)
SELECT code, entry_date, date, round(top, 6) AS top, phase::INTEGER AS phase, round(max(level) OVER (PARTITION BY code ORDER BY date), 6) AS stop FROM l""",
    digits=6,
    dates=("date", "entry_date"),
)
def trailing_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    ready = indicators.moving(frame).filter("atr_14 is not null")
    entries = ready.groupBy("code").agg(F.min("date").alias("entry_date"), F.min_by("close", "date").alias("entry"))
    return signals.trailing_stop(frame, entries).select("code", "entry_date", "date", "top", "phase", "stop")


_GROWTH = "g0 AS (SELECT *, lag(revenue, 4) OVER (PARTITION BY industry ORDER BY quarter_end) AS before FROM fundamentals), g AS (SELECT *, CASE WHEN before < 0 AND revenue > 0 THEN NULL WHEN before < 0 AND revenue < 0 THEN -(revenue / before - 1) ELSE revenue / nullif(before, 0) - 1 END AS growth FROM g0)"


@query("revenue_growth", _GROWTH + " SELECT industry, quarter_end, available_date, round(growth, 6) AS growth FROM g", dates=("quarter_end", "available_date"))
def revenue_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamental.revenue_growth(market.fundamentals(spark, sf_dir), "industry", "quarter_end").select("industry", "quarter_end", "available_date", "growth")


@query(
    "revenue_streaks",
    _GROWTH
    + """, k AS (SELECT industry, sign(growth) AS s, row_number() OVER w AS i, first_value(sign(growth)) OVER w AS last FROM g WHERE growth IS NOT NULL WINDOW w AS (PARTITION BY industry ORDER BY quarter_end DESC)),
r AS (SELECT industry, any_value(last) AS last, coalesce(min(CASE WHEN s <> last OR s = 0 THEN i END) - 1, max(i)) AS n FROM k GROUP BY industry)
SELECT industry, CASE WHEN last > 0 THEN n ELSE 0 END::BIGINT AS up, CASE WHEN last < 0 THEN n ELSE 0 END::BIGINT AS down FROM r""",
)
def revenue_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamental.streaks(fundamental.revenue_growth(market.fundamentals(spark, sf_dir), "industry", "quarter_end"), "industry", "quarter_end")


@query(
    "attention_features",
    """d AS (SELECT doc_id % 20 AS code, DATE '2000-01-01' + (doc_id % 60)::INTEGER AS day, source FROM documents),
a AS (SELECT code, CASE dayofweek(day) WHEN 6 THEN day + 2 WHEN 0 THEN day + 1 ELSE day END AS date, count(*) AS articles, count(DISTINCT source) AS sources FROM d GROUP BY ALL),
b AS (SELECT bars.code, bars.date, coalesce(articles, 0) AS n, articles, sources FROM bars LEFT JOIN a ON a.code = bars.code AND a.date = bars.date)
SELECT code, date, sum(n) OVER (PARTITION BY code ORDER BY date ROWS 6 PRECEDING)::BIGINT AS articles_7, round(n / nullif(avg(n) OVER (PARTITION BY code ORDER BY date ROWS 29 PRECEDING), 0), 6) AS spike,
       coalesce(max(sources) OVER (PARTITION BY code ORDER BY date ROWS 6 PRECEDING), 0)::BIGINT AS sources_7,
       least(coalesce(date_diff('day', max(CASE WHEN articles IS NOT NULL THEN date END) OVER (PARTITION BY code ORDER BY date), date), 30), 30)::INTEGER AS recency FROM b""",
    dates=("date",),
)
def attention_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = market.table(spark, sf_dir, "documents")
    news = docs.select((F.col("doc_id") % 20).alias("code"), F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("doc_id") % 60).cast("int")).alias("date"), "source", F.lit(1).alias("mentions"), F.lit(0).alias("polarity"))
    return attention.attention_features(market.bars(spark, sf_dir), attention.daily_attention(news)).drop("polarity", "co_mention")


@query(
    "healed_last_day",
    f"""r AS (SELECT *, lag(close) {_W} AS before, max(date) OVER (PARTITION BY code) AS newest FROM bars),
h AS (SELECT *, coalesce(date = newest AND abs(close / nullif(before, 0) - 1) > 0.15 AND code % 7 <> 0, false) AS healed FROM r)
SELECT code, date, round(CASE WHEN healed THEN before ELSE close END, 6) AS close, healed FROM h WHERE date = newest""",
    dates=("date",),
)
def healed_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh code has a known action on its last day."""
    from pyspark.sql import Window

    frame = market.bars(spark, sf_dir)
    actions = frame.groupBy("code").agg(F.max("date").alias("date")).filter("code % 7 = 0")
    newest = F.max("date").over(Window.partitionBy("code"))
    return screener.heal_last_day(frame, actions).withColumn("newest", newest).filter("date = newest").select("code", "date", "close", "healed")


@query(
    "price_performance",
    """r AS (SELECT *, row_number() OVER w AS n, lead(close, 5) OVER w AS p5, lead(close, 63) OVER w AS p63, lead(close, 252) OVER w AS p252 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date DESC)),
e AS (SELECT code, max(high) AS high, min(low) AS low, first(date ORDER BY high DESC, date) AS high_date, first(date ORDER BY low, date) AS low_date FROM r WHERE n <= 252 GROUP BY code)
SELECT code, date, round(coalesce(close / p5 - 1, 0), 6) AS change_1w, round(coalesce(close / p63 - 1, 0), 6) AS change_3m, round(coalesce(close / p252 - 1, 0), 6) AS change_1y, high_date, low_date,
       round(close / e.high - 1, 6) AS from_high, round(close / e.low - 1, 6) AS from_low FROM r JOIN e USING (code) WHERE n = 1""",
    dates=("date", "high_date", "low_date"),
)
def price_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.performance(market.bars(spark, sf_dir)).select("code", "date", "change_1w", "change_3m", "change_1y", "high_date", "low_date", "from_high", "from_low")


#: Swing points as swung (code, side, date, price, pos).
_SWUNG = """sw0 AS (
  SELECT code, date, high, low, row_number() OVER (PARTITION BY code ORDER BY date) AS pos, count(*) OVER w AS n, max(high) OVER w AS top, min(low) OVER w AS bottom FROM bars
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
sw1 AS (SELECT code, 'high' AS side, date, high AS price, high AS rank, pos FROM sw0 WHERE n = 31 AND high = top UNION ALL SELECT code, 'low', date, low, -low, pos FROM sw0 WHERE n = 31 AND low = bottom),
sw2 AS (SELECT code, side, list_reduce(list_prepend([], list_transform(list({'date': date, 'price': price, 'rank': rank, 'pos': pos} ORDER BY pos), lambda x: [x])),
        lambda k, x: CASE WHEN len(k) = 0 OR x[1].pos - k[-1].pos >= 10 THEN k || x WHEN x[1].rank > k[-1].rank THEN k[:-2] || x ELSE k END) AS kept FROM sw1 GROUP BY code, side),
sw3 AS (SELECT code, side, unnest(kept) AS x FROM sw2),
swung AS (SELECT code, side, x.date AS date, x.price AS price, x.pos AS pos FROM sw3)"""
#: Retracements and extensions as fib (code, direction, kind, ratio, level).
_FIB = f"""{_SWUNG},
fb0 AS (SELECT code, max(price) FILTER (side = 'high') AS top, min(price) FILTER (side = 'low') AS bottom FROM (SELECT *, row_number() OVER (PARTITION BY code, side ORDER BY pos DESC) AS n FROM swung) WHERE n <= 5 GROUP BY code),
fb1 AS (SELECT code, arg_max(close, date) AS close, max(high) AS high, min(low) AS low, min(low) FILTER (back <= 120) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM bars) GROUP BY code),
fb2 AS (SELECT fb1.*, coalesce(top, high) AS t, coalesce(bottom, low) AS b FROM fb1 LEFT JOIN fb0 USING (code)),
fb3 AS (SELECT * REPLACE (CASE WHEN t <= b THEN high ELSE t END AS t, CASE WHEN t <= b THEN low ELSE b END AS b) FROM fb2),
fb4 AS (SELECT code, close, CASE WHEN close > t * 1.02::DOUBLE THEN high ELSE t END AS t, CASE WHEN close > t * 1.02::DOUBLE THEN CASE WHEN high <= recent THEN low ELSE recent END ELSE b END AS b FROM fb3),
fb5 AS (SELECT *, close - b > (t - b) * 0.5::DOUBLE AS up FROM fb4),
fib AS (SELECT code, CASE WHEN up THEN 'uptrend' ELSE 'downtrend' END AS direction, 'retracement' AS kind, ratio, CASE WHEN up THEN t - (t - b) * ratio ELSE b + (t - b) * ratio END AS level FROM fb5, (SELECT unnest([0.236, 0.382, 0.5, 0.618, 0.786]::DOUBLE[]) AS ratio)
  UNION ALL SELECT code, CASE WHEN up THEN 'uptrend' ELSE 'downtrend' END, 'extension', ratio, CASE WHEN up THEN b + (t - b) * ratio ELSE t - (t - b) * ratio END FROM fb5, (SELECT unnest([1.0, 1.272, 1.618, 2.0]::DOUBLE[]) AS ratio))"""


@query("swing_points", _SWUNG + " SELECT code, side, date, round(price, 6) AS price FROM swung", dates=("date",))
def swing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.swings(market.bars(spark, sf_dir)).select("code", "side", "date", "price")


@query("retracement_levels", _FIB + " SELECT code, direction, kind, ratio, round(level, 6) AS level FROM fib")
def retracement_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    return levels.retracements(frame, levels.swings(frame))


@query(
    "walk_forward",
    _PNL
    + """, w AS (SELECT date_trunc('quarter', close_date)::DATE AS start, count(*) AS trades, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(ret) AS mean_ret FROM p GROUP BY ALL)
SELECT start, trades, round(win_rate, 6) AS win_rate, round(mean_ret, 6) AS mean_ret, round(mean_ret / nullif(lag(mean_ret) OVER (ORDER BY start), 0), 6) AS efficiency FROM w""",
    dates=("start",),
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.walk_forward(market.trades(spark, sf_dir).withColumn("ret", F.try_divide(F.col("proceeds") - F.col("cost"), "cost")))


@query(
    "walk_forward_efficiency",
    _PNL
    + """, w AS (SELECT date_trunc('quarter', close_date)::DATE AS start, count(*) AS trades, sum(ret) AS net FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY start) AS i, count(*) OVER () AS m FROM w),
h AS (SELECT any_value(m) AS windows, sum(trades) AS trades, coalesce(sum(net) FILTER (i <= m // 2), 0) AS first_half, coalesce(sum(net) FILTER (i > m // 2), 0) AS second_half FROM n)
SELECT windows::BIGINT AS windows, trades::BIGINT AS trades, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, round(coalesce(second_half / nullif(first_half, 0), 0), 6) AS efficiency FROM h""",
)
def walk_forward_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.efficiency(monitoring.walk_forward(market.trades(spark, sf_dir).withColumn("ret", F.try_divide(F.col("proceeds") - F.col("cost"), "cost"))))


@query(
    "bounds_check",
    _RET
    + f""", b AS (SELECT code, date, ret, coalesce(ret < -0.5, false) AS below FROM ret), i AS (SELECT *, sum(CASE WHEN below THEN 0 ELSE 1 END) {_W} AS island FROM b),
r AS (SELECT code, island, sum(below::INTEGER) AS run, sum(CASE WHEN ret BETWEEN -0.5 AND 0.8 THEN 1 ELSE 0 END) AS inside, count(ret) AS n FROM i GROUP BY ALL)
SELECT code, round(sum(inside) / sum(n), 6) AS in_bounds, max(run)::BIGINT AS longest, max(run) >= 3 AS alarm FROM r GROUP BY code""",
)
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.functions.windows import change

    return monitoring.bounds_check(market.bars(spark, sf_dir).select("code", "date", change("close").alias("ret"), F.lit(-0.5).alias("low"), F.lit(0.8).alias("high")))


@query(
    "exposure",
    """f AS (
  SELECT date, close, CASE WHEN count(*) OVER f >= 20 THEN avg(close) OVER f END AS fast, CASE WHEN count(*) OVER s >= 60 THEN avg(close) OVER s END AS slow FROM idx
  WINDOW f AS (ORDER BY date ROWS 19 PRECEDING), s AS (ORDER BY date ROWS 59 PRECEDING)),
g AS (SELECT date, CASE WHEN close > fast AND fast > slow THEN 'bull' WHEN close < fast AND fast < slow THEN 'bear' ELSE 'sideways' END AS regime FROM f),
n AS (SELECT *, coalesce(regime <> lag(regime) OVER (ORDER BY date), true)::INTEGER AS new FROM g), r AS (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM n),
s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY date) AS streak FROM r)
SELECT date, regime, streak::INTEGER AS streak,
       coalesce(last_value(CASE WHEN streak >= 2 OR regime = 'bear' THEN CASE regime WHEN 'bull' THEN 1.0 WHEN 'bear' THEN 0.3 ELSE 0.6 END END IGNORE NULLS) OVER (ORDER BY date), 1.0)::DOUBLE AS exposure FROM s""",
    dates=("date",),
)
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    regimes = relative.regime(market.index_bars(market.bars(spark, sf_dir))).select("date", "regime")
    return monitoring.exposure(regimes, {"bull": 1.0, "bear": 0.3, "sideways": 0.6}, at_once=("bear",))


@query("mean_intervals")
def mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.functions.windows import change

    returns = market.bars(spark, sf_dir).select("code", "date", change("close").alias("ret"))
    return monitoring.mean_interval(returns, "code", "ret")

"""Analytics of trades, signals and portfolios over the driver's tables, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import lag
from quantloom.operators import analytics, indicators, relative
from quantloom.plans.queries import _MOVING, _PNL, _RET, _W, query
from quantloom.sources import market


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with their result, a stop 7 % below the entry and a confidence that follows from the id."""
    rows = market.trades(spark, sf_dir).withColumns({"pnl": F.col("proceeds") - F.col("cost"), "ret": F.try_divide(F.col("proceeds") - F.col("cost"), F.col("cost"))})
    return rows.withColumns({"entry": F.col("cost"), "exit": F.col("proceeds"), "stop": F.col("cost") * 0.93, "confidence": (F.col("trade_id") % 15) / 10})


_T = _PNL + ", t AS (SELECT *, CASE WHEN cost > cost * 0.93 THEN (proceeds - cost) / (cost - cost * 0.93) ELSE 0 END AS r, (trade_id % 15) / 10 AS confidence FROM p)"


@query(
    "risk_expectancy",
    _T
    + """, e AS (
  SELECT tag, count(*) AS trades, avg(CASE WHEN r > 0.1 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(CASE WHEN r < -0.1 THEN 1.0 ELSE 0.0 END) AS loss_rate, coalesce(avg(CASE WHEN r > 0.1 THEN r END), 0) AS avg_win_r,
         coalesce(abs(avg(CASE WHEN r < -0.1 THEN r END)), 0) AS avg_loss_r, max(r) AS best_r, min(r) AS worst_r, count(CASE WHEN r < -2 THEN 1 END) AS n_below_m2, count(CASE WHEN r >= -2 AND r < -1 THEN 1 END) AS n_m2_to_m1,
         count(CASE WHEN r >= -1 AND r < -0.1 THEN 1 END) AS n_m1_to_0, count(CASE WHEN abs(r) <= 0.1 THEN 1 END) AS n_even, count(CASE WHEN r >= 0.1 AND r < 1 THEN 1 END) AS n_0_to_1, count(CASE WHEN r >= 1 AND r < 2 THEN 1 END) AS n_1_to_2,
         count(CASE WHEN r >= 2 AND r < 3 THEN 1 END) AS n_2_to_3, count(CASE WHEN r >= 3 THEN 1 END) AS n_above_3 FROM t GROUP BY tag),
x AS (SELECT *, win_rate * avg_win_r - loss_rate * avg_loss_r AS expectancy FROM e)
SELECT * REPLACE (round(win_rate, 4) AS win_rate, round(loss_rate, 4) AS loss_rate, round(avg_win_r, 4) AS avg_win_r, round(avg_loss_r, 4) AS avg_loss_r, round(best_r, 4) AS best_r, round(worst_r, 4) AS worst_r, round(expectancy, 4) AS expectancy),
       CASE WHEN trades < 10 THEN 'insufficient' WHEN expectancy < 0 THEN 'losing' WHEN expectancy < 0.5 THEN 'break-even' WHEN expectancy < 1 THEN 'profitable' ELSE 'excellent' END AS grade FROM x""",
    digits=4,
)
def risk_expectancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.expectancy(analytics.r_multiples(_trades(spark, sf_dir)), "tag")


@query("risk_multiples", _T + " SELECT trade_id, code, round(r, 4) AS r FROM t", digits=4)
def risk_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.r_multiples(_trades(spark, sf_dir)).select("trade_id", "code", "r")


@query(
    "discipline",
    _T
    + """, d AS (SELECT CASE WHEN c >= 1 THEN 100.0 WHEN c >= 0.5 THEN 70.0 ELSE 30.0 END::DOUBLE AS s FROM (SELECT CASE WHEN confidence = 0 THEN 0.7 ELSE confidence END AS c FROM t))
SELECT round(avg(s), 6) AS score, count(*) AS trades, count(CASE WHEN s = 100 THEN 1 END) AS high, count(CASE WHEN s = 70 THEN 1 END) AS middle, count(CASE WHEN s = 30 THEN 1 END) AS low FROM d""",
)
def discipline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.discipline(_trades(spark, sf_dir))


@query(
    "confidence_brackets",
    _T
    + """ SELECT CASE WHEN confidence >= 1.2 THEN 3 WHEN confidence >= 1.0 THEN 2 WHEN confidence >= 0.5 THEN 1 ELSE 0 END::INTEGER AS bracket, count(*) AS trades, round(avg(ret), 6) AS avg_return,
    round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM t GROUP BY ALL""",
)
def confidence_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.confidence_brackets(_trades(spark, sf_dir))


@query(
    "recent_trades",
    _PNL + " SELECT count(*) AS trades, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(ret), 6) AS avg_return FROM p WHERE close_date >= DATE '1998-09-01'",
)
def recent_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.recent(_trades(spark, sf_dir), F.lit("1998-09-01").cast("date"))


_FW = """fw AS (SELECT code, date, sector, lead(close, 1) OVER w / close - 1 AS d1, lead(close, 3) OVER w / close - 1 AS d3, lead(close, 5) OVER w / close - 1 AS d5, lead(close, 10) OVER w / close - 1 AS d10, lead(close, 20) OVER w / close - 1 AS d20,
  lead(close, 21) OVER w / close - 1 AS d21 FROM bars JOIN sectors USING (code) WINDOW w AS (PARTITION BY code ORDER BY date))"""


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.forward_returns(market.bars(spark, sf_dir), (1, 3, 5, 10, 20, 21)).join(market.sectors(spark, sf_dir), "code")


@query(
    "decay_curve",
    _FW
    + """, l AS (SELECT sector, substr(h, 2)::INTEGER AS day, ret FROM (SELECT sector, d1, d3, d5, d10, d20 FROM fw) UNPIVOT (ret FOR h IN (d1, d3, d5, d10, d20))),
e AS (SELECT sector, day, avg(ret) AS avg_return, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS w, coalesce(avg(CASE WHEN ret > 0 THEN ret END), 0) AS g, coalesce(avg(CASE WHEN ret <= 0 THEN ret END), 0) AS l FROM l GROUP BY ALL)
SELECT sector, day, round(avg_return, 6) AS avg_return, n, round(w * g - (1 - w) * abs(l), 6) AS ev, round(w * g - (1 - w) * abs(l) - 0.005855, 6) AS net_ev, w * g - (1 - w) * abs(l) > 0 AND w * g - (1 - w) * abs(l) < 0.005855 AS cost_trap FROM e""",
)
def decay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.decay_curve(_forward(spark, sf_dir), "sector")


@query(
    "path_statistics",
    f"""n AS (SELECT code, date, close, volume, row_number() {_W} AS i FROM bars), s AS (SELECT *, code * 100000 + i AS c FROM n WHERE volume >= 90),
x AS (SELECT s.c, b.i - s.i AS day, b.close / nullif(s.close, 0) AS x FROM s JOIN n b ON b.code = s.code AND b.i BETWEEN s.i AND s.i + 20),
f AS (SELECT c, last(x ORDER BY day) AS f FROM x GROUP BY c), e AS (SELECT first(c ORDER BY f, c) AS worst, first(c ORDER BY f DESC, c) AS best FROM f)
SELECT x.day::INTEGER AS day, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.25), 6) AS p25, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(max(CASE WHEN c = worst THEN x END), 6) AS worst,
       round(max(CASE WHEN c = best THEN x END), 6) AS best FROM x, e GROUP BY x.day""",
)
def path_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the twenty days after each bar of much volume."""
    rows = analytics.forward_paths(market.bars(spark, sf_dir), 20).withColumn("i", F.row_number().over(Window.partitionBy("code").orderBy("date")))
    return analytics.path_statistics(rows.filter("volume >= 90").select((F.col("code") * 100000 + F.col("i")).alias("case"), "path"))


@query(
    "confidence_score",
    _FW
    + """, g AS (SELECT sector, count(*) AS cases, count(d21) AS n, avg(d21 - 0.005855) AS mean, stddev_pop(d21 - 0.005855) AS sd, count(CASE WHEN d21 > 0 THEN 1 END) AS up FROM fw WHERE date >= DATE '1998-11-01' GROUP BY sector),
s AS (SELECT *, round_even(least(cases / 30.0, 1) * 30 + coalesce(greatest(least((3 - CASE WHEN abs(round(mean, 4)) > 0.001 THEN round(sd, 4) / abs(round(mean, 4)) ELSE 10 END) / 2.5, 1), 0) * 40, 0) + coalesce(greatest(up, n - up) / nullif(n, 0) * 30, 0), 0) AS score FROM g)
SELECT sector, cases, score::DOUBLE AS score, CASE WHEN score >= 65 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS grade, round(mean - 1.96 * sd / sqrt(greatest(n, 1)), 6) AS low, round(mean + 1.96 * sd / sqrt(greatest(n, 1)), 6) AS high FROM s""",
)
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the cases of the last months, by sector."""
    return analytics.confidence_score(_forward(spark, sf_dir).filter("date >= DATE '1998-11-01'"), "sector")


@query(
    "hit_rate",
    _FW + " SELECT sector, round(avg(CASE WHEN coalesce(d3, 1) > 0 AND coalesce(d5, 1) > 0 AND coalesce(d10, 1) > 0 AND coalesce(d20, 1) > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n FROM fw WHERE coalesce(d3, d5, d10, d20) IS NOT NULL GROUP BY sector",
)
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.hit_rate(_forward(spark, sf_dir), "sector", ["d3", "d5", "d10", "d20"])


@query(
    "sector_success",
    _FW
    + """, r AS (SELECT sector, count(d21) AS n, CASE WHEN count(d21) >= 3 THEN avg(CASE WHEN d21 BETWEEN -0.5 AND 2 THEN 1.0 WHEN d21 IS NOT NULL THEN 0.0 END) END AS rate FROM fw GROUP BY sector)
SELECT sector, n, round(rate, 6) AS rate, CASE WHEN rate > 0.7 THEN 3 WHEN rate < 0.4 THEN -5 ELSE 0 END::INTEGER AS adjustment FROM r""",
)
def sector_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.group_success(_forward(spark, sf_dir).withColumn("inside", F.col("d21").between(-0.5, 2.0)), "sector")


@query(
    "slippage_audit",
    """f AS (SELECT sector, (open - before) / before * 10000 AS bps FROM (SELECT code, open, lag(close) OVER (PARTITION BY code ORDER BY date) AS before FROM bars) JOIN sectors USING (code) WHERE before IS NOT NULL),
g AS (SELECT sector, count(*) AS n, median(bps) AS m, quantile_cont(bps, 0.95) AS p, avg(bps) AS a FROM f GROUP BY sector)
SELECT sector, n, round(m, 4) AS median_bps, round(p, 4) AS p95_bps, round(a, 4) AS avg_bps, CASE WHEN n < 5 THEN 'INSUFFICIENT_DATA' WHEN m >= 50 OR p >= 150 THEN 'HIGH' ELSE 'LOW' END AS status FROM g""",
    digits=4,
)
def slippage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What buying at the next open costs against the close before it."""
    rows = market.bars(spark, sf_dir).select("code", F.col("open").alias("paid"), lag("close").alias("planned")).join(market.sectors(spark, sf_dir), "code")
    return analytics.slippage(rows, "sector")


@query(
    "payload_ratio",
    _PNL
    + """, o AS (SELECT *, count(CASE WHEN ret > 0 THEN 1 END) OVER (PARTITION BY tag) AS wins, row_number() OVER (PARTITION BY tag ORDER BY ret DESC NULLS LAST) AS place FROM p)
SELECT tag, count(*) AS trades, round(coalesce(sum(CASE WHEN place <= greatest(1, floor(wins * 0.05)) THEN greatest(ret, 0) END) / nullif(sum(greatest(ret, 0)), 0), 0), 6) AS payload_ratio, count(CASE WHEN ret > 0.5 THEN 1 END) AS home_runs FROM o GROUP BY tag""",
)
def payload_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.payload(_trades(spark, sf_dir), "tag")


@query(
    "score_distribution",
    _T + " SELECT count(r) AS n, round(avg(r), 4) AS mean, round(stddev_samp(r), 4) AS sd, round(quantile_cont(r, 0.1), 4) AS p10, round(quantile_cont(r, 0.25), 4) AS p25, round(median(r), 4) AS p50, round(quantile_cont(r, 0.75), 4) AS p75, round(quantile_cont(r, 0.9), 4) AS p90 FROM t",
    digits=4,
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.score_distribution(analytics.r_multiples(_trades(spark, sf_dir)), "r")


@query(
    "strategy_drift",
    _PNL
    + """, s AS (SELECT trade_id, ret + 0.2 AS drift, (ret + 0.2) / ((0.3 + 0.7) / 3.92) AS z, row_number() OVER (ORDER BY close_date DESC, trade_id) AS n FROM p WHERE ret IS NOT NULL),
a AS (SELECT count(*) AS signals, avg(CASE WHEN n <= 20 THEN drift END) AS drift, avg(CASE WHEN n <= 20 THEN z END) AS z0, avg(CASE WHEN n > 10 AND n <= 30 THEN z END) AS z1, avg(CASE WHEN n > 20 AND n <= 40 THEN z END) AS z2 FROM s),
b AS (SELECT *, signals >= 40 AND z0 < z1 AND z1 < z2 AND z0 < -0.75 AS expanding FROM a)
SELECT signals, round(drift, 6) AS drift, round(z0, 6) AS z, CASE WHEN drift > 0.01 THEN 'POSITIVE' WHEN drift < -0.01 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction, expanding,
       CASE WHEN expanding THEN 'CRITICAL' WHEN abs(z0) > 1.5 OR abs(drift) > 0.15 THEN 'WARNING' ELSE 'NORMAL' END AS alert FROM b WHERE signals >= 5""",
)
def strategy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as signals that were expected to lose 20 %, with an interval from -70 to 30 %."""
    rows = _trades(spark, sf_dir).select(F.col("trade_id").alias("id"), F.col("close_date").alias("date"), "ret", F.lit(-0.2).alias("expected"), F.lit(-0.7).alias("low"), F.lit(0.3).alias("high"))
    return analytics.drift(rows)


_SWING = f"""lows AS (SELECT *, row_number() {_W} AS i FROM mv),
sw AS (
  SELECT a.code, a.i, max(CASE WHEN b.i BETWEEN a.i - 14 AND a.i - 1 AND b.low <= (SELECT min(c.low) FROM lows c WHERE c.code = a.code AND c.i BETWEEN b.i - 5 AND least(b.i + 5, a.i)) THEN b.i END) AS at, min(b.low) AS least, count(*) AS n
  FROM lows a JOIN lows b ON b.code = a.code AND b.i BETWEEN a.i - 19 AND a.i GROUP BY a.code, a.i),
swing AS (SELECT sw.code, sw.i, CASE WHEN sw.n >= 20 THEN coalesce(l.low, sw.least) END AS swing_low FROM sw LEFT JOIN lows l ON l.code = sw.code AND l.i = sw.at)"""


@query(
    "initial_stops",
    _MOVING
    + f""", {_SWING},
e AS (SELECT l.code, l.date, close, atr_14, swing_low, CASE WHEN l.i % 3 = 0 THEN 'squeeze_breakout' WHEN l.i % 3 = 1 THEN 'momentum_breakout' ELSE 'other' END AS kind, CASE WHEN l.i % 4 = 0 THEN l.low * 0.99::DOUBLE - CASE WHEN l.low * 0.99::DOUBLE < 10 THEN 0.01::DOUBLE WHEN l.low * 0.99::DOUBLE < 50 THEN 0.05::DOUBLE WHEN l.low * 0.99::DOUBLE < 100 THEN 0.1::DOUBLE WHEN l.low * 0.99::DOUBLE < 500 THEN 0.5::DOUBLE WHEN l.low * 0.99::DOUBLE < 1000 THEN 1 ELSE 5 END END AS pv, CASE WHEN l.i % 4 = 0 THEN (l.i % 12) * 8 END AS pv_score
  FROM lows l JOIN swing USING (code, i) WHERE atr_14 IS NOT NULL),
r AS (SELECT *, close - atr_14 * CASE WHEN kind = 'squeeze_breakout' THEN 1.7 ELSE 2.2 END AS ranged, CASE WHEN pv_score >= 70 THEN pv WHEN pv_score >= 50 THEN greatest(swing_low, pv) ELSE swing_low END AS structural FROM e),
c AS (SELECT *, least(CASE WHEN structural > 0 THEN structural END, CASE WHEN ranged > 0 THEN ranged END, close * 0.93) AS lowest, pv_score >= 70 AND pv > ranged AS by_pivot FROM r),
s AS (SELECT *, CASE WHEN coalesce(by_pivot, false) THEN pv ELSE lowest END AS s0 FROM c)
SELECT code, date, round(CASE WHEN s0 >= close THEN close * 0.93 ELSE s0 END, 9) AS stop,
       CASE WHEN s0 >= close THEN 'percent' WHEN coalesce(by_pivot, false) THEN 'pivot' WHEN s0 = close * 0.93 THEN 'percent' WHEN ranged > 0 AND s0 = ranged THEN 'range' ELSE 'structural' END AS method, round((close - CASE WHEN s0 >= close THEN close * 0.93 ELSE s0 END) / close, 9) AS risk FROM s""",
    digits=9,
    dates=("date",),
)
def initial_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar as an entry at its close; kinds, pivots and their scores follow from the bar's number."""
    w = Window.partitionBy("code").orderBy("date")
    rows = analytics.swing_low(indicators.moving(market.bars(spark, sf_dir)).withColumn("i", F.row_number().over(w)))
    fourth = F.col("i") % 4 == 0
    kind = F.when(F.col("i") % 3 == 0, "squeeze_breakout").when(F.col("i") % 3 == 1, "momentum_breakout").otherwise("other")
    entries = rows.filter("atr_14 IS NOT NULL").select("code", "date", F.col("close").alias("entry"), kind.alias("kind"), F.col("atr_14").alias("atr"), analytics.range_adjustment(F.lit(0.4)).alias("adjustment"), "swing_low", F.when(fourth, F.col("low") * 0.99).alias("pivot"), F.when(fourth, F.col("i") % 12 * 8).alias("pivot_score"))
    return analytics.initial_stop(entries).select("code", "date", "stop", "method", "risk")


@query(
    "range_multiples",
    f"""s AS (SELECT code, date, max(high) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead, low * 0.9 AS stop FROM bars), k AS (SELECT code, avg(CASE WHEN ahead > stop * 1.02 THEN 1.0 WHEN ahead IS NOT NULL THEN 0.0 END) AS rate FROM s GROUP BY code)
SELECT code, round(rate, 6) AS rate, CASE WHEN rate > 0.3 THEN 0.2 WHEN rate < 0.15 THEN -0.1 ELSE 0 END::DOUBLE AS adjustment, greatest(least(1.5 + CASE WHEN rate > 0.3 THEN 0.2 WHEN rate < 0.15 THEN -0.1 ELSE 0 END, 3.5), 1.5)::DOUBLE AS multiple FROM k""",
)
def range_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar as a stop a tenth below its low; per code the share that was shaken out and what that does to its ranges."""
    frame = market.bars(spark, sf_dir)
    out = analytics.shakeouts(frame, frame.select("code", "date", (F.col("low") * 0.9).alias("stop"))).groupBy("code").agg(F.avg(F.col("shaken").cast("int").cast("double")).alias("rate"))
    out = out.withColumn("adjustment", analytics.range_adjustment(F.col("rate")))
    return out.withColumn("multiple", analytics.range_multiple(F.lit("squeeze_breakout"), F.col("adjustment")))


_DAYS = _PNL + ", days AS (SELECT close_date AS date, sum(pnl) / 1e8 AS pnl FROM p GROUP BY close_date)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of a day as shares of an account of a hundred million."""
    return _trades(spark, sf_dir).groupBy(F.col("close_date").alias("date")).agg((F.sum("pnl") / 1e8).alias("pnl"))


@query(
    "circuit_breaker",
    _DAYS
    + """, g AS (SELECT date, pnl AS daily, sum(pnl) OVER (PARTITION BY date_trunc('week', date) ORDER BY date) AS weekly, sum(pnl) OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS monthly, row_number() OVER (ORDER BY date) AS n FROM days),
h AS (SELECT *, n - coalesce(max(CASE WHEN daily >= 0 THEN n END) OVER (ORDER BY date), 0) AS losses FROM g)
SELECT date, round(daily, 6) AS daily, round(weekly, 6) AS weekly, round(monthly, 6) AS monthly, losses::INTEGER AS losses,
       concat_ws(';', CASE WHEN daily < -0.03 THEN 'daily' END, CASE WHEN weekly < -0.05 THEN 'weekly' END, CASE WHEN monthly < -0.10 THEN 'monthly' END, CASE WHEN losses >= 5 THEN 'losses' END) AS reasons,
       daily < -0.03 OR weekly < -0.05 OR monthly < -0.10 OR losses >= 5 AS triggered FROM h""",
    dates=("date",),
)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.circuit_breaker(analytics.running_gains(_days(spark, sf_dir)))


@query(
    "sector_multipliers",
    """v AS (SELECT sector, sum(cost) AS v FROM trades JOIN sectors USING (code) GROUP BY sector), h AS (SELECT sector, v / sum(v) OVER () AS share FROM v)
SELECT code, round(CASE WHEN share >= 0.2 THEN greatest(least(0.2 / share, 1), 0.1) ELSE 1 END, 6) AS multiplier FROM sectors LEFT JOIN h USING (sector)""",
)
def sector_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = market.sectors(spark, sf_dir)
    held = market.trades(spark, sf_dir).join(sectors, "code").select("sector", F.col("cost").alias("value"))
    return analytics.sector_multiplier(sectors.select("code", "sector"), held, 0.2).select("code", "multiplier")


@query(
    "live_performance",
    """c AS (SELECT i.date, i.close AS benchmark, avg(b.close) AS equity FROM idx i JOIN bars b ON i.date = b.date AND b.code % 2 = 0 GROUP BY i.date, i.close),
r AS (SELECT *, CASE WHEN lag(equity) OVER (ORDER BY date) > 0 THEN equity / lag(equity) OVER (ORDER BY date) - 1 END AS ret, CASE WHEN lag(benchmark) OVER (ORDER BY date) > 0 THEN benchmark / lag(benchmark) OVER (ORDER BY date) - 1 END AS bench, max(equity) OVER (ORDER BY date) AS peak FROM c),
a AS (SELECT last(equity ORDER BY date) / first(equity ORDER BY date) - 1 AS total_return, max(CASE WHEN peak > 0 THEN 1 - equity / peak ELSE 0 END) AS max_drawdown, covar_samp(ret, bench) / var_samp(bench) FILTER (ret IS NOT NULL AND bench IS NOT NULL) AS beta,
  avg(ret) FILTER (bench IS NOT NULL) AS mean, avg(bench) FILTER (ret IS NOT NULL) AS bench, corr(ret, bench) AS correlation, count(CASE WHEN round(ret, 4) <> 0 THEN 1 END) AS days, avg(CASE WHEN round(ret, 4) <> 0 THEN round(ret, 4) - 0.015 / 252 END) AS excess,
  sqrt(avg(CASE WHEN round(ret, 4) <> 0 THEN pow(least(round(ret, 4) - 0.015 / 252, 0), 2) END)) AS down FROM r)
SELECT round(total_return, 4) AS total_return, round(max_drawdown, 4) AS max_drawdown, round((mean - beta * bench) * 252, 4) AS alpha, round(beta, 4) AS beta, round(correlation, 4) AS correlation, round(coalesce(excess * sqrt(252) / nullif(down, 0), 0), 4) AS sortino,
       round(coalesce((pow(1 + total_return, 252 / days) - 1) / nullif(max_drawdown, 0), 0), 4) AS calmar FROM a""",
    digits=4,
)
def live_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean close of every second code as the equity, against the index of all."""
    frame = market.bars(spark, sf_dir)
    half = frame.filter("code % 2 = 0").groupBy("date").agg(F.avg("close").alias("equity"))
    return analytics.live_performance(half.join(market.index_bars(frame).select("date", F.col("close").alias("benchmark")), "date"))


@query(
    "rolling_alpha",
    _RET
    + """, m AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS mkt FROM idx), j AS (SELECT code, date, ret, mkt FROM ret JOIN m USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL),
a AS (SELECT code, date, count(*) OVER w AS n, avg(ret) OVER w - (0.015 / 252 + covar_samp(ret, mkt) OVER w / nullif(var_samp(mkt) OVER w, 0) * (avg(mkt) OVER w - 0.015 / 252)) AS daily FROM j WINDOW w AS (PARTITION BY code ORDER BY date ROWS 59 PRECEDING))
SELECT code, date, round(daily, 6) AS daily FROM a WHERE n >= 48 AND daily IS NOT NULL""",
    dates=("date",),
)
def rolling_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily alpha: a year of the tick prices' alphas is beyond what a double holds."""
    frame = market.bars(spark, sf_dir)
    return analytics.rolling_alpha(frame, market.index_bars(frame)).select("code", "date", "daily")

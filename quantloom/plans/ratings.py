"""Reports of the last day over the driver's tables, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import guard, levels, ratings, relative, signals
from quantloom.plans.features import _BROKERS, _NETS, _brokers, _institutions
from quantloom.plans.guard import _GROWTH, _GROWTH_SQL, _JUDGED, _growth
from quantloom.plans.patterns import _INSTITUTIONS
from quantloom.plans.queries import _FIB, _SIGNALS, _UPTREND, _W, _full, query
from quantloom.sources import market
from quantloom.sources.snapshots import snapshot

_LAST_20 = "OVER (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)"
_REPORT = f"""{_JUDGED}, {_FIB},
nr AS (SELECT code, max(price) FILTER (price < close) AS support, min(price) FILTER (price > close) AS resistance, min(price) FILTER (price >= close * 1.02::DOUBLE) AS resistance_far FROM swung JOIN (SELECT code, close FROM judged) USING (code) GROUP BY code),
rp0 AS (SELECT code, back, open, close, close / nullif(lag(close) {_W}, 0) - 1 AS ret, CASE WHEN back <= 252 THEN close END AS y, volume > coalesce(nullif(vol_5, 0), 1) AS busy, lag(macd - macd_signal, 2) {_W} AS hist_2,
  lag(close, 4) {_W} AS close_4, lag(volume, 4) {_W} AS volume_4, avg(close * volume) {_LAST_20} AS turnover, date FROM a0),
rp1 AS (SELECT *, {_full("stddev_samp(ret)", "ret", 20)} AS hv_20, {_full("stddev_samp(ret)", "ret", 60)} AS hv_60, max(y) {_W} AS peak_y, max(close) {_W} AS peak,
  count(CASE WHEN close > open AND busy THEN 1 END) {_LAST_20} AS up_bars, count(CASE WHEN close < open AND busy THEN 1 END) {_LAST_20} AS down_bars FROM rp0),
rp2 AS (SELECT code, back, hist_2, close_4, volume_4, turnover, peak, up_bars - down_bars AS more, coalesce(hv_20 * sqrt(252), 0) AS hv_20, coalesce(hv_60 * sqrt(252), 0) AS hv_60, min(y / nullif(peak_y, 0) - 1) {_W} AS max_drawdown FROM rp1),
rp3 AS (SELECT judged.* REPLACE (coalesce(adx, 0) AS adx, coalesce(rsi, 50) AS rsi), rp2.* EXCLUDE (code, back), support, resistance_far, coalesce(support, close * 0.93::DOUBLE) AS low_level, coalesce(resistance, close * 1.05::DOUBLE) AS high_level,
  CASE WHEN vol_5 > 0 AND vol_20 > 0 THEN vol_5 / vol_20 ELSE 1 END AS surge, coalesce(atr / nullif(close, 0), 0) AS range_pct FROM judged JOIN rp2 ON rp2.code = judged.code AND rp2.back = 1 LEFT JOIN nr ON nr.code = judged.code),
rp4 AS (SELECT *, CASE WHEN surge > 1.3 THEN 'rising' WHEN surge < 0.7 THEN 'shrinking' ELSE 'steady' END AS volume_trend, CASE WHEN more > 3 THEN 'accumulation' WHEN more < -3 THEN 'distribution' ELSE 'neutral' END AS accumulation,
  CASE WHEN range_pct > 0.04 THEN 'high' WHEN range_pct > 0.02 THEN 'middle' ELSE 'low' END AS volatility, coalesce(bb_width, 0) AS band_width, coalesce(bb_pct, 0.5) AS band_position, close / nullif(peak, 0) - 1 AS drawdown,
  greatest(0, CASE WHEN close > low_level THEN (high_level - close) / (close - low_level) ELSE 0 END) AS risk_reward, macd > macd_signal AND macd > 0 AS bull, macd < macd_signal AND macd < 0 AS bear FROM rp3),
report AS (SELECT *, list_filter([CASE WHEN bull AND coalesce(k, 0) < coalesce(d, 0) THEN 'macd_up_kd_down' END, CASE WHEN bear AND coalesce(k, 0) > coalesce(d, 0) THEN 'macd_down_kd_up' END, CASE WHEN bull AND macd - macd_signal < hist_2 THEN 'histogram_shrinks' END,
  CASE WHEN risk_reward < 0.5 THEN 'little_reward' END, CASE WHEN averages = 'bullish' AND rsi > 70 THEN 'overbought' END, CASE WHEN close > close_4 AND volume < volume_4 * 0.7 THEN 'rise_without_volume' END,
  CASE WHEN close < close_4 AND volume > volume_4 * 1.3 THEN 'fall_on_volume' END], lambda x: x IS NOT NULL) AS conflicts FROM rp4)"""


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each code against its swing points, built once a session."""

    def build() -> DataFrame:
        frame = market.bars(spark, sf_dir)
        return ratings.technical_report(frame, ratings.nearest_levels(frame, levels.swings(frame)))

    return snapshot(spark, "technical_report", sf_dir, build)


@query(
    "technical_reports",
    _REPORT
    + """ SELECT code, date, averages, trend, strength, momentum, volume_trend, accumulation, volatility, round(hv_20, 6) AS hv_20, round(hv_60, 6) AS hv_60, round(range_pct, 6) AS range_pct, round(band_width, 6) AS band_width, round(band_position, 6) AS band_position,
    round(max_drawdown, 6) AS max_drawdown, round(drawdown, 6) AS drawdown, round(risk_reward, 6) AS risk_reward, array_to_string(conflicts, ',') AS conflicts FROM report""",
    dates=("date",),
)
def technical_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = "code date averages trend strength momentum volume_trend accumulation volatility hv_20 hv_60 range_pct band_width band_position max_drawdown drawdown risk_reward".split()
    return report(spark, sf_dir).select(*shown, F.array_join("conflicts", ",").alias("conflicts"))


_TARGETS = f"""{_REPORT},
pt0 AS (SELECT code, any_value(direction) AS direction, max(level) FILTER (kind = 'extension' AND ratio = 1.272::DOUBLE) AS e1, max(level) FILTER (kind = 'extension' AND ratio = 1.618::DOUBLE) AS e2,
  max(level) FILTER (kind = 'retracement' AND ratio = 0.5::DOUBLE) AS r1, max(level) FILTER (kind = 'retracement' AND ratio = 0.786::DOUBLE) AS r2 FROM fib GROUP BY code),
pt1 AS (SELECT *, sqrt(days / 14.0::DOUBLE) AS scale, trend IN ('strong_up', 'up') AS rises, CASE WHEN timeframe = '1Y' THEN coalesce(e2, close * 1.25::DOUBLE) ELSE coalesce(e1, close * 1.15::DOUBLE) END AS e,
  coalesce(CASE WHEN direction = 'uptrend' THEN CASE WHEN timeframe = '1Y' THEN r2 ELSE r1 END END, close * 0.85::DOUBLE) AS r FROM report LEFT JOIN pt0 USING (code), (VALUES ('3M', 63), ('6M', 126), ('1Y', 252)) v(timeframe, days)),
pt2 AS (SELECT *, CASE WHEN e < close * 1.01::DOUBLE THEN close * (1 + range_pct * CASE WHEN rises AND adx > 25 THEN 1.5::DOUBLE ELSE 1 END * scale) ELSE e END AS ee FROM pt1),
pt3 AS (SELECT *, least(ee * 0.4::DOUBLE + close * (1 + range_pct * 2 * scale) * 0.3::DOUBLE + coalesce(resistance_far, close * 1.05::DOUBLE) * 0.3::DOUBLE, close * 2) AS hi, greatest(r * 0.4::DOUBLE + close * (1 - range_pct * 2 * scale) * 0.3::DOUBLE + low_level * 0.3::DOUBLE, close * 0.5::DOUBLE) AS lo,
  CASE WHEN rises AND adx > 25 THEN 0.6 WHEN rises THEN 0.55 WHEN trend IN ('strong_down', 'down') THEN 0.4 ELSE 0.5 END::DOUBLE AS share FROM pt2),
pt4 AS (SELECT *, greatest(hi, lo) AS t, least(hi, lo) AS b, hi * share + lo * (1 - share) AS m0 FROM pt3),
pt5 AS (SELECT *, CASE WHEN m0 > t THEN t * 0.95::DOUBLE ELSE m0 END AS m1 FROM pt4), pt6 AS (SELECT *, CASE WHEN m1 < b THEN b * 1.05::DOUBLE ELSE m1 END AS m FROM pt5),
targets AS (SELECT code, timeframe, scenario, target, target / nullif(close, 0) - 1 AS upside, CASE WHEN scenario <> 'base' THEN 'middle' WHEN adx > 25 THEN 'high' WHEN adx > 18 THEN 'middle' ELSE 'low' END AS confidence
  FROM (SELECT code, timeframe, close, adx, 'bull' AS scenario, t AS target FROM pt6 UNION ALL SELECT code, timeframe, close, adx, 'base', m FROM pt6 UNION ALL SELECT code, timeframe, close, adx, 'bear', b FROM pt6))"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    return ratings.price_targets(report(spark, sf_dir), levels.retracements(frame, levels.swings(frame)))


@query("price_targets", _TARGETS + " SELECT code, timeframe, scenario, round(target, 6) AS target, round(upside, 6) AS upside, confidence FROM targets")
def price_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without analysts, of whom the tables know nothing."""
    return targets(spark, sf_dir)


_NAMES = "['" + "', '".join(ratings.RATINGS) + "']"
#: Code, condition and highest level of each gate after the first.
_GATES = (("institutions_sell", "visibility <> 'ghost_town' AND inst < -2", 2), ("bear_market", "regime = 'bear'", 3), ("conflict", "n > 0", 3), ("overbought", "rsi > 70", 3))
_GATED = ",\n".join(
    f"""gt{i + 1} AS (SELECT * REPLACE (CASE WHEN coalesce({holds}, false) AND l > {cap} THEN {cap} ELSE l END AS l, CASE WHEN coalesce({holds}, false) AND l > {cap} THEN list_append(trace, '{code}:' || {_NAMES}[l + 1] || '>' || {_NAMES}[{cap + 1}]) ELSE trace END AS trace) FROM gt{i})"""
    for i, (code, holds, cap) in enumerate(_GATES)
)


@query(
    "overall_ratings",
    f"""{_TARGETS}, {_NETS}, {_GROWTH}, {_UPTREND}, {_SIGNALS}, inst AS (WITH {_INSTITUTIONS}),
rg AS (SELECT date, CASE WHEN close > fast AND fast > slow THEN 'bull' WHEN close < fast AND fast < slow THEN 'bear' ELSE 'sideways' END AS regime FROM (SELECT date, close, CASE WHEN count(*) OVER f >= 20 THEN avg(close) OVER f END AS fast, CASE WHEN count(*) OVER s >= 60 THEN avg(close) OVER s END AS slow FROM idx
  WINDOW f AS (ORDER BY date ROWS 19 PRECEDING), s AS (ORDER BY date ROWS 59 PRECEDING))),
ov0 AS (SELECT report.code, report.date, report.trend, report.momentum, report.rsi, risk_reward, turnover, len(conflicts) AS n, coalesce(upside, 0) AS up, CASE WHEN kind = 'exit' THEN -2 WHEN kind IS NOT NULL THEN 2 ELSE 0 END AS points, regime, coalesce(inst.score, 0) AS inst, visibility,
  (SELECT {_GROWTH_SQL.replace("yoy", "revenue_yoy")}::DOUBLE) AS growth FROM report LEFT JOIN targets t ON t.code = report.code AND timeframe = '3M' AND scenario = 'base' LEFT JOIN ts ON ts.code = report.code AND ts.date = report.date LEFT JOIN rg ON rg.date = report.date LEFT JOIN inst ON inst.code = report.code
  LEFT JOIN sectors ON sectors.code = report.code LEFT JOIN gy ON gy.industry = sectors.industry AND gy.back = 1),
ov1 AS (SELECT *, (CASE trend WHEN 'strong_up' THEN 2 WHEN 'up' THEN 1 WHEN 'down' THEN -1 WHEN 'strong_down' THEN -2 ELSE 0 END + points + CASE momentum WHEN 'strong_bull' THEN 2 WHEN 'bull' THEN 1 WHEN 'bear' THEN -1 WHEN 'strong_bear' THEN -2 ELSE 0 END
  + CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END + CASE WHEN risk_reward > 2 THEN 1 WHEN risk_reward < 0.3 THEN -3 WHEN risk_reward < 0.5 THEN -2 WHEN risk_reward < 0.8 THEN -1 ELSE 0 END - least(n * 0.5, 2))::DOUBLE AS tech,
  (growth - 50) / 10 * 0.4::DOUBLE + CASE WHEN up > 0.1 THEN 2 WHEN up > 0.05 THEN 1 WHEN up < -0.05 THEN -2 WHEN up < 0 THEN -1 ELSE 0 END AS fund FROM ov0),
ov2 AS (SELECT *, tech + fund + inst * 0.25::DOUBLE * 4 AS score FROM ov1),
ov3 AS (SELECT *, ((score >= -4)::INTEGER + (score >= -1)::INTEGER + (score >= 3)::INTEGER + (score >= 6)::INTEGER) AS l0, visibility = 'ghost_town' AND turnover < 10000000 AS ghost FROM ov2),
gt0 AS (SELECT *, CASE WHEN ghost THEN greatest(l0 - 1, 0) ELSE l0 END AS l, CASE WHEN ghost THEN ['ghost_town:' || {_NAMES}[l0 + 1] || '>' || {_NAMES}[greatest(l0 - 1, 0) + 1]] ELSE []::VARCHAR[] END AS trace FROM ov3),
{_GATED}
SELECT code, date, round(tech, 9) AS tech, round(fund, 9) AS fund, round(inst, 9) AS inst, round(score, 9) AS score, {_NAMES}[l0 + 1] AS raw_rating, {_NAMES}[l + 1] AS rating, array_to_string(trace, ';') AS overrides FROM gt{len(_GATES)}""",
    digits=9,
    dates=("date",),
)
def overall_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the report, the base target of three months, the last trend signal, institutions, the industry's growth and the market's regime.

    Growth of 0 to 95 points counts as (points - 50) / 10; the tables know no composite of the older strategy and no cash.
    """
    frame = market.bars(spark, sf_dir)
    base = targets(spark, sf_dir).filter("timeframe = '3M' AND scenario = 'base'").select("code", "upside")
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    said = signals.trend_signals(frame, min_days=2, min_adx=5.0, min_volume=10.0).withColumn("_n", last).filter("_n = 1").select("code", "signal")
    sectors = market.sectors(spark, sf_dir)
    inst = signals.institution_score(_institutions(spark, sf_dir), sectors).select("code", F.col("score").alias("inst_score"), "visibility")
    grown = sectors.join(_growth(spark, sf_dir), "industry", "left").select("code", ((guard.growth_score(F.col("revenue_yoy")) - 50) / 10).alias("fundamental"))
    rows = report(spark, sf_dir).join(relative.regime(market.index_bars(frame)).select("date", "regime"), "date", "left")
    for other in (base, said, inst, grown):
        rows = rows.join(other, "code", "left")
    unknown = {"composite": F.lit(None).cast("double"), "biotech": F.lit(False), "runway": F.lit(None).cast("double"), "total_runway": F.lit(None).cast("double")}
    out = ratings.overall_rating(rows.withColumns(unknown))
    trace = F.array_join(F.transform("overrides", lambda x: F.concat(x["code"], F.lit(":"), x["before"], F.lit(">"), x["after"])), ";")
    return out.select("code", "date", "tech", "fund", "inst", "score", "raw_rating", "rating", trace.alias("overrides"))


@query(
    "broker_reversals",
    f"""{_BROKERS}, br0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM brokers),
br1 AS (SELECT code, max(date) AS date, max(streak) FILTER (back = 1) AS streak, max(purity) FILTER (back = 1) AS purity, max(net_momentum_5d) FILTER (back = 1) AS momentum, max(net_buy_ratio) FILTER (back = 1) AS ratio,
  count(purity) AS n, avg(purity) AS mean, stddev_samp(purity) AS sd, arg_max(purity, date) AS current FROM br0 WHERE back <= 20 GROUP BY code),
br2 AS (SELECT *, greatest(0, least(100, streak * 10)) * 0.3::DOUBLE + greatest(0, least(100, purity)) * 0.25::DOUBLE + greatest(0, least(100, (momentum + 1) * 50)) * 0.25::DOUBLE + greatest(0, least(100, ratio * 100)) * 0.2::DOUBLE AS feature,
  CASE WHEN n >= 5 THEN CASE WHEN sd > 1e-9 * abs(mean) THEN (current - mean) / sd ELSE 0 END END AS z FROM br1),
br3 AS (SELECT *, coalesce(streak >= 3 AND z > 0.6, false) AS accumulates FROM br2)
SELECT code, date, streak, round(feature, 9) AS feature_score, round(z, 9) AS purity_z, accumulates, round(CASE WHEN n >= 5 THEN (CASE WHEN streak > 0 THEN least(1, streak / 6.0::DOUBLE) ELSE 0 END * 0.5 + greatest(0, least(1, z / 2)) * 0.5) * 100 ELSE 0 END::DOUBLE, 9) AS confidence,
  round(least(100, feature + CASE WHEN accumulates THEN 15 ELSE 0 END), 9) AS score FROM br3""",
    digits=9,
    dates=("date",),
)
def broker_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.broker_reversal(_brokers(spark, sf_dir))

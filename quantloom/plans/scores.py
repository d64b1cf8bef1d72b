"""Scores of the trend signals of all codes and days, from the operators that know their parts, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, last_rows, numbered
from quantloom.operators import analytics, guard, indicators, joins, matching, relative, risk, scores, signals
from quantloom.plans.features import _NETS, _institutions
from quantloom.plans.guard import _GROWTH_SQL
from quantloom.plans.patterns import _INSTITUTIONS
from quantloom.plans.queries import _MOVING, _RET, _SCAN, _TREND, _W, query
from quantloom.plans.trading import _HEAT_STEPS, _MOMENTUM, _TRADED, line_trades, sector_scans
from quantloom.sources import market
from quantloom.sources.snapshots import snapshot
from quantloom.streaming import heat

HORIZONS = (1, 3, 5, 10, 20)
_AHEAD = ", ".join(f"lead(close, {n}) {_W} / nullif(close, 0) - 1 AS d{n}" for n in HORIZONS)
_NEXT_5 = "OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
_PAST = "OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING)"
_SCORED = f"""{_MOVING}, {_TREND}, {_NETS},
sq0 AS (SELECT code, date, coalesce(kind <> 'exit', false) AS buy, uptrend_days, vol_5, {_AHEAD}, max(high) {_NEXT_5} / nullif(close, 0) - 1 AS gain_5, min(low) {_NEXT_5} / nullif(close, 0) - 1 AS loss_5 FROM ts),
sq1 AS (SELECT *, avg(CASE WHEN buy THEN d20 END) {_PAST} AS ev, count(CASE WHEN buy THEN d20 END) {_PAST} AS cases FROM sq0),
sqr AS (SELECT date, CASE WHEN close > fast AND fast > slow THEN 'bull' WHEN close < fast AND fast < slow THEN 'bear' ELSE 'sideways' END AS regime FROM (SELECT date, close, CASE WHEN count(*) OVER f >= 20 THEN avg(close) OVER f END AS fast, CASE WHEN count(*) OVER s >= 60 THEN avg(close) OVER s END AS slow FROM idx
  WINDOW f AS (ORDER BY date ROWS 19 PRECEDING), s AS (ORDER BY date ROWS 59 PRECEDING))),
sqn AS (SELECT code, date, CASE WHEN count(*) OVER w >= 3 THEN sum(total_net) OVER w END AS net_5 FROM nets WINDOW w AS (PARTITION BY code ORDER BY date ROWS 4 PRECEDING)),
sqh AS (WITH {_HEAT_STEPS} SELECT sector, ts, heat, {_MOMENTUM} AS momentum FROM hb),
sqf AS (SELECT industry, available_date, (revenue / nullif(lag(revenue, 4) OVER (PARTITION BY industry ORDER BY quarter_end), 0) - 1) * 100 AS yoy FROM fundamentals),
sq2 AS (SELECT sq1.*, sector, industry, regime, net_5 / nullif(vol_5 * 5, 0) AS inst_ratio FROM sq1 LEFT JOIN sectors USING (code) LEFT JOIN sqr ON sqr.date = sq1.date LEFT JOIN sqn ON sqn.code = sq1.code AND sqn.date = sq1.date WHERE buy),
sq3 AS (SELECT sq2.*, heat, momentum FROM sq2 LEFT JOIN sqh ON sqh.sector = sq2.sector AND sqh.ts = date_trunc('month', sq2.date)::DATE - INTERVAL 1 MONTH),
sq4 AS (SELECT sq3.*, yoy FROM sq3 ASOF LEFT JOIN sqf ON sqf.industry = sq3.industry AND sq3.date >= sqf.available_date),
sq5 AS (SELECT *, CASE regime WHEN 'bull' THEN 95 WHEN 'sideways' THEN 45 WHEN 'bear' THEN 20 ELSE 50 END AS re,
  CASE WHEN ev IS NULL OR cases < 3 THEN 40 ELSE CASE WHEN ev - 0.005855::DOUBLE >= 0.03 THEN 100 WHEN ev - 0.005855::DOUBLE >= 0 THEN 50 + (ev - 0.005855::DOUBLE) / 0.03::DOUBLE * 50 WHEN ev - 0.005855::DOUBLE >= -0.02 THEN greatest(0, 50 + (ev - 0.005855::DOUBLE) / 0.02::DOUBLE * 50) ELSE 0 END * least(1, cases / 20) + 40 * (1 - least(1, cases / 20)) END AS e,
  CASE WHEN heat IS NULL THEN 50 ELSE greatest(0, least(100, least(70, heat * 100) + CASE momentum WHEN 'surge' THEN 30 WHEN 'heating' THEN 20 WHEN 'cooling' THEN -20 ELSE 0 END)) END AS he, CASE WHEN uptrend_days > 15 THEN 95 WHEN uptrend_days > 7 THEN 70 ELSE 30 END AS ma,
  CASE WHEN inst_ratio IS NULL THEN 50 WHEN inst_ratio >= 0.2 THEN 95 WHEN inst_ratio >= 0 THEN 50 + inst_ratio / 0.2::DOUBLE * 45 WHEN inst_ratio >= -0.2 THEN greatest(10, 50 + inst_ratio / 0.2::DOUBLE * 40) ELSE 10 END AS ins, {_GROWTH_SQL} AS gr FROM sq4),
sq6 AS (SELECT *, (CASE WHEN yoy IS NOT NULL THEN ins * 0.2::DOUBLE + gr * 0.15::DOUBLE + 50 * 0.15::DOUBLE + 50 * 0.1::DOUBLE + re * 0.1::DOUBLE + e * 0.1::DOUBLE + he * 0.1::DOUBLE + ma * 0.1::DOUBLE
  ELSE 50 * 0.25::DOUBLE + re * 0.2::DOUBLE + e * 0.15::DOUBLE + he * 0.1::DOUBLE + ma * 0.1::DOUBLE + ins * 0.2::DOUBLE END)::DOUBLE AS sqs FROM sq5),
scored AS (SELECT *, CASE WHEN sqs >= 80 THEN 'diamond' WHEN sqs >= 60 THEN 'gold' WHEN sqs >= 40 THEN 'silver' ELSE 'noise' END AS grade FROM sq6)"""


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each BUY bar with what guard.signal_quality() reads; nothing is known of a code's fitness and valuation.

    Heat and momentum are those of the sector's scan of the month before, growth is that of the last statement known on the
    day, ev comes from the code's earlier signals, net buying is that of five days over their volume.
    """
    frame = market.bars(spark, sf_dir)
    # What comes after a bar is looked up beside its windows, and only BUY bars, which are few, are shuffled again.
    after = (*(f"d{n}" for n in HORIZONS), "gain_5", "loss_5")
    ahead = numbered(relative.forward_returns(frame, HORIZONS, keep=("open", "high", "low", "close", "volume")))
    rows = signals.trend_signals(ahead, min_days=2, min_adx=5.0, min_volume=10.0, keep=("uptrend_days", "vol_5", "_row", *after)).filter("signal = 'BUY'")
    rows = scores.past_value(rows.select("code", "date", "signal", "uptrend_days", "vol_5", "_row", *after), number="_row").drop("_row")
    w = last_rows(5)
    nets = _institutions(spark, sf_dir).select("code", "date", F.when(F.count(F.lit(1)).over(w) >= 3, F.sum("total_net").over(w)).alias("net_5"))
    sectors = market.sectors(spark, sf_dir)
    scans = heat.heat_changes(sector_scans(spark, sf_dir)).select("sector", F.add_months(F.to_date("ts"), 1).alias("month"), "heat", "momentum")
    rows = rows.join(sectors, "code", "left").withColumn("month", F.trunc("date", "MM").cast("date")).join(scans, ["sector", "month"], "left")
    rows = rows.join(nets, ["code", "date"], "left").join(relative.regime(market.index_bars(frame)).select("date", "regime"), "date", "left")
    grown = market.fundamentals(spark, sf_dir)
    yoy = (F.try_divide("revenue", F.lag("revenue", 4).over(Window.partitionBy("industry").orderBy("quarter_end"))) - 1) * 100
    grown = grown.withColumn("yoy", yoy).join(sectors.select("code", "industry"), "industry").select("code", "available_date", "yoy")
    rows = joins.as_of(rows, grown, "code", "date", "available_date")
    maturity = F.when(F.col("uptrend_days") > 15, "Structural Shift").when(F.col("uptrend_days") > 7, "Trend Formation").otherwise("Speculative Spike")
    unknown = {"fitness": F.lit(None).cast("string"), "valuation": F.lit(None).cast("double")}
    return rows.withColumns(unknown | {"strategy": F.lit("V4"), "maturity": maturity, "inst_ratio": F.try_divide("net_5", F.col("vol_5") * 5)})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All BUY bars with their scores and what came after them, built once a session."""
    names = ["code", "date", "regime", "sqs", "grade", *(f"d{n}" for n in HORIZONS), "gain_5", "loss_5"]
    return snapshot(spark, "scored_signals", sf_dir, lambda: guard.signal_quality(_inputs(spark, sf_dir)).select(*names))


@query("signal_quality", f"{_SCORED} SELECT code, date, regime, round(sqs, 9) AS sqs, grade FROM scored", digits=9, dates=("date",))
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("code", "date", "regime", "sqs", "grade")


_NAMED = """sg AS (SELECT *, unnest(list_filter(['all', CASE WHEN sqs >= 40 THEN 'sqs_40' END, CASE WHEN sqs >= 60 THEN 'sqs_60' END, CASE WHEN sqs >= 80 THEN 'sqs_80' END, 'grade_' || grade, 'regime_' || regime], lambda x: x IS NOT NULL)) AS "group" FROM scored),
so AS (SELECT "group", count(*) AS signals, count(d5) AS count_5, count(d20) AS count_20, avg((d5 > 0)::INTEGER) AS win_rate_5, avg((d20 > 0)::INTEGER) AS win_rate_20, avg(d5) AS return_5, avg(d20) AS return_20, avg(gain_5) AS gain_5, avg(loss_5) AS loss_5,
  sum(d5) FILTER (d5 > 0) / nullif(abs(sum(d5) FILTER (d5 <= 0)), 0) AS profit_factor FROM sg GROUP BY "group")"""


@query(
    "score_groups",
    f"""{_SCORED}, {_NAMED}
SELECT so."group", so.signals, so.count_5, so.count_20, round(so.win_rate_5, 6) AS win_rate_5, round(so.win_rate_20, 6) AS win_rate_20, round(so.return_5, 6) AS return_5, round(so.return_20, 6) AS return_20, round(so.return_5 - 0.005855::DOUBLE, 6) AS net_5, round(so.return_20 - 0.005855::DOUBLE, 6) AS net_20,
  round(so.gain_5, 6) AS gain_5, round(so.loss_5, 6) AS loss_5, round(so.profit_factor, 6) AS profit_factor, round(so.signals / a.signals, 6) AS share, round(so.win_rate_5 - a.win_rate_5, 6) AS lift_win_rate, round(so.return_5 - a.return_5, 6) AS lift_return FROM so, so a WHERE a."group" = 'all'""",
)
def score_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.score_groups(scored(spark, sf_dir))


@query(
    "score_summary",
    f"""{_SCORED} SELECT count(*) AS signals, round(min(sqs), 6) AS low, round(max(sqs), 6) AS high, round(avg(sqs), 6) AS mean, round(quantile_cont(sqs, 0.1), 6) AS p10, round(quantile_cont(sqs, 0.25), 6) AS p25, round(median(sqs), 6) AS median, round(quantile_cont(sqs, 0.75), 6) AS p75, round(quantile_cont(sqs, 0.9), 6) AS p90,
  {" || ',' || ".join(f"count(*) FILTER (least(floor(sqs / 10), 9) = {i})" for i in range(10))} AS histogram FROM scored""",
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.score_summary(scored(spark, sf_dir))


@query(
    "score_periods",
    f"""{_SCORED}, sp AS ({" UNION ALL ".join(f"SELECT grade, {n}::INTEGER AS days, d{n} AS ret FROM scored" for n in HORIZONS)})
SELECT grade, days, count(*) AS count, round(avg((ret > 0)::INTEGER), 6) AS win_rate, round(avg(ret), 6) AS avg_return, round(avg(ret) - 0.005855::DOUBLE, 6) AS net_return, round(median(ret), 6) AS median_return, round(max(ret), 6) AS best, round(min(ret), 6) AS worst FROM sp WHERE ret IS NOT NULL GROUP BY grade, days""",
)
def score_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.period_metrics(scored(spark, sf_dir), HORIZONS)


@query(
    "score_curve",
    f"""{_SCORED} SELECT code, date, round(sqs, 6) AS sqs, grade, round(d5, 6) AS ret, round(d5 - 0.005855::DOUBLE, 6) AS net, round(sum(d5 - 0.005855::DOUBLE) OVER (ORDER BY date, code ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM scored WHERE d5 IS NOT NULL""",
    dates=("date",),
)
def score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.cumulative_curve(scored(spark, sf_dir))


@query(
    "priorities",
    f"""{_SCORED}, {_SCAN}, pl AS (WITH {_TRADED} SELECT DISTINCT code FROM lm WHERE exit_date IS NULL AND quantity > 0),
pq AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
pa AS (SELECT code, rating, rs_ratio / nullif(quantile_cont(rs_ratio, 0.5) OVER (PARTITION BY sector), 0) AS peer_alpha FROM scan JOIN sectors USING (code)),
pr AS (SELECT pq.code, pq.date, sqs, rating, peer_alpha, pl.code IS NOT NULL AS is_live FROM pq LEFT JOIN pa ON pa.code = pq.code LEFT JOIN pl ON pl.code = pq.code)
SELECT code, date, is_live, round((0.3::DOUBLE * greatest(0, least(100, coalesce(rating, 50))) + 0.25::DOUBLE * greatest(0, least(100, sqs)) + 0.2::DOUBLE * 0 + 0.15::DOUBLE * greatest(0, least(100, (coalesce(peer_alpha, 1) - 0.5) * 40)) + 0.1::DOUBLE * 50)::DOUBLE, 9) AS priority,
  CASE WHEN is_live THEN 'held' WHEN date = (SELECT max(date) FROM bars) THEN 'new' ELSE 'watch' END AS action FROM pr""",
    digits=9,
    dates=("date",),
)
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code's last signal by its score, the code's strength and that against its sector; live where items are held. Phases of accumulation and liquidity are left unknown, since folds are beyond SQL."""
    frame, sectors = market.bars(spark, sf_dir), market.sectors(spark, sf_dir)
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    rows = scored(spark, sf_dir).withColumn("_n", last).filter("_n = 1").select("code", "date", F.col("sqs").alias("quality"))
    scan = relative.strength_scan(frame)
    rows = rows.join(scan.select("code", F.col("rating").alias("strength")), "code", "left").join(relative.peer_alpha(scan, sectors).select("code", "peer_alpha"), "code", "left")
    held = matching.fifo(line_trades(spark, sf_dir)).filter("exit_date IS NULL AND quantity > 0").select("code").distinct().withColumn("is_live", F.lit(True))
    unknown = {"phase": F.lit("NONE"), "liquidity": F.lit(None).cast("double"), "trailing_phase": F.lit(0)}
    rows = rows.join(held, "code", "left").withColumns(unknown | {"is_live": F.coalesce("is_live", F.lit(False))})
    today = frame.agg(F.max("date").alias("today"))
    rows = guard.priority(rows).join(F.broadcast(today))  # One row.
    return rows.select("code", "date", "is_live", "priority", scores.action_tag(F.col("today")).alias("action"))


#: More than any date's number.
_BUY = 1 << 40


@query(
    "sector_heat",
    f"""{_MOVING}, {_TREND}, {_NETS}, hi AS (WITH {_INSTITUTIONS}),
l AS (SELECT ts.code, industry, sector, kind IS NOT NULL AND kind <> 'exit' AS buy, CASE WHEN uptrend_days > 15 THEN 2.0 WHEN uptrend_days > 7 THEN 1.5 ELSE 1 END AS weight, vol_ratio, uptrend_days, hi.score AS inst FROM ts JOIN sectors USING (code) LEFT JOIN hi ON hi.code = ts.code
  WHERE sma_60 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts.code ORDER BY (kind IS NOT NULL AND kind <> 'exit')::INTEGER DESC, ts.date DESC) = 1),
s AS (SELECT *, CASE WHEN buy THEN round((weight - 1) * 0.4 + greatest(least((inst + 5) / 10, 1), 0) * 0.4 + coalesce(greatest(least(vol_ratio - 1, 1), 0), 0) * 0.2, 3) END AS score FROM l),
g AS (SELECT sector, industry, count(*) AS codes, count(CASE WHEN buy THEN 1 END) AS buys, sum(CASE WHEN buy THEN weight ELSE 0 END) AS wh, coalesce(avg(CASE WHEN buy AND vol_ratio > 0 THEN vol_ratio END), 0) AS av,
  first(code ORDER BY score DESC, uptrend_days DESC, code) FILTER (score > 0.6) AS leader, max(score) FILTER (score > 0.6) AS leader_score FROM s GROUP BY GROUPING SETS ((sector), (sector, industry)))
SELECT sector, industry, codes, buys, round(buys / codes, 6) AS heat, round((wh / codes)::DOUBLE, 6) AS weighted_heat, round(av, 6) AS avg_buy_volume, leader, leader_score FROM g""",
)
def sector_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code's latest BUY bar, or its latest bar without one; maturity by the length of the uptrend, institutions by their score."""
    sectors = market.sectors(spark, sf_dir)
    rows = signals.trend_signals(market.bars(spark, sf_dir), min_days=2, min_adx=5.0, min_volume=10.0, keep=("sma_60", "vol_ratio", "uptrend_days")).filter("sma_60 IS NOT NULL")
    # The order in one number, so that a code's bars are added up before they are shuffled: its BUY bars are above all others.
    buy = F.when(F.col("signal") == "BUY", _BUY).otherwise(0)
    rows = rows.withColumn("_at", buy + F.unix_date("date")).groupBy("code").agg(F.max("_at").alias("_at"), *(F.max_by(c, "_at").alias(c) for c in ("vol_ratio", "uptrend_days")))
    rows = rows.withColumn("signal", F.when(F.col("_at") > _BUY // 2, "BUY").otherwise("HOLD")).drop("_at").join(sectors, "code")
    inst = signals.institution_score(_institutions(spark, sf_dir), sectors).select("code", F.col("score").alias("inst_score"))
    maturity = F.when(F.col("uptrend_days") > 15, "Structural Shift").when(F.col("uptrend_days") > 7, "Trend Formation").otherwise("Speculative Spike")
    return guard.sector_heat(rows.join(inst, "code", "left").withColumn("maturity", maturity))


#: What sizes of positions read, as c.
_CANDIDATES = f"""{_MOVING}, {_RET}, {_NETS},
ca0 AS (SELECT code, last(close ORDER BY date) / 10000 AS price, stddev_samp(ret) AS sd FROM ret GROUP BY code),
ca1 AS (SELECT code, greatest(0, sum(total_net) OVER (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)) AS held FROM nets QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
ca2 AS (SELECT code, regr_slope(ret, mkt) AS beta, regr_r2(ret, mkt) AS r2 FROM ret JOIN (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS mkt FROM idx) USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY code),
ca3 AS (SELECT code, coalesce(sma_20 > sma_60, false) AS trending FROM mv QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
ca4 AS (WITH {_SCORED} SELECT code, sqs FROM scored QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
c AS (SELECT ca0.*, coalesce(held, 0) * price * 1.65::DOUBLE * coalesce(sd, 0.02) / 1e6 AS current_var, CASE WHEN beta > 0 THEN sqrt(r2) ELSE 0 END AS max_corr, coalesce(beta, 1) AS beta, coalesce(sqs / 100, 0.5) AS confidence, trending
  FROM ca0 LEFT JOIN ca1 USING (code) LEFT JOIN ca2 USING (code) LEFT JOIN ca3 USING (code) LEFT JOIN ca4 USING (code))"""


def _prices(frame: DataFrame) -> DataFrame:
    """code, price (a ten-thousandth of the last close) and sd of its returns."""
    return frame.withColumn("ret", change("close")).groupBy("code").agg((F.max_by("close", "date") / 10000).alias("price"), F.stddev_samp("ret").alias("sd"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code at a ten-thousandth of its last close. What institutions bought in 20 days is the position held; correlation is that
    with the index of all codes, the portfolio; confidence is the score of the last signal, a half where there was none."""
    frame = market.bars(spark, sf_dir)
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    rows = _prices(frame)
    held = _institutions(spark, sf_dir).withColumns({"held": F.greatest(F.lit(0.0), F.sum("total_net").over(last_rows(20))), "_back": back}).filter("_back = 1").select("code", "held")
    market_side = risk.alpha_beta(frame, market.index_bars(frame)).select("code", "beta", F.when(F.col("beta") > 0, F.sqrt("r2")).otherwise(0.0).alias("max_corr"))
    trending = indicators.moving(frame).withColumn("_back", back).filter("_back = 1").select("code", F.coalesce(F.col("sma_20") > F.col("sma_60"), F.lit(False)).alias("trending"))
    sure = scored(spark, sf_dir).groupBy("code").agg((F.max_by("sqs", "date") / 100).alias("confidence"))
    for other in (held, market_side, trending, sure):
        rows = rows.join(other, "code", "left")
    var = F.coalesce("held", F.lit(0.0)) * F.col("price") * 1.65 * F.coalesce("sd", F.lit(0.02)) / 1e6
    return rows.withColumns({"current_var": var, "max_corr": F.coalesce("max_corr", F.lit(0.0)), "beta": F.coalesce("beta", F.lit(1.0)), "confidence": F.coalesce("confidence", F.lit(0.5))})


@query(
    "position_sizes",
    _CANDIDATES
    + """, e AS (SELECT *, greatest(1, floor(1e6 * 0.2 / (price * 1000))) AS by_size, 1.65 * coalesce(sd, 0.02) * price * 1000 / 1e6 AS each, 0.02 - current_var AS budget FROM c),
l AS (SELECT *, CASE WHEN budget > 0 THEN greatest(1, floor(least(by_size, CASE WHEN each > 0 THEN greatest(1, floor(budget / each)) ELSE by_size END) * CASE WHEN max_corr > 0.75 THEN 0.5 WHEN max_corr > 0.5 THEN 0.75 ELSE 1 END
    * CASE WHEN beta > 1.5 THEN 0.7 WHEN beta > 1.2 THEN 0.85 ELSE 1 END * (0.5 + 0.5 * least(confidence, 1)))) ELSE 0 END::BIGINT AS lots FROM e)
SELECT code, lots, round(current_var + lots * each, 6) AS projected_var FROM l""",
)
def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.position_size(_candidates(spark, sf_dir)).select("code", F.col("lots").cast("long").alias("lots"), "projected_var")


@query(
    "equal_risk_sizes",
    _CANDIDATES
    + """, s AS (SELECT *, greatest(least(0.03 / 0.07 * CASE WHEN trending OR coalesce(sd, 0) <= 0 THEN 1 ELSE least(1, 0.018 / sd) END, 0.9), 0.05) AS share FROM c), w AS (SELECT *, floor(50000 * share / price / 1000) * 1000 AS whole FROM s),
f AS (SELECT *, whole < 1000 AND 50000 >= price * 1000 * 1.01 AS over_risk FROM w), g AS (SELECT *, CASE WHEN over_risk THEN 1000 WHEN whole < 1000 THEN 0 ELSE whole END::BIGINT AS shares FROM f)
SELECT code, over_risk, shares, round(CASE WHEN over_risk THEN shares * price / 50000 ELSE share END, 6) AS position_pct FROM g""",
)
def equal_risk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumns({"atr_pct": F.coalesce("sd", F.lit(0.0)), "stop_pct": F.lit(0.07)})
    return analytics.equal_risk_size(rows, 50_000.0).select("code", "over_risk", "shares", "position_pct")


@query(
    "scenarios",
    _CANDIDATES
    + """, s(scenario, shock, vol) AS (VALUES ('pullback', -0.03, 1.0), ('decline', -0.05, 1.3), ('crash', -0.10, 2.0), ('black_swan', -0.20, 3.0)), b AS (SELECT price * 1000 AS value, greatest(least(coalesce(sd / 0.01, 1), 2.5), 0.5) AS beta FROM c)
SELECT scenario, round(sum(value * shock * beta), 4) AS loss, count(CASE WHEN abs(shock * beta) > 0.05 THEN 1 END) AS at_risk, round((any_value(vol) * 0.02)::DOUBLE, 6) AS stressed_var, round(sum(value * shock * beta) / 1e6, 4) AS loss_pct FROM b, s GROUP BY scenario""",
    digits=4,
)
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the candidates only value and deviation count; what else is known of them is joined a row a code, which changes neither."""
    return analytics.scenarios(_prices(market.bars(spark, sf_dir)).withColumn("value", F.col("price") * 1000), 1e6, 0.02)

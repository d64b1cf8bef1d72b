"""Feature families over the driver's tables, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import history
from quantloom.operators import features, indicators, relative
from quantloom.plans.queries import _MOVING, _RET, _SCAN, _W, _full, query
from quantloom.plans.winners import _WINNERS, winners
from quantloom.sources import market


def _rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"


#: RSI by span and by alpha from the second bar on, MACD histogram, exponential mean of absolute returns.
_EWM = f"""e0 AS (SELECT code, date, close, row_number() {_W} AS i, greatest(close - lag(close) {_W}, 0) AS gain, greatest(lag(close) {_W} - close, 0) AS loss, abs(close / nullif(lag(close) {_W}, 0) - 1) AS move FROM bars),
e1 AS (
  SELECT a.code, a.date, a.i, any_value(a.close) AS close,
         sum(CASE WHEN b.i = 2 THEN pow(13.0 / 15, a.i - b.i) ELSE 2.0 / 15 * pow(13.0 / 15, a.i - b.i) END * b.gain) AS g, sum(CASE WHEN b.i = 2 THEN pow(13.0 / 15, a.i - b.i) ELSE 2.0 / 15 * pow(13.0 / 15, a.i - b.i) END * b.loss) AS l,
         sum(CASE WHEN b.i = 2 THEN pow(13.0 / 14, a.i - b.i) ELSE 1.0 / 14 * pow(13.0 / 14, a.i - b.i) END * b.gain) AS ga, sum(CASE WHEN b.i = 2 THEN pow(13.0 / 14, a.i - b.i) ELSE 1.0 / 14 * pow(13.0 / 14, a.i - b.i) END * b.loss) AS la,
         sum(CASE WHEN b.i = 2 THEN pow(13.0 / 15, a.i - b.i) ELSE 2.0 / 15 * pow(13.0 / 15, a.i - b.i) END * b.move) AS atr_ewm,
         sum(CASE WHEN b.i = 1 THEN pow(11.0 / 13, a.i - b.i) ELSE 2.0 / 13 * pow(11.0 / 13, a.i - b.i) END * b.close)
         - sum(CASE WHEN b.i = 1 THEN pow(25.0 / 27, a.i - b.i) ELSE 2.0 / 27 * pow(25.0 / 27, a.i - b.i) END * b.close) AS macd
  FROM e0 a JOIN e0 b ON a.code = b.code AND b.i <= a.i GROUP BY a.code, a.date, a.i),
ew AS (
  SELECT a.code, a.date, any_value(1 - 1 / (1 + a.g / nullif(a.l, 0))) AS rsi_span, any_value(CASE WHEN a.i >= 15 THEN 1 - 1 / (1 + a.ga / nullif(a.la, 0)) END) AS rsi_alpha, any_value(a.atr_ewm) AS atr_ewm,
         any_value(a.macd) - sum(CASE WHEN b.i = 1 THEN pow(0.8, a.i - b.i) ELSE 0.2 * pow(0.8, a.i - b.i) END * b.macd) AS macd_hist FROM e1 a JOIN e1 b ON a.code = b.code AND b.i <= a.i GROUP BY a.code, a.date)"""
_TECH = f"""{_MOVING}, {_EWM},
t0 AS (
  SELECT *, close / nullif(lag(close) {_W}, 0) - 1 AS ret_1d, close / nullif(lag(close, 5) {_W}, 0) - 1 AS ret_5d, close / nullif(lag(close, 20) {_W}, 0) - 1 AS ret_20d, open / nullif(lag(close) {_W}, 0) - 1 AS gap_pct,
         close / nullif(lag(close, 60) {_W}, 0) - 1 AS ret_60, row_number() {_W} AS i, {_full("min(low)", "low", 14)} AS lo, {_full("max(high)", "high", 14)} AS hi, {_full("min(close)", "close", 14)} AS clo, {_full("max(close)", "close", 14)} AS chi,
         {_full("max(close)", "close", 20)} AS top FROM mv),
t1 AS (SELECT *, (close - lo) / nullif(hi - lo, 0) AS kd_k, (close - clo) / nullif(chi - clo, 0) AS ckd_k, {_full("regr_slope(close, i)", "close", 20)} / close AS trend_slope_20, {_full("stddev_samp(ret_1d)", "ret_1d", 20)} AS volatility_20 FROM t0),
tech AS (SELECT *, {_full("avg(kd_k)", "kd_k", 3)} AS kd_d, {_full("avg(ckd_k)", "ckd_k", 3)} AS ckd_d FROM t1 JOIN ew USING (code, date))"""


@query(
    "feature_technicals",
    _TECH
    + """ SELECT code, date, round(ret_1d, 5) AS ret_1d, round(ret_5d, 5) AS ret_5d, round(ret_20d, 5) AS ret_20d, round(close / sma_5, 5) AS ma5_ratio, round(close / sma_20, 5) AS ma20_ratio, round(close / sma_60, 5) AS ma60_ratio,
    round(bb_pct, 5) AS bb_position, round(rsi_span, 5) AS rsi_14, round(macd_hist / close, 5) AS macd_hist, round(kd_k, 5) AS kd_k, round(kd_d, 5) AS kd_d, round(atr_pct, 5) AS atr_pct, round(vol_ratio, 5) AS vol_ratio_5,
    round(volume / nullif(vol_20, 0), 5) AS vol_ratio_20, round((high - low) / close, 5) AS high_low_range, round((close - low) / nullif(high - low, 0), 5) AS close_vs_high, round(gap_pct, 5) AS gap_pct, round(trend_slope_20, 5) AS trend_slope_20,
    round(volatility_20, 5) AS volatility_20 FROM tech""",
    digits=5,
    dates=("date",),
)
def feature_technicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_technicals(market.bars(spark, sf_dir))


@query(
    "close_technicals",
    f"""{_TECH}, e AS (SELECT code FROM bars GROUP BY code HAVING count(*) >= 60), r AS (SELECT *, (1 + ret_60) / (1 + median(ret_60) OVER (PARTITION BY date)) - 1 AS rs_raw FROM tech JOIN e USING (code))
SELECT code, date, round(ret_1d, 5) AS ret_1d, round(rsi_alpha, 5) AS rsi_14, round(macd_hist / close, 5) AS macd_hist, round(ckd_k, 5) AS kd_k, round(ckd_d, 5) AS kd_d, round(atr_ewm, 5) AS atr_pct, round(abs(ret_1d), 5) AS high_low_range,
       round(close / nullif(top, 0), 5) AS close_vs_high, round(trend_slope_20, 5) AS trend_slope_20, round(volatility_20, 5) AS volatility_20, round({_rank("rs_raw")}, 5) AS rs_rating FROM r""",
    digits=5,
    dates=("date",),
)
def close_technicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.close_technicals(market.bars(spark, sf_dir))


@query(
    "latest_technicals",
    f"""{_TECH}, m AS (SELECT *, {_full("avg(abs(ret_1d))", "ret_1d", 14)} AS atr, count(*) OVER (PARTITION BY code) AS n FROM tech)
SELECT code, date, round(close, 5) AS close, round(ret_1d, 5) AS change_pct, round(close / sma_5, 5) AS ma5_ratio, round(close / sma_20, 5) AS ma20_ratio, round(close / sma_60, 5) AS ma60_ratio, round(rsi_span * 100, 5) AS rsi_14, round(atr, 5) AS atr_pct
FROM m WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1""",
    digits=5,
    dates=("date",),
)
def latest_technicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.latest_technicals(market.bars(spark, sf_dir))


@query(
    "strength_to_index",
    f"""i AS (SELECT date, close / nullif(lag(close, 63) OVER (ORDER BY date), 0) - 1 AS index_ret FROM idx), s AS (SELECT code, date, close / nullif(lag(close, 63) {_W}, 0) - 1 AS ret FROM bars),
r AS (SELECT code, date, ret - index_ret AS rs_raw FROM s LEFT JOIN i USING (date))
SELECT code, date, round(rs_raw, 6) AS rs_raw, round({_rank("rs_raw")}, 6) AS rs_rating FROM r""",
    dates=("date",),
)
def strength_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = market.bars(spark, sf_dir)
    return features.strength_to_index(frame, market.index_bars(frame))


@query(
    "strength_to_median",
    f"""s AS (SELECT code, date, close / nullif(lag(close, 60) {_W}, 0) - 1 AS ret FROM bars), r AS (SELECT code, date, (1 + ret) / (1 + median(ret) OVER (PARTITION BY date)) - 1 AS rs_raw FROM s)
SELECT code, date, round(rs_raw, 6) AS rs_raw, round({_rank("rs_raw")}, 6) AS rs_rating FROM r""",
    dates=("date",),
)
def strength_to_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.strength_to_median(market.bars(spark, sf_dir))


@query(
    "strength_of_pool",
    f"""s AS (SELECT code, date, pow(close / lag(close, 120) {_W}, 0.6) * pow(lag(close, 20) {_W} / lag(close, 140) {_W}, 0.4) AS rs FROM bars),
r AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY rs, code) - 1 AS place FROM s WHERE rs IS NOT NULL)
SELECT code, date, round(rs, 6) AS rs, round(place / (n - 1) * 100, 6) AS rating FROM r WHERE n >= 5""",
    dates=("date",),
)
def strength_of_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.strength_of_pool(market.bars(spark, sf_dir))


@query("strength_summary", _SCAN + " SELECT count(rs_ratio) AS codes, round(avg(rs_ratio), 6) AS mean, round(median(rs_ratio), 6) AS median, round(stddev_samp(rs_ratio), 6) AS sd FROM scan")
def strength_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.strength_summary(relative.strength_scan(market.bars(spark, sf_dir)))


_HEAT = """h AS (SELECT sector, sum(CASE WHEN rating >= 90 THEN 1 ELSE 0 END) / count(*) AS diamond_share, avg(CASE WHEN rating >= 50 THEN 1.0 ELSE 0.0 END) AS heat FROM scan JOIN sectors USING (code) GROUP BY sector)"""


@query("cluster_risk", f"{_SCAN}, {_HEAT} SELECT sector, round(heat, 6) AS heat, CASE WHEN diamond_share >= 0.5 AND heat >= 0.75 THEN 'danger' WHEN diamond_share >= 0.3 AND heat >= 0.6 THEN 'caution' ELSE 'normal' END AS risk FROM h")
def cluster_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = relative.strength_scan(market.bars(spark, sf_dir)).join(market.sectors(spark, sf_dir), "code")
    heat = scan.groupBy("sector").agg(F.avg(F.when(F.col("rating") >= 90, 1.0).otherwise(0.0)).alias("diamond_share"), F.avg(F.when(F.col("rating") >= 50, 1.0).otherwise(0.0)).alias("heat"))
    return features.cluster_risk(heat).select("sector", "heat", "risk")


@query(
    "sector_concentration",
    "n AS (SELECT date, sector, count(*) AS n FROM bars JOIN sectors USING (code) GROUP BY ALL) SELECT date, sector, round(n / sum(n) OVER (PARTITION BY date), 6) AS sector_concentration FROM n",
    dates=("date",),
)
def sector_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.sector_concentration(market.bars(spark, sf_dir), market.sectors(spark, sf_dir))


@query(
    "regime_tag",
    "a AS (SELECT date, close, CASE WHEN count(close) OVER w >= 200 THEN avg(close) OVER w END AS average FROM idx WINDOW w AS (ORDER BY date ROWS 199 PRECEDING)) SELECT date, CASE WHEN average IS NULL THEN 0 WHEN close > average THEN 1 ELSE -1 END::INTEGER AS regime_tag FROM a",
    dates=("date",),
)
def regime_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.regime_tag(market.index_bars(market.bars(spark, sf_dir)))


_NETS = """nets AS (
  SELECT code, date, sum(CASE WHEN broker < 5 THEN buy - sell ELSE 0 END) AS foreign_net, sum(CASE WHEN broker BETWEEN 5 AND 9 THEN buy - sell ELSE 0 END) AS trust_net, sum(CASE WHEN broker BETWEEN 10 AND 14 THEN buy - sell ELSE 0 END) AS dealer_net,
         sum(CASE WHEN broker < 15 THEN buy - sell ELSE 0 END) AS total_net, sum(CASE WHEN broker >= 15 THEN buy ELSE 0 END) AS b, sum(CASE WHEN broker >= 15 THEN sell ELSE 0 END) AS s FROM flows GROUP BY ALL),
held AS (SELECT *, sum(b) OVER w AS margin_balance, sum(s) OVER w AS short_balance, CASE WHEN dayofweek(date) = 5 THEN sum(foreign_net) OVER w END AS foreign_holding FROM nets WINDOW w AS (PARTITION BY code ORDER BY date))"""


def _institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brokers below 5 are foreign, below 10 trusts, below 15 dealers; the others' running sums are margin and short balances; holdings are known on Fridays."""
    return with_balances(market.broker_flows(spark, sf_dir).groupBy("code", "date").agg(*(x.alias(c) for c, x in institution_sums().items())))


def institution_sums() -> dict[str, Column]:
    """What kinds of institutions net of a day's flows; b and s are what the others buy and sell."""
    net = lambda low, high: F.sum(F.when(F.col("broker").between(low, high), F.col("buy") - F.col("sell")).otherwise(0.0))
    other = lambda x: F.sum(F.when(F.col("broker") >= 15, F.col(x)).otherwise(0.0))
    return {"foreign_net": net(0, 4), "trust_net": net(5, 9), "dealer_net": net(10, 14), "total_net": net(0, 14), "b": other("buy"), "s": other("sell")}


def with_balances(days: DataFrame) -> DataFrame:
    """Days of institution_sums() with their running sums."""
    w = history()
    return days.withColumns({"margin_balance": F.sum("b").over(w), "short_balance": F.sum("s").over(w), "foreign_holding": F.when(F.dayofweek("date") == 6, F.sum("foreign_net").over(w))})


def margin_share() -> Column:
    return F.try_divide(F.col("margin_balance"), F.col("margin_balance") + F.col("short_balance"))


def institutional_family(frame: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _institutions(spark, sf_dir)
    margin = days.select("code", "date", "margin_balance", "short_balance", margin_share().alias("margin_utilization"))
    return features.institutional(frame, days.select("code", "date", "foreign_net", "trust_net", "dealer_net", "total_net"), margin, days.select("code", "date", "foreign_holding"))


@query(
    "institutional_features",
    _NETS
    + f""", j AS (SELECT b.code, b.date, b.volume, foreign_net, trust_net, dealer_net, total_net, margin_balance, short_balance, margin_balance / nullif(margin_balance + short_balance, 0) AS margin_utilization, foreign_holding FROM bars b LEFT JOIN held USING (code, date)),
k AS (SELECT *, last_value(foreign_holding IGNORE NULLS) {_W} AS tdcc FROM j)
SELECT code, date, round(foreign_net / volume, 6) AS inst_foreign_net, round(trust_net / volume, 6) AS inst_trust_net, round(dealer_net / volume, 6) AS inst_dealer_net, round(total_net / volume, 6) AS inst_total_net,
       round(sum(total_net / volume) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING), 6) AS inst_5d_sum, round(margin_balance / nullif(lag(margin_balance) {_W}, 0) - 1, 6) AS margin_balance_chg,
       round(short_balance / nullif(lag(short_balance) {_W}, 0) - 1, 6) AS short_balance_chg, round(margin_utilization, 6) AS margin_utilization, round(-(tdcc - lag(tdcc) {_W}), 6) AS tdcc_retail_chg, round(tdcc - lag(tdcc) {_W}, 6) AS tdcc_big_chg, round(tdcc, 6) AS tdcc_concentration FROM k""",
    dates=("date",),
)
def institutional_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return institutional_family(market.bars(spark, sf_dir), spark, sf_dir)


_BROKERS = f"""{_WINNERS},
f0 AS (SELECT flows.*, tier, buy - sell AS net, sum(buy + sell) OVER (PARTITION BY code, date) AS turnover, sum(CASE WHEN buy > sell THEN 1 ELSE 0 END) OVER (PARTITION BY date, flows.broker) AS spread_of FROM flows LEFT JOIN winners ON winners.broker = flows.broker),
f1 AS (SELECT *, abs(net) / nullif(turnover, 0) AS pct, row_number() OVER (PARTITION BY code, date ORDER BY net DESC, broker) AS up, row_number() OVER (PARTITION BY code, date ORDER BY net, broker) AS down FROM f0),
f2 AS (
  SELECT code, date, sum(CASE WHEN pct > 0 THEN pct * pct END) AS hhi, sum(CASE WHEN net > 0 AND up <= 3 THEN pct END) AS top3_pct, coalesce(sum(CASE WHEN net > 0 AND up <= 5 THEN net END), 0) AS b5, coalesce(sum(CASE WHEN net < 0 AND down <= 5 THEN net END), 0) AS s5,
         count(CASE WHEN net > 0 THEN 1 END) AS buyers, count(CASE WHEN net < 0 THEN 1 END) AS sellers, count(CASE WHEN net > 0 AND up <= 3 AND tier IS NOT NULL THEN 1 END) AS won, count(CASE WHEN net > 0 AND up <= 3 AND tier = 1 THEN 1 END) AS first_rank,
         coalesce(coalesce(sum(CASE WHEN net > 0 AND broker < 5 THEN buy END), 0) / nullif(sum(CASE WHEN net > 0 THEN buy END), 0), 0) AS foreign_pct, avg(CASE WHEN net > 0 AND up <= 5 THEN spread_of END) AS overlap, any_value(turnover) AS turnover FROM f1 GROUP BY ALL),
f3 AS (SELECT *, CASE WHEN abs(b5) + abs(s5) > 0 THEN b5 / (abs(b5) + abs(s5)) ELSE 0.5 END AS net_buy_ratio, row_number() {_W} AS i FROM f2),
brokers AS (
  SELECT code, date, hhi, top3_pct, hhi - lag(hhi) {_W} AS hhi_delta, net_buy_ratio, CASE WHEN sellers > 0 THEN buyers / sellers WHEN buyers > 0 THEN buyers ELSE 1 END::DOUBLE AS spread,
         CASE WHEN i >= 5 THEN avg(net_buy_ratio) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING) ELSE net_buy_ratio END AS net_momentum_5d, CASE WHEN coalesce(top3_pct, 0) >= 0.4 THEN top3_pct * 100 * (won / least(3, buyers)) ELSE 0 END AS purity, foreign_pct, overlap,
         CASE WHEN i >= 11 THEN stddev_samp(net_buy_ratio) OVER (PARTITION BY code ORDER BY date ROWS 19 PRECEDING) END AS net_buy_volatility, turnover / nullif(lag(turnover) {_W}, 0) - 1 AS turnover_chg,
         ((i - coalesce(max(CASE WHEN NOT net_buy_ratio > 0.5 THEN i END) {_W}, 0)) - (i - coalesce(max(CASE WHEN NOT net_buy_ratio < 0.5 THEN i END) {_W}, 0)))::INTEGER AS streak, (least(first_rank, 2) * 50)::BIGINT AS winner_momentum FROM f3)"""


def _brokers(spark: SparkSession, sf_dir: str, also: dict[str, Column] | None = None) -> DataFrame:
    return features.broker_day(market.by_code(spark, sf_dir)[1], foreign=(0, 1, 2, 3, 4), registry=winners(spark, sf_dir), also=also)


@query(
    "broker_day_features",
    _BROKERS
    + """ SELECT code, date, round(hhi, 9) AS hhi, round(top3_pct, 9) AS top3_pct, round(hhi_delta, 9) AS hhi_delta, round(net_buy_ratio, 9) AS net_buy_ratio, round(spread, 9) AS spread, round(net_momentum_5d, 9) AS net_momentum_5d, round(purity, 9) AS purity,
    round(foreign_pct, 9) AS foreign_pct, round(overlap, 9) AS overlap, round(net_buy_volatility, 9) AS net_buy_volatility, round(turnover_chg, 9) AS turnover_chg, streak, winner_momentum FROM brokers""",
    digits=9,
    dates=("date",),
)
def broker_day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brokers(spark, sf_dir)


@query(
    "price_divergence",
    _MOVING + " SELECT code, date, round(CASE WHEN atr_14 > 0 THEN (close - (high + low + close) / 3) / atr_14 WHEN atr_14 IS NOT NULL THEN 0 END, 6) AS price_divergence FROM mv",
    dates=("date",),
)
def price_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.price_divergence(market.bars(spark, sf_dir))


_SCORED = ("purity", "winner_momentum", "streak", "top3_pct", "net_buy_ratio")


def _rolling_z(x: str) -> str:
    w = "OVER (PARTITION BY code ORDER BY date ROWS 251 PRECEDING)"
    return f"coalesce(CASE WHEN {x} IS NOT NULL AND count({x}) {w} >= 60 AND stddev_samp({x}) {w} > 1e-6 * abs(avg({x}) {w}) THEN greatest(-5, least(5, ({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0))) END, 0) AS {x}"


@query(
    "accumulation_score",
    _BROKERS
    + f""", zs AS (SELECT code, date, {", ".join(map(_rolling_z, _SCORED))} FROM brokers), a AS (SELECT code, date, count(*) OVER w AS n, avg(purity) OVER w AS p, avg(winner_momentum) OVER w AS b, avg(streak) OVER w AS s, avg(top3_pct) OVER w AS h, avg(net_buy_ratio) OVER w AS r
  FROM zs WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING))
SELECT code, date, round(0.4::DOUBLE * p * CASE WHEN b > 1e-12 THEN 1.2::DOUBLE ELSE 1 END + 0.25::DOUBLE * s + 0.2::DOUBLE * h + 0.15::DOUBLE * r, 9) AS score FROM a WHERE n >= 20""",
    digits=9,
    dates=("date",),
)
def accumulation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the normalised broker features."""
    return features.accumulation_score(indicators.normalised(_brokers(spark, sf_dir).select("code", "date", *_SCORED), list(_SCORED), prefix=""))


@query("return_summary", _RET + " SELECT code, round(avg(ret), 6) AS mean, round(quantile_cont(ret, 0.25), 6) AS q1, round(median(ret), 6) AS median, round(quantile_cont(ret, 0.75), 6) AS q3 FROM ret WHERE ret IS NOT NULL GROUP BY code")
def return_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of a code's returns."""
    rows = relative.forward_returns(market.bars(spark, sf_dir), (1,)).filter("d1 IS NOT NULL")
    q = F.percentile("d1", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("code").agg(F.avg("d1").alias("mean"), q.alias("q")).select("code", "mean", *(F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("q1", "median", "q3"))))

"""Templates, coupled sectors, frontiers and rules over the driver's tables, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change
from quantloom.operators import analytics, contraction, coupling, levels, portfolio, screener, signals, templates
from quantloom.plans.features import _NETS, _institutions
from quantloom.plans.queries import _MOVING, _REVERSION, _TREND, _W, query
from quantloom.sources import market

#: What a case is described by: changes of the close over so many bars, then of the volume; weights of a scan.
_CLOSES, _VOLUMES = (1, 3, 5, 10, 20, 60), (5, 20)
_WEIGHTS = [2.0] * len(_CLOSES) + [1.0] * len(_VOLUMES)
_VECTOR = ", ".join(f"coalesce({c} / nullif(lag({c}, {n}) {_W}, 0) - 1, 0)" for c, spans in (("close", _CLOSES), ("volume", _VOLUMES)) for n in spans)
_GOLDEN = f"""cs AS (SELECT code, date, [{_VECTOR}] AS v, {", ".join(f"lead(close, {h}) {_W} / nullif(close, 0) - 1 AS d{h}" for h in templates.HORIZONS)} FROM bars),
rose AS (SELECT * FROM cs WHERE d30 >= 0.2 AND list_sum(list_transform(v, lambda x: abs(x))) > 1e-6),
days AS (SELECT code, unnest(kept) AS date FROM (SELECT code, list_reduce(list_prepend([], list_transform(list(date ORDER BY date), lambda d: [d])), lambda k, d: CASE WHEN len(k) = 0 OR date_diff('day', k[-1], d[1]) >= 30 THEN k || d ELSE k END) AS kept FROM rose GROUP BY code)),
kp AS (SELECT rose.*, list_filter([d7, d14, d30, d90], lambda x: x IS NOT NULL) AS known FROM rose JOIN days USING (code, date)),
gd AS (SELECT *, len(list_filter(known, lambda x: x > 0)) / len(known) AS consistency FROM kp QUALIFY row_number() OVER (PARTITION BY code ORDER BY len(list_filter(known, lambda x: x > 0)) / len(known) DESC, date) <= 20)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = market.bars(spark, sf_dir)
    w = Window.partitionBy("code").orderBy("date")
    vector = F.array(*(F.coalesce(change(c, n), F.lit(0.0)) for c, spans in (("close", _CLOSES), ("volume", _VOLUMES)) for n in spans))
    return bars.select("code", "date", vector.alias("vector"), *((F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1).alias(f"d{h}") for h in templates.HORIZONS))


@query("golden_templates", _GOLDEN + " SELECT code, date, round(d7, 6) AS d7, round(d14, 6) AS d14, round(d30, 6) AS d30, round(d90, 6) AS d90, round(consistency, 6) AS consistency FROM gd", dates=("date",))
def golden_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.golden(_cases(spark, sf_dir)).drop("vector")


@query(
    "market_scan",
    _GOLDEN
    + f""", c AS (SELECT max(date) AS newest, count(DISTINCT date) AS n FROM bars), ac AS (SELECT code FROM (SELECT code, max(date) AS last, count(*) AS days FROM bars GROUP BY code), c WHERE date_diff('day', last, newest) <= 30 AND days / n >= 0.2),
td AS (SELECT code, industry, v FROM cs JOIN ac USING (code) JOIN sectors USING (code) QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
s AS (SELECT td.code, gd.code * 100000 + date_diff('day', DATE '1970-01-01', date) AS id, d30, consistency, len(list_filter(known, lambda x: x <= 0)) = 0 AS hit,
  round(list_cosine_similarity([{", ".join(f"td.v[{i + 1}] * {w}::DOUBLE" for i, w in enumerate(_WEIGHTS))}], [{", ".join(f"gd.v[{i + 1}] * {w}::DOUBLE" for i, w in enumerate(_WEIGHTS))}]), 6) AS sim FROM td, gd),
p AS (SELECT code, count(*) AS matches, avg(sim) AS similarity, avg(consistency) AS consistency, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS hit_rate, median(d30) AS median_d30
  FROM (SELECT * FROM s WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY sim DESC, id) <= 5) GROUP BY code),
q AS (SELECT p.*, industry, round(similarity * 0.7 + consistency * 0.3, 9) AS score FROM p JOIN td USING (code)),
r AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY industry ORDER BY score DESC, code) <= 3)
SELECT code, industry, matches, round(similarity, 9) AS similarity, round(consistency, 9) AS consistency, round(hit_rate, 9) AS hit_rate, round(median_d30, 9) AS median_d30, score FROM r ORDER BY score DESC, code LIMIT 15""",
    digits=9,
)
def market_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last situation of each active code against all templates; the fifteen best are the feature."""
    cases = _cases(spark, sf_dir)
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    active = screener.active(market.bars(spark, sf_dir), 30, 0.2).select("code")
    today = cases.withColumn("_back", last).filter("_back = 1").join(active, "code").join(market.sectors(spark, sf_dir), "code").select("code", "industry", "vector")
    # A scan reads both several times: twenty templates and one situation a code at most.
    return templates.scan(templates.golden(cases).persist(), today.persist(), _WEIGHTS)


_COUPLED = f"""rr AS (SELECT code, date, close / nullif(lag(close) {_W}, 0) - 1 AS ret, lag(volume) {_W} AS weight FROM bars),
dd AS (SELECT industry AS sector, date, sum(ret * weight) / nullif(sum(weight), 0) AS ret FROM rr JOIN sectors USING (code) WHERE ret IS NOT NULL GROUP BY ALL),
pp AS (SELECT a.sector AS sector_a, b.sector AS sector_b, a.date, a.ret AS x, b.ret AS y FROM dd a JOIN dd b ON a.date = b.date AND a.sector < b.sector),
ro AS (SELECT *, CASE WHEN count(*) OVER w >= 90 THEN corr(x, y) OVER w END AS rolled, row_number() OVER (PARTITION BY sector_a, sector_b ORDER BY date DESC) AS back FROM pp WINDOW w AS (PARTITION BY sector_a, sector_b ORDER BY date ROWS 89 PRECEDING)),
c0 AS (SELECT sector_a, sector_b, corr(x, y) FILTER (back <= 90) AS structural, CASE WHEN count(*) >= 15 THEN corr(x, y) FILTER (back <= 15) END AS flash, count(rolled) FILTER (back <= 667) AS n, avg(rolled) FILTER (back <= 667) AS m, stddev_samp(rolled) FILTER (back <= 667) AS s FROM ro GROUP BY ALL),
c1 AS (SELECT *, CASE WHEN n < 2 THEN structural ELSE m END AS mean, CASE WHEN n < 2 THEN 0 ELSE s END AS sd, flash - structural AS spike FROM c0),
c2 AS (SELECT *, CASE WHEN sd > 0.01 THEN (structural - mean) / sd ELSE 0 END AS z FROM c1),
cp AS (SELECT *, CASE WHEN structural > 0.95 THEN 'absolute_extreme' WHEN structural IS NOT NULL AND z > 1.5 THEN 'zscore_spike' END AS alert, coalesce(spike > 0.2, false) AS flash_alert FROM c2)"""


def _industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.sectors(spark, sf_dir).select("code", F.col("industry").alias("sector"))


@query(
    "sector_couplings",
    _COUPLED + " SELECT sector_a, sector_b, round(structural, 4) AS structural, round(flash, 4) AS flash, round(mean, 4) AS mean, round(sd, 4) AS sd, round(z, 4) AS z, round(spike, 4) AS spike, alert, flash_alert FROM cp",
    digits=4,
)
def sector_couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pairs of industries."""
    return coupling.couplings(market.bars(spark, sf_dir), _industries(spark, sf_dir))


@query(
    "systemic_share",
    _COUPLED
    + """, y AS (SELECT count(*) AS pairs, count(CASE WHEN spike > 0.15 THEN 1 END) AS spiking FROM cp), v AS (SELECT *, coalesce(spiking / nullif(pairs, 0), 0) AS score FROM y)
SELECT pairs, spiking, round(score, 6) AS score, CASE WHEN score > 0.5 THEN 'systemic' WHEN score > 0.2 THEN 'elevated' ELSE 'normal' END AS level, score > 0.5 AS tighten_stops FROM v""",
)
def systemic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.systemic(coupling.couplings(market.bars(spark, sf_dir), _industries(spark, sf_dir)))


_BUCKETS = """ll AS (SELECT sector_a AS a, sector_b AS b FROM cp WHERE alert IS NOT NULL OR flash_alert UNION SELECT sector_b, sector_a FROM cp WHERE alert IS NOT NULL OR flash_alert),
re AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT DISTINCT industry AS sector, industry AS member FROM sectors UNION SELECT r.sector, ll.b FROM r JOIN ll ON ll.a = r.member) SELECT * FROM r)),
bk AS (SELECT sector, min(member) AS bucket, string_agg(member, ',' ORDER BY member) AS members FROM re GROUP BY sector)"""


@query("risk_buckets", f"{_COUPLED}, {_BUCKETS} SELECT sector, bucket, members, 0.24::DOUBLE AS cap FROM bk")
def risk_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _industries(spark, sf_dir)
    return coupling.buckets(coupling.couplings(market.bars(spark, sf_dir), made), made)


@query(
    "bucket_entries",
    f"""{_COUPLED}, {_BUCKETS}, w AS (SELECT industry AS sector, sum(cost) / sum(sum(cost)) OVER () AS weight FROM trades JOIN sectors USING (code) GROUP BY industry),
i AS (SELECT bucket, sum(weight) AS held FROM w JOIN bk USING (sector) GROUP BY bucket)
SELECT bk.sector, 0.01::DOUBLE AS weight, bk.bucket, round(coalesce(held, 0), 6) AS current, 0.24::DOUBLE AS cap, coalesce(held, 0) + 0.01 <= 0.24 AS allowed FROM bk LEFT JOIN i ON i.bucket = bk.bucket
UNION ALL SELECT 'none', 0.01, NULL, 0, 0.2, true""",
)
def bucket_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth more of each industry, and of one that is in no bucket, for a portfolio of all trades."""
    made = _industries(spark, sf_dir)
    held = coupling.buckets(coupling.couplings(market.bars(spark, sf_dir), made), made)
    costs = market.trades(spark, sf_dir).join(F.broadcast(made), "code").groupBy("sector").agg(F.sum("cost").alias("cost"))
    weights = costs.select("sector", (F.col("cost") / F.sum("cost").over(Window.partitionBy(F.lit(1)))).alias("weight"))  # a row an industry
    asked = made.select("sector").distinct().union(spark.createDataFrame([("none",)], "sector string")).withColumn("weight", F.lit(0.01))
    return coupling.entries(asked, weights, held)


@query(
    "efficient_frontier",
    f"""rr AS (SELECT code, date, close / nullif(lag(close) {_W}, 0) - 1 AS ret, lag(volume) {_W} AS weight FROM bars),
dd AS (SELECT sector AS asset, date, sum(ret * weight) / nullif(sum(weight), 0) AS ret FROM rr JOIN sectors USING (code) WHERE ret IS NOT NULL GROUP BY ALL),
h AS (SELECT * FROM dd WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) = (SELECT count(DISTINCT asset) FROM dd WHERE ret IS NOT NULL)),
l AS (SELECT * FROM h QUALIFY dense_rank() OVER (ORDER BY date DESC) <= 60), mu AS (SELECT asset, avg(ret) * 252 AS mean FROM l GROUP BY asset),
cv AS (SELECT a.asset AS a, b.asset AS b, covar_samp(a.ret, b.ret) * 252 AS cov FROM l a JOIN l b USING (date) GROUP BY ALL),
pl AS (SELECT asset, row_number() OVER (ORDER BY asset) AS place FROM (SELECT DISTINCT asset FROM dd WHERE ret IS NOT NULL)),
u0 AS (SELECT range AS draw, asset, place, (range * 1000003 + place * 7919 + 1) % 2147483647 AS x FROM range(3000), pl),
u1 AS (SELECT draw, asset, place, (x * x + draw) % 2147483647 AS x FROM u0), u2 AS (SELECT draw, asset, (x * 48271 + place) % 2147483647 AS x FROM u1),
u AS (SELECT draw, asset, (x * x % 2147483647 + 1) / 2147483647 AS u FROM u2), w AS (SELECT draw, asset, u / sum(u) OVER (PARTITION BY draw) AS w FROM u),
g AS (SELECT draw, sum(w * mean) AS ret FROM w JOIN mu USING (asset) GROUP BY draw),
k AS (SELECT a.draw, sqrt(sum(a.w * b.w * cov)) AS vol FROM w a JOIN w b ON a.draw = b.draw JOIN cv ON cv.a = a.asset AND cv.b = b.asset GROUP BY a.draw),
e AS (SELECT draw, ret, vol, coalesce((ret - 0.015) / nullif(vol, 0), 0) AS sharpe FROM g JOIN k USING (draw))
SELECT draw, round(ret, 4) AS ret, round(vol, 4) AS vol, round(sharpe, 4) AS sharpe, row_number() OVER (ORDER BY sharpe DESC, draw) = 1 AS best FROM e""",
    digits=4,
)
def efficient_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a portfolio of all sectors."""
    days = portfolio.sector_days(market.bars(spark, sf_dir), market.sectors(spark, sf_dir))
    return portfolio.frontier(spark, days.withColumnRenamed("sector", "asset"))


@query(
    "position_multiples",
    """p AS (SELECT trade_id, code, cost AS entry, cost * (1 + (trade_id % 7 - 3) / 20) AS current, CASE WHEN trade_id % 5 > 0 THEN cost * 0.93 ELSE cost END AS stop, CASE WHEN trade_id % 2 = 0 THEN proceeds END AS exit FROM trades),
q AS (SELECT *, CASE WHEN entry > stop THEN (current - entry) / (entry - stop) ELSE 0 END AS i, CASE WHEN exit IS NOT NULL THEN CASE WHEN entry > stop THEN (exit - entry) / (entry - stop) ELSE 0 END END AS r FROM p), s AS (SELECT *, coalesce(r, i) AS x FROM q)
SELECT trade_id, code, round(i, 4) AS intended_r, round(r, 4) AS realized_r, CASE WHEN exit <> current THEN round(r - i, 4) END AS gap_r,
  CASE WHEN x >= 3 THEN 'Home Run' WHEN x >= 1 THEN '1R Winner' WHEN abs(x) < 0.1 THEN 'Breakeven' WHEN x < 0 THEN 'Initial Risk' ELSE 'Partial Gain' END AS status, round(entry - stop, 4) AS risk, exit IS NOT NULL AS closed FROM s""",
    digits=4,
)
def position_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other trade is still open; stops 7 % below the entry, but for every fifth."""
    t = market.trades(spark, sf_dir)
    i = F.col("trade_id")
    rows = t.select("trade_id", "code", F.col("cost").alias("entry"), (F.col("cost") * (1 + (i % 7 - 3) / 20)).alias("current"), F.when(i % 5 > 0, F.col("cost") * 0.93).otherwise(F.col("cost")).alias("stop"), F.when(i % 2 == 0, F.col("proceeds")).alias("exit"))
    return analytics.track(rows).drop("entry", "current", "stop", "exit")


@query(
    "blended_signals",
    f"""{_MOVING}, {_TREND}, {_REVERSION},
bl0 AS (SELECT ts.code, ts.date, CASE WHEN kind = 'exit' THEN 'SELL' WHEN kind IS NOT NULL THEN 'BUY' ELSE 'HOLD' END AS trend, reverted.signal AS reversion, reverted.bias AS bias, ts.adx, ts.close / nullif(lag(ts.close) OVER w, 0) - 1 AS ret FROM ts JOIN reverted USING (code, date) WINDOW w AS (PARTITION BY ts.code ORDER BY ts.date)),
bl1 AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY code ORDER BY date ROWS 59 PRECEDING) * sqrt(252) AS sd FROM bl0),
bl2 AS (SELECT *, CASE WHEN adx >= 25 THEN CASE WHEN sd > 0.3 THEN 'trend_explosive' ELSE 'trend_mild' END WHEN adx IS NOT NULL AND sd > 0.25 THEN 'range_volatile' ELSE 'range_quiet' END AS regime FROM bl1),
bl3 AS (SELECT *, CASE regime WHEN 'trend_explosive' THEN 0.9 WHEN 'trend_mild' THEN 0.8 WHEN 'range_volatile' THEN 0.2 ELSE 0.3 END::DOUBLE AS w FROM bl2),
bl4 AS (SELECT *, round(w * CASE trend WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END + (1 - w) * CASE reversion WHEN 'BUY' THEN CASE WHEN bias THEN 1.2::DOUBLE ELSE 1 END WHEN 'SELL' THEN -1 ELSE 0 END::DOUBLE, 9) AS composite FROM bl3)
SELECT code, date, trend, reversion, regime, bias, composite, CASE WHEN composite >= 0.5 THEN 'BUY' WHEN composite <= -0.5 THEN 'SELL' ELSE 'HOLD' END AS signal FROM bl4""",
    digits=9,
    dates=("date",),
)
def blended_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every bar, by its trend and reversion signals and the code's regime."""
    frame = market.bars(spark, sf_dir)
    trend = signals.trend_signals(frame, min_days=2, min_adx=5.0, min_volume=10.0, keep=("adx",)).select("code", "date", "close", "adx", F.col("signal").alias("trend"))
    back = signals.reversion_signals(frame).select("code", "date", F.col("signal").alias("reversion"), "bias")
    rows = signals.four_regimes(trend).join(back, ["code", "date"]).withColumn("confidence", F.lit(1.0))
    return signals.blend(rows).select("code", "date", "trend", "reversion", "regime", "bias", "composite", "signal")


#: Goes on from _NETS.
_INSTITUTIONS = """b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back, sign(total_net) AS side FROM nets), f AS (SELECT code, side AS direction FROM b WHERE back = 1),
a AS (SELECT code, count(*) AS days, sum(total_net) FILTER (back <= 3) AS n3, sum(foreign_net) FILTER (back <= 5) AS f5, sum(trust_net) FILTER (back <= 5) AS t5, sum(dealer_net) FILTER (back <= 5) AS d5, bool_and(trust_net > 0) FILTER (back <= 5) AS bought, bool_and(trust_net < 0) FILTER (back <= 5) AS sold,
  avg(abs(total_net)) AS mean, max(total_net) FILTER (back = 1) AS last FROM b GROUP BY code),
r AS (SELECT code, any_value(direction)::INTEGER AS direction, CASE WHEN any_value(direction) = 0 THEN 0 ELSE coalesce(min(back) FILTER (side <> direction) - 1, count(*)) END AS run FROM b JOIN f USING (code) GROUP BY code),
s AS (SELECT code, days, f5, t5, d5, run * direction AS streak, CASE WHEN days >= 3 THEN sign(n3) + sign(f5) + CASE WHEN bought THEN 0.5 WHEN sold THEN -0.5 ELSE 0 END ELSE 0 END + direction * CASE WHEN run >= 5 THEN 1.5 WHEN run >= 3 THEN 0.5 ELSE 0 END + CASE WHEN days >= 5 AND abs(last) > 3 * mean THEN sign(last) ELSE 0 END AS score FROM a JOIN r USING (code))
SELECT s0.code, coalesce(greatest(-5, least(5, score)), -3)::DOUBLE AS score, coalesce(streak, 0)::INTEGER AS streak, CASE WHEN days >= 3 THEN CASE WHEN abs(f5) >= abs(t5) AND abs(f5) >= abs(d5) THEN 'foreign' WHEN abs(t5) >= abs(d5) THEN 'trust' ELSE 'dealer' END END AS dominant,
  CASE WHEN days IS NULL THEN 'ghost_town' ELSE 'active' END AS visibility FROM sectors s0 LEFT JOIN s USING (code)"""


@query("institution_scores", f"{_NETS}, {_INSTITUTIONS}")
def institution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.institution_score(_institutions(spark, sf_dir), market.sectors(spark, sf_dir))


@query("support_levels")
def support_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = market.bars(spark, sf_dir)
    return levels.support_resistance(bars, levels.swings(bars))


@query("contractions")
def contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds are wide, since the model's prices move far and its volumes are small."""
    return contraction.contractions(market.bars(spark, sf_dir), least_volume=1.0, deepest=0.9, limit=10.0)

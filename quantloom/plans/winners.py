"""Winning brokers and winning situations over the driver's tables, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import history
from quantloom.operators import dna, registry, relative
from quantloom.plans.queries import _W, query
from quantloom.sources import market
from quantloom.sources.snapshots import snapshot


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry reads several times, built once a session."""

    def build() -> DataFrame:
        frame, flows = market.by_code(spark, sf_dir)
        return registry.purchases(flows, relative.forward_returns(frame, (21,)), market.sectors(spark, sf_dir))

    return snapshot(spark, "purchases", sf_dir, build)


#: Prices here move so much that every broker has a tier by the usual bounds; these divide them.
_SCORE, _TIER_1, _TIER_2 = 7.5, 6.0, 5.5


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry, built once a session."""
    return snapshot(spark, "winner_registry", sf_dir, lambda: registry.registry(purchases(spark, sf_dir), score=_SCORE, tier_1=_TIER_1, tier_2=_TIER_2))


_SQUARE = "(x * x + x * 48271 % 2147483647 + {k}) % 2147483647"
_WINNERS = f"""wf AS (SELECT code, date AS bar, lead(close, 21) {_W} / nullif(close, 0) - 1 AS ret FROM bars),
wm AS (SELECT code, broker, last_day(flows.date) AS date, sum(buy - sell) AS net FROM flows GROUP BY code, broker, last_day(flows.date) HAVING sum(buy - sell) > 0),
wb AS (SELECT * FROM wm QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY net DESC, broker) <= 5),
wp AS (SELECT wb.code, broker, wb.date, coalesce(sector, 'unknown') AS sector, ret FROM wb JOIN wf ON wf.code = wb.code AND ret IS NOT NULL AND abs(wf.bar - wb.date) <= 5 LEFT JOIN sectors ON sectors.code = wb.code
  QUALIFY row_number() OVER (PARTITION BY wb.code, broker, wb.date ORDER BY abs(wf.bar - wb.date), wf.bar) = 1),
wx AS (SELECT broker, draw, ret, (42 + broker * 7919 + code * 104729 + (date - DATE '1970-01-01') * 15485863 + draw * 49979687) % 2147483647 AS x FROM wp, range(1, 1001) t(draw)),
w1 AS (SELECT broker, draw, ret, {_SQUARE.format(k=12345)} AS x FROM wx), w2 AS (SELECT broker, draw, ret, {_SQUARE.format(k=67891)} / 2147483647.0::DOUBLE AS u FROM w1),
w3 AS (SELECT broker, draw, ret, {" + ".join(f"(u >= {p!r}::DOUBLE)::BIGINT" for p in registry.POISSON)} AS w FROM w2),
w4 AS (SELECT broker, draw, sum(w) AS n, sum(w) FILTER (ret > 0) AS wins, sum(ret * w) FILTER (ret > 0) AS gain, sum(ret * w) FILTER (ret <= 0) AS loss FROM w3 GROUP BY ALL),
w5 AS (SELECT broker, draw, wins / nullif(n, 0) AS rate, coalesce(gain / nullif(wins, 0), 0) AS profit, coalesce(abs(loss / nullif(n - coalesce(wins, 0), 0)), 0.001) AS bad FROM w4),
w6 AS (SELECT broker, coalesce(CASE WHEN bad > 1e-6 THEN rate * profit / bad ELSE rate * profit * 100 END, 0) AS score FROM w5),
wi AS (SELECT broker, quantile_cont(score, 0.025) AS ci_low, quantile_cont(score, 0.975) AS ci_high FROM w6 GROUP BY broker),
ws AS (SELECT broker, sector, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY broker) AS share FROM wp GROUP BY broker, sector),
wt AS (SELECT broker, count(*) AS sectors, sum(share * share) AS hhi, max(share) AS top_share FROM ws GROUP BY broker),
wa AS (SELECT broker, count(*) AS n, count(DISTINCT code) AS codes, avg((ret > 0)::INTEGER) AS win_rate, coalesce(avg(ret) FILTER (ret > 0), 0) AS avg_profit, coalesce(avg(ret) FILTER (ret <= 0), -0.001) AS avg_loss FROM wp GROUP BY broker HAVING count(*) >= 15),
wr AS (SELECT *, CASE WHEN abs(avg_loss) > 1e-6 THEN win_rate * avg_profit / abs(avg_loss) ELSE win_rate * avg_profit * 100 END AS score FROM wa JOIN wt USING (broker) JOIN wi USING (broker)),
winners AS (SELECT *, top_share > 0.5 AS ghost_bias, CASE WHEN top_share > 0.5 THEN 0.5 ELSE 1 END::DOUBLE AS discount, CASE WHEN score >= {_SCORE} AND ci_low >= {_TIER_1} THEN 1 WHEN score >= {_SCORE} AND ci_low >= {_TIER_2} THEN 2 END::INTEGER AS tier FROM wr)"""


@query(
    "winner_registry",
    f"""{_WINNERS} SELECT broker, n, codes, round(win_rate, 9) AS win_rate, round(avg_profit, 9) AS avg_profit, round(avg_loss, 9) AS avg_loss, round(score, 9) AS score, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, sectors, round(hhi, 9) AS hhi, round(top_share, 9) AS top_share,
    ghost_bias, discount, tier FROM winners""",
    digits=9,
)
def winner_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(spark, sf_dir)


def dna_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, label, newest: days that gained or lost a fifth in 30 bars, none of a code within 30 days of one that counts, and each code's last day. Built once a session."""
    from quantloom.operators.similarity import spaced

    def build() -> DataFrame:
        ahead = relative.forward_returns(market.by_code(spark, sf_dir)[0], (30,)).select("code", "date", "d30", F.lead("date").over(history()).isNull().alias("newest"))
        moved = spaced(ahead.filter("abs(d30) >= 0.2"), 30).select("code", "date", F.when(F.col("d30") > 0, "winner").otherwise("loser").alias("label"), F.lit(False).alias("newest"))
        return moved.unionByName(ahead.filter("newest").select("code", "date", F.lit(None).cast("string").alias("label"), "newest"))

    return snapshot(spark, "dna_days", sf_dir, build)


def dna_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, today's codes and bars: dna_days() as the matrix has them; clusters are the dimensions that stand out most.

    These days go into the matrix's buckets, and of its rows only they come out.
    """
    from quantloom.operators import dual, matrix
    from quantloom.plans.matrix import whole_matrix

    def build() -> DataFrame:
        marks = dna_days(spark, sf_dir).withColumn("_counts", F.lit(True))
        rows = whole_matrix(spark, sf_dir, marks, "_counts")
        score = F.array(*(F.struct(F.abs(matrix.dimension_score(d)).alias("size"), F.lit(d).alias("dimension")) for d in matrix.DIMENSIONS))
        return rows.select("code", "date", dual._vector(None).alias("vector"), F.array_max(score)["dimension"].alias("cluster"), "label", "newest")

    rows = snapshot(spark, "dna_situations", sf_dir, build)
    return rows.filter("NOT newest").drop("newest"), rows.filter("newest").select("code", "date", "vector", "cluster"), market.by_code(spark, sf_dir)[0]


@query("dna_match", digits=9)
def dna_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of these tables are less alike than a market's: a mean likeness of 0.4 is a match. Time warping is beyond SQL; tests hold it against a plain version."""
    return dna.match(*dna_inputs(spark, sf_dir), threshold=0.4)


@query("accumulation_phases", digits=9)
def accumulation_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the strength ratings and the accumulation scores of the last day. Folds over swings are beyond SQL; tests hold them against a plain version."""
    from quantloom.operators import bottoms, features, indicators, matrix
    from quantloom.plans.features import _SCORED, _brokers

    frame = market.bars(spark, sf_dir)
    scores = matrix.latest(features.accumulation_score(indicators.normalised(_brokers(spark, sf_dir).select("code", "date", *_SCORED), list(_SCORED), prefix="")))
    return bottoms.accumulation(frame, relative.strength_scan(frame), scores, least_volume=20.0)


@query("reversal_signals", digits=9)
def reversal_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested like accumulation_phases."""
    from quantloom.operators import bottoms

    return bottoms.reversals(market.bars(spark, sf_dir))

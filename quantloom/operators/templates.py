"""Templates: situations that rose, and the codes of today that look most like them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.similarity import diversified, nearest_vectors, spaced

#: Bars ahead, weights of likeness and consistency, matches of a code.
HORIZONS = (7, 14, 30, 90)
LIKENESS, CONSISTENCY = 0.7, 0.3
MATCHES = 5


def _rising(horizons: tuple[int, ...]) -> Column:
    """Share of the known returns ahead that are above 0; 0 if none is known."""
    known = F.array_compact(F.array(*(f"d{h}" for h in horizons)))
    return F.coalesce(F.try_divide(F.size(F.filter(known, lambda x: x > 0)), F.size(known)), F.lit(0.0))


def golden(cases: DataFrame, gain: float = 0.2, days: int = 30, most: int = 20, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The templates among (code, date, vector, d7, d14, d30, d90), with consistency, the share of their known returns that are above 0.

    Cases that gain at least `gain` in 30 bars, whose vector is not zero; of a code none within `days` days after one that
    is kept, and then the `most` most consistent (ties: the earliest).
    """
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x))
    rose = cases.filter((F.col("d30") >= gain) & (size > 1e-6))
    kept = spaced(rose, days - 1).withColumn("consistency", _rising(horizons))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("consistency"), "date"))
    return kept.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def scan(templates: DataFrame, today: DataFrame, weights: list[float], k: int = 15, per_industry: int = 3, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The k codes of `today` (code, industry, vector; a row a code) most like golden() templates, at most `per_industry` of an industry.

    A code's MATCHES most like templates by weighted cosine give its similarity and consistency (means), score, hit_rate (share
    of matches all of whose known returns are above 0) and median_d30. Codes like no template are left out; a code with
    fewer matches is judged by those. Codes are compared with templates block by block.
    """
    weigh = lambda: F.transform("vector", lambda x, i: x * F.get(F.array(*(F.lit(float(w)) for w in weights)), i))
    # Ids of templates are above 0, those of today's codes below.
    known = templates.withColumn("id", F.col("code").cast("long") * 100000 + F.datediff("date", F.lit("1970-01-01").cast("date")))
    asked = today.select((-F.col("code").cast("long") - 1).alias("id"), weigh().alias("v"))
    found = nearest_vectors(known.select("id", weigh().alias("v")), asked, MATCHES, key="id", vector="v")
    ahead = F.array_compact(F.array(*(f"d{h}" for h in horizons)))
    ends = known.select("id", "consistency", "d30", F.forall(ahead, lambda x: x > 0).alias("hit"))
    per = found.join(ends, "id").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("matches"), F.avg("similarity").alias("similarity"), F.avg("consistency").alias("consistency"), F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("hit_rate"), F.median("d30").alias("median_d30")
    )
    scored = per.withColumns({"code": -F.col("query_id") - 1, "score": F.round(F.col("similarity") * LIKENESS + F.col("consistency") * CONSISTENCY, 9)}).drop("query_id")
    return diversified(scored.join(today.select(F.col("code").cast("long").alias("code"), "industry"), "code"), "score", "industry", per_industry, k, "code")

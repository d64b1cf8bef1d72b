"""DNA match: today's codes against past winners and losers, by features first and by the shape of prices then."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.similarity import nearest_vectors

#: Neighbours, the mean likeness of a match, bars of both shapes, weights of likeness and shape, the boost where
#: both shapes agree, and the share of losers that warns.
NEIGHBOURS, MATCH = 5, 0.85
STRUCTURE, MOMENTUM = 60, 20
LIKENESS, SHAPE = 0.7, 0.3
BOOST, LOSERS = 1.5, 0.6


def closes(bars: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """`wanted` (key, code, date, a bar's date, and back) with closes: those of the last n bars but for the `back` newest, up to that date, oldest first.

    Each wanted row meets just these bars, by equality of code and row number. Rows without any are left out.
    """
    rows = bars.select("code", "date", "close", F.row_number().over(Window.partitionBy("code").orderBy("date")).alias("_row"))
    at = wanted.join(rows.drop("close"), ["code", "date"]).select("key", "code", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("_row") - F.col("back") - k)).alias("_row"))
    found = at.join(rows.select("code", "_row", "close"), ["code", "_row"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_row", "close"))).alias("x"))
    return found.select("key", F.transform("x", lambda x: x["close"]).alias("closes"))


def normalised_shape(series: np.ndarray) -> np.ndarray:
    """Prices as z-scores of the series; a flat one is all zeros."""
    deviation = series.std()
    return np.zeros_like(series) if deviation < 1e-8 else (series - series.mean()) / deviation


def warped_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping of the pairs of rows of two matrices of one shape, over the series' length: all pairs at once."""
    pairs, n = a.shape
    before = np.full((n + 1, pairs), np.inf)
    before[0] = 0.0
    for i in range(n):
        now = np.full((n + 1, pairs), np.inf)
        cost = np.abs(a[:, i : i + 1] - b).T
        least = np.minimum(before[1:], before[:-1])
        for j in range(n):
            now[j + 1] = cost[j] + np.minimum(least[j], now[j])
        before = now
    return before[n] / n


def _warped(ours: list[np.ndarray], theirs: list[np.ndarray], least: int) -> list[float | None]:
    """Distances of pairs of shapes, compared over the newest bars that both have; none for theirs of fewer than `least` bars."""
    out: list[float | None] = [None] * len(ours)
    size = np.array([min(len(x), len(y)) if len(y) >= least else 0 for x, y in zip(ours, theirs, strict=True)], int)
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        found = warped_distances(np.array([normalised_shape(ours[i])[-n:] for i in at]), np.array([normalised_shape(theirs[i])[-n:] for i in at]))
        for i, x in zip(at.tolist(), found.tolist(), strict=True):
            out[i] = x
    return out


def shape_distances(pairs: DataFrame) -> DataFrame:
    """query, place, dtw_60, dtw_20 of (query, place, ours, theirs): closes, oldest first. Null where theirs are too short, or ours shorter than 60."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            long = [len(x) >= STRUCTURE and len(y) >= MOMENTUM for x, y in zip(batch["ours"], batch["theirs"], strict=True)]
            ours, theirs = ([np.asarray(x, float) if ok else np.zeros(0) for x, ok in zip(batch[c], long, strict=True)] for c in ("ours", "theirs"))
            cut = lambda xs, n: [x[-n:] for x in xs]
            yield pd.DataFrame({
                "query": batch["query"], "place": batch["place"],
                "dtw_60": _warped(cut(ours, STRUCTURE), cut(theirs, STRUCTURE), MOMENTUM), "dtw_20": _warped(cut(ours, MOMENTUM), cut(theirs, MOMENTUM), MOMENTUM // 2),
            }).astype({"dtw_60": float, "dtw_20": float})

    out = pairs.select("query", "place", "ours", "theirs").mapInPandas(f, "query long, place int, dtw_60 double, dtw_20 double")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("query", "place", known("dtw_60"), known("dtw_20"))


def neighbours(samples: DataFrame, today: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """query (a code of `today`: code, vector), place, similarity and the sample (code, date, label, cluster) of its k nearest by cosine.

    Samples of the same code count too, but for the day itself; ties go to the earlier number of code and date.
    """
    number = F.col("code").cast("long") * 100_000 + F.datediff("date", F.lit("1970-01-01").cast("date"))
    known = samples.withColumn("id", number)
    asked = today.select((-F.col("code").cast("long") - 1).alias("id"), F.col("vector").alias("v"))  # below 0, where no sample is
    found = nearest_vectors(known.select("id", F.col("vector").alias("v")), asked, k, key="id", vector="v")
    return found.select((-F.col("query_id") - 1).alias("query"), "id", F.col("place").cast("int").alias("place"), "similarity").join(known.select("id", "code", "date", "label", "cluster"), "id").drop("id")


def match(samples: DataFrame, today: DataFrame, bars: DataFrame, k: int = NEIGHBOURS, threshold: float = MATCH) -> DataFrame:
    """Per code of `today` (code, date, vector; a row a code) that is like any sample: how it matches past winners and losers.

    cluster is what most of its k neighbours are of (the nearest one's of equally many), similarity their mean, failed_ratio
    the share of losers among them, warning where that reaches `LOSERS`. From `threshold` on it is a match: its last 60 and
    20 closes are warped onto those before each neighbour's day, and final blends likeness and shape, times `BOOST` (1 at
    most) where both mean distances are below 1. Codes of fewer than 60 bars match by features alone.
    """
    near = neighbours(samples, today, k)
    votes = near.groupBy("query", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    best = votes.groupBy("query").agg(F.max(F.struct("n", (-F.col("first")).alias("first"), "cluster"))["cluster"].alias("cluster"))
    per = near.groupBy("query").agg(F.avg("similarity").alias("similarity"), F.avg(F.when(F.col("label") == "loser", 1.0).otherwise(0.0)).alias("failed_ratio"), F.count(F.lit(1)).alias("neighbours")).join(best, "query")
    per = per.withColumns({"is_match": F.round("similarity", 9) >= threshold, "warning": F.round("failed_ratio", 9) >= LOSERS})
    matched = near.join(per.filter("is_match").select("query"), "query")
    # Place 0 is the code's own shape: both kinds meet the bars in one pass.
    asked = today.select(F.col("code").cast("long").alias("query"), "code", "date").join(per.filter("is_match").select("query"), "query")
    key = F.struct("query", "place").alias("key")
    wanted = matched.select(key, "code", "date", F.lit(1).alias("back")).unionByName(asked.withColumn("place", F.lit(0)).select(key, "code", "date", F.lit(0).alias("back")))
    found = closes(bars, wanted, STRUCTURE).select("key.query", F.struct("key.place", "closes").alias("shape"))
    each = found.groupBy("query").agg(F.collect_list("shape").alias("x"))
    each = each.select("query", F.get(F.filter("x", lambda x: x["place"] == 0), F.lit(0))["closes"].alias("ours"), F.explode(F.filter("x", lambda x: x["place"] > 0)).alias("shape"))
    pairs = each.select("query", "shape.place", "ours", F.col("shape.closes").alias("theirs")).filter("ours IS NOT NULL")
    shapes = shape_distances(pairs).groupBy("query").agg(F.avg("dtw_60").alias("dtw_60"), F.avg("dtw_20").alias("dtw_20"))
    out = per.join(shapes, "query", "left")
    shape: Column = F.when(F.coalesce("dtw_60", F.lit(0.0)) > 0, 1 / (1 + F.col("dtw_60"))).otherwise(1.0)
    agree = F.coalesce((F.col("dtw_60") < 1) & (F.col("dtw_20") < 1), F.lit(False))
    blended = LIKENESS * F.col("similarity") + SHAPE * shape
    final = F.when(~F.col("is_match"), F.col("similarity")).when(agree, F.least(F.lit(1.0), blended * BOOST)).otherwise(blended)
    return out.select(F.col("query").alias("code"), "neighbours", "cluster", "similarity", "failed_ratio", "warning", "is_match", "dtw_60", "dtw_20", agree.alias("agree"), final.alias("final"))

"""Cases: earlier situations most like one of today, and groups of situations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(cases: DataFrame, asked: DataFrame, k: int = 10, least: float = 0.5, half_life_days: float = 730.0) -> DataFrame:
    """The k earlier cases (code, date, vector) of other codes most like the one row of `asked`.

    Cases at least `least` alike are ranked by likeness that halves with age; of the best 3k the best of a code and month stay.
    """
    one = asked.limit(1).select(F.col("code").alias("own"), F.col("date").alias("today"), F.col("vector").alias("wanted"))
    both = cases.crossJoin(F.broadcast(one)).filter((F.col("code") != F.col("own")) & (F.col("date") < F.col("today")))  # one row
    scored = both.withColumn("similarity", F.greatest(F.lit(0.0), F.least(_cosine(F.col("vector"), F.col("wanted")), F.lit(1.0)))).filter(F.col("similarity") >= least)
    scored = scored.withColumn("score", F.col("similarity") * F.pow(F.lit(2.0), -F.datediff("today", "date") / F.lit(half_life_days)))
    best = scored.select("code", "date", "similarity", "score").orderBy(F.desc("score"), "code", "date").limit(3 * k)
    place = F.row_number().over(Window.partitionBy("code", F.trunc("date", "MM")).orderBy(F.desc("score"), "date"))
    return best.withColumn("_place", place).filter("_place = 1").drop("_place").orderBy(F.desc("score"), "code", "date").limit(k)


def profile(rows: DataFrame, label: str, vector: str, confident: int = 30) -> DataFrame:
    """Per label: rows, the mean vector's three largest places by size, and whether there are enough rows to trust it; -1 is noise."""
    long = rows.filter(F.col(label) != -1).select(label, F.posexplode(vector).alias("place", "x"))
    mean = long.groupBy(label, "place").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    top = F.slice(F.sort_array(F.collect_list(F.struct(F.abs(F.round("mean", 9)).alias("size"), "place")), False), 1, 3)
    return mean.groupBy(label).agg(F.max("n").alias("n"), F.array_join(F.transform(top, lambda x: x["place"].cast("string")), ",").alias("top_places")).withColumn("confident", F.col("n") >= confident)


def clusters(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", reduced: int = 8) -> DataFrame:
    """key, cluster of k-means over the principal components."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    flat = PCA(k=reduced, inputCol="v", outputCol="r").fit(rows).transform(rows)
    model = KMeans(k=k, featuresCol="r", predictionCol="cluster", seed=7).fit(flat)
    return model.transform(flat).select(key, "cluster")

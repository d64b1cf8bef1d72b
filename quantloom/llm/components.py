"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(node, comp), stored, of every node of `links` (a, b: long): the least node that can be reached.

    In each round every component takes the least label next to it, chains are shortened, and links inside a component
    end; the rest, between components, are what the next round reads. Nothing is collected; each round is stored.
    """
    edges = shared.stored(links.select("a", "b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    while True:
        hooks = edges.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).groupBy("c").agg(F.min("p").alias("p"))
        up = hooks.select(F.col("c").alias("p"), F.col("p").alias("q"))
        for _ in range(2):
            hooks = hooks.join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p"))
        hooks = shared.stored(hooks, "hooks")
        to, done = hooks.select(F.col("c").alias("comp"), "p"), [edges, hooks, *([labels] if hasattr(labels, "_stored_at") else [])]
        labels = shared.stored(labels.join(to, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            edges = edges.join(hooks.select(F.col("c").alias(end), "p"), end, "left").withColumn(end, F.coalesce("p", end)).drop("p")
        edges = shared.stored(edges.filter("a <> b").distinct(), "edges")
        shared.discard(*done)
        if edges.isEmpty():
            return labels

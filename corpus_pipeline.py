"""A training corpus from `documents`: quality, line dedup, near duplicates, decontamination, packing.

Each stage reads what the one before it has kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import shared
from quantloom.llm.decontaminate import drop_contaminated
from quantloom.llm.jaccard import keep_one
from quantloom.llm.lines import drop_recurring_lines
from quantloom.llm.packing import pack
from quantloom.llm.quality import keep_passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the strict policy of the quality rules go.

    Null, empty and blank texts fail it. Rows that repeat an id are judged each by its own text; null ids make no difference.
    """
    return keep_passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay at their first place only; n_chars follows the text. Nothing is exempt.

    So copies lose what stands in another document first, and near copies keep the lines that are their own. A document left
    without a word goes: all of its lines have another place. Null texts stay. Rows of equal id and text are one document
    and stay or change alike; null ids come after all others.
    """
    out = drop_recurring_lines(docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id.

    Groups are linked at a similarity of 0.8 of five-word shingles of what the stage before has left, so copies that share less
    stay. An id is one document: its rows stay or go together, and go if any of them links to a smaller id. Null and empty
    texts, and rows of a null id, stay.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Passages are exact; proximity matches do not reject. Null and empty texts stay; rows that repeat an id are judged each
    by its own text; an empty benchmark keeps all.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its place in a sequence. Null and empty texts are a piece of one id; each row is a document of its own."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stored(docs, name)
    return docs

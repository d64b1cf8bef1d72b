"""Raw files: positional JSON rows, text numbers, minguo dates, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """"1,234.56" as 1234.56 and "3.16%" as 0.0316; null for "-", "--", blanks and what is no number."""
    plain = F.regexp_replace(F.trim(text), "[,%\\s]", "")
    value = plain.try_cast("double")
    return F.when(F.endswith(F.trim(text), F.lit("%")), value / 100).otherwise(value)


def minguo_date(text: Column) -> Column:
    """"115/02/13" as 2026-02-13; null for what is no date."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{2,3})/(\d{1,2})/(\d{1,2})\s*$", i).try_cast("int")
    iso = F.concat_ws("-", (part(1) + 1911).cast("string"), F.lpad(part(2).cast("string"), 2, "0"), F.lpad(part(3).cast("string"), 2, "0"))
    return F.when(part(1).isNotNull(), iso.try_cast("date"))


def positional(spark: SparkSession, path: str, fields: dict[str, int], name: str = r"(\d{8})") -> DataFrame:
    """Files of {"data": [[...], ...]}: a row per inner array, `fields` by place, all but `code` as numbers; the date from the file's name."""
    raw = spark.read.schema("data array<array<string>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("data").alias("row"), F.to_date(F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), name, 1), "yyyyMMdd").alias("date"))
    cell = lambda k, i: F.trim(F.get("row", F.lit(i))) if k == "code" else number(F.get("row", F.lit(i)))
    return rows.select("date", *(cell(k, i).alias(k) for k, i in fields.items()))


def not_yet(wanted: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be fetched: rows of `wanted` whose keys the fetch log lacks."""
    return wanted.join(log.select(*keys).distinct(), keys, "left_anti")


def fetch_stats(log: DataFrame) -> DataFrame:
    """Per source and market: first and last date, and files."""
    return log.groupBy("source", "market").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("files"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; not-a-number and infinite values as empty cells."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    df.select(*(finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes)).write.mode("errorifexists").option("header", True).csv(path)


def first_known(frames: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key with each column from the first frame that has it: layered sources by priority. Keys are unique within a frame."""
    ranked = None
    for k, frame in enumerate(frames):
        part = frame.select(*keys, *columns, F.lit(k).alias("_layer"))
        ranked = part if ranked is None else ranked.unionByName(part)
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_layer"))).alias(c) for c in columns]
    return ranked.groupBy(*keys).agg(*pick)

"""Streams of quotes: bars, last values and alerts in event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ticks(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(event_id, code, ts, kind, price, props) from Parquet files as they arrive in a folder."""
    raw = spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)
    return quotes(raw)


def quotes(raw: DataFrame) -> DataFrame:
    return raw.select("event_id", F.col("user_id").alias("code"), "ts", F.col("event_type").alias("kind"), F.col("value").alias("price"), "props")


def ohlc(stream: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling bars per code of ticks that are at most `late` behind; a tick that comes twice counts once."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if stream.isStreaming else stream.dropDuplicates(["event_id"])
    at = F.struct("ts", "event_id")
    bars = once.groupBy("code", F.window("ts", every)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("ticks")
    )
    return bars.select("code", F.col("window.start").alias("start"), "open", "high", "low", "close", "ticks")


def sessions(stream: DataFrame, gap: str = "2 days", late: str = "1 day") -> DataFrame:
    """Runs of a code's ticks with no longer pause than `gap`."""
    marked = stream.withWatermark("ts", late) if stream.isStreaming else stream
    out = marked.groupBy("code", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("ticks"), F.sum("price").alias("turnover"))
    return out.select("code", F.col("session_window.start").alias("start"), "ticks", "turnover")


def last_quotes(stream: DataFrame) -> DataFrame:
    """The newest price of each code, for update or complete mode."""
    return stream.groupBy("code").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))


_ALERTS = "code long, ts timestamp, price double"


def _cooled(hours: float):
    pause = pd.Timedelta(hours=hours)

    def fire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ts, price in zip(rows["ts"], rows["price"], strict=True):
            if last is None or ts - last >= pause:
                out.append((key[0], ts, price))
                last = ts
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["code", "ts", "price"])

    return fire


def alerts(stream: DataFrame, condition: str, hours: float = 24.0) -> DataFrame:
    """Ticks that meet a SQL condition, not more often per code than once in so many hours; the last alert is a code's state."""
    return stream.filter(condition).select("code", "event_id", "ts", "price").groupBy("code").applyInPandasWithState(_cooled(hours), _ALERTS, "last timestamp", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, mode: str = "append", **options: Any) -> DataFrame:
    """Runs a stream over all that has arrived into Parquet below `path`, with its checkpoint beside, and reads the result."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")

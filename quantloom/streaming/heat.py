"""Changes of heat and maturity from one scan to the next, over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A change that counts, a ratio that is a jump, the least heat it is taken from, volume that confirms it, ranks of maturity.
STEP, JUMP, FLOOR, BUSY = 0.1, 2.0, 0.05, 1.2
RANKS = {"Speculative Spike": 1, "Trend Formation": 2, "Structural Shift": 3}


def momentum(now: Column, before: Column, volume: Column) -> Column:
    """new, surge (a jump on volume), heating, cooling or stable."""
    delta = F.round(now - before, 9)
    jump = (F.round(now / F.greatest(before, F.lit(FLOOR)), 9) >= JUMP) & (F.coalesce(volume, F.lit(0.0)) >= BUSY)
    return F.when(before.isNull(), "new").when((delta >= STEP) & jump, "surge").when(delta >= STEP, "heating").when(delta <= -STEP, "cooling").otherwise("stable")


def heat_changes(scans: DataFrame) -> DataFrame:
    """`scans` (sector, ts, heat, volume) with delta, jump and momentum against the sector's scan before; 0 and 'new' for its first."""
    before = F.lag("heat").over(Window.partitionBy("sector").orderBy("ts"))
    rows = scans.withColumn("_before", before)
    zero = lambda x: F.when(F.col("_before").isNull(), 0.0).otherwise(x)
    return rows.select("sector", "ts", "heat", zero(F.col("heat") - F.col("_before")).alias("delta"), zero(F.col("heat") / F.greatest("_before", F.lit(FLOOR))).alias("jump"), momentum(F.col("heat"), F.col("_before"), F.col("volume")).alias("momentum"))


def maturity_rises(scans: DataFrame) -> DataFrame:
    """code, ts, from and to: scans (code, ts, signal, maturity) of a BUY whose maturity ranks above that of the code's scan before."""
    rank = lambda c: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in RANKS.items()), F.lit(0))
    rows = scans.withColumn("_before", F.lag(F.coalesce("maturity", F.lit("N/A"))).over(Window.partitionBy("code").orderBy("ts")))
    return rows.filter((F.col("signal") == "BUY") & F.col("_before").isNotNull() & (rank("maturity") > rank("_before"))).select("code", "ts", F.col("_before").alias("from"), F.col("maturity").alias("to"))


_CHANGES = "sector string, ts timestamp, heat double, before double, volume double"


def heat_stream(stream: DataFrame, late: str = "1 day", expire: str = "90 days") -> DataFrame:
    """heat_changes() of a stream: a sector's last scan is its state, which is forgotten once the watermark is `expire` beyond it.

    Scans that arrive after a later one of their sector are left out.
    """
    keep = pd.Timedelta(expire)

    def change(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("ts").itertuples():
            if last is None or r.ts > pd.Timestamp(last[0]):
                out.append((key[0], r.ts, r.heat, None if last is None else last[1], r.volume))
                last = (r.ts.to_pydatetime(), float(r.heat))
        state.update(last)
        expires = int((pd.Timestamp(last[0]) + keep).timestamp() * 1000)
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["sector", "ts", "heat", "before", "volume"]).astype({"before": float})

    found = stream.withWatermark("ts", late).groupBy("sector").applyInPandasWithState(change, _CHANGES, "ts timestamp, heat double", "append", GroupStateTimeout.EventTimeTimeout)
    before = F.when(~F.isnan("before"), F.col("before"))
    zero = lambda x: F.when(before.isNull(), 0.0).otherwise(x)
    return found.select("sector", "ts", "heat", zero(F.col("heat") - before).alias("delta"), zero(F.col("heat") / F.greatest(before, F.lit(FLOOR))).alias("jump"), momentum(F.col("heat"), before, F.col("volume")).alias("momentum"))

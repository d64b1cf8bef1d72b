"""Backtests: positions that hang on positions before them, one instrument a group; everything around them is native."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import history
from quantloom.operators.indicators import ROWS, _whole_codes
from quantloom.operators.signals import trend_signals


@dataclass(frozen=True)
class Costs:
    """Shares of the turnover: commission on both sides, tax on sales, slippage on both."""

    commission: float = 0.001425
    tax: float = 0.003
    slippage: float = 0.001


@dataclass(frozen=True)
class Exits:
    """Profit target, stop, trailing stop (shares of the entry, and of the peak), least days held, days held at most."""

    take_profit: float = 0.10
    stop_loss: float = 0.07
    trail: float = 0.02
    min_hold: int = 5
    max_hold: int = 60


def round_trip(entry: Column, exit_: Column, costs: Costs = Costs()) -> Column:
    """Net return of buying at one price and selling at another."""
    paid = entry * (1 + costs.slippage) * (1 + costs.commission)
    got = exit_ * (1 - costs.slippage) * (1 - costs.commission - costs.tax)
    return F.try_divide(got, paid) - 1


_TRADES = "code long, entry_date date, entry double, exit_date date, exit double, held long, reason string"


def _one(exits: Exits, high: np.ndarray, low: np.ndarray, close: np.ndarray, buys: np.ndarray, sells: np.ndarray) -> Iterator[tuple[int, int, float, str]]:
    """Row of entry, row of exit, price and reason of each trade of one code's bars; between trades only its BUY rows are read."""
    i, last = 0, len(close) - 1
    while (at := int(np.searchsorted(buys, i))) < len(buys) and buys[at] < last:
        entry = int(buys[at])
        price = peak = float(close[entry])
        for i in range(entry + 1, last + 1):
            held, top, bottom, now = i - entry, float(high[i]), float(low[i]), float(close[i])
            peak = max(peak, top)
            stop, reason = price * (1 - exits.stop_loss), "stop"
            if peak * (1 - exits.trail) > max(stop, price):
                stop, reason = peak * (1 - exits.trail), "trail"
            target, got = price * (1 + exits.take_profit), None
            if held >= exits.min_hold:
                hit_stop, hit_target = bottom <= stop, top >= target
                if hit_target and (not hit_stop or now >= price):
                    got, reason = target, "target"
                elif hit_stop:
                    got = min(stop, top)
                elif sells[i]:
                    got, reason = now, "signal"
                elif held >= exits.max_hold:
                    got, reason = now, "time"
            if got is None and i == last:
                got, reason = now, "end"
            if got is not None:
                yield entry, i, got, reason
                break
        i += 1


def _trades(exits: Exits, table: pa.Table) -> pa.RecordBatch:
    """Trades of whole codes, one after another (_i counts a code's bars)."""
    first = np.flatnonzero(table["_i"].to_numpy() == 1)
    codes, dates = table["code"], table["date"]
    high, low, close = (table[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("high", "low", "close"))
    side = table["_side"].to_numpy()
    entries, exits_at, prices, reasons = [], [], [], []
    for start, end in zip(first.tolist(), [*first[1:].tolist(), len(side)], strict=True):
        buys = np.flatnonzero(side[start:end] == 1)
        if len(buys):
            for entry, at, price, reason in _one(exits, high[start:end], low[start:end], close[start:end], buys, side[start:end] == -1):
                entries.append(start + entry)
                exits_at.append(start + at)
                prices.append(price)
                reasons.append(reason)
    a, b = np.array(entries, np.int64), np.array(exits_at, np.int64)
    columns = [codes.take(a), dates.take(a), pa.array(close[a]), dates.take(b), pa.array(prices, pa.float64()), pa.array(b - a), pa.array(reasons, pa.string())]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[x.split()[0] for x in _TRADES.split(", ")])


def run(signals: DataFrame, exits: Exits = Exits()) -> DataFrame:
    """Trades of one position at a time per code from (code, date, high, low, close, signal).

    Entry at the close of a BUY. Each bar raises the peak before its low is tested; of a target and a stop on one bar the
    target counts if the close is not below the entry; what is open at the end is closed there. A code's bars stay together, some thousands at most.
    """
    side = F.when(F.col("signal") == "BUY", 1).when(F.col("signal") == "SELL", -1).otherwise(0).cast("byte").alias("_side")

    def traded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_codes(batches, ROWS):
            yield _trades(exits, table)

    rows = signals.select(F.col("code").cast("long").alias("code"), "date", "high", "low", "close", side)
    return rows.withColumn("_i", F.row_number().over(history())).mapInArrow(traded, _TRADES)


def results(trades: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Trades with their net return."""
    return trades.withColumn("ret", round_trip(F.col("entry"), F.col("exit"), costs))


def summary(trades: DataFrame, *by: str) -> DataFrame:
    """Count, win rate, mean and total log return, profit factor, per group or overall, of results()."""
    up, down = F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)), -F.sum(F.when(F.col("ret") <= 0, F.col("ret")).otherwise(0.0))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("ret").alias("mean_ret"), F.sum(F.log1p("ret")).alias("log_ret"), F.coalesce(F.try_divide(up, down), F.lit(999.0)).alias("profit_factor"), F.avg("held").alias("mean_held")
    )


def grid(bars: DataFrame, choices: list[Exits]) -> DataFrame:
    """summary() for each set of exit rules, signals computed once; `zone` marks islands and deserts by deviation from the mean."""
    signals = trend_signals(bars)
    parts = [results(run(signals, x)).withColumns({"take_profit": F.lit(x.take_profit), "stop_loss": F.lit(x.stop_loss)}) for x in choices]
    all_trades = parts[0]
    for part in parts[1:]:
        all_trades = all_trades.unionByName(part)
    out = summary(all_trades, "take_profit", "stop_loss")
    stats = out.agg(F.avg("mean_ret").alias("m"), F.stddev_pop("mean_ret").alias("s"))
    z = F.try_divide(F.col("mean_ret") - F.col("m"), F.col("s"))
    return out.crossJoin(F.broadcast(stats)).withColumn("zone", F.when(z > 1.5, "island").when(z < -0.5, "desert").otherwise("plain")).drop("m", "s")  # stats: one row


def equity(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Per code and bar the equity of results() that starts at 1: trades count at their exit."""
    from pyspark.sql import Window

    closed = trades.groupBy("code", F.col("exit_date").alias("date")).agg(F.sum(F.log1p("ret")).alias("gain"))
    w = Window.partitionBy("code").orderBy("date")
    return bars.select("code", "date").join(closed, ["code", "date"], "left").select("code", "date", F.exp(F.sum(F.coalesce("gain", F.lit(0.0))).over(w)).alias("equity"))

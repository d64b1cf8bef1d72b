"""The registry of winning brokers: how well what they bought did, how sure that is, and the tiers that follow."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.joins import by_day

#: Score and lower bounds that tiers ask for, purchases a broker needs, buyers of a code's month, share of one sector.
SCORE, TIER_1, TIER_2 = 1.1, 1.0, 0.7
LEAST, BUYERS, ONE_SECTOR = 15, 5, 0.5
DRAWS = 1000
#: A prime below 2**31, so that squares of numbers below it fit into 64 bits.
_PRIME = 2_147_483_647
#: What numbers are multiplied by before they are added up, and what each round of squaring adds.
_FACTORS, _ROUNDS = (7919, 104_729, 15_485_863, 49_979_687), (12_345, 67_891)
#: Cumulative probabilities of 0, 1, 2... for the Poisson distribution of mean 1.
POISSON = tuple(round(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)), 15) for k in range(12))


def monthly_buyers(flows: DataFrame, most: int = BUYERS) -> DataFrame:
    """code, broker, date (the month's last day), net: the largest net buyers of each code and month, `most` of them at most."""
    months = flows.groupBy("code", "broker", F.last_day("date").alias("date")).agg(F.sum(F.col("buy") - F.col("sell")).alias("net")).filter("net > 0")
    place = F.row_number().over(Window.partitionBy("code", "date").orderBy(F.desc("net"), "broker"))
    return months.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def purchases(flows: DataFrame, forward: DataFrame, sectors: DataFrame, horizon: str = "d21", days: int = 5, most: int = BUYERS) -> DataFrame:
    """code, broker, date, sector, ret: monthly_buyers() with what followed, from the code's bar nearest to the month's end, `days` away at most."""
    known = forward.select("code", F.col("date").alias("bar"), F.col(horizon).alias("ret")).filter("ret IS NOT NULL")
    found = by_day(monthly_buyers(flows, most), near_month_ends(known, days)).filter("ret IS NOT NULL")
    return found.join(sectors.select("code", "sector"), "code", "left").select("code", "broker", "date", F.coalesce("sector", F.lit("unknown")).alias("sector"), "ret")


def near_month_ends(known: DataFrame, days: int) -> DataFrame:
    """code, date (a month's last day) and ret of the row of `known` (code, bar, ret) that is nearest, `days` (less than a month) away at most; the earlier of two.

    Each row goes to the month's ends around it, so they are aggregated by code: nothing is carried along a code's rows.
    """
    if days >= 28:
        raise ValueError("a row meets the ends of its month and of the one before only")
    ends = known.withColumn("date", F.explode(F.array(F.last_day("bar"), F.last_day(F.add_months("bar", -1))))).withColumn("_gap", F.abs(F.datediff("bar", "date"))).filter(F.col("_gap") <= days)
    return ends.groupBy("code", "date").agg(F.min_by("ret", F.struct("_gap", "bar")).alias("ret"))


def _score(n: Column, wins: Column, gain: Column, loss: Column) -> Column:
    """Win rate times the mean gain over the mean loss; a mean loss of 0.001 stands for none at all."""
    rate, losses = F.try_divide(wins, n), n - wins
    profit = F.coalesce(F.try_divide(gain, wins), F.lit(0.0))
    mean_loss = F.when(losses > 0, F.abs(loss / losses)).otherwise(0.001)
    return F.when(mean_loss > 1e-6, rate * profit / mean_loss).otherwise(rate * profit * 100)


def _start(*numbers: Column, seed: int = 42) -> Column:
    return sum((F.pmod(F.col(c) if isinstance(c, str) else c, F.lit(_PRIME).cast("long")) * f for c, f in zip(numbers, _FACTORS, strict=False)), F.lit(seed).cast("long")) % _PRIME


def uniform(*numbers: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that hangs on integers alone: two rounds of squaring modulo a prime, the same in every engine."""
    x = _start(*numbers, seed=seed)
    for k in _ROUNDS:
        x = (x * x + x * 48_271 % _PRIME + k) % _PRIME
    return x / float(_PRIME)


def _weights(x: np.ndarray) -> np.ndarray:
    """How often a purchase counts by its number below the prime: the POISSON steps that number over the prime reaches."""
    w = _STEPS_OF[x >> 15]
    cut = np.flatnonzero(w.ravel() < 0)  # parts of the range that a step cuts
    if len(cut):
        w.ravel()[cut] = np.searchsorted(_STEPS, x.ravel()[cut], side="right")
    return w


#: The least numbers over the prime that reach each step, and the steps that numbers equal but for their last 15 bits reach; -1 where those differ.
_STEPS = np.array([next(x for x in range(int(p * _PRIME) - 2, _PRIME + 1) if x / float(_PRIME) >= p) for p in POISSON], np.int64)
_STEPS_OF = np.searchsorted(_STEPS, np.arange(1 << 16, dtype=np.int64) << 15, side="right").astype(np.int8)
_STEPS_OF[_STEPS >> 15] = -1
#: Purchases whose draws are taken at once, and brokers whose sums a task keeps before it sends them on.
CHUNK, KEPT = 64, 256


def _folded(x: np.ndarray, times: int) -> np.ndarray:
    """Numbers below 2**63 with their high bits added to the low ones, in place: the same modulo the prime 2**31 - 1, and after two times no more than 2 above it."""
    for _ in range(times):
        high = x >> 31
        x &= _PRIME
        x += high
    return x


def resampled(start: np.ndarray, ret: np.ndarray, draws: int) -> np.ndarray:
    """For purchases of one broker, 4 rows of `draws` sums: times counted, times counted with a gain, gains and losses.

    `start` is uniform()'s sum but for the draw's share, modulo the prime; the draws of some purchases at a time are one matrix.
    """
    share = np.arange(1, draws + 1, dtype=np.int64) * _FACTORS[3] % _PRIME
    won = ret > 0
    values = np.stack([np.ones(len(ret)), won.astype(float), np.where(won, ret, 0.0), np.where(won, 0.0, ret)])
    out = np.zeros((4, draws))
    for i in range(0, len(ret), CHUNK):
        x = _folded(start[i : i + CHUNK, None] + share, 1)
        for k in _ROUNDS:
            x *= x + 48_271
            x += k
            x = _folded(x, 2)
        np.subtract(x, _PRIME, out=x, where=x >= _PRIME)
        out += values[:, i : i + CHUNK] @ _weights(x).astype(float)
    return out


def intervals(bought: DataFrame, draws: int = DRAWS) -> DataFrame:
    """broker, ci_low, ci_high: the 2.5 and 97.5 percentiles of the score over `draws` resamples of its purchases.

    Each purchase counts 0, 1, 2... times in a draw, by the Poisson distribution and a number that broker, code, date and draw
    fix (uniform()). A task adds up its purchases' draws as matrices and sends on one row a broker and draw, so neither a
    purchase's draws are shuffled nor do a broker's purchases meet in one task.
    """
    start = _start(F.col("broker").cast("long"), F.col("code").cast("long"), F.unix_date("date").cast("long"))
    rows = bought.select("broker", start.alias("start"), F.col("ret").cast("double").alias("ret"))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        numbers = np.arange(1, draws + 1)
        sent = lambda: (pd.DataFrame({"broker": b, "draw": numbers, "n": x[0], "wins": x[1], "gain": x[2], "loss": x[3]}) for b, x in sums.items())
        for batch in batches:
            for broker, own in batch.groupby("broker", sort=False):
                if broker not in sums and len(sums) >= KEPT:
                    yield from sent()
                    sums.clear()
                sums[broker] = sums.get(broker, 0.0) + resampled(own["start"].to_numpy(np.int64), own["ret"].to_numpy(float), draws)
        yield from sent()

    kind = dict(bought.dtypes)["broker"]
    each = rows.mapInPandas(added, f"broker {kind}, draw int, n double, wins double, gain double, loss double")
    each = each.groupBy("broker", "draw").agg(*(F.sum(c).alias(c) for c in ("n", "wins", "gain", "loss")))
    scores = each.select("broker", F.coalesce(_score(F.col("n"), F.col("wins"), F.col("gain"), F.col("loss")), F.lit(0.0)).alias("score"))
    return scores.groupBy("broker").agg(F.percentile("score", F.lit(0.025)).alias("ci_low"), F.percentile("score", F.lit(0.975)).alias("ci_high"))


def registry(bought: DataFrame, least: int = LEAST, score: float = SCORE, tier_1: float = TIER_1, tier_2: float = TIER_2, draws: int = DRAWS) -> DataFrame:
    """Per broker of `least` purchases: n, codes, win_rate, avg_profit, avg_loss, score, ci_low, ci_high, sectors, hhi, top_share, ghost_bias, discount, tier.

    A tier needs the score; 1 needs a lower bound of `tier_1`, 2 of `tier_2`; brokers of neither have null. Brokers of one
    sector, by more than half, have ghost_bias and count half.
    """
    won = F.col("ret") > 0
    per = bought.groupBy("broker", "sector").agg(F.count(F.lit(1)).alias("n"), F.sum(won.cast("int")).alias("wins"), F.sum(F.when(won, F.col("ret")).otherwise(0.0)).alias("gain"), F.sum(F.when(won, 0.0).otherwise(F.col("ret"))).alias("loss"))
    per = per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("broker")))
    sums = per.groupBy("broker").agg(*(F.sum(c).alias(c) for c in ("n", "wins", "gain", "loss")), F.count(F.lit(1)).alias("sectors"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top_share")).filter(F.col("n") >= least)
    codes = bought.groupBy("broker").agg(F.count_distinct("code").alias("codes"))
    out = sums.join(codes, "broker").join(intervals(bought, draws), "broker")
    out = out.withColumns({"win_rate": F.col("wins") / F.col("n"), "avg_profit": F.coalesce(F.try_divide("gain", "wins"), F.lit(0.0)), "avg_loss": F.coalesce(F.try_divide(F.col("loss"), F.col("n") - F.col("wins")), F.lit(-0.001)), "score": _score(F.col("n"), F.col("wins"), F.col("gain"), F.col("loss"))})
    tier = F.when((F.col("score") >= score) & (F.col("ci_low") >= tier_1), 1).when((F.col("score") >= score) & (F.col("ci_low") >= tier_2), 2)
    biased = F.col("top_share") > ONE_SECTOR
    return out.select("broker", "n", "codes", "win_rate", "avg_profit", "avg_loss", "score", "ci_low", "ci_high", "sectors", "hhi", "top_share", biased.alias("ghost_bias"), F.when(biased, 0.5).otherwise(1.0).alias("discount"), tier.alias("tier"))

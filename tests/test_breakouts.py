"""Breakouts and waits against a loop over bars; regimes of a code; halves of a walk-forward."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest

from quantloom.operators import breakouts, monitoring, signals
from quantloom.operators.scores import COST


def _bars(seed: int, n: int = 260) -> list[tuple]:
    rng, close, out = random.Random(seed), 100.0, []
    for i in range(n):
        before, jump = close, rng.random() < 0.08
        close *= 1 + (rng.uniform(0.05, 0.12) if jump else rng.uniform(-0.012, 0.012))
        out.append((seed, dt.date(2020, 1, 1) + dt.timedelta(i), before, max(before, close) * 1.003, min(before, close) * 0.997, close, (5000.0 if jump else 1000.0) * rng.uniform(0.8, 1.2)))
    return out


def _plain(bars: list[tuple], most: int) -> list[tuple[bool, int | None]]:
    high, low, close, volume = ([b[k] for b in bars] for k in (3, 4, 5, 6))
    tr = [max(h - lo, *((abs(h - c), abs(lo - c)) if i else (0, 0))) for i, (h, lo, c) in enumerate(zip(high, low, [None, *close[:-1]], strict=True))]
    width, upper = [0.0] * len(bars), [None] * len(bars)
    for i in range(19, len(bars)):
        mid, sd = statistics.mean(close[i - 19 : i + 1]), statistics.stdev(close[i - 19 : i + 1])
        width[i], upper[i] = 4 * sd / mid, mid + 2 * sd
    hits = []
    for i in range(len(bars)):
        last = slice(max(i - 19, 0), i + 1)
        hits.append(upper[i] is not None and close[i] > upper[i] and width[i] > width[i - 1] and width[i] > statistics.mean(width[last]) and tr[i] > 1.2 * statistics.mean(tr[last]) and volume[i] > 1.5 * statistics.mean(volume[last]))
    return [(hits[i], next((j - i for j in range(i + 1, min(i + most, len(bars))) if hits[j]), None)) for i in range(len(bars))]


def test_breakouts(spark):
    groups = {seed: _bars(seed) for seed in (1, 2, 3)}
    groups[4] = _bars(4, 10)
    frame = spark.createDataFrame([b for g in groups.values() for b in g], "code long, date date, open double, high double, low double, close double, volume double")
    got = {(r["code"], r["date"]): (r["breakout"], r["ttb"]) for r in breakouts.breakouts(frame, 30).collect()}
    want = {(s, b[1]): x for s, g in groups.items() for b, x in zip(g, _plain(g, 30), strict=True)}
    assert got == want and sum(x[0] for x in want.values()) > 10 and any(x[1] is None for x in want.values())
    assert breakouts.breakouts(frame.limit(0)).count() == 0


def test_waits_strata_and_years(spark):
    rows = [(dt.date(2020 + i % 3, 1, 1), [None, 1, 5, 6, 20, 25, 31][i % 7], None if i % 6 == 0 else (i % 9 - 4) / 50, None if i % 4 == 0 else i / 100, i % 5 == 0, [None, 0.2, 0.5][i % 3]) for i in range(60)]
    frame = spark.createDataFrame(rows, "date date, ttb int, d21 double, d30 double, busted boolean, aqs double")
    of = lambda t: "30d+" if t is None or t > 30 else "0-5d" if t <= 5 else "5-10d" if t <= 10 else "10-20d" if t <= 20 else "20-30d"
    for r in breakouts.wait_buckets(frame).collect():
        mine = [x for x in rows if of(x[1]) == r["wait"]]
        d21 = [x[2] for x in mine if x[2] is not None]
        assert r["signals"] == len(mine) and r["d21_median"] == pytest.approx(statistics.median(d21)) and r["win_rate"] == pytest.approx(sum(x > COST for x in d21) / len(d21))
    strata = {r["stratum"]: r for r in breakouts.score_strata(frame).collect()}
    assert {k: r["signals"] for k, r in strata.items()} == {"none": 20, "low": 20, "high": 20}
    for r in breakouts.by_year(frame).collect():
        mine = [x for x in rows if x[0].year == r["year"]]
        net = [x[2] - COST for x in mine if x[2] is not None]
        lost = sum(x for x in net if x <= 0)
        assert r["busted"] == sum(x[4] for x in mine) and r["net_return"] == pytest.approx(statistics.mean(net)) and r["profit_factor"] == pytest.approx(sum(x for x in net if x > 0) / -lost)


def test_four_regimes(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    wild, calm = [100.0 * (1.05 if i % 2 else 1) for i in range(80)], [100.0 * (1.001 if i % 2 else 1) for i in range(80)]
    rows = [(c, day(i), x[i], adx) for c, (x, adx) in enumerate([(wild, 30.0), (calm, 25.0), (wild, 24.9), (calm, 10.0), (wild, None)]) for i in range(80)]
    out = signals.four_regimes(spark.createDataFrame(rows, "code long, date date, close double, adx double")).filter(f"date = '{day(79)}'").collect()
    assert {r["code"]: r["regime"] for r in out} == {0: "trend_explosive", 1: "trend_mild", 2: "range_volatile", 3: "range_quiet", 4: "range_quiet"}


def test_efficiency_of_halves(spark):
    rows = [(dt.date(2020, 3 * q + 1, 1), n, m) for q, (n, m) in enumerate([(2, 0.1), (3, 0.2), (1, 0.3)])]
    one = lambda x: monitoring.efficiency(spark.createDataFrame(x, "start date, trades long, mean_ret double")).first()
    r = one(rows)
    assert (r["windows"], r["trades"]) == (3, 6) and r["first_half"] == pytest.approx(0.2) and r["second_half"] == pytest.approx(0.9) and r["efficiency"] == pytest.approx(4.5)
    assert one(rows[:1])["efficiency"] == 0 and one([])["windows"] == 0

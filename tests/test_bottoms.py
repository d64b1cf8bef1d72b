"""Accumulation phases and reversals against plain Python, on the given tables and on random walks."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from quantloom.operators import bottoms
from quantloom.operators.indicators import recursive
from quantloom.sources import market
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def walks(spark):
    """Codes that fall from a high and base out, with quiet and busy days, of all lengths."""
    rng, rows = random.Random(12), []
    for code in range(140):
        price, n = 100.0, rng.choice([5, 19, 24, 30, 45, 61, 90, 150, 260, 320])
        for k in range(n):
            drift = -0.006 if k < n // 2 else rng.choice([0.0, 0.001, 0.002])
            close = price * math.exp(drift + rng.gauss(0, 0.012 if k < n // 2 else 0.006))
            spike = rng.random() < 0.03
            close = close * 1.02 if spike else close
            volume = (600 if code % 10 == 0 else 1000) * rng.uniform(0.3, 1.0) * (5 if spike else 1)
            rows.append((code, dt.date(2020, 1, 1) + dt.timedelta(k), price, max(price, close) * 1.002, min(price, close) * 0.998, close, volume))
            price = close
    return spark.createDataFrame(rows, "code long, date date, open double, high double, low double, close double, volume double")


def plain_swings(x, half, sign=1):
    out = []
    for i in range(half, len(x) - half):
        if sign * x[i] == min(sign * v for v in x[i - half : i + half + 1]):
            if out and i - out[-1][0] < half:
                if sign * x[i] < sign * out[-1][1]:
                    out[-1] = (i, x[i])
            else:
                out.append((i, x[i]))
    return out if len(x) >= 2 * half + 1 else []


def plain_higher_lows(p):
    up = lambda x: all(b >= a * 1.005 for a, b in zip(x, x[1:], strict=False))
    if len(p) < 3:
        return False
    if up(p[-3:]):
        return True
    picked = [p[-1]]
    for x in p[-2::-1]:
        if x < picked[-1] and len(picked) < 3:
            picked.append(x)
    if len(picked) == 3 and up(picked[::-1]):
        return True
    if len(p) < 4:
        return False
    second = p[len(p) // 2 :]
    after = second[second.index(min(second)) :]
    held = after[:1] + [x for x in after[1:] if x >= after[0] * 0.98]
    return len(after) >= 3 and len(held) >= 3 and held[-1] > held[0] * 1.005


def plain_accumulation(bars, rating, aqs, least_volume):
    bars = bars[-252:]
    n = len(bars)
    if n < 60:
        return ("NONE", 0, "history")
    if sum(b.volume for b in bars[-20:]) / 20 < least_volume:
        return ("NONE", 0, "volume")
    top = max(b.high for b in bars)
    peak = [b.high for b in bars].index(top)
    start = max(peak, n - 200)
    part = bars[start:] if n - start >= 30 else bars
    usual = [sum(b.volume for b in part[k - 19 : k + 1]) / 20 if k >= 19 else None for k in range(len(part))]
    tests = [k for k, b in enumerate(part) if usual[k] and b.volume / usual[k] >= 2.5 and b.close > b.open]
    confirmed = False
    if tests:
        t = part[tests[-1]]
        after = range(tests[-1] + 1, min(tests[-1] + 11, len(part)))
        if len(after) >= 5:
            ratios = [part[k].volume / usual[k] for k in after if usual[k]]
            low = min(part[k].low for k in after)
            confirmed = bool(ratios) and sum(ratios) / len(ratios) < 0.7 and (t.close - low) / t.close <= max((t.close - t.open) / t.open * 0.5, 0.05)
    floor = round(min(part[k].low for k in tests), 2) if tests else None
    adx = [b.adx for b in bars[start:]][-30:]
    flags = {
        "higher_lows": plain_higher_lows([x for _, x in plain_swings([b.low for b in part], 8)]), "volume_test": bool(tests), "confirmed": confirmed,
        "low_adx": n - start >= 20 and sum(x is not None and x < 25 for x in adx) >= 20, "strong": rating is not None and rating >= 70, "smart_money": aqs is not None and aqs >= 0.5,
    }
    met = sum(flags.values())
    score = 25 * flags["higher_lows"] + 20 * flags["volume_test"] + 20 * confirmed + 15 * flags["low_adx"] + 10 * flags["strong"] + 10 * flags["smart_money"] + 10 * (0.2 <= 1 - bars[-1].close / top <= 0.45)
    if n - 1 - peak > 60:
        score = max(0, score - 15)
    if floor is not None and bars[-1].close < floor:
        return ("INVALIDATED", 0, None)
    if met >= 4 and confirmed:
        phase = "ALPHA" if aqs is not None and aqs < 0.5 else "BETA"
    else:
        phase = "ALPHA" if met >= 2 and flags["higher_lows"] else "NONE"
    return (phase, min(100, score), None)


def plain_reversal(bars, broker):
    n, bars = len(bars), bars[-60:]
    close, rsi = [b.close for b in bars], [b.rsi for b in bars]
    direction = spread = None
    if n >= 20 and sum(x is not None for x in rsi) >= 20:
        for sign, name in ((1, "bullish"), (-1, "bearish")):
            points = plain_swings(close, 5, sign)
            if direction is None and len(points) >= 2:
                (i, x), (j, y) = points[-2:]
                if sign * (y - x) < 0 and rsi[i] is not None and rsi[j] is not None and sign * (rsi[j] - rsi[i]) > 2:
                    direction, spread = name, sign * (rsi[j] - rsi[i])
    rising = []
    for w in (20, 40, 60):
        lows = [x for _, x in plain_swings(close[-w:], 5)][-3:]
        if n >= max(w, 25) and len(lows) >= 2 and all(b >= a * (1 - 0.005) for a, b in zip(lows, lows[1:], strict=False)):
            rising.append(w)
    phase = "NONE" if not rising or n < 20 else "STRONG" if direction else "WATCH"
    score = {"STRONG": 80.0, "WATCH": 50.0, "NONE": 0.0}[phase]
    if score and broker and broker > 0:
        score = min(100.0, round(score + broker * 0.1, 1))
    return (phase, score, direction, spread, ",".join(map(str, rising)))


def by_code(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.code, r.date)):
        out.setdefault(r.code, []).append(r)
    return out


@pytest.mark.parametrize("given", [False, True])
def test_accumulation_equals_a_plain_version(spark, walks, given):
    bars = market.bars(spark, SMALL) if given else walks
    least = 20.0 if given else 500.0
    codes = by_code(recursive(bars).collect())
    ratings = {c: None if c % 5 == 0 else float(c * 37 % 101) for c in codes}
    scores = {c: None if c % 3 == 0 else (c * 29 % 20 - 8) / 10 for c in codes}
    table = lambda x, name: spark.createDataFrame([(c, v) for c, v in x.items() if v is not None], f"code long, {name} double")
    got = {r.code: (r.phase, r.score, r.reason) for r in bottoms.accumulation(bars, table(ratings, "rating"), table(scores, "score"), least_volume=least).collect()}
    want = {c: plain_accumulation(b, ratings[c], scores[c], least) for c, b in codes.items()}
    assert got == want
    if not given:
        assert {x[0] for x in want.values()} == {"NONE", "ALPHA", "BETA", "INVALIDATED"} and {x[2] for x in want.values()} == {None, "history", "volume"}


@pytest.mark.parametrize("given", [False, True])
def test_reversals_equal_a_plain_version(spark, walks, given):
    bars = market.bars(spark, SMALL) if given else walks
    codes = by_code(recursive(bars).collect())
    broker = {c: float(c % 7 * 15) for c in codes}
    found = bottoms.reversals(bars, spark.createDataFrame(list(broker.items()), "code long, score double")).collect()
    want = {c: plain_reversal(b, broker[c]) for c, b in codes.items()}
    assert {r.code: (r.phase, r.score, r.direction, r.rising) for r in found} == {c: (*w[:3], w[4]) for c, w in want.items()}
    assert all(r.rsi_spread == pytest.approx(want[r.code][3], abs=1e-9) if r.rsi_spread is not None else want[r.code][3] is None for r in found)
    if not given:
        assert {w[0] for w in want.values()} == {"NONE", "WATCH", "STRONG"} and {w[2] for w in want.values()} == {None, "bullish", "bearish"}


def test_bottoms_of_no_bars(spark, walks):
    assert bottoms.accumulation(walks.limit(0)).count() == 0 and bottoms.reversals(walks.limit(0)).count() == 0

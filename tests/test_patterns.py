"""Support levels and contractions against plain Python, over the bars of the smallest tables."""

from __future__ import annotations

import math
import statistics

from quantloom.operators import contraction, levels
from quantloom.sources import market
from tests.conftest import SMALL


def _by_code(bars):
    out: dict = {}
    for r in sorted(bars.collect(), key=lambda r: (r.code, r.date)):
        out.setdefault(r.code, []).append(r)
    return out


def _expected_levels(rows, swings):
    closes = [r.close for r in rows]
    now = closes[-1]
    found = [(p, "swing") for p in swings]
    for n in (20, 60, 120, 240):
        if len(rows) >= n:
            found.append((sum(closes[-n:]) / n, f"ma{n}"))
    if len(rows) >= 20:
        middle, sd = sum(closes[-20:]) / 20, statistics.stdev(closes[-20:])
        found += [(middle + 2 * sd, "bb"), (middle - 2 * sd, "bb")]
    width = next(w for bound, w in ((50, 5), (200, 10), (500, 25), (2000, 50), (math.inf, 100)) if now < bound)
    found += [((int(now / width) + i) * width, "round") for i in range(-3, 4)]
    last = rows[-250:]

    def turns(level):
        n = 0
        for before, r in zip(last[:-2], last[1:-1], strict=True):
            low, high = abs(r.low - level) / level < 0.015, abs(r.high - level) / level < 0.015
            n += (low and r.close > before.close) or (high and r.close < before.close)
        return max(1, min(n, 3))

    kept: list = []
    for price, source in sorted(x for x in found if x[0] > 0):
        if kept and abs(kept[-1][0] - price) / price < 0.015:
            kept[-1] = (kept[-1][0], kept[-1][1] | {source}, max(kept[-1][2], turns(price)))
        else:
            kept.append((price, {source}, turns(price)))
    below = sorted((x for x in kept if x[0] < now * 0.998), reverse=True, key=lambda x: x[0])[:5]
    above = [x for x in kept if x[0] > now * 1.002][:5]
    return {(k, round(p, 4), "+".join(sorted(s)), n) for k, part in (("support", below), ("resistance", above)) for p, s, n in part}


def test_support_levels(spark):
    bars = market.bars(spark, SMALL).cache()
    points = levels.swings(bars).cache()
    swings: dict = {}
    for r in sorted(points.collect(), key=lambda r: -r.at):
        side = swings.setdefault(r.code, {}).setdefault(r.side, [])
        if len(side) < 10:
            side.append(r.price)
    got: dict = {}
    for r in levels.support_resistance(bars, points).collect():
        got.setdefault(r.code, set()).add((r.kind, round(r.price, 4), r.sources, r.strength))
    want = {code: _expected_levels(rows, [p for side in swings.get(code, {}).values() for p in side]) for code, rows in _by_code(bars).items()}
    assert got == {k: v for k, v in want.items() if v}


def _expected_pattern(rows, floor, deepest, limit):
    none = lambda why: (0, 0, 0, 0, None, False, why)
    moves = [0.0] + [b.close / a.close - 1 for a, b in zip(rows, rows[1:], strict=False)]
    rows, moves = rows[-120:], [0.0] + moves[-119:]
    if len(rows) < 120:
        return none("history")
    usual = [statistics.fmean(r.volume for r in rows[max(0, i - 19) : i + 1]) if i >= 9 else None for i in range(120)]
    if usual[-1] < floor:
        return none("volume")
    calm = [i for i in range(3, 117) if abs(moves[i]) <= limit]
    tops = [i for i in calm if rows[i].high == max(r.high for r in rows[i - 3 : i + 4])]
    bottoms = [i for i in calm if rows[i].low == min(r.low for r in rows[i - 3 : i + 4])]
    raw: list = []
    for t in tops:
        free = [b for b in bottoms if b > t and all(b != x[1] for x in raw)]
        if free and all(abs(m) <= limit for m in moves[t : free[0] + 1]):
            depth = (rows[t].high - rows[free[0]].low) / rows[t].high
            if free[0] - t >= 5 and depth > 0.01:
                raw.append((t, free[0], depth))
    if len(raw) < 2:
        return none("bases")
    if raw[0][2] > deepest:
        return none("depth")
    kept = raw[:1]
    for x in raw[1:]:
        if x[2] < kept[-1][2]:
            kept.append(x)
    if len(kept) < 2:
        return none("decay")
    start, stop, depth = kept[-1]
    if stop - kept[0][0] < 15:
        return none("duration")
    ghosts = [bool(usual[i] and rows[i].volume < 0.5 * usual[i]) for i in range(start, stop + 1)]
    springs = "".join("x" if g and (rows[start + k].high - rows[start + k].low) / rows[start + k].high < 0.01 else " " for k, g in enumerate(ghosts))
    spring = max(map(len, springs.split(" ")))
    score = (50 if len(kept) >= 3 else 30) + max(0, min(20, int(20 * (1 - depth / kept[0][2])))) + min(15, 5 * sum(ghosts))
    score = min(score, 50) if not any(ghosts) else score
    last = rows[-1]
    return (len(kept), sum(ghosts), spring, min(100, score + (15 if spring >= 2 else 0)), round(rows[start].high, 6), last.close > rows[start].high and last.volume > 2 * usual[-1], None)


def test_contractions(spark):
    bars = market.bars(spark, SMALL).cache()
    for floor, deepest, limit in ((1.0, 0.9, 10.0), (1.0, 0.5, 0.6), (1e9, 0.35, 0.095)):
        out = contraction.contractions(bars, least_volume=floor, deepest=deepest, limit=limit)
        got = {r.code: (r.bases, r.ghost_days, r.spring_days, r.score, r.pivot and round(r.pivot, 6), r.breakout, r.reason) for r in out.collect()}
        assert got == {code: _expected_pattern(rows, floor, deepest, limit) for code, rows in _by_code(bars).items()}
    assert any(x[6] == "volume" for x in got.values())

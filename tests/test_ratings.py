"""Ratings, targets and broker reversals against plain rules, row by row."""

from __future__ import annotations

import datetime as dt
import itertools
import statistics

import pytest

from quantloom.operators import ratings

NAMES = ratings.RATINGS


def rated(r: dict) -> tuple[float, str, list[tuple[str, str, str]]]:
    """Score, rating and (code, before, after) of one row, by a plain walk through the gates."""
    rsi, reward, n = 50 if r["rsi"] is None else r["rsi"], 1 if r["risk_reward"] is None else r["risk_reward"], len(r["conflicts"] or [])
    tech = {"strong_up": 2, "up": 1, "down": -1, "strong_down": -2}.get(r["trend"], 0) + {"BUY": 2, "SELL": -2}.get(r["signal"], 0) + {"strong_bull": 2, "bull": 1, "bear": -1, "strong_bear": -2}.get(r["momentum"], 0)
    tech += ((r["composite"] or 0) > 0.3) - ((r["composite"] or 0) < -0.3) + (rsi < 30) - (rsi > 70)
    tech += 1 if reward > 2 else -3 if reward < 0.3 else -2 if reward < 0.5 else -1 if reward < 0.8 else 0
    tech -= min(n * 0.5, 2)
    up = r["upside"] or 0
    fund = (r["fundamental"] or 0) * 0.4 + (2 if up > 0.1 else 1 if up > 0.05 else -2 if up < -0.05 else -1 if up < 0 else 0)
    inst = r["inst_score"] or 0
    score = tech + fund + inst * (0.3 if r["biotech"] else 0.25) * 4
    at, trace = 4 if score >= 6 else 3 if score >= 3 else 2 if score >= -1 else 1 if score >= -4 else 0, []

    def cap(code, to):
        nonlocal at
        if at > to:
            trace.append((code, NAMES[at], NAMES[to]))
            at = to

    if r["visibility"] == "ghost_town":
        if r["turnover"] is not None and r["turnover"] < 1e7:
            trace.append(("ghost_town", NAMES[at], NAMES[max(at - 1, 0)]))
            at = max(at - 1, 0)
    elif inst < -2:
        cap("institutions_sell", 2)
    own, total = r["runway"], r["total_runway"]
    if own is not None or total is not None:
        own, total = 99 if own is None else own, 99 if total is None else total
        left = min(own, total) if r["biotech"] else own
        if left < 4:
            cap("cash_critical", 1)
        elif left < 8:
            cap("cash_warning", 2)
    if r["regime"] == "bear":
        cap("bear_market", 3)
    if n:
        cap("conflict", 3)
    if rsi > 70:
        cap("overbought", 3)
    return score, NAMES[at], trace


FIELDS = "id long, trend string, momentum string, signal string, composite double, rsi double, risk_reward double, conflicts array<string>, upside double, fundamental double, inst_score double, visibility string, turnover double, regime string, biotech boolean, runway double, total_runway double"


def test_overall_rating(spark):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    best = dict(trend="strong_up", momentum="strong_bull", signal="BUY", composite=0.5, rsi=60.0, risk_reward=2.5, conflicts=[], upside=0.2, fundamental=4.0, inst_score=2.0, visibility="active", turnover=5e7, regime="bull", biotech=False, runway=None, total_runway=None)
    changes = [
        dict(), dict(rsi=75.0), dict(regime="bear"), dict(conflicts=["a"]), dict(conflicts=["a", "b", "c", "d", "e"], regime="bear"), dict(inst_score=-3.0), dict(inst_score=-2.0), dict(visibility="ghost_town"), dict(runway=3.0), dict(runway=6.0),
        dict(total_runway=3.0), dict(total_runway=3.0, biotech=True), dict(runway=8.0), dict(trend="down", momentum="strong_bear", signal="SELL", upside=-0.2), dict(risk_reward=0.1, upside=0.0, fundamental=None), dict(inst_score=None, rsi=None, composite=-1.0),
    ]
    rows = [best | a | b | dict(turnover=t) for a, b in itertools.product(changes, changes) for t in (5e7, 1e6, None)]
    rows.append({k: None for k in best})
    got = ratings.overall_rating(spark.createDataFrame([tuple([i] + [r[c] for c in names[1:]]) for i, r in enumerate(rows)], FIELDS)).collect()
    assert len(got) == len(rows)
    for g in got:
        score, rating, trace = rated(rows[g["id"]])
        assert (g["score"], g["rating"], [(x["code"], x["before"], x["after"]) for x in g["overrides"]]) == (pytest.approx(score), rating, trace), rows[g["id"]]
        assert g["raw_rating"] == (trace[0][1] if trace else rating)


def test_rating_of_no_rows(spark):
    assert ratings.overall_rating(spark.createDataFrame([], FIELDS)).count() == 0


def test_price_targets_heed_two_analysts(spark):
    report = spark.createDataFrame([(c, 100.0, 0.01, "up", 30.0, 90.0, 110.0) for c in (1, 2, 3)], "code long, close double, range_pct double, trend string, adx double, support double, resistance_far double")
    levels = spark.createDataFrame([(c, "uptrend", k, r, x) for c in (1, 2) for k, r, x in (("extension", 1.272, 120.0), ("extension", 1.618, 140.0), ("retracement", 0.5, 85.0), ("retracement", 0.786, 75.0))], "code long, direction string, kind string, ratio double, level double")
    analysts = spark.createDataFrame([(1, 3, 130.0, 150.0, 80.0), (2, 1, 130.0, 150.0, 80.0), (3, 5, 900.0, 900.0, None)], "code long, analysts int, mean double, high double, low double")
    got = {(r["code"], r["timeframe"], r["scenario"]): r for r in ratings.price_targets(report, levels, analysts).collect()}
    assert len(got) == 27
    for code, (name, days) in itertools.product((1, 2, 3), ratings.SPANS):
        scale, far = (days / 14) ** 0.5, name == "1Y"
        drawn = (140 if far else 120) if code < 3 else (125 if far else 115)
        bull = min(drawn * 0.4 + 100 * (1 + 0.02 * scale) * 0.3 + 110 * 0.3, 200)
        low = (75 if far else 85) if code < 3 else 85
        bear = max(low * 0.4 + 100 * (1 - 0.02 * scale) * 0.3 + 90 * 0.3, 50)
        heeded = code == 1 and name != "3M"
        if heeded:
            share = 0.3 if far else 0.2
            bull, bear = bull * (1 - share) + 150 * share, bear * (1 - share) + 80 * share
        base = bull * 0.6 + bear * 0.4
        if heeded:
            share = 0.35 if far else 0.25
            base = base * (1 - share) + 130 * share
        for scenario, want in (("bull", bull), ("base", base), ("bear", bear)):
            row = got[code, name, scenario]
            assert row["target"] == pytest.approx(want) and row["upside"] == pytest.approx(want / 100 - 1)
            assert row["confidence"] == ("high" if scenario == "base" else "middle")


def test_broker_reversal(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    rows = [(1, day(i), 5, float(i), 0.2, 0.8) for i in range(30)]  # A streak and a rising purity.
    rows += [(2, day(i), 5, 40.0, 0.2, 0.8) for i in range(30)]  # No spread, so no accumulation.
    rows += [(3, day(0), 4, 50.0, None, 0.5), (4, day(0), None, None, None, 0.5), (5, day(0), -3, None, -2.0, None)]  # Few days and missing parts.
    got = {r["code"]: r for r in ratings.broker_reversal(spark.createDataFrame(rows, "code long, date date, streak int, purity double, net_momentum_5d double, net_buy_ratio double")).collect()}
    last = [float(i) for i in range(10, 30)]
    feature = 50 * 0.3 + 29 * 0.25 + 60 * 0.25 + 80 * 0.2
    z = (29 - statistics.mean(last)) / statistics.stdev(last)
    assert got[1]["accumulates"] and got[1]["purity_z"] == pytest.approx(z) and got[1]["score"] == pytest.approx(feature + 15)
    assert got[1]["confidence"] == pytest.approx((5 / 6 * 0.5 + z / 2 * 0.5) * 100)
    assert not got[2]["accumulates"] and got[2]["purity_z"] == 0 and got[2]["score"] == pytest.approx(50 * 0.3 + 40 * 0.25 + 60 * 0.25 + 80 * 0.2)
    assert got[3]["score"] == pytest.approx((40 * 0.3 + 50 * 0.25 + 50 * 0.2) / 0.75) and got[3]["purity_z"] is None and got[3]["confidence"] == 0
    assert got[4]["score"] is None and got[4]["feature_score"] is None
    assert got[5]["score"] == pytest.approx(0)

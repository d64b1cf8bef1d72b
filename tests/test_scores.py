"""Scores of signals against plain rules: every kind of value and of gap, earlier outcomes, groups, running sums, action tags."""

from __future__ import annotations

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from quantloom.operators import guard, scores

FIELDS = "id long, fitness string, strategy string, regime string, ev double, cases long, heat double, momentum string, maturity string, inst_ratio double, valuation double, yoy double"


def quality(fitness, strategy, regime, ev, cases, heat, momentum, maturity, inst, valuation, yoy) -> float:
    fits = {"Trend Preferred (V4)": ["V4"], "Trend Only (V4)": ["V4"], "Volatility Preferred (V5)": ["V5"], "Reversion Only (V5)": ["V5"], "Balanced": ["V4", "V5", "Adaptive"]}
    f = 50 if fitness not in fits else 100 if strategy in fits[fitness] else 80 if fitness == "Balanced" else 20
    r = {("bull", "V4"): 95, ("bull", "V5"): 50, ("bull", "Adaptive"): 80, ("sideways", "V4"): 45, ("sideways", "V5"): 85, ("sideways", "Adaptive"): 75, ("bear", "V4"): 20, ("bear", "V5"): 60, ("bear", "Adaptive"): 50}.get((regime, strategy), 50)
    if ev is None or cases < 3:
        e = 40.0
    else:
        net, sure = ev - 0.005855, min(1, cases / 20)
        e = 100 if net >= 0.03 else 50 + net / 0.03 * 50 if net >= 0 else max(0, 50 + net / 0.02 * 50) if net >= -0.02 else 0
        e = e * sure + 40 * (1 - sure)
    h = 50 if heat is None else max(0, min(100, min(70, heat * 100) + {"surge": 30, "heating": 20, "cooling": -20}.get(momentum, 0)))
    m = {"Structural Shift": 95, "Trend Formation": 70, "Speculative Spike": 30}.get(maturity, 40)
    i = 50 if inst is None else 95 if inst >= 0.2 else 50 + inst / 0.2 * 45 if inst >= 0 else max(10, 50 + inst / 0.2 * 40) if inst >= -0.2 else 10
    v = 50 if valuation is None else valuation
    if yoy is None:
        g = 50
    elif yoy > 0:
        g = 95 if yoy > 50 else 80 + (yoy - 20) / 2 if yoy > 20 else 65 + (yoy - 10) * 1.5 if yoy > 10 else 50 + yoy * 1.5
    else:
        g = 35 + yoy * 1.5 if yoy > -10 else 20 + (yoy + 10) * 1.5 if yoy > -20 else max(5, 10 + (yoy + 20) / 2)
    if valuation is None and yoy is None:
        return f * 0.25 + r * 0.2 + e * 0.15 + h * 0.1 + m * 0.1 + i * 0.2
    return i * 0.2 + g * 0.15 + f * 0.15 + (v + r + e + h + m) * 0.1


def test_signal_quality(spark):
    values = (
        ("Trend Preferred (V4)", "Trend Only (V4)", "Volatility Preferred (V5)", "Reversion Only (V5)", "Balanced", "unknown", None), ("V4", "V5", "Adaptive", "Bold"), ("bull", "sideways", "bear", "other"), (None, -0.1, -0.01, 0.005855, 0.02, 0.1),
        (0, 3, 7, 20, 40), (None, 0.0, 0.35, 0.9), ("surge", "heating", "cooling", "stable"), ("Structural Shift", "Trend Formation", "Speculative Spike", "N/A"), (None, -0.5, -0.1, 0.1, 0.3), (None, 0.0, 90.0), (None, -60.0, -15.0, -5.0, 5.0, 15.0, 30.0, 80.0),
    )
    # Each value of each column, with the others at varying places.
    rows = [tuple(v[(i * p + k) % len(v)] for k, (v, p) in enumerate(zip(values, (1, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31), strict=True))) for i in range(2000)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FIELDS)
    got = guard.signal_quality(frame).select("id", "sqs", "grade").collect()
    assert len(got) == len(rows)
    for g in got:
        want = quality(*rows[g["id"]])
        assert g["sqs"] == pytest.approx(want), rows[g["id"]]
        if min(abs(want - x) for x in (40, 60, 80)) > 1e-9:
            assert g["grade"] == ("diamond" if want >= 80 else "gold" if want >= 60 else "silver" if want >= 40 else "noise")


def test_priority_and_action(spark):
    clip = lambda x: max(0, min(100, x))
    cases = list(itertools.product((None, 30.0, 130.0), (None, -5.0, 70.0), ("BETA", "ALPHA", "GAMMA_READY", "NONE", None), (None, 0.2, 2.0, 9.0), (None, 40.0)))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(cases)], "id long, strength double, quality double, phase string, peer_alpha double, liquidity double")
    for g in guard.priority(frame).collect():
        s, q, phase, peer, liquid = cases[g["id"]]
        want = 0.3 * clip(50 if s is None else s) + 0.25 * clip(50 if q is None else q) + 0.2 * {"BETA": 100, "ALPHA": 60, "GAMMA_READY": 80}.get(phase, 0) + 0.15 * clip(((1 if peer is None else peer) - 0.5) * 40) + 0.1 * clip(50 if liquid is None else liquid)
        assert g["priority"] == pytest.approx(want)
    today = dt.date(2024, 1, 5)
    rows = [(True, 2, today, "BETA", "trailing"), (True, 1, today, "BETA", "held"), (True, None, today, None, "held"), (False, 3, today, "BETA", "new"), (None, None, dt.date(2024, 1, 1), "GAMMA_READY", "try"), (False, 0, dt.date(2024, 1, 1), "ALPHA", "watch"), (None, None, None, None, "watch")]
    tags = spark.createDataFrame(rows, "is_live boolean, trailing_phase int, date date, phase string, want string").withColumn("got", scores.action_tag(F.lit(today))).collect()
    assert all(r["got"] == r["want"] for r in tags)


def test_past_value_looks_at_known_outcomes_only(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    bars = [(1, day(i), "BUY" if i % 3 == 0 else "HOLD", i / 10 if i < 27 else None) for i in range(30)]
    got = {r["date"]: r for r in scores.past_value(spark.createDataFrame(bars, "code long, date date, signal string, d3 double"), 3).collect()}
    for i in range(30):
        known = [b[3] for b in bars[: max(i - 2, 0)] if b[2] == "BUY" and b[3] is not None]
        assert got[day(i)]["cases"] == len(known)
        assert got[day(i)]["ev"] == (pytest.approx(sum(known) / len(known)) if known else None)


def test_groups_and_curve(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    rows = [(c, day(d), float(10 * c + d), "gold" if c > 4 else "noise", "bull" if d else None, (c - 4) / 10 if (c + d) % 5 else None, (d - 1) / 10, 0.2, -0.1) for c in range(9) for d in range(3)]
    frame = spark.createDataFrame(rows, "code long, date date, sqs double, grade string, regime string, d5 double, d20 double, gain_5 double, loss_5 double")
    got = {r["group"]: r for r in scores.score_groups(frame).collect()}
    assert set(got) == {"all", "sqs_40", "sqs_60", "sqs_80", "grade_gold", "grade_noise", "regime_bull"}
    d5 = lambda keep: [r[5] for r in rows if keep(r) and r[5] is not None]
    for name, keep in (("all", lambda r: True), ("sqs_60", lambda r: r[2] >= 60), ("grade_noise", lambda r: r[3] == "noise"), ("regime_bull", lambda r: r[4] == "bull")):
        x, g = d5(keep), got[name]
        gains, losses = [v for v in x if v > 0], [v for v in x if v <= 0]
        assert (g["signals"], g["count_5"]) == (sum(map(keep, rows)), len(x)) and g["share"] == pytest.approx(sum(map(keep, rows)) / len(rows))
        assert g["win_rate_5"] == pytest.approx(len(gains) / len(x)) and g["net_5"] == pytest.approx(sum(x) / len(x) - scores.COST)
        assert g["profit_factor"] == (pytest.approx(sum(gains) / abs(sum(losses))) if gains and losses and sum(losses) else None)
        assert g["lift_return"] == pytest.approx(sum(x) / len(x) - sum(d5(lambda r: True)) / len(d5(lambda r: True)))
    total, want = 0.0, {}
    for r in sorted((r for r in rows if r[5] is not None), key=lambda r: (r[1], r[0])):
        total += r[5] - scores.COST
        want[r[0], r[1]] = total
    curve = {(r["code"], r["date"]): r["cumulative"] for r in scores.cumulative_curve(frame).collect()}
    assert curve == {k: pytest.approx(v) for k, v in want.items()}
    assert scores.score_groups(frame.limit(0)).count() == 0 and scores.cumulative_curve(frame.limit(0)).count() == 0


def test_past_value_of_numbered_buy_bars_alone(spark):
    signal = lambda i: "BUY" if i % 3 == 0 or i in (7, 8) else "HOLD"
    bars = [(code, dt.date(2024, 1, 1) + dt.timedelta(days=i), signal(i), None if i > 36 else float(i * code), i + 1) for code in (1, 2) for i in range(40)]
    rows = spark.createDataFrame(bars, "code long, date date, signal string, d3 double, n int")
    cells = lambda df: {(r.code, r.date): (r.ev, r.cases) for r in df.filter("signal = 'BUY'").collect()}
    assert cells(scores.past_value(rows.filter("signal = 'BUY'"), 3, number="n")) == cells(scores.past_value(rows, 3))


def test_scenarios_and_heat_read_no_more_than_they_need(spark):
    from quantloom.plans import scores as plans

    small = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "sqs" not in plan(plans.scenarios(spark, small)) and "Join" not in plan(plans.scenarios(spark, small))
    assert "_n#" not in plan(plans.sector_heat(spark, small))


def test_heat_scans_sort_bars_once(spark):
    from quantloom.plans import trading

    plan = trading.heat_scans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan

"""Price levels and monitoring on small frames."""

from __future__ import annotations

import datetime as dt

import pytest

from quantloom.operators import fundamental, levels, monitoring

D = dt.date(2024, 1, 1)


def test_swings_merge_to_the_more_extreme(spark):
    highs = [10.0] * 20 + [15.0] + [10.0] * 4 + [16.0] + [10.0] * 20
    rows = [(1, D + dt.timedelta(days=i), h, h - 5, h - 1) for i, h in enumerate(highs)]
    bars = spark.createDataFrame(rows, "code long, date date, high double, low double, close double")
    assert [r.price for r in levels.swings(bars).filter("side = 'high' and price > 10").collect()] == [16.0]


def test_streaks_pass_over_nulls_and_end_at_zero(spark):
    rows = [("a", k, g) for k, g in enumerate([0.1, -0.1, 0.2, None, 0.3])] + [("b", k, g) for k, g in enumerate([0.1, 0.0, -0.2])] + [("c", 0, 0.0)]
    df = spark.createDataFrame(rows, "k string, period int, growth double")
    assert {r.k: (r.up, r.down) for r in fundamental.streaks(df, "k", "period").collect()} == {"a": (2, 0), "b": (0, 1), "c": (0, 0)}


def test_growth_on_losses(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (2, 5.0, -5.0), (3, -2.0, -4.0), (4, 6.0, 4.0)], "k int, now double, before double")
    from pyspark.sql import functions as F

    got = {r.k: r.g for r in df.select("k", fundamental.safe_growth(F.col("now"), F.col("before")).alias("g")).collect()}
    assert got == {1: None, 2: None, 3: 0.5, 4: 0.5}


def test_exposure_waits_for_a_second_day_but_not_for_safety(spark):
    rows = [(D + dt.timedelta(days=i), r) for i, r in enumerate(["NORMAL", "NORMAL", "DEFENSIVE", "NORMAL", "LOCKDOWN", "DEFENSIVE", "DEFENSIVE"])]
    out = monitoring.exposure(spark.createDataFrame(rows, "date date, regime string"), {"NORMAL": 0.9, "DEFENSIVE": 0.5, "LOCKDOWN": 0.1})
    assert [r.exposure for r in out.orderBy("date").collect()] == [1.0, 0.9, 0.9, 0.9, 0.1, 0.1, 0.5]


def test_intervals_hold_the_mean(spark):
    df = spark.createDataFrame([(k % 2, float(k % 10)) for k in range(400)], "k long, x double")
    for r in monitoring.mean_interval(df, "k", "x", draws=300).collect():
        assert r.low < r.mean < r.high and r.n == 200 and r.high - r.low < 1.6 and r.mean == pytest.approx(4.0 + r.k)

"""What is made along a code's days stays in the code's bucket: little is shuffled, and nothing wide is written."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from quantloom.functions.windows import rank_pct
from quantloom.operators import dual, joins, matrix, registry, relative
from quantloom.plans import matrix as plans
from quantloom.sources import market, snapshots
from tests.conftest import SMALL

_DAY = dt.date(2020, 1, 1)


def _exchanges(df):
    """Names of the columns that each shuffle of a plan deals out."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.initialPlan())
            continue
        if plan.nodeName() == "Exchange":
            found.append([plan.output().apply(i).name() for i in range(plan.output().size())])
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_matrix_shuffles_no_wide_rows_and_is_not_written(spark):
    rows = plans.whole_matrix(spark, SMALL)
    assert max(map(len, _exchanges(rows))) < 15
    assert not [c for names in _exchanges(rows) for c in names if c in ("close", "volume", "hhi") or c in matrix.COLUMNS[:-6]]
    newest = plans.latest_matrix(spark, SMALL)
    plans.gene_mutations(spark, SMALL).collect()
    assert not [k for k in snapshots._WRITTEN if k[1] == "feature_matrix"]
    want = {r["code"]: r for r in matrix.latest(rows).collect()}
    assert {r["code"]: r for r in newest.collect()} == want and want


def test_bars_and_flows_by_code_are_those_of_the_lines(spark):
    bars, flows = market.by_code(spark, SMALL)
    days = flows.groupBy("code", "date").agg(*(x.alias(c) for c, x in market.bar_sums().items())).filter("volume IS NOT NULL")
    want = sorted(map(tuple, market.bars(spark, SMALL).collect()))
    assert sorted(map(tuple, bars.collect())) == sorted(map(tuple, days.collect())) == want and want
    assert sorted(map(tuple, flows.select("code", "broker", "date", "buy", "sell").collect())) == sorted(map(tuple, market.broker_flows(spark, SMALL).collect()))
    assert _exchanges(days) == _exchanges(joins.by_day(bars, bars.select("code", "date", "close"))) == []


def test_month_ends_meet_the_nearest_row(spark):
    rng = random.Random(3)
    rows = sorted({(code, _DAY + dt.timedelta(rng.randrange(150))) for code in range(6) for _ in range(40)})
    known = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(rows)], "code long, bar date, ret double")
    ends = spark.createDataFrame([(code, d) for code in range(7) for d in (dt.date(2020, 1, 31), dt.date(2020, 2, 29), dt.date(2020, 3, 31), dt.date(2020, 4, 30))], "code long, date date")
    want = joins.nearest(ends, known, "code", "date", "bar", 5).filter("ret IS NOT NULL").select("code", "date", "ret")
    got = joins.by_day(ends, registry.near_month_ends(known, 5)).filter("ret IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_sector_days_rank_as_rows_do(spark):
    rng = random.Random(4)
    rows = [(code, _DAY + dt.timedelta(day), f"s{code % 5}", None if code % 5 == 4 or day == 3 else float(rng.randrange(3))) for code in range(40) for day in range(6) if rng.random() < 0.8]
    named = spark.createDataFrame(rows, "code long, date date, sector string, ret_20 double")
    got = relative.with_sector_days(named, relative.sector_days(named))
    median = named.groupBy("date", "sector").agg(F.percentile("ret_20", F.lit(0.5)).alias("m"))
    want = named.join(median, ["date", "sector"]).withColumn("rs", rank_pct("m"))
    assert sorted(map(str, got.select("code", "date", "sector_momentum", "sector_rs").collect())) == sorted(map(lambda r: str(r).replace("m=", "sector_momentum=").replace("rs=", "sector_rs="), want.select("code", "date", "m", "rs").collect()))


def test_cases_by_bounds_are_those_of_all_rows(spark, monkeypatch):
    """Many queries: what is sent on is bounded by the best among some codes' rows, and the cases are the same, with what they carry."""
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(code, dt.date(1970, 1, 1) + dt.timedelta(7 * day), 7 * day, rng.randrange(-1, 2), rng.random(), None if day % 3 else rng.random(), vector(), vector()) for code in range(60) for day in range(20)]
    frame = spark.createDataFrame(rows, "code long, date date, day int, regime int, growth double, polarity double, raw array<double>, augmented array<double>")
    queries = matrix.latest(frame)
    plain = sorted(map(tuple, dual.cases(frame, queries, 3, carry=("growth", "polarity")).collect()))
    sent = []
    monkeypatch.setattr(dual, "MANY", 1)
    monkeypatch.setattr(dual, "SHARES", (8, 2))
    monkeypatch.setattr(dual, "_met", lambda *a, met=dual._met: sent.append(met(*a)) or sent[-1])
    some = lambda share: frame.filter(F.pmod(F.xxhash64("code"), F.lit(share)) == 0)
    assert sorted(map(tuple, dual.cases(frame, queries, 3, carry=("growth", "polarity"), some=some).collect())) == plain
    assert len(sent) == 3 and sent[-1].count() < dual._met(frame, queries, 9, dual.LEAST, dual.HALF_LIFE, (), None).count()
    by_day = {(r[0], r[1]): r[4:6] for r in rows}
    assert plain and all(r[-2:] == by_day[r[3], r[4]] for r in plain)


def test_dual_search_shuffles_no_rows_of_vectors(spark):
    queries = matrix.latest(plans._situations(spark, SMALL))
    found = dual.cases(plans._situations(spark, SMALL), queries, 5)
    assert not [c for names in _exchanges(found) for c in names if c in ("raw", "augmented", "volume", *matrix.COLUMNS[:-6])]


def test_waiting_signals_shuffle_no_bars(spark):
    from quantloom.plans import breakouts

    dealt = _exchanges(breakouts.waiting_rows(spark, SMALL))
    assert not [names for names in dealt if {"close", "d21", "d30"} & {*names}]

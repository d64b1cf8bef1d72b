"""Trades matched into positions against loops, and files of trades."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quantloom.operators import matching
from quantloom.plans import trading
from quantloom.sources import trade_files
from tests.conftest import SMALL


def plain_fifo(trades):
    held, out = [], []
    for t in trades:
        if t[3] > 0:
            held.append([t[1], t[5], t[4]])
            continue
        left = t[4]
        while left and held:
            n = min(left, held[0][2])
            out.append((t[0], held[0][0], held[0][1], t[1], t[5], n))
            left, held[0][2] = left - n, held[0][2] - n
            if not held[0][2]:
                held.pop(0)
    return out + [(trades[0][0], d, p, None, None, n) for d, p, n in held]


def plain_average(trades):
    lots, cost, first, out = 0, 0.0, None, []
    for t in trades:
        if t[3] > 0:
            first = t[1] if lots == 0 else first
            lots, cost = lots + t[4], cost + t[4] * t[5]
        elif lots:
            n, mean = min(t[4], lots), cost / lots
            out.append((t[0], first, mean, t[1], t[5], float(n)))
            lots -= n
            cost = mean * lots
    return out + ([(trades[0][0], first, cost / lots, None, None, float(lots))] if lots else [])


@pytest.mark.parametrize("given", [False, True])
def test_positions_equal_loops(spark, given):
    if given:
        trades = trading.line_trades(spark, SMALL)
    else:
        rng = random.Random(6)
        rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(20)), k, rng.choice([1, -1, -1]) if c % 2 else rng.choice([1, 1, -1]), rng.randint(1, 9), float(rng.randint(10, 99))) for c in range(12) for k in range(rng.choice([1, 2, 60]))]
        trades = spark.createDataFrame([*rows, (99, dt.date(2024, 1, 1), 0, -1, 5, 1.0), (99, dt.date(2024, 1, 2), 0, 0, 5, 1.0)], "code long, date date, seq long, side int, quantity long, price double")
    by_code: dict = {}
    for r in sorted((tuple(r) for r in trades.collect() if r.side), key=lambda t: t[:4]):
        by_code.setdefault(r[0], []).append(r)
    key = lambda r: tuple((x is None, x or 0) for x in (r[0], str(r[1]), r[2], str(r[3]), r[4], r[5]))
    for f, plain in ((matching.fifo, plain_fifo), (matching.average_cost, plain_average)):
        found = f(trades).collect()
        got = sorted((tuple(r)[:6] for r in found), key=key)
        want = sorted((x for t in by_code.values() for x in plain(t)), key=key)
        assert len(got) == len(want)
        assert all(g == pytest.approx(w, rel=1e-9) if isinstance(w, float) else g == w for a, b in zip(got, want, strict=True) for g, w in zip(a, b, strict=True))
        assert all((r.pnl is None) == (r.exit_date is None) for r in found)


def test_results_after_cost(spark):
    trades = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1, 1, 2, 100.0), (1, dt.date(2024, 1, 11), 2, -1, 2, 110.0)], "code long, date date, seq long, side int, quantity long, price double")
    for f in (matching.fifo, matching.average_cost):
        r = f(trades, shares=1000).first()
        assert (r.pnl, r.days_held) == (20000.0, 10) and r.return_pct == pytest.approx(0.1)
        assert r.net_pnl == pytest.approx(20000 - 420000 * 0.001425 - 220000 * 0.003)


def test_files_of_trades(spark, tmp_path):
    (tmp_path / "a.csv").write_text("成交日期,股票代號,股票名稱,買賣別,成交股數,成交價格\n113/01/15,2330.TW,台積電,買進,\"2,500\",600\n2024/1/16,2330,台積電,賣出,900,\"1,610.5\"\n20240117,2317,鴻海,現股,1000,100\n,2317,鴻海,買,1000,100\n2024-01-18,2317,鴻海,買,0,100\nx,1,a,買,1000,1\n", encoding="utf-8")
    rows = [tuple(r)[:6] for r in trade_files.read_trades(spark, f"file://{tmp_path}/a.csv").orderBy("date").collect()]
    day = lambda k: dt.date(2024, 1, k)
    assert rows == [(day(15), "2330", "台積電", 2, 600.0, 1), (day(16), "2330", "台積電", 1, 1610.5, -1), (day(17), "2317", "鴻海", 1, 100.0, 0)]
    plain = spark.createDataFrame([("2024-02-30", "1", "Sell", "x", "5"), ("2024-02-28", "1", "Sell", "3000", "5")], "date string, code string, action string, shares string, price string")
    assert [(r.lots, r.side) for r in trade_files.normalised_trades(plain).collect()] == [(3, -1)]
    with pytest.raises(ValueError, match="date and code"):
        trade_files.normalised_trades(plain.select("shares"))

"""Heat of sectors as a stream."""

from __future__ import annotations

import datetime as dt

from quantloom.plans import trading
from quantloom.streaming import heat, quotes
from tests.conftest import SMALL


def test_stream_equals_batch(spark, tmp_path):
    scans = trading.sector_scans(spark, SMALL).select("sector", "ts", "heat", "volume").cache()
    months = sorted({r.ts for r in scans.collect()})
    for k, cut in enumerate((0, len(months) // 3, len(months) // 2)):  # three files, in order of time
        end = (len(months) // 3, len(months) // 2, len(months))[k]
        scans.filter(scans.ts.isin(months[cut:end])).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(scans.schema).parquet(f"{tmp_path}/in")
    key = lambda r: (r.sector, r.ts)
    got = sorted(quotes.drain(heat.heat_stream(stream, expire="20000 days"), str(tmp_path / "out")).collect(), key=key)
    assert got == sorted(heat.heat_changes(scans).collect(), key=key)
    assert {"new", "heating", "cooling"} <= {r.momentum for r in got}


def test_state_expires_and_late_scans_are_left_out(spark, tmp_path):
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(k)
    batches = [[("a", day(0), 0.1, 2.0), ("b", day(0), 0.5, 1.0)], [("b", day(60), 0.5, 1.0)], [("b", day(61), 0.2, 1.0)], [("a", day(62), 0.4, 2.0), ("b", day(60), 0.9, 1.0)], [("a", day(63), 0.9, 2.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "sector string, ts timestamp, heat double, volume double").coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
    stream = spark.readStream.schema("sector string, ts timestamp, heat double, volume double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = {(r.sector, r.ts): r.momentum for r in quotes.drain(heat.heat_stream(stream, expire="30 days"), str(tmp_path / "out")).collect()}
    assert got["a", day(0)] == got["b", day(0)] == "new" and got["b", day(61)] == "cooling" and got["a", day(63)] == "surge"
    assert got["a", day(62)] == "new" and got["b", day(60)] != "surge" and len(got) == 6

"""Raw files and layered sources."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quantloom.sources import files


def test_numbers_and_dates(spark):
    texts = ["1,234.56", " 3.16% ", "-", "--", "", None, "x", "-5"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.n for r in df.select("k", files.number(F.col("t")).alias("n")).orderBy("k").collect()] == [1234.56, pytest.approx(0.0316), None, None, None, None, None, -5.0]
    df = spark.createDataFrame([("115/02/13",), ("99/1/5",), ("115/02/31",), ("x",), (None,)], "t string")
    assert [r.d for r in df.select(files.minguo_date(F.col("t")).alias("d")).collect()] == [dt.date(2026, 2, 13), dt.date(2010, 1, 5), None, None, None]


def test_positional_rows_take_the_date_of_their_file(spark, tmp_path):
    (tmp_path / "flow_20240105.json").write_text(json.dumps({"stat": "OK", "data": [["2330 ", "a", "1,000"], ["2317", "b", "-"]]}))
    got = sorted(tuple(r) for r in files.positional(spark, str(tmp_path), {"code": 0, "net": 2}).collect())
    assert got == [(dt.date(2024, 1, 5), "2317", None), (dt.date(2024, 1, 5), "2330", 1000.0)]


def test_layers_by_priority(spark):
    a = spark.createDataFrame([(1, None, 2.0), (2, 5.0, None)], "code int, pe double, pb double")
    b = spark.createDataFrame([(1, 9.0, 7.0), (3, 1.0, None)], "code int, pe double, pb double")
    got = {r.code: (r.pe, r.pb) for r in files.first_known([a, b], ["code"], ["pe", "pb"]).collect()}
    assert got == {1: (9.0, 2.0), 2: (5.0, None), 3: (1.0, None)}


def test_export_leaves_out_what_is_no_number(spark, tmp_path):
    files.export_csv(spark.createDataFrame([(1, float("nan")), (2, 1.5)], "a int, x double").coalesce(1), f"file://{tmp_path}/out")
    assert sorted(next((tmp_path / "out").glob("*.csv")).read_text().split()) == ["1,", "2,1.5", "a,x"]

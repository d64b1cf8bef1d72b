from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession

#: Tables that the driver's queries read.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(__file__)), os.environ.get("PYTHONPATH", "")])
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of a SQL text over the tables of a folder."""
    import duckdb

    def rows(sql: str, folder: str = SMALL):
        con = duckdb.connect()
        for t in TABLES:
            path = f"{folder}/{t}.parquet"
            if os.path.exists(path):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        cursor = con.execute(sql)
        names = [x[0] for x in cursor.description]
        return names, cursor.fetchall()

    return rows


def same(df, names, rows) -> None:
    """A DataFrame's rows equal some rows, whatever the order of rows and columns."""
    cols = sorted(df.columns)
    assert cols == sorted(names)
    key = lambda r: tuple((x is None, str(round(x, 4) if isinstance(x, float) else x)) for x in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9, abs=2e-9)) for x, y in zip(g, w, strict=True)), (g, w)

"""Every query of the market model against its SQL, or that it gives rows."""

from __future__ import annotations

import pytest

from quantloom import catalog
from tests.conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, oracle, name):
    same(catalog.QUERIES[name](spark, SMALL), *oracle(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    flagship = __spark_entry__.entry(spark)
    assert flagship.columns == ["code", "sector", "rsi", "adx", "rating", "trend"] and flagship.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query with SQL equals it on the smallest tables."""

from __future__ import annotations

import pytest
from compare import SMALL, oracle, rows

from assayer import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    want = oracle(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0

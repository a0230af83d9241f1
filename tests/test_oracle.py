"""Every catalog query equals its DuckDB oracle on the sf0.01 tables (names, types,
row count, values)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tillroll.plans import catalog, oracle
from oracle_harness import compare, duck_connection, duck_result, spark_result
from conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    con = duck_connection(SF_SMALL)
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = compare(spark_result(df), duck_result(duck, entry.oracle_sql()[name]))
    assert res["ok"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["band", "months", "avg_total", "avg_private", "percentage"]

"""Plan shape checks on every catalog query: the plans that would not survive scale must
not appear (cartesian products, Python in the hot path, a whole un-aggregated table in
one task), and filters / column selections must reach the Parquet scans."""

from __future__ import annotations

import os
import re

import pytest

from tillroll.plans import catalog
from conftest import SF_SMALL
from tillroll.plans.inspect import (
    has_cartesian,
    has_python_udf,
    plan_text,
    pushed_filters,
    read_schemas,
    single_partition_children,
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")

NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_plan_scales(spark, name):
    df = catalog.queries()[name](spark, SF_SMALL)
    assert not has_cartesian(df), name
    assert not has_python_udf(df), name
    for child in single_partition_children(df):
        # only already-aggregated rows (global aggregates, per-slice counts, distinct
        # dates) may be gathered into one task
        assert "Aggregate" in child, (name, child)


def test_year_range_reaches_the_scan(spark):
    df = catalog.queries()["trips_in_year"](spark, SF_SMALL)
    pushed = " ".join(pushed_filters(df))
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed


@pytest.mark.parametrize(
    "name,table_cols",
    [
        ("trip_count", {"o_custkey", "o_orderdate"}),
        # the nation lookup is eliminated: only customer keys are needed
        ("avg_items_by_month", {"o_orderkey", "o_custkey", "o_orderdate", "l_orderkey", "l_quantity", "c_custkey"}),
        ("price_quantity_corr", {"l_quantity", "l_extendedprice"}),
    ],
)
def test_scans_read_only_needed_columns(spark, name, table_cols):
    df = catalog.queries()[name](spark, SF_SMALL)
    read = set()
    for schema in read_schemas(df):
        read |= set(re.findall(r"(\w+):", schema))
    assert read == table_cols, read


def test_sequence_cuts_at_fixed_splitters(spark):
    text = plan_text(catalog.queries()["trip_sequence_by_household"](spark, SF_SMALL)).lower()
    # one lazy plan: no copy is written, and no range exchange draws a sample of its own
    assert "existingrdd" not in text and "rangepartitioning" not in text
    assert "subquery" in text


def test_loyal_households_list_no_pairs(spark):
    """An existence test: no self-join of the shares and no expansion of pairs."""
    text = plan_text(catalog.queries()["loyal_households"](spark, SF_SMALL))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 2

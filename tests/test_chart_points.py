"""Scatter samples of exact size, and histograms that evaluate their input once."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillroll.operators.chartdata import histogram, scatter_frame
from tillroll.plans.catalog import P, queries
from tillroll.plans.inspect import plan_text


def points(spark, n: int = 900):
    rows = [(k, float(k % 37), float(k % 11) if k % 50 else None) for k in range(n)]
    return spark.createDataFrame(rows + rows[:40], "k long, x double, y double"), rows + rows[:40]


def smallest(rows: list[tuple], n: int, key) -> list[tuple]:
    def order(r):
        digest = hashlib.md5(":".join("" if v is None else str(v) for v in key(r)).encode()).hexdigest()
        return digest, r[1] is not None, r[1] or 0.0, r[2] is not None, r[2] or 0.0

    return [(x, y) for _, x, y in sorted(rows, key=order)[:n]]


@pytest.mark.parametrize("partitions", [1, 7, 32])
def test_same_points_under_any_partitioning(spark, partitions):
    df, rows = points(spark)
    for n in (1, 50, 333, 5000):
        got = scatter_frame(df.repartition(partitions), "x", "y", max_points=n, key=["k"]).collect()
        assert [tuple(r) for r in got] == smallest(rows, n, lambda r: (r[0],))
        assert len(got) == min(n, len(rows))


def test_without_a_key_equal_points_come_together(spark):
    df, rows = points(spark)
    got = scatter_frame(df.repartition(5), "x", "y", max_points=60).collect()
    assert [tuple(r) for r in got] == smallest(rows, 60, lambda r: (r[1], r[2]))


def test_points_of_an_empty_table_and_wrong_arguments(spark):
    df, _ = points(spark, 3)
    assert scatter_frame(df.where("k < 0"), "x", "y", max_points=5).collect() == []
    with pytest.raises(ValueError):
        scatter_frame(df, "x", "y", max_points=5, bins=(2, 2))


def test_few_values_give_the_same_histogram(spark):
    df = spark.createDataFrame([(float(v % 23), v % 4) for v in range(500)] + [(None, 1)], "x double, w long")
    for view in ((None, None), (3, 15), (None, 0)):
        one = histogram(df, "x", 9, weight="w", view=view).collect()
        other = histogram(df, "x", 9, weight="w", view=view, few=True).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, other))
    assert histogram(df.where("x > 99"), "x", 9, few=True).collect() == []


def test_the_view_evaluates_its_input_as_often_as_the_whole_histogram(spark):
    def exchanges(name: str) -> int:
        return plan_text(queries()[name](spark, SF_SMALL)).count("Exchange hashpartitioning")

    assert exchanges("gap_histogram_view") == exchanges("gap_histogram") <= 4
    assert "Subquery" not in plan_text(queries()["income_share_histogram"](spark, SF_SMALL))


def test_private_label_plans_aggregate_by_month_only(spark):
    for name in ("private_label_by_income", "spend_by_month", "private_label_expenditure_share"):
        text = plan_text(queries()[name](spark, SF_SMALL))
        lines = [t for t in text.splitlines() if "HashAggregate(keys=" in t and "prod_id" in t.split("functions=")[0] and "month" in t.split("functions=")[0]]
        assert not lines, (name, lines)
    assert P.max_points == queries()["scatter_price_points"](spark, SF_SMALL).agg(F.count("*")).first()[0]

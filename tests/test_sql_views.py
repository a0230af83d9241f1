"""The panel and the analyses as Spark SQL views."""

from __future__ import annotations

import os

import pytest

from conftest import SF_SMALL
from tillroll.plans.catalog import P, analyses, register_views
from tillroll.sources.panel import panel_from_tpch

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")


@pytest.fixture(scope="module")
def views(spark):
    panel = panel_from_tpch(spark, SF_SMALL)
    names = register_views(panel, P, prefix="t_")
    yield panel, names
    for n in names:
        spark.catalog.dropTempView(n)


def test_every_analysis_is_a_view(spark, views):
    _, names = views
    expected = {"t_" + n for n in analyses(P) if not n.startswith("panel_")}
    assert expected | {"t_households", "t_products", "t_trips", "t_purchases"} == set(names)


def test_registering_views_runs_no_job(spark):
    panel = panel_from_tpch(spark, SF_SMALL)
    spark.sparkContext.setJobGroup("views", "views")
    try:
        names = register_views(panel, P, prefix="j_")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("views")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for n in names:
        spark.catalog.dropTempView(n)


def test_plain_sql_over_the_panel(spark, views):
    panel, _ = views
    n = spark.sql(f"SELECT count(hh_id) AS n FROM t_trips WHERE year(tc_date) = {P.year}").first()["n"]
    assert n == analyses(P)["trip_count"](panel).first()["n_trips"]
    groups = spark.sql(
        "SELECT group_at_prod_id, count(prod_id) AS n_products FROM t_products GROUP BY group_at_prod_id"
    )
    assert sorted(map(tuple, groups.collect())) == sorted(map(tuple, analyses(P)["products_per_group"](panel).collect()))


def test_sql_over_analysis_views(spark, views):
    top = spark.sql(
        "SELECT hh_id, max(percentage_of_spent) AS best FROM t_loyal_pair GROUP BY hh_id ORDER BY best DESC LIMIT 1"
    ).first()
    assert top["best"] > P.pair_threshold
    months = spark.sql("SELECT count(*) AS n FROM t_items_vs_trips_by_month").first()["n"]
    assert months == 12

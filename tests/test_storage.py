"""Storage that survives failures and repeats: staged replace, merged loads, bucketed tables,
the loyalty state, distinct sketches, and header discovery over many files."""

from __future__ import annotations

import datetime as dt
import os
import re
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, d, m, make_panel
from tillroll.operators import distinct, loyalty
from tillroll.plans.catalog import P, analyses
from tillroll.plans.inspect import plan_text
from tillroll.sources import distinct_state, loyalty_state
from tillroll.sources.layout import trips_with_year, write_panel_tables
from tillroll.sources.panel import csv_headers, panel_from_tpch, read_panel, read_typed_csv
from tillroll.sources.schema import HOUSEHOLDS
from tillroll.sources.sinks import merge_rows, write_table


def _scratch() -> str:
    return tempfile.mkdtemp(prefix="tillroll-storage-")


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


# ---- headers ----


def test_headers_of_two_thousand_files(spark):
    root = _scratch()
    for i in range(2000):
        name = f"a b{i}.csv" if i % 2 else f"c[{i}].csv"
        text = f"hh_id,hh_income,hh_state\n{i},1,AL\n" if i % 3 else f"hh_state,hh_id,hh_income\nTX,{i},2\n"
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    open(os.path.join(root, "empty.csv"), "w").close()
    with open(os.path.join(root, "long.csv"), "w") as f:
        f.write("hh_income,hh_state,hh_id\n")
        f.writelines(f"3,NY,{5000 + i}\n" for i in range(200_000))
    began = time.time()
    found = csv_headers(spark, root)
    assert {h: len(files) for h, files in found.items()} == {"hh_id,hh_income,hh_state": 1333, "hh_state,hh_id,hh_income": 667, "hh_income,hh_state,hh_id": 1}
    assert time.time() - began < 60
    typed = read_typed_csv(spark, root, HOUSEHOLDS)
    assert typed.where("hh_income IS NULL OR hh_state IS NULL OR hh_id IS NULL").count() == 0
    got = {(r["hh_income"], r["hh_state"]): (r["n"], r["s"]) for r in typed.groupBy("hh_income", "hh_state").agg(F.count("*").alias("n"), F.sum("hh_id").alias("s")).collect()}
    ones, twos = [i for i in range(2000) if i % 3], [i for i in range(2000) if i % 3 == 0]
    assert got == {(1, "AL"): (1333, sum(ones)), (2, "TX"): (667, sum(twos)), (3, "NY"): (200_000, sum(range(5000, 205_000)))}


def test_headers_are_read_by_tasks(spark):
    root = _scratch()
    for i in range(3):
        with open(os.path.join(root, f"{i}.csv"), "w") as f:
            f.write("hh_id,hh_income,hh_state\n1,2,AL\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        assert len(csv_headers(spark, root)) == 1
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# ---- replace ----


def test_a_failed_replace_leaves_the_old_table(spark):
    target = os.path.join(_scratch(), "t")
    write_table(spark.range(10), target, "replace")
    failing = spark.range(100).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("midway"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="midway"):
        write_table(failing, target, "replace")
    assert rows(spark.read.parquet(target)) == rows(spark.range(10))
    assert os.listdir(os.path.dirname(target)) == ["t"]


def test_a_table_is_rebuilt_from_itself(spark):
    target = os.path.join(_scratch(), "t")
    write_table(spark.range(10).withColumn("p", F.col("id") % 3), target, "replace", partition_by=["p"])
    write_table(spark.read.parquet(target).where("id % 2 = 0"), target, "replace", partition_by=["p"])
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8]
    assert os.listdir(os.path.dirname(target)) == ["t"]


# ---- merge ----


def _trips(spark, ids, spent=1):
    return make_panel(spark, trips=[(i, i % 4, d(f"200{4 + i % 2}-01-{1 + i % 28:02d}") if i % 7 else None, "R", m(spent)) for i in ids]).trips


def test_loading_the_same_rows_twice_changes_nothing(spark):
    target = os.path.join(_scratch(), "trips")
    first, second = (trips_with_year(_trips(spark, ids)) for ids in (range(30), range(20, 50)))
    both = trips_with_year(_trips(spark, range(50)))
    for load in (first, second, first, second, second):
        merge_rows(load, target, ["tc_id"], ["tc_year"])
    assert rows(spark.read.parquet(target).select(*both.columns)) == rows(both)
    merge_rows(trips_with_year(_trips(spark, [3, 7], spent=9)), target, ["tc_id"], ["tc_year"])  # 7 has no date
    changed = spark.read.parquet(target).where("tc_total_spent = 9")
    assert sorted(r["tc_id"] for r in changed.collect()) == [3, 7] and spark.read.parquet(target).count() == 50


def test_untouched_partitions_are_not_rewritten(spark):
    target = os.path.join(_scratch(), "trips")
    merge_rows(trips_with_year(_trips(spark, range(30))), target, ["tc_id"], ["tc_year"])

    def files(year):
        return sorted(f for f in os.listdir(f"{target}/tc_year={year}") if f.endswith(".parquet"))

    before = files(2004), files(2005)
    merge_rows(trips_with_year(_trips(spark, [31, 33])), target, ["tc_id"], ["tc_year"])  # 2005
    assert files(2004) == before[0] and files(2005) != before[1]


def test_lines_of_a_trip_come_and_go_together(spark):
    target = os.path.join(_scratch(), "lines")
    lines = spark.createDataFrame([(1, 5, 2), (1, 5, 2), (2, 6, 1), (None, 7, 1)], "tc_id long, prod_id long, q int")
    for _ in range(3):
        merge_rows(lines, target, ["tc_id"])
    assert rows(spark.read.parquet(target)) == rows(lines)
    merge_rows(spark.createDataFrame([(1, 8, 1)], lines.schema), target, ["tc_id"])
    assert rows(spark.read.parquet(target)) == [(1, 8, 1), (2, 6, 1), (None, 7, 1)]


# ---- bucketed tables ----


@pytest.fixture(scope="module")
def bucketed(spark):
    direct = panel_from_tpch(spark, SF_SMALL)
    names = write_panel_tables(direct, "tillroll_test_", buckets=7)
    yield direct, read_panel(spark, names, "table")
    for n in names.values():
        spark.sql(f"DROP TABLE IF EXISTS {n}")


@pytest.mark.parametrize("name", ["avg_items_by_month", "spend_by_month", "private_label_by_income", "items_vs_trips_by_month", "loyal_pair", "sample_by_keys", "panel_trips"])
def test_same_answers_on_bucketed_tables(bucketed, name):
    direct, stored = bucketed
    fn = analyses(P)[name]
    assert fn(stored).schema.simpleString() == fn(direct).schema.simpleString()
    assert rows(fn(stored)) == rows(fn(direct))


@pytest.mark.parametrize("name", ["avg_items_by_month", "spend_by_month", "private_label_by_income"])
def test_lines_and_trips_join_without_an_exchange(spark, bucketed, name):
    _, stored = bucketed
    # households and products broadcast, trips and lines are too large to
    settings = {"spark.sql.autoBroadcastJoinThreshold": "70000", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        text = plan_text(analyses(P)[name](stored))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert re.search(r"SortMergeJoin \[tc_id", text), text
    assert not re.search(r"Exchange hashpartitioning\(tc_id", text), text


# ---- loyalty state ----


def _spread(spark, ids):
    panel = [(i, i % 9 if i % 13 else None, d(f"200{i % 3}-{1 + i % 12:02d}-05") if i % 11 else None, "ABCD"[i % 4] if i % 17 else None, m(i % 50)) for i in ids]
    return make_panel(spark, trips=panel).trips


def test_state_of_loads_equals_the_whole(spark):
    root = os.path.join(_scratch(), "state")
    loads = {"jan": range(200), "feb": range(200, 500), "mar": range(500, 640)}
    assert loyalty_state.read_state(spark, root) is None
    for name, ids in loads.items():
        assert loyalty_state.add_trips(_spread(spark, ids), root, name)
        assert not loyalty_state.add_trips(_spread(spark, ids), root, name)  # repeated
    whole = _spread(spark, range(640))
    state = loyalty_state.read_state(spark, root)
    assert rows(state) == rows(loyalty.retailer_state(whole)) and state.schema == loyalty.retailer_state(whole).schema
    for months in (1, 8, 12):
        assert rows(loyalty.share_of_state(state, months)) == rows(loyalty.active_retailer_share(whole, months))
    assert loyalty_state.loads_in(spark, root) == set(loads)
    assert sorted(os.listdir(root)) == ["v000000002", "v000000003"]


def test_a_failed_load_leaves_the_state(spark):
    root = os.path.join(_scratch(), "state")
    loyalty_state.add_trips(_spread(spark, range(50)), root, "a")
    before = rows(loyalty_state.read_state(spark, root))
    bad = _spread(spark, range(50, 90)).withColumn("tc_total_spent", F.when(F.col("tc_id") == 77, F.raise_error(F.lit("midway")).cast("decimal(18,2)")).otherwise(F.col("tc_total_spent")))
    with pytest.raises(Exception, match="midway"):
        loyalty_state.add_trips(bad, root, "b")
    assert rows(loyalty_state.read_state(spark, root)) == before and loyalty_state.loads_in(spark, root) == {"a"}
    assert os.listdir(root) == ["v000000001"]
    assert loyalty_state.add_trips(_spread(spark, range(50, 90)), root, "b")


# ---- distinct sketches ----


def _many(spark, n, months=6):
    """Trips of ``n`` households in each month, half of them in the next month too."""
    ids = spark.range(n * months).select(
        F.col("id").alias("tc_id"),
        (F.col("id") % n + (F.col("id") / n).cast("int") * (n // 2)).alias("hh_id"),
        F.add_months(F.lit(dt.date(2004, 1, 15)), (F.col("id") / n).cast("int")).alias("tc_date"),
        (F.col("id") % 7).cast("string").alias("tc_retailer_code"),
    )
    return ids


@pytest.mark.parametrize("lg_k", [10, 12, 14])
def test_sketches_of_any_range_are_within_their_bound(spark, lg_k):
    trips = _many(spark, 40_000)
    state = distinct.month_sketches(trips, lg_k)
    assert state.count() == 6
    for first, last in ((None, None), (dt.date(2004, 2, 1), dt.date(2004, 4, 1)), (dt.date(2004, 6, 1), None), (None, dt.date(2004, 1, 1))):
        exact = trips
        if first:
            exact = exact.filter(F.col("tc_date") >= first)
        if last:
            exact = exact.filter(F.trunc("tc_date", "MM") <= last)
        want = exact.agg(F.countDistinct("hh_id"), F.countDistinct("tc_retailer_code")).first()
        got = distinct.approx_distinct(state, first, last).first()
        assert abs(got["n_households"] - want[0]) <= 5 * distinct.relative_error(lg_k) * want[0]
        assert got["n_retailers"] == want[1]
    none = distinct.approx_distinct(state, dt.date(2010, 1, 1)).first()
    assert (none["n_households"], none["n_retailers"]) == (0, 0)
    assert distinct.month_sketches(trips.limit(0)).count() == 0


def test_sketch_state_of_loads_equals_the_whole(spark):
    root = os.path.join(_scratch(), "sketches")
    trips = _many(spark, 3000)
    for k, name in enumerate(("a", "b", "c")):  # the loads cut across the months
        part = trips.filter(F.col("tc_id") % 3 == k)
        assert distinct_state.add_trips(part, root, name)
        assert not distinct_state.add_trips(part, root, name)
    month = F.col("month")
    of_loads = distinct.approx_distinct(distinct_state.read_state(spark, root), by=month)
    whole = distinct.approx_distinct(distinct.month_sketches(trips), by=month)
    bound = 5 * distinct.relative_error()
    for a, b in zip(rows(of_loads), rows(whole), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) <= bound * b[1] and a[2] == b[2]
    assert distinct_state.loads_in(spark, root) == {"a", "b", "c"}


def test_sketches_of_odd_trips(spark):
    trips = make_panel(spark, trips=[(1, 5, d("2004-03-02"), "A", m(1)), (2, 5, d("2004-03-09"), None, m(1)), (3, None, None, "B", m(1)), (3, None, None, "B", m(1)), (4, 6, None, "B", m(1))]).trips
    state = distinct.month_sketches(trips)
    assert rows(distinct.approx_distinct(state, by=F.col("month"))) == [(None, 1, 1), (dt.date(2004, 3, 1), 1, 1)]
    assert rows(distinct.approx_distinct(state)) == [(2, 2)]
    assert rows(distinct.approx_distinct(state, dt.date(2004, 1, 1))) == [(1, 1)]
    assert rows(distinct.distinct_by_quarter(trips)) == [("2004-Q1", 1, 1, True, True)]

"""The plans a large cluster would run: no broadcast joins (every dimension too large),
many shuffle partitions, skew splitting forced on. Results must not change, and
range-partitioned sequence slices must stay balanced under a hot key."""

from __future__ import annotations

import contextlib
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_harness import compare, duck_connection, duck_result, spark_result
from tillroll.operators.sequence import sequence_number

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")

SCALE_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1KB",
}


@contextlib.contextmanager
def conf(spark, settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.fixture(scope="module")
def duck():
    con = duck_connection(SF_SMALL)
    yield con
    con.close()


@pytest.mark.parametrize(
    "name",
    [
        "sample_by_keys", "trip_sequence_by_household", "next_trip_pairs", "avg_gap_per_household",
        "monthly_active_trips", "retailer_share", "loyal_pair", "loyal_household_state",
        "loyal_income_comparison", "avg_items_by_month", "items_trips_corr",
        "private_label_expenditure_share", "private_label_by_income", "private_label_share_by_income_month",
        "gap_histogram", "scatter_price_quantity",
    ],
)
def test_results_hold_without_broadcasts(spark, duck, name):
    with conf(spark, SCALE_CONF):
        df = entry.queries()[name](spark, SF_SMALL)
        res = compare(spark_result(df), duck_result(duck, entry.oracle_sql()[name]))
    assert res["ok"], res


def test_hot_key_slices_stay_balanced(spark):
    rnd = random.Random(3)
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 5000), rnd.randint(0, 365), i) for i in range(60000)]
    df = spark.createDataFrame(rows, "hh long, day int, tc long").repartition(7)
    numbered = sequence_number(df, ["hh", "day", "tc"], "id", num_slices=12)
    sizes = [r["n"] for r in numbered.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    # one household holds a third of the rows, yet no slice is far above the mean
    assert max(sizes) <= 2 * (len(rows) / 12), sizes


def test_cluster_profile_settings_apply(spark, duck):
    from tillroll.session import cluster_conf

    settings = cluster_conf(shuffle_bytes=4 * 256 * 1024 * 1024, executors_cores=8)
    assert settings["spark.sql.shuffle.partitions"] == "16"
    with conf(spark, settings):
        for name in ("next_trip_pairs", "private_label_by_income"):
            df = entry.queries()[name](spark, SF_SMALL)
            res = compare(spark_result(df), duck_result(duck, entry.oracle_sql()[name]))
            assert res["ok"], (name, res)

"""Benchmark the headline analyses.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: a warm-up pass over all of them, so that the first queries do not
pay for compiling what they share, then the median of ``$BENCH_REPEATS`` (default 5) timed
runs of each. Each run executes the whole plan into Spark's no-op sink (nothing is
collected). Prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
Set BENCH_ALL=1 to time every catalog query instead of the headline set. The line also
carries a machine-speed calibration (a fixed Python loop and a fixed Spark job).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.plans.catalog import queries  # noqa: E402
from tillroll.session import build_session  # noqa: E402

HEADLINE = [
    "trips_in_year",
    "department_profile",
    "sample_by_keys",
    "trip_sequence_by_household",
    "next_trip_pairs",
    "inactive_gap_count",
    "avg_gap_per_household",
    "global_gap_count",
    "retailer_share",
    "loyal_pair",
    "loyal_income_comparison",
    "avg_items_by_month",
    "items_trips_corr",
    "price_quantity_corr",
    "private_label_share_by_group",
    "private_label_expenditure_share",
    "private_label_by_income",
    "gap_histogram",
    "scatter_price_quantity",
]


def _calibrate(spark) -> dict[str, float]:
    """Machine speed in this run (the VM's speed varies over time): a fixed pure-Python
    loop and a fixed Spark job, median of 3 each. Divide query times by these to compare
    runs made at different times."""
    def loop() -> float:
        t0 = time.perf_counter()
        total = 0
        for i in range(3_000_000):
            total += i
        return time.perf_counter() - t0

    def job() -> float:
        t0 = time.perf_counter()
        spark.range(20_000_000).selectExpr("sum(id % 7) AS s").collect()
        return time.perf_counter() - t0

    job()  # warm-up
    return {
        "python_loop_sec": round(statistics.median(loop() for _ in range(3)), 4),
        "spark_range_sum_sec": round(statistics.median(job() for _ in range(3)), 4),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="tillroll-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    calibration = _calibrate(spark)
    catalog = queries()
    names = list(catalog) if os.environ.get("BENCH_ALL") else HEADLINE
    timings: dict[str, float] = {}

    def run(name: str) -> float:
        t0 = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in names:  # warm-up pass
        run(name)
    for name in names:
        timings[name] = round(statistics.median(run(name) for _ in range(repeats)), 4)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_median_sec" if not os.environ.get("BENCH_ALL") else "all_total_median_sec",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "spark": spark.version,
        "calibration": calibration,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

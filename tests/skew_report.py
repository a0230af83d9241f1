"""Write SKEW.md: task balance of the heavy analyses on a hot-household panel.

The panel is derived by Spark from the driver's tables: every third trip is reassigned to
one household, so that household holds a third of all trips. Broadcast joins are disabled
(the plans a large cluster runs). Task input records per stage come from Spark's event
log, written to a fresh scratch folder.

usage: python tests/skew_report.py [sf_dir] [out.md]
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import statistics
import sys
import tempfile

import zstandard

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tillroll.plans.catalog import P, analyses  # noqa: E402
from tillroll.session import build_session  # noqa: E402
from tillroll.sources.panel import Panel, panel_from_tpch  # noqa: E402

QUERIES = [
    "next_trip_pairs", "trip_sequence_by_household", "retailer_share", "loyal_pair", "sample_by_keys",
    "avg_items_by_month", "private_label_by_income",
]


def stage_records(log_dir: str) -> dict[int, tuple[str, list[int]]]:
    groups, tasks = {}, collections.defaultdict(list)
    for path in glob.glob(os.path.join(log_dir, "*", "events_*")) + glob.glob(os.path.join(log_dir, "*.zstd")):
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
            for line in io.TextIOWrapper(reader, encoding="utf-8"):
                e = json.loads(line)
                if e["Event"] == "SparkListenerJobStart":
                    for sid in e["Stage IDs"]:
                        groups[sid] = e.get("Properties", {}).get("spark.jobGroup.id")
                elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                    m = e["Task Metrics"]
                    tasks[e["Stage ID"]].append(
                        m["Input Metrics"]["Records Read"] + m["Shuffle Read Metrics"]["Total Records Read"]
                    )
    return {sid: (groups.get(sid), recs) for sid, recs in tasks.items()}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out_path = sys.argv[2] if len(sys.argv) > 2 else os.path.join(
        os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "SKEW.md")
    log_dir = tempfile.mkdtemp(prefix="tillroll-eventlog-")
    spark = build_session("local[8]", 16, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    })
    base = panel_from_tpch(spark, sf_dir)
    hot_trips = base.trips.withColumn("hh_id", F.when(F.col("tc_id") % 3 == 0, F.lit(1)).otherwise(F.col("hh_id")))
    panel = Panel(base.households, base.products, hot_trips, base.purchases)
    share = hot_trips.filter(F.col("hh_id") == 1).count() / hot_trips.count()
    queries = analyses(P)
    for name in QUERIES:
        spark.sparkContext.setJobGroup(name, name)
        queries[name](panel).write.format("noop").mode("overwrite").save()
    spark.stop()

    lines = [
        "# SKEW",
        "",
        f"Task balance on a hot-household panel derived from `{sf_dir}`: household 1 holds",
        f"{share:.1%} of all trips. Broadcasts disabled, 16 shuffle partitions, local[8]. For every",
        "stage with at least 4 tasks and 20,000 input records: records read per task (scan",
        "input + shuffle input), largest task against the median. Generated by",
        "`tests/skew_report.py`; stages on a single Parquet row group are one task by nature.",
        "",
        "| analysis | stage | tasks | records | max task | median task | max / median |",
        "| --- | --- | --- | --- | --- | --- | --- |",
    ]
    for sid, (group, recs) in sorted(stage_records(log_dir).items()):
        if len(recs) < 4 or sum(recs) < 20000:
            continue
        med = statistics.median(recs)
        lines.append(
            f"| `{group}` | {sid} | {len(recs)} | {sum(recs):,} | {max(recs):,} | {int(med):,} | "
            f"{max(recs) / max(med, 1):.1f} |"
        )
    with open(out_path, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(f"wrote {out_path}")


if __name__ == "__main__":
    main()

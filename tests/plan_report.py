"""Write PLANS.md: the shape of every catalog query's physical plan.

For each query, two configurations: the local default (small tables, AQE may broadcast)
and a cluster-shaped one (broadcast disabled, as when every side is large). Counts are
taken from the plan as ``explain()`` prints it (before AQE re-planning).

usage: python tests/plan_report.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.plans import catalog  # noqa: E402
from tillroll.plans.inspect import physical_plan  # noqa: E402
from tillroll.session import build_session  # noqa: E402

CLUSTER = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def shape(plan: str) -> dict:
    return {
        "hash": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "bcast": len(re.findall(r"BroadcastExchange", plan)),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "window": len(re.findall(r"\bWindow\b", plan)),
        "expand": plan.count("Expand"),
    }


def scans(text: str) -> list[str]:
    out = []
    for block in re.findall(r"Scan parquet[^\n]*\n(?:[^\n]+\n)+?ReadSchema: [^\n]+", text):
        table = re.search(r"/(\w+)\.parquet", block)
        cols = re.search(r"ReadSchema: struct<([^>]*)>", block)
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", block)
        names = ",".join(c.split(":")[0] for c in cols.group(1).split(",")) if cols else ""
        filt = pushed.group(1) if pushed and pushed.group(1) else ""
        filt = ", ".join(f for f in filt.split(", ") if not f.startswith("IsNotNull"))
        out.append(f"{table.group(1) if table else '?'}({names}){' [' + filt + ']' if filt else ''}")
    return sorted(set(out))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out_path = sys.argv[2] if len(sys.argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "PLANS.md")
    spark = build_session("local[8]", 8)
    rows = []
    for name, fn in catalog.queries().items():
        loc = shape(physical_plan(fn(spark, sf_dir), "simple"))
        for k, v in CLUSTER.items():
            spark.conf.set(k, v)
        df = fn(spark, sf_dir)
        clu, cluster_scans = shape(physical_plan(df, "simple")), scans(physical_plan(df))
        for k in CLUSTER:
            spark.conf.unset(k)
        rows.append((name, loc, clu, cluster_scans))

    def fmt(s: dict) -> str:
        parts = [f"{k} {v}" for k, v in s.items() if v]
        return ", ".join(parts) or "—"

    lines = [
        "# PLANS",
        "",
        "Physical plan shape of every catalog query (generated by `tests/plan_report.py` on",
        f"`{sf_dir}`). *local*: default settings (AQE may still turn sort-merge joins into",
        "broadcasts at runtime). *cluster*: broadcasting disabled, the plan when every join side",
        "is large. Counts: `hash`/`range`/`single` = shuffle exchanges by hash, range, to one",
        "task; `bcast` = broadcast exchanges; `smj`/`bhj` = sort-merge / broadcast hash joins;",
        "`window`, `expand` = operators. `single` only ever sits above an aggregate (global",
        "totals, per-slice counts, distinct dates), checked in `tests/test_plans.py`. Scans list",
        "the columns read and the filters pushed into Parquet (not-null filters omitted).",
        "",
        "| query | local | cluster | scans (columns) [pushed filters] |",
        "| --- | --- | --- | --- |",
    ]
    for name, loc, clu, sc in rows:
        lines.append(f"| `{name}` | {fmt(loc)} | {fmt(clu)} | {'<br>'.join(sc)} |")
    with open(out_path, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(f"wrote {out_path} ({len(rows)} queries)")
    spark.stop()


if __name__ == "__main__":
    main()

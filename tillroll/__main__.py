"""Run one analysis on a panel and write its result.

    python -m tillroll <analysis> --panel DIR [--format csv|parquet|table]
                       [--out PATH] [--out-format csv|parquet] [--year 2004 ...]
    python -m tillroll --list
    python -m tillroll --panel DIR [--format csv] --write-layout OUT
    python -m tillroll --panel DIR --sql "SELECT ... FROM trips / loyal_pair / ..."

``--write-layout OUT`` stores the panel as Parquet with trips and purchases partitioned
by trip year (read it back with ``--panel OUT --format parquet``).

``--panel DIR`` holds households, products, trips and purchases (``<name>.csv`` files or
folders, or ``<name>`` Parquet folders); with ``--format table`` the names are catalog
tables. The session comes from ``spark-submit`` / the environment; with ``--out`` the
result is written in parallel by the executors (CSV with a header row, the hand-off format
of the study), without it the first 50 rows are shown.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession

from tillroll.plans.catalog import STUDY, analyses, register_views
from tillroll.sources.layout import write_panel
from tillroll.sources.panel import read_panel
from tillroll.sources.sinks import export_csv, write_table

TABLES = ("households", "products", "trips", "purchases")


def _panel_paths(spark: SparkSession, root: str, fmt: str) -> dict[str, str]:
    """Where each table lies, on whatever file system ``root`` names."""
    if fmt == "table":
        return {t: t for t in TABLES}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).exists(at)

    root = root.rstrip("/")
    return {t: next((c for c in (f"{root}/{t}.{fmt}",) if exists(c)), f"{root}/{t}") for t in TABLES}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tillroll", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    ap.add_argument("analysis", nargs="?")
    ap.add_argument("--list", action="store_true", help="list the analyses")
    ap.add_argument("--panel", default=".")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet", "orc", "table"])
    ap.add_argument("--out")
    ap.add_argument("--out-format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--write-layout", metavar="OUT", help="store the panel in the year-partitioned layout")
    ap.add_argument("--sql", help="run a Spark SQL statement over the panel tables and analysis views")
    for field in dataclasses.fields(STUDY):
        if field.type in ("int", "float", "str", int, float, str):
            ap.add_argument(f"--{field.name.replace('_', '-')}", type=type(getattr(STUDY, field.name)))
    args = ap.parse_args(argv)

    overrides = {
        f.name: getattr(args, f.name)
        for f in dataclasses.fields(STUDY)
        if getattr(args, f.name, None) is not None
    }
    params = dataclasses.replace(STUDY, **overrides)
    queries = analyses(params)
    if args.write_layout is None and args.sql is None and (args.list or not args.analysis):
        print("\n".join(sorted(queries)))
        return 0
    if args.analysis and args.analysis not in queries:
        print(f"unknown analysis {args.analysis!r}; see --list", file=sys.stderr)
        return 2

    spark = SparkSession.builder.appName("tillroll").getOrCreate()
    panel = read_panel(spark, _panel_paths(spark, args.panel, args.format), args.format)
    if args.write_layout:
        for name, path in write_panel(panel, args.write_layout).items():
            print(f"{name}\t{path}")
        return 0
    if args.sql:
        register_views(panel, params)
        result = spark.sql(args.sql)
    else:
        result = queries[args.analysis](panel)
    if args.out is None:
        result.show(50, truncate=False)
    elif args.out_format == "csv":
        export_csv(result, args.out)
    else:
        write_table(result, args.out, "overwrite")
    return 0

if __name__ == "__main__":
    sys.exit(main())

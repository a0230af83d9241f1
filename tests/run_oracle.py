"""Run every catalog query in Spark and its oracle SQL in DuckDB; print one line each.

usage: python tests/run_oracle.py [--cluster] [sf_dir] [name ...]

--cluster runs the Spark side as a large cluster would plan it: no broadcast joins,
32 shuffle partitions, skew splitting forced on (see tests/test_scale_paths.py).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck_connection, duck_result, spark_result  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tillroll.session import build_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    cluster = "--cluster" in args
    args = [a for a in args if a != "--cluster"]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    only = set(args[1:])
    if cluster:
        from test_scale_paths import SCALE_CONF

        spark = build_session("local[8]", 32, extra=SCALE_CONF)
    else:
        spark = build_session("local[8]", 8)
    con = duck_connection(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only or name not in sqls:
            continue
        t0 = time.time()
        try:
            res = compare(spark_result(fn(spark, sf_dir)), duck_result(con, sqls[name]))
        except Exception as exc:  # report and continue
            res = {"ok": False, "error": f"{type(exc).__name__}: {str(exc)[:400]}"}
        res["sec"] = round(time.time() - t0, 2)
        bad += not res["ok"]
        print(name, json.dumps(res, default=str), flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

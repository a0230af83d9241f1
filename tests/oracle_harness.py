"""Compare a Spark result with a DuckDB oracle result: column names, column types,
row count, and the multiset of rows (exact values)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(v))
    if isinstance(v, decimal.Decimal):
        return (3, str(v.normalize()) if v != 0 else "0")
    if isinstance(v, bool):
        return (4, str(v))
    if isinstance(v, int):
        return (5, str(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return (6, v.isoformat())
    return (7, str(v))


def spark_result(df):
    names = df.columns
    types = [_SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
             for f in df.schema.fields]
    rows = [tuple(r) for r in df.collect()]
    return names, types, rows


def duck_result(con, sql: str):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    types = [str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]
    return names, types, rows


def _rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark_res, duck_res) -> dict:
    sn, st, sr = spark_res
    dn, dtp, dr = duck_res
    out = {
        "names": sorted(sn) == sorted(dn),
        "types": sorted(zip(sn, st)) == sorted(zip(dn, dtp)),
        "rows": len(sr) == len(dr),
        "spark_rows": len(sr),
        "oracle_rows": len(dr),
    }
    out["values"] = out["names"] and _rows_by_name(sn, sr) == _rows_by_name(dn, dr)
    if not out["types"]:
        out["type_detail"] = {"spark": dict(zip(sn, st)), "oracle": dict(zip(dn, dtp))}
    if out["names"] and not out["values"]:
        a, b = Counter(_rows_by_name(sn, sr)), Counter(_rows_by_name(dn, dr))
        out["value_detail"] = {
            "spark_only": list((a - b).elements())[:3],
            "oracle_only": list((b - a).elements())[:3],
        }
    out["ok"] = out["names"] and out["types"] and out["rows"] and out["values"]
    return out

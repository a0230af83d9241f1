"""Plan checks used by tests and the bench: read the physical plan Spark chose and flag
shapes that do not scale (whole fact table in one task, cartesian products, Python in
the hot path, scans that read every column)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    """What ``df.explain(mode)`` prints, as a string."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def plan_text(df: DataFrame) -> str:
    """The physical plan as ``df.explain()`` prints it (the initial plan under AQE)."""
    return physical_plan(df, "simple")


def single_partition_children(df: DataFrame) -> list[str]:
    """For each 'Exchange SinglePartition' in the plan, the operator right below it."""
    lines = plan_text(df).splitlines()
    return [lines[i + 1].strip() for i, line in enumerate(lines[:-1]) if "Exchange SinglePartition" in line]


def has_cartesian(df: DataFrame) -> bool:
    text = plan_text(df)
    return "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text


def has_python_udf(df: DataFrame) -> bool:
    text = plan_text(df)
    return any(k in text for k in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"))


def single_partition_exchanges(df: DataFrame) -> int:
    return plan_text(df).count("SinglePartition")


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical_plan(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^>]*>)", physical_plan(df))

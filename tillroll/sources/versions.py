"""A small state kept on storage in versions, merged load by load.

Each merge writes a new version folder, with the state and the names of the loads in it, and
moves it in by one rename: a failed job, or two that raced, leave the versions before as they
were. A load whose name is already there is ignored, so loads may be repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.sources.sinks import _filesystem

KEEP = 2  # versions that stay, so that a reader of the one before can finish


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _filesystem(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def _folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v{version:09d}"


def read_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest state; None before the first load."""
    versions = _versions(spark, root)
    return spark.read.parquet(f"{_folder(root, versions[-1])}/state") if versions else None


def loads_in(spark: SparkSession, root: str) -> set[str]:
    """The names of the loads that the newest state holds."""
    versions = _versions(spark, root)
    return {r["load"] for r in spark.read.parquet(f"{_folder(root, versions[-1])}/loads").collect()} if versions else set()


def add_load(state: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], root: str, load: str) -> bool:
    """Merge ``state``, that of the load named ``load``, into the state at ``root``. False, and
    nothing changes, if it holds that load already. Of two jobs that merge at a time, the later
    to finish fails and is run again."""
    spark = state.sparkSession
    versions = _versions(spark, root)
    known = loads_in(spark, root)
    if load in known:
        return False
    if versions:
        state = merge(read_state(spark, root), state)
    fs, path = _filesystem(spark, root)
    beside = f"{root.rstrip('/')}/_new-{uuid.uuid4().hex}"
    try:
        state.write.parquet(f"{beside}/state")
        names = spark.createDataFrame([(n,) for n in sorted(known | {load})], "load string")
        names.coalesce(1).write.parquet(f"{beside}/loads")
        version = (versions or [0])[-1] + 1
        # the rename fails, or moves into a folder that is there, if another job was faster
        if fs.exists(path(_folder(root, version))) or not fs.rename(path(beside), path(_folder(root, version))):
            raise OSError(f"version {version} of {root} is there already")
    except Exception:
        fs.delete(path(beside), True)
        raise
    for old in versions[: -(KEEP - 1) or None]:
        fs.delete(path(_folder(root, old)), True)
    return True

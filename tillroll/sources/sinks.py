"""Writers: persist a derived table (CREATE TABLE AS SELECT / append loads) or export a
result as CSV for charting tools."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MODES = {"append", "overwrite", "replace", "error", "ignore"}


def write_table(
    df: DataFrame,
    target: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    as_table: bool = False,
    options: dict[str, str] | None = None,
) -> None:
    """Write ``df`` to a path (default), a catalog table (``as_table=True``) or, with
    ``fmt="jdbc"``, a database table named ``target`` (connection settings such as
    ``url``, ``user``, ``password`` go in ``options``; nothing is hard-coded).

    ``mode`` is append / overwrite / replace. Reloads should use ``overwrite`` or, where the
    old table must outlive a failed job or is itself read, ``replace``, which writes a path
    beside it and swaps it in (``replace_path``); repeated appends duplicate rows (see
    ``merge_rows``).
    """
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {sorted(_MODES)}")
    if mode == "replace" and not as_table and fmt != "jdbc":
        replace_path(df, target, fmt, partition_by, options)
        return
    writer = df.write.mode("overwrite" if mode == "replace" else mode).format(fmt)
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "jdbc":
        writer.option("dbtable", target).save()
    elif as_table:
        writer.saveAsTable(target)
    else:
        writer.save(target)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def replace_path(
    df: DataFrame, target: str, fmt: str = "parquet", partition_by: list[str] | None = None, options: dict[str, str] | None = None
) -> None:
    """Replace the files of ``target`` by the rows of ``df``, which may read ``target``.

    The rows are written beside it; only when that job has succeeded is the old folder moved
    away and the new one moved in (two renames of folders; the old one is put back if the
    second fails). A failed job leaves the old table as it was and nothing beside it."""
    spark = df.sparkSession
    fs, path = _filesystem(spark, target)
    base, mark = target.rstrip("/"), uuid.uuid4().hex
    fresh, old, final = path(f"{base}.new-{mark}"), path(f"{base}.old-{mark}"), path(base)
    try:
        write_table(df, fresh.toString(), "error", fmt, partition_by, options=options)
    except Exception:
        fs.delete(fresh, True)
        raise
    present = fs.exists(final)
    if present and not fs.rename(final, old):
        fs.delete(fresh, True)
        raise OSError(f"{base} could not be moved away")
    if not fs.rename(fresh, final):
        if present:
            fs.rename(old, final)
        raise OSError(f"{fresh.toString()} could not be moved to {base}")
    if present:
        fs.delete(old, True)


def merge_rows(df: DataFrame, target: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Load ``df`` into the Parquet table at ``target`` so that loading it again changes nothing.

    The rows of a key come and go together: where the load has a key, its rows take the place
    of the target's rows of that key (in the same partition; a key does not move between
    partitions). Nulls are equal to each other. Only partitions that the load touches are read and written
    anew, in one commit of Spark's dynamic partition overwrite; without ``partition_by`` the
    table is one partition, and is swapped as by ``replace_path``. A failed job leaves the
    table as it was, so a load is simply run again. A load that gives every row it has to the
    same keys twice in itself keeps both, as a first load does."""
    spark = df.sparkSession
    fs, path = _filesystem(spark, target)
    if not fs.exists(path(target)):
        write_table(df, target, "error", partition_by=partition_by)
        return
    parts = partition_by or []
    stored = spark.read.parquet(target).select(*df.columns)
    if parts:
        touched = df.select(*parts).distinct()
        stored = stored.join(F.broadcast(touched), _equal(stored, touched, parts), "left_semi")  # prunes folders
    given = df.select(*{*keys, *parts}).distinct()
    kept = stored.join(given, _equal(stored, given, given.columns), "left_anti")
    merged = kept.unionByName(df)
    if not parts:
        replace_path(merged, target)
        return
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(target)


def _equal(a: DataFrame, b: DataFrame, columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV hand-off with a header row (one file per partition, written in parallel)."""
    df.write.mode(mode).option("header", True).csv(path)

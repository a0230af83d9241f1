"""Shared helpers of the text operators: worker paths, checkpoints, column handling."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def use_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver imported it from
    (a no-op where PYTHONPATH or --py-files already provide it)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A dictionary that stays in a Python worker between tasks, by name."""
    return _CACHES.setdefault(name, {})


def release_caches() -> None:
    """Empty the worker's caches: for tasks that use none, since Spark hands them workers that
    still hold what tasks of other operators have cached. What has been freed goes back to the
    system; allocators keep it otherwise, in workers that idle beside the executor's JVM."""
    for cache in _CACHES.values():
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset (tests, local
    runs), a folder in the warehouse, by the one rule of the session module."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _files_go(spark: SparkSession) -> Iterator[None]:
    """Jobs planned in the block delete their shuffle files at their end, so that the disk holds
    one step of an operator at a time."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


ARROW_ROWS = 1000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run in the block hand their Python tasks at most ``ARROW_ROWS`` rows at a time:
    whole texts, and lists made of them, that the JVM and the worker both hold."""
    before = spark.conf.get(BATCH_ROWS)
    if not 0 < int(before) <= ARROW_ROWS:
        spark.conf.set(BATCH_ROWS, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back; ``df`` itself should not be run
    again (Spark would have to make its shuffle files anew)."""
    checkpoint_folder(df.sparkSession)
    with _files_go(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, under the setting


def _store(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _files_go(spark):
        df.select("*").write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder (compressed, unlike a checkpoint)."""
    return _store(df, name)[1]


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete ``path``, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table in the checkpoint folder, for as long as the block lasts."""
    path, table = _store(df, "table")
    try:
        yield table
    finally:
        delete_folder(df.sparkSession, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that other columns, whatever their names, play no part; a
    null text is the empty text."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the key (k1, k2), 128 bits of id and text: rows that share it share both."""
    values = (docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit("")))
    return docs.withColumns({"k1": F.xxhash64(*values), "k2": F.xxhash64(F.lit("second"), *values)})


def ascii_lower(col):
    """Lower-case A-Z only. Texts of ASCII alone take lower(), which is the same there and
    much cheaper than translate()."""
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 marks the held-out fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5

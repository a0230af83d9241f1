"""Incremental panel loading with Structured Streaming.

New panel CSV files landing in a folder are typed exactly like the batch reader, can be
restricted to a key sample (a stream-static left-semi join), and are appended to a
Parquet table. The checkpoint records which files were loaded, so a rerun (or a restart
after a failure) appends each file once; a plain batch ``append`` would duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tillroll.sources.panel import _typed, without_index
from tillroll.sources.schema import SCHEMAS


def raw_csv_schema(header: list[str]) -> T.StructType:
    """All-string schema for a CSV header (a file stream needs its schema up front)."""
    return T.StructType([T.StructField(c, T.StringType()) for c in header])


def panel_stream(
    spark: SparkSession,
    name: str,
    source_dir: str,
    header: list[str],
    keys: DataFrame | None = None,
    key: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A streaming DataFrame of one panel table (households/products/trips/purchases)."""
    # a file whose header differs stops the stream instead of loading values by position
    reader = spark.readStream.schema(raw_csv_schema(header)).option("header", True).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(source_dir)
    typed = _typed(without_index(raw), SCHEMAS[name])
    if keys is not None:
        typed = typed.join(keys.select(key), key, "left_semi")
    return typed


def append_panel_files(
    spark: SparkSession,
    name: str,
    source_dir: str,
    header: list[str],
    target: str,
    checkpoint: str,
    keys: DataFrame | None = None,
    key: str | None = None,
    partition_by: list[str] | None = None,
) -> None:
    """Load every not-yet-loaded file of ``source_dir`` into ``target`` and stop
    (``availableNow`` trigger). ``checkpoint`` must be on storage shared by the cluster."""
    stream = panel_stream(spark, name, source_dir, header, keys, key)
    writer = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()

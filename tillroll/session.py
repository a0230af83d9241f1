"""SparkSession construction and lineage helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Session settings the operators are designed around. AQE re-plans joins at runtime
# (broadcast only when the measured side is below the threshold, split skewed join
# partitions) and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files (sequence numbering) are removed once their DataFrame is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(shuffle_bytes: float = 20e12, executors_cores: int = 8000) -> dict[str, str]:
    """Settings for a large cluster, sized from the expected shuffle volume of the
    biggest stage (default 20 TB: purchase lines projected to a few columns).

    - shuffle partitions start at ~256 MiB each (AQE merges small ones, splits skewed
      ones), and never below two waves of the cluster's cores; the sequence operators use
      the same number of range slices;
    - scans split at 512 MiB (Parquet row groups permitting);
    - joins broadcast what AQE *measures* under 64 MiB; the static threshold, which acts
      on planner estimates, stays at Spark's 10 MiB; everything else sort-merges.
    """
    target = 256 * 1024 * 1024
    partitions = max(2 * executors_cores, int(shuffle_bytes // target))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    }


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "tillroll",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session (None under Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext
        return None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    sc = _context(spark)
    configured = sc.getCheckpointDir() if sc is not None else None
    return configured or spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where ``spark.checkpoint.dir`` is unset, a folder in
    the SQL warehouse, which all executors share as well."""
    sc = _context(spark)
    folder = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc is None:
        spark.conf.set("spark.checkpoint.dir", folder)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and return a frame that reads
    it back (survives executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bench_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))

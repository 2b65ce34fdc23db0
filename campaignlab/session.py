"""Spark session helpers.

The library itself never creates a session: every operator takes DataFrames
and returns a DataFrame. These helpers are for tests, the benchmark and the
command-line entry points.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale. Shuffle partition count is left to the
# caller (cluster default) and AQE coalesces/splits at runtime.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(shuffle_bytes: float, executor_memory_gb: float = 16, executor_cores: int = 4,
                 target_partition_mb: int = 256) -> dict[str, str]:
    """Settings for a large cluster, sized from the expected shuffle volume.

    AQE can only coalesce shuffle partitions, never split them, so the
    initial count is sized for the largest shuffle: ``shuffle_bytes /
    target_partition_mb``, and not less than what keeps one task's share of
    execution memory (about 60% of the heap spread over the cores) above
    twice the partition size. Example: 100 TB of facts that partial
    aggregation reduces to ~10 TB of shuffle gives ~40,000 partitions of
    256 MB."""
    per_task_mb = executor_memory_gb * 1024 * 0.6 / executor_cores
    part_mb = min(target_partition_mb, per_task_mb / 2)
    partitions = max(200, int(shuffle_bytes / (part_mb * 1024 * 1024)) + 1)
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{int(part_mb)}m",
        "spark.sql.files.maxPartitionBytes": f"{int(part_mb)}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{int(part_mb * 4)}m",
    }


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "campaignlab") -> SparkSession:
    """A local-mode session for tests and the benchmark."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's ``spark.checkpoint.dir``. Only a local master, whose tasks run in
    the driver's process, falls back to a fresh scratch folder where it is unset;
    on a cluster executors would write to a folder that only the driver has, so that fails."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="campaignlab-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d

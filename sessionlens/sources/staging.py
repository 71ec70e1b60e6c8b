"""Written intermediate tables: shared between operators and safe against lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Temporary folder of each local application without a configured one.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode with none configured."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if context.master.startswith("local"):
        if context.applicationId not in _local_dirs:
            _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="sessionlens-")
        return _local_dirs[context.applicationId]
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, grouped by application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/sessionlens/{app}/{name}-{uuid.uuid4().hex}"


def stage(
    df: DataFrame, name: str, partition_by: str | None = None, sort_by: str | None = None, aligned: bool = False
) -> tuple[DataFrame, str]:
    """Write `df` as parquet in the shared folder; returns it read back (lineage cut) and its path.

    With `partition_by`, a rebalance on that column lets adaptive execution split a heavy day over
    several tasks and merge light ones, instead of every task writing a file per day; `aligned` says
    tasks already hold few days each and saves that shuffle. `sort_by` orders the rows inside each file,
    so that filters on it skip pages.
    """
    path = scratch_path(df.sparkSession, name)
    order = [c for c in (partition_by, sort_by) if c]
    if partition_by and not aligned:
        df = df.hint("rebalance", partition_by)
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path

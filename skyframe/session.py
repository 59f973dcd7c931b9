"""Session construction and the shared scratch location.

Jobs never pick a machine-local folder on their own: intermediate tables, landing
directories and model versions go under the cluster's ``spark.checkpoint.dir``.
Where the session names none, a single-process (``local``) session gets a fresh temporary
folder; on a cluster that is an error, because executors would write to their own disks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "skyframe", checkpoint_dir: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.sources.partitionOverwriteMode", "dynamic"))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session (``spark.checkpoint.dir``).

    Set here only for a ``local`` session that has none, as in tests; a cluster must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="skyframe-ckpt-")  # one process: its disk is the shared one
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/skyframe/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back: later steps read
    files that every executor can reach, and the lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 250_000
LEAST_ROWS_PER_TASK = 10_000


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same rows dealt evenly to tasks of at most about ``rows_per_task`` each, and to every core
    where there are rows enough. A file of few row groups is otherwise as few tasks, however
    many rows it has."""
    n = df.count()
    cores = min(df.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS_PER_TASK))
    return df.repartition(max(1, cores, -(-n // rows_per_task)))


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for the few driver-side file writes tests need."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)

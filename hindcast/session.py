"""Session settings and the checkpoint location shared by every job."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The default (10k rows) is too small a batch for the vectorised encoder / GEMM path.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def build_session(app: str = "hindcast", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; a cluster's own submit settings stay in force."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def temporary_folder(master: str) -> str:
    """A folder of this machine for a local master; on a cluster executors could not see it."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="hindcast-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a temporary one only in local mode with none named."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or temporary_folder(context.master)
    context.setCheckpointDir(named)
    return named

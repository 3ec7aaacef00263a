"""Folders for tables a job writes on its way, inside the shared checkpoint folder.

All of a session's are under one folder of its own. `clear` removes it: call it when a job's results have been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hindcast.session import ensure_checkpoint_dir


def _root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def _on_store(spark: SparkSession, path: str):
    """(file system, path) in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    store, place = _on_store(spark, path)
    store.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete tables in a folder."""
    store, place = _on_store(spark, path)
    if not store.exists(place):
        return []
    inside = [f.getPath() for f in store.listStatus(place) if f.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in inside if store.exists(done(p, "_SUCCESS")))


def clear(spark: SparkSession) -> None:
    """Remove everything the session has put here; frames that still read it fail from then on."""
    remove(spark, _root(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage and survives lost executors.

    For tables an operator scans several times, such as an inverted index.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

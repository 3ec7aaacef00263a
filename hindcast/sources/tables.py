"""JSON-lines and Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON-lines scan with a quarantine column; blank lines are skipped.

    A line that does not parse, or has a value of another type in any column of the schema, keeps its text in
    `_corrupt_record`. Every line is parsed with the whole schema, so which lines are good does not depend on the columns read.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{schema}, {CORRUPT} STRING", options).alias("_line")).select("_line.*")


def split_quarantine(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of a `scan_jsonl`."""
    return (
        scan.filter(F.col(CORRUPT).isNull()).drop(CORRUPT),
        scan.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT),
    )


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add rows to an append-only JSON-lines log; existing files are never touched."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

"""Order-independent content hashes of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row count plus four mergeable 32-bit sums of each row's SHA-256.

    Sums (not XOR) so that a repeated row does not cancel itself; partial aggregation makes
    the shuffle one row per task.
    """
    names = sorted(columns or df.columns)
    digest = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    lanes = [
        F.sum(F.conv(F.substring(F.col("d"), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
        for i in range(4)
    ]
    modulus = F.lit(2**32).cast("decimal(20,0)")
    text = F.concat(*[
        F.lpad(F.lower(F.hex((F.coalesce(lane, F.lit(0)) % modulus).cast("long"))), 8, "0") for lane in lanes
    ])
    return df.select(digest.alias("d")).agg(
        F.count(F.lit(1)).alias("n_rows"), text.alias("fingerprint")
    )


def row_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row with the SHA-256 of its canonical JSON (keys sorted)."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return df.withColumn("row_sha256", F.sha2(body, 256))

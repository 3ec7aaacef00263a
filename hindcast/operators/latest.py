"""Keyed newest/oldest-wins operators. All are single aggregates with map-side combine, so a
key that holds a third of the rows costs no more than any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Column, first: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    chosen = (F.min_by if first else F.max_by)(row, order)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def newest_per_key(df: DataFrame, keys: Sequence[str], at: str, seq: str) -> DataFrame:
    """The most recently collected copy; among equal times the one seen first."""
    return _pick(df, keys, F.struct(F.col(at), -F.col(seq)), first=False)


def last_line_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Later lines of an append-only log replace earlier ones."""
    return _pick(df, keys, F.col(seq), first=False)


def first_by_precedence(df: DataFrame, keys: Sequence[str], precedence: Column) -> DataFrame:
    return _pick(df, keys, precedence, first=True)


def merge_linked_prs(closing: DataFrame, cross: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Linked pull requests, one per key; a closing reference beats a cross reference.

    Within a kind the later closing row and the earlier cross row win (`seq`).
    """
    both = closing.withColumn("via", F.lit("closing_reference")).unionByName(
        cross.withColumn("via", F.lit("cross_reference"))
    )
    is_closing = F.col("via") == "closing_reference"
    rank = F.struct(
        F.when(is_closing, 0).otherwise(1),
        F.when(is_closing, -F.col("seq")).otherwise(F.col("seq")),
    )
    return first_by_precedence(both, keys, rank)


def earliest_revision(revisions: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(key, original_at, original_body): the oldest revision, only for rows marked as edited."""
    oldest = revisions.groupBy(key).agg(
        F.min_by(F.struct("at", "body"), F.struct("at", "seq")).alias("_first")
    )
    edited = F.col("last_edited_at").isNotNull()
    return issues.join(oldest, key, "left").select(
        key,
        F.when(edited, F.col("_first.at")).alias("original_at"),
        F.when(edited, F.col("_first.body")).alias("original_body"),
    )


def not_yet_stored(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What an interrupted job still has to do."""
    return wanted.join(stored.select(*keys), list(keys), "left_anti")


def union_history(history: DataFrame, dataset: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History plus dataset, one row per key; the dataset's copy wins.

    An anti join drops the beaten copies before they travel with their payload.
    """
    only_history = history.join(dataset.select(*keys), list(keys), "left_anti")
    return only_history.unionByName(dataset)

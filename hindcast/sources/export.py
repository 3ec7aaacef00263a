"""Leakage-safe export: cut a dataset at a moment, and check a cut someone else made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def forbidden(split: Column) -> Column:
    """The test sample and its reserve pool."""
    return F.startswith(split, F.lit("test"))


def cutoff_export(
    splits: DataFrame, corpus: DataFrame, vectors: DataFrame, cutoff: Column, key: str = "number"
) -> dict[str, DataFrame]:
    """Tables without test-period rows: split rows, corpus rows before the cutoff, kept vectors."""
    kept_splits = splits.filter(~forbidden(F.col("split")))
    kept_corpus = corpus.filter(F.col("created_at") < cutoff)
    kept_vectors = vectors.join(kept_corpus.select(key), key, "left_semi")
    return {"splits": kept_splits, "corpus": kept_corpus, "vectors": kept_vectors}


def verify_export(splits: DataFrame, corpus: DataFrame, cutoff: Column) -> DataFrame:
    """Violations by kind, counted against the given cutoff (never against a manifest's claim)."""
    bad_splits = splits.agg(F.count_if(forbidden(F.col("split"))).alias("violations"))
    late = corpus.agg(F.count_if(F.col("created_at") >= cutoff).alias("violations"))
    out = bad_splits.select(F.lit("forbidden_split").alias("check"), "violations").unionByName(
        late.select(F.lit("late_document").alias("check"), "violations")
    )
    return out.withColumn("passed", F.col("violations") == 0)


def reproduce_diff(rebuilt: DataFrame, published: DataFrame) -> DataFrame:
    """Rows on one side only, labelled; empty when the table reproduces exactly."""
    published = published.select(*rebuilt.columns)
    return rebuilt.exceptAll(published).withColumn("side", F.lit("rebuilt")).unionByName(
        published.exceptAll(rebuilt).withColumn("side", F.lit("published"))
    )

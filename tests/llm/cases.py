"""Rows that every operator must handle, with columns named like the operators' own."""

from __future__ import annotations

LONG = " ".join(f"w{i % 997}" for i in range(60_000))
BASE = " ".join(f"alpha{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "Two words", "en", "b", 9),
    (6, BASE, "en", "b", len(BASE)), (7, BASE, "en", "b", len(BASE)), (7, BASE, "en", "b", len(BASE)), (8, BASE.upper(), "en", "b", len(BASE)),
    (9, LONG, "en", "c", len(LONG)), (None, BASE + " tail", "en", "c", 5), (None, None, None, None, None), (10, "x " + BASE + " y", "en", "c", 9),
    (10, "another text under the same id", "en", "c", 30), (11, "é ñ 日本 語 İ ẞ", "es", "d", 9), (12, "a a a a a a a a a a a a a a a a a a a a a a a", "en", "d", 45),
]
CLASH = (
    "n runs stay copies target source_size fingerprint text_hash leak private repeat terms word score s _s _row _k one shard size").split()


def frame(spark, rows=None, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("own") for c in CLASH}) if clash else df


def empty(spark):
    return frame(spark, [])

"""A corpus from raw documents: toxicity, near duplicates, benchmark passages, source mix, token ids.

Every stage takes the documents its predecessor kept, written as Parquet and read again, and all but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import decontaminate as leaks
from hindcast.llm import gray_index, huffman, mixing, near_copies, toxicity
from hindcast.llm.queries import TOKENIZERS, table
from hindcast.sources.scratch import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is above 0 with probability under toxicity.REJECT, by a model of the labelled ones.

    Null and empty texts have no words and stay, as do all if no label is toxic; repeated rows share their fate.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("_toxicity", toxicity.score(docs, F.col("text"), model))
    return scored.filter(F.col("_toxicity.p_toxic") < toxicity.REJECT).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity about 0.8 or more): the smallest id.

    Documents without words are copies of one another. A null id stays only if no copy has one; a repeated row stays once.
    """
    return gray_index.keep_one(docs.select(*COLUMNS), search=near_copies.near_duplicates)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words that benchmark windows cover: no row goes, null texts and texts without a hit stay as they are."""
    found = leaks.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), cut=True, result="_leak")
    hit = F.size("_leak.spans") > 0
    return found.withColumns({
        "text": F.when(hit, F.col("_leak.kept")).otherwise(F.col("text")),
        "n_chars": F.when(hit, F.length("_leak.kept").cast("long")).otherwise(F.col("n_chars")),
    }).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to twice: ids repeat from here on. Null and empty texts have size 0."""
    mixed = mixing.mix(docs.select(*COLUMNS).withColumn("_size", mixing.word_count(F.col("text"))), size="_size")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written id files say of each document: doc_id, start, n_tokens, ids_crc32.

    Repeats of an id follow one another, ordered by text hash; a null or empty text is an end id alone.
    """
    return huffman.roundtrip(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: A trained model decides the first stage: SQL cannot state the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

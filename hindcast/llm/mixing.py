"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words by water-filling. A document's expected number of copies is its source's
target over its source's words (times its own relative weight, if one is given). The whole part is certain; the
rest is an inclusion probability p. With a uniform u of the document, its rank is [u/(1-u)] / [p/(1-p)], and a
source takes its documents in rank order until the words still missing are reached: a sample of fixed size with
unequal probabilities.

No source is sorted as a whole: ranks fall into `BUCKETS` equal slices, words are summed per (source, slice), and only the
slice in which a source's sample ends is ordered row by row, so a source with a third of all rows is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.columns import field, pack, packed, unpack
from hindcast.sources.scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A uniform of 48 bits in (0, 1) from the key, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target): one row per source.

    Weights repeat over the sources in code-point order, null last. The targets are min(most * size, weight * level)
    with the level at which they add up to `share` of all words: what a full source cannot take goes to the others by
    weight, until none is above its limit. The level is the largest over all prefixes of the sources in the order in
    which they fill up. Windows here run over one row per source.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights)
    weighted = per.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    filling = Window.orderBy(limit / F.col("_weight"), F.col(source).asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    ) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    levels = weighted.withColumn("_level", level)
    return levels.withColumn("target", F.least(limit, F.col("_weight") * F.max("_level").over(everything))).select(
        source, "source_size", "target")


def mix(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "size", weight: str | None = None,
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """Every row of `docs` with source_size, target and copies (0 .. ceil(most)).

    `size` is a column of `docs` (words, never null). `weight` names a column of relative sampling intensities
    (default: equal inside a source). A source's taken words end within one document of its target.

    Null source: a source of its own, last. Null key: one shared random number, ties go by size. Repeated rows are rows of
    their own and share their random number. Empty documents have size 0 and take nothing from a target. Empty table: empty
    result. Other columns are kept; one named source_size, target or copies is replaced.
    """
    def staged_columns(get) -> list[Column]:
        return [
            get(source).alias("_s"), get(size).alias("_n"), uniform(get(key), seed).alias("_u"),
            (get(weight) if weight else F.lit(1.0)).cast("double").alias("_w")]

    narrow = materialise(docs.select(*staged_columns(field)), "mix")
    aims = targets(narrow, "_s", "_n", weights, share, most)
    force = narrow.groupBy("_s").agg(F.sum(F.col("_w") * F.col("_n")).alias("_force"))
    aims = aims.alias("a").join(force.alias("f"), F.col("a._s").eqNullSafe(F.col("f._s"))).select(
        F.col("a._s").alias("_as"), "source_size", "target", "_force")

    def drawn(df: DataFrame) -> DataFrame:
        """Add certain copies, rank and slice."""
        joined = df.join(aims, F.col("_s").eqNullSafe(F.col("_as"))).drop("_as")
        expected = F.least(
            F.lit(float(most)), F.when(F.col("_force") > 0, F.col("target") * F.col("_w") / F.col("_force")).otherwise(F.lit(0.0)))
        joined = joined.withColumn("_whole", F.floor(expected)).withColumn("_p", expected - F.floor(expected))
        rank = F.when(
            F.col("_p") > 0,
            (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p"))))  # null: never sampled
        joined = joined.withColumn("_rank", rank)
        # Odds against the source's mean probability: even slices whatever that probability is.
        mean = F.try_divide("target", "source_size") % 1
        scaled = F.col("_rank") * F.least(F.greatest(mean, F.lit(1e-9)), F.lit(1 - 1e-9)) / (
            1 - F.least(F.greatest(mean, F.lit(1e-9)), F.lit(1 - 1e-9)))
        return joined.withColumn("_slice", F.floor(scaled / (1 + scaled) * BUCKETS))

    slices = drawn(narrow).groupBy("_s", "_slice").agg(
        F.sum("_n").alias("_words"), F.sum(F.col("_whole") * F.col("_n")).alias("_sure"), F.max("target").alias("_aim"))
    inside = Window.partitionBy("_s")
    running = inside.orderBy(F.col("_slice").asc_nulls_last())
    slices = slices.select(
        F.col("_s").alias("_bs"), F.col("_slice").alias("_bk"),
        (F.col("_aim") - F.sum("_sure").over(inside)).alias("_left"),
        (F.sum("_words").over(running) - F.col("_words")).alias("_before"), "_words",
    ).filter("_bk is not null")
    staged = drawn(pack(docs).select("_doc", *staged_columns(packed)))
    staged = staged.join(slices, F.col("_s").eqNullSafe(F.col("_bs")) & (F.col("_slice") == F.col("_bk")), "left")
    # A document is in when half of it or more still fits; a slice is decided as a whole unless the end falls into it.
    open_slice = F.coalesce((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_words") > F.col("_left")), F.lit(False))
    closed = staged.filter(~open_slice).withColumn(
        "_in", F.coalesce(F.col("_before") + F.col("_words") <= F.col("_left"), F.lit(False)).cast("long"))
    order = Window.partitionBy("_s").orderBy("_rank", packed(key).asc_nulls_first(), "_n")
    ends = staged.filter(open_slice).withColumn(
        "_in", (F.col("_before") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") / 2
                <= F.col("_left")).cast("long"))
    pick = ["_doc", "source_size", "target", "_whole", "_in"]
    return unpack(
        closed.select(*pick).unionByName(ends.select(*pick)), docs.columns, source_size=F.col("source_size"), target=F.col("target"),
        copies=(F.col("_whole") + F.col("_in")).cast("long"))

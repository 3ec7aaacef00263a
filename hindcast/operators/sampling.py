"""Time windows, strata, stratified samples and hash-based subsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.hashing import hash_bucket, stable_hash
from hindcast.functions.numeric import ratio

FLAGS = ("duplicate", "needs_info", "component")
SAMPLED = ("dev", "test")


def time_window(ts: Column, start: str, train_end: str, dev_end: str, test_end: str) -> Column:
    """train and dev are half-open, the test window closes on its last day, else 'out'."""
    day = ts.cast("date")
    return (
        F.when((day >= F.lit(start).cast("date")) & (day < F.lit(train_end).cast("date")), "train")
        .when((day >= F.lit(train_end).cast("date")) & (day < F.lit(dev_end).cast("date")), "dev")
        .when((day >= F.lit(dev_end).cast("date")) & (day <= F.lit(test_end).cast("date")), "test")
        .otherwise("out")
    )


def stratum(flags: Sequence[str] = FLAGS) -> Column:
    """duplicate=0|needs_info=1|component=0"""
    return F.concat_ws("|", *[F.concat(F.lit(f"{f}="), F.col(f).cast("int")) for f in flags])


def draw_order(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))


def stratified_sample(
    pool: DataFrame, key: str, n: int, minimums: Mapping[str, int], seed: str
) -> DataFrame:
    """Sampled keys: each flag in turn is topped up to its minimum (rows already chosen count),
    then the rest is filled uniformly to n.

    The draw is a seeded hash order. A round only ever takes rows that come first in that order
    among those with some flag, so the first n rows of each flag combination decide everything.
    They are found in one scan (Spark prunes a ranked window before its shuffle). The rounds are
    then columns over that table of at most n * 2^flags rows, the only thing one task sorts.
    """
    flags = list(minimums)
    ordered = pool.select(key, *flags).withColumn("_d", draw_order(seed, key))
    within = Window.partitionBy(*flags).orderBy("_d")
    rows = ordered.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= n).drop("_r")
    rows = rows.withColumn("_in", F.lit(False))
    everything = Window.partitionBy(F.lit(0))
    upto = everything.orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for f in [*flags, None]:
        wanted = F.col(f) if f else F.lit(True)
        total = F.count_if("_in").over(everything)
        room = F.lit(n) - total
        need = F.least(F.lit(int(minimums[f])) - F.count_if(F.col("_in") & wanted).over(everything), room) if f else room
        free = ~F.col("_in") & wanted
        rows = rows.withColumn("_need", need).withColumn("_k", F.count_if(free).over(upto)).withColumn(
            "_in", F.col("_in") | (free & (F.col("_k") <= F.col("_need"))))
    return rows.filter("_in").select(key)


def poststrat_weights(pool: DataFrame, chosen: DataFrame, key: str, stratum_col: str = "stratum") -> DataFrame:
    """(key, stratum, weight): pool size over sample size of each sampled row's stratum."""
    sizes = pool.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("_pool"))
    picked = pool.join(chosen.select(key), key, "left_semi").select(key, stratum_col)
    taken = picked.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("_taken"))
    # One row per stratum: at most 2^flags rows.
    weights = sizes.join(taken, stratum_col).select(
        stratum_col, (F.col("_pool") / F.col("_taken")).alias("weight")
    )
    return picked.join(weights, stratum_col).select(key, stratum_col, "weight")


def assign_splits(
    issues: DataFrame,
    key: str,
    window: Column,
    sizes: Mapping[str, int],
    minimums: Mapping[str, Mapping[str, int]],
    seed: str,
) -> DataFrame:
    """(key, split, stratum, weight, exclusion_reason): every in-window or excluded row once."""
    base = issues.withColumn("_window", window).withColumn("stratum", stratum())
    plain = base.filter("exclusion_reason IS NOT NULL OR _window = 'train'").select(
        key,
        F.when(F.col("exclusion_reason").isNotNull(), "excluded").otherwise("train").alias("split"),
        "stratum",
        F.lit(None).cast("double").alias("weight"),
        "exclusion_reason",
    )
    out = plain
    for name in SAMPLED:
        pool = base.filter((F.col("_window") == name) & F.col("exclusion_reason").isNull())
        chosen = stratified_sample(pool, key, sizes[name], minimums[name], f"{seed}-{name}")
        weights = poststrat_weights(pool, chosen, key).select(key, "weight")
        rows = pool.join(weights, key, "left").select(  # at most sizes[name] rows
            key,
            F.when(F.col("weight").isNotNull(), name).otherwise(f"{name}_reserve").alias("split"),
            "stratum",
            "weight",
            "exclusion_reason",
        )
        out = out.unionByName(rows)
    return out


def hash_half(item: Column, names: tuple[str, str] = ("judge-dev", "judge-test")) -> Column:
    """A stable 50/50 assignment from the first eight hex digits of the item's hash."""
    head = F.conv(F.substring(stable_hash(item), 1, 8), 16, 10).cast("long")
    return F.when(head % 2 == 0, names[0]).otherwise(names[1])


def hash_subset(refs: DataFrame, ref: str, n: int) -> DataFrame:
    """The n refs with the smallest hash: one top-n, the same on any partitioning."""
    return refs.withColumn("_h", stable_hash(F.col(ref))).orderBy("_h").limit(n).drop("_h")


def fold_of(ref: Column, folds: int = 2) -> Column:
    return hash_bucket(stable_hash(ref), folds)


def one_item_per_key(runs: Mapping[str, DataFrame], key: str, text: str, seed: str) -> DataFrame:
    """For each key every run answered, one run with a non-empty text chosen by seeded hash."""
    rows = None
    for name, df in runs.items():
        part = df.select(key, F.lit(name).alias("system"), F.trim(text).alias("comment"))
        rows = part if rows is None else rows.unionByName(part)
    has_text = F.coalesce(F.col("comment") != "", F.lit(False))
    order = F.when(has_text, F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), "system")))
    grouped = rows.groupBy(key).agg(
        F.count_distinct("system").alias("_runs"),
        F.min_by(F.when(has_text, F.struct("system", "comment")), order).alias("_pick"),
    )
    return grouped.filter((F.col("_runs") == len(runs)) & F.col("_pick").isNotNull()).select(
        F.concat_ws(":", F.col(key).cast("string"), "_pick.system").alias("item_id"), key, "_pick.system", "_pick.comment"
    )


def explicit_subset(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the listed keys. A listed key outside the rows fails the query when it runs."""
    listed = wanted.select(key).distinct()
    # A key's presence on each side, as one aggregate of the two key columns.
    sides = rows.select(key, F.lit(1).alias("_in"), F.lit(0).alias("_asked")).unionByName(
        listed.select(key, F.lit(0).alias("_in"), F.lit(1).alias("_asked"))
    )
    missing = sides.groupBy(key).agg(F.max("_in").alias("i"), F.max("_asked").alias("a")).filter("i = 0 AND a = 1")
    n_missing = missing.agg(F.count(F.lit(1))).scalar()
    checked = F.when(n_missing == 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(n_missing.cast("string"), F.lit(" listed refs are not in the split"))).cast("boolean")
    )
    return rows.join(listed, key, "left_semi").filter(checked)


def positive_rate(flag: Column, weight: Column | None = None) -> Column:
    value = flag.cast("double")
    if weight is None:
        return F.coalesce(F.avg(value), F.lit(0.0))
    return ratio(F.coalesce(F.sum(weight * value), F.lit(0.0)), F.coalesce(F.sum(weight), F.lit(0.0)))



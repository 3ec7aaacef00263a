"""Agreement between raters and consistency across repeated runs.

Every statistic is built from counts or sums, so a group of any size is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa_of(observed: Column, chance: Column) -> Column:
    return F.when(F.abs(1.0 - chance) > 1e-12, (observed - chance) / (1.0 - chance))


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, exact, kappa) for nominal answers; null is an answer like any other.

    Rows collapse to the confusion table first; both marginals come from that table.
    """
    by = list(by)
    table = pairs.groupBy(*by, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"))
    sides = F.explode(F.array(
        F.struct(F.col("_a").alias("c"), F.col("_n").alias("na"), F.lit(0).cast("long").alias("nb")),
        F.struct(F.col("_b").alias("c"), F.lit(0).cast("long").alias("na"), F.col("_n").alias("nb"))))
    same = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("_n")).otherwise(0)
    # The diagonal rides along on one of the two exploded rows.
    long = table.select(*by, sides.alias("x"), same.alias("_same")).select(
        *by, "x.*", F.when(F.col("x.na") > 0, F.col("_same")).otherwise(0).alias("_same"))
    margins = long.groupBy(*by, "c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("_same").alias("same"))
    total = margins.groupBy(*by).agg(
        F.sum("na").alias("n"), F.sum("same").alias("_same"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("_x"))
    exact = F.col("_same") / F.col("n")
    chance = F.col("_x") / (F.col("n").cast("double") * F.col("n"))
    return total.select(*by, "n", exact.alias("exact"), kappa_of(exact, chance).alias("kappa"))


def binary_kappa(both: Column, only_a: Column, only_b: Column, n: Column) -> Column:
    """Kappa of two yes/no raters from counts of yes-yes, yes-no, no-yes and the total."""
    yes_a, yes_b, total = both + only_a, both + only_b, n.cast("double")
    observed = (n - only_a - only_b) / total
    chance = (yes_a * yes_b + (n - yes_a) * (n - yes_b)) / (total * total)
    return F.when(n > 0, kappa_of(observed, chance))


def weighted_kappa(pairs: DataFrame, a: str, b: str, scale: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, qwk, exact, adjacent, mean_a, mean_b): quadratic weights over a declared scale.

    Expanding (i - j)^2 turns both the observed and the chance term into sums of first and
    second moments, so there is no k x k table and no cross join. Off-scale scores fail the job.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    inside = F.col(a).isin(*scale) & F.col(b).isin(*scale)
    checked = F.when(inside, True).otherwise(F.raise_error(F.lit("score outside the scale")).cast("boolean"))
    n = F.count(F.lit(1)).cast("double")
    stats = pairs.filter(checked).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.pow(x - y, F.lit(2.0))) / n).alias("_o"),
        (F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)).alias("_e"),
        F.avg((x == y).cast("double")).alias("exact"), F.avg((F.abs(x - y) <= 1).cast("double")).alias("adjacent"),
        F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"))
    # The common factor 1 / (k - 1)^2 cancels.
    qwk = F.when(F.col("_e") > 1e-12, 1.0 - F.col("_o") / F.col("_e"))
    return stats.select(*by, "n", qwk.alias("qwk"), "exact", "adjacent", "mean_a", "mean_b")


def agreement_by_task(pairs: DataFrame, vocabulary: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Five rows (task, n, exact, kappa) between two answers a_*, b_* for the same items."""
    first_type = lambda c: F.array_min(F.filter(c, lambda x: x.isin(*types)))
    triaged = pairs.filter("a_triaged")
    long = None
    for task, rows, a, b in (
        ("T1 type label", triaged, first_type("a_labels"), first_type("b_labels")),
        ("T2 is a duplicate", pairs, F.col("a_dup").isNotNull(), F.col("b_dup").isNotNull()),
        ("T3 component", pairs.filter("a_comp IS NOT NULL AND b_comp IS NOT NULL"), F.col("a_comp"), F.col("b_comp")),
        ("T4 needs info", pairs, F.col("a_info"), F.col("b_info")),
    ):
        part = rows.select(F.lit(task).alias("task"), a.cast("string").alias("a"), b.cast("string").alias("b"))
        long = part if long is None else long.unionByName(part)
    nominal = cohen_kappa(long, "a", "b", ["task"])
    # Presence over the whole vocabulary, without a row per item and label: absent-absent pairs
    # are what is left of items x labels.
    vocab = F.array(*[F.lit(v) for v in sorted(set(vocabulary))])
    a, b = F.array_intersect("a_labels", vocab), F.array_intersect("b_labels", vocab)
    counts = triaged.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size(F.array_intersect(a, b))).alias("both"),
        F.sum(F.size(F.array_except(a, b))).alias("oa"), F.sum(F.size(F.array_except(b, a))).alias("ob"))
    cells = F.col("n") * len(set(vocabulary))
    pooled = counts.select(
        F.lit("T1 labels (pooled)").alias("task"), "n", ((cells - F.col("oa") - F.col("ob")) / cells).alias("exact"),
        binary_kappa(F.col("both"), F.col("oa"), F.col("ob"), cells).alias("kappa"))
    return nominal.unionByName(pooled)


def bias_shift(plain: DataFrame, other: DataFrame, item: str) -> DataFrame:
    """(criterion, shift, n): mean score change on shared items."""
    b = other.withColumnRenamed("score", "_other")
    return plain.join(b, [item, "criterion"]).groupBy("criterion").agg(
        F.avg(F.col("_other") - F.col("score")).alias("shift"), F.count(F.lit(1)).alias("n"))


def tag_agreement(tags: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(category, n, human, model, kappa), then one row of exact-set share and mean Jaccard.

    tags(item, human, model) holds the two sets of each shared item.
    """
    n = tags.agg(F.count(F.lit(1))).scalar()
    either = tags.select("human", "model", F.explode(F.array_union("human", "model")).alias("category"))
    h, m = F.array_contains("human", F.col("category")), F.array_contains("model", F.col("category"))
    counts = either.groupBy("category").agg(
        F.count_if(h & m).alias("both"), F.count_if(h & ~m).alias("oh"), F.count_if(m & ~h).alias("om"))
    declared = tags.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    full = declared.join(counts, "category", "left").na.fill(0, ["both", "oh", "om"]).withColumn("n", n)
    per = full.select(
        "category", "n", (F.col("both") + F.col("oh")).alias("human"), (F.col("both") + F.col("om")).alias("model"),
        binary_kappa(F.col("both"), F.col("oh"), F.col("om"), F.col("n")).alias("kappa"),
        F.lit(None).cast("double").alias("exact"), F.lit(None).cast("double").alias("jaccard"))
    overlap = F.size(F.array_intersect("human", "model")) / F.greatest(F.size(F.array_union("human", "model")), F.lit(1))
    same = (F.array_sort("human") == F.array_sort("model")).cast("double")
    whole = tags.agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("exact"), F.avg(overlap).alias("jaccard")).select(
        F.lit("(all)").alias("category"), "n", F.lit(None).cast("long").alias("human"), F.lit(None).cast("long").alias("model"),
        F.lit(None).cast("double").alias("kappa"), "exact", "jaccard")
    return per.unionByName(whole)


def code_to_category(tags: DataFrame, item: str, codes: str, mapping: DataFrame) -> DataFrame:
    """(item, categories): free codes mapped to categories; unmapped codes drop out.

    The taxonomy is configuration, tens of rows; the engine sees that and picks the join.
    """
    rows = tags.select(item, F.explode(codes).alias("code")).join(mapping, "code", "left")
    return rows.groupBy(item).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def consistency_items(answers: DataFrame, key: str, runs: int) -> DataFrame:
    """(decision, key, accuracy, every, ever, same) for items all runs answered.

    answers(decision, key, run_id, answer, truth, counted); no answer is an answer.
    """
    right = F.col("answer").eqNullSafe(F.col("truth"))
    per = answers.groupBy("decision", key).agg(
        F.count_distinct("run_id").alias("_runs"), F.bool_and("counted").alias("_counted"),
        F.avg(right.cast("double")).alias("accuracy"), F.bool_and(right).alias("every"), F.bool_or(right).alias("ever"),
        (F.count_distinct("answer") + F.bool_or(F.col("answer").isNull()).cast("int") == 1).alias("same"))
    return per.filter((F.col("_runs") == runs) & F.col("_counted")).drop("_runs", "_counted")


def run_accuracy(answers: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(decision, key, run_id, right): each run's answer on the items that `consistency_items` kept."""
    kept = answers.join(items.select("decision", key), ["decision", key], "left_semi")
    return kept.select("decision", key, "run_id", F.col("answer").eqNullSafe(F.col("truth")).alias("right"))


def consistency(items: DataFrame) -> DataFrame:
    """(decision, n, accuracy, pass_k, ever_right, unanimous)."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return items.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), share("accuracy").alias("accuracy"), share("every").alias("pass_k"),
        share("ever").alias("ever_right"), share("same").alias("unanimous"))

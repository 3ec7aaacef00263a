"""Dataset statistics: rates, sizes, label and component distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.sampling import FLAGS, positive_rate

POOL = ("dev", "test", "dev_reserve", "test_reserve")
EVAL = ("dev", "test")
TOP_LABELS = 12
EXAMPLES = 3


def positive_rates(assigned: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """(scope, flag, rate, weighted): the eval pool, then each sample plain and weighted.

    One pass over the assignments; flags are unpivoted after aggregation (a handful of rows).
    """
    scopes = F.array(F.lit("pool"), *[F.when(F.col("split") == s, s) for s in EVAL])
    rows = assigned.filter(F.col("split").isin(*POOL)).withColumn("scope", F.explode(F.array_compact(scopes)))
    aggs = []
    for f in flags:
        aggs += [positive_rate(F.col(f)).alias(f"r_{f}"), positive_rate(F.col(f), F.col("weight")).alias(f"w_{f}")]
    wide = rows.groupBy("scope").agg(*aggs)
    long = F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f"r_{f}").alias("rate"), F.col(f"w_{f}").alias("w")) for f in flags]))
    return wide.select("scope", long.alias("x")).select(
        "scope", "x.flag", "x.rate", F.when(F.col("scope") != "pool", F.col("x.w")).alias("weighted"))


def split_sizes(assigned: DataFrame) -> DataFrame:
    """(kind, name, n): rows per split, and per exclusion reason."""
    both = F.array(
        F.struct(F.lit("split").alias("kind"), F.col("split").alias("name")),
        F.struct(F.lit("excluded").alias("kind"), F.col("exclusion_reason").alias("name")))
    rows = assigned.select(F.explode(both).alias("x")).filter("x.name IS NOT NULL")
    return rows.groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


def top_labels(rows: DataFrame, group: str, label: str, k: int = TOP_LABELS) -> DataFrame:
    """(group, label, n, rank): the k commonest labels per group, equal counts by name."""
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), F.asc(label))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def component_by_split(rows: DataFrame, component: str, split: str, splits: Sequence[str]) -> DataFrame:
    """Component x split counts; the split values are given, so the pivot needs no extra job."""
    name = F.coalesce(F.col(component), F.lit("(none)")).alias("component")
    return rows.groupBy(name).pivot(split, list(splits)).agg(F.count(F.lit(1))).na.fill(0)


def rate_by(rows: DataFrame, by: str, flag: Column, name: str) -> DataFrame:
    return rows.groupBy(by).agg(positive_rate(flag).alias(name), F.count(F.lit(1)).alias("n"))


def component_ties(votes: DataFrame, fixes_count: DataFrame) -> DataFrame:
    """How many issues have votes and fixing PRs but no winning component."""
    return votes.join(fixes_count, "issue").agg(
        F.count_if(F.col("component").isNull() & (F.size("votes") > 0) & (F.col("n_fix_prs") > 0)).alias("ties"),
        F.count(F.lit(1)).alias("voted"))


def edit_counts(issues: DataFrame, renames: DataFrame) -> DataFrame:
    renamed = renames.agg(F.count_distinct("issue")).scalar()
    return issues.agg(
        F.count_if(F.col("last_edited_at").isNotNull()).alias("body_edited"), F.count(F.lit(1)).alias("issues")
    ).withColumn("renamed", renamed)


def label_profile(labelled: DataFrame, key: str, title: str, labels: str, examples: int = EXAMPLES) -> DataFrame:
    """(label, n, share, examples): per label its count, share of the human-triaged rows given, first example titles.

    Examples come from a ranked window that Spark prunes to `examples` rows per label before the
    shuffle, so a label on every row does not gather its rows anywhere.
    """
    total = labelled.agg(F.count(F.lit(1))).scalar()
    rows = labelled.select(key, title, F.explode(F.array_distinct(labels)).alias("label"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("label").orderBy(key)
    picked = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= examples)
    shown = picked.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("_r", title))).alias("_e"))
    return counts.join(shown, "label").select(
        "label", "n", (F.col("n") / total).alias("share"), F.transform("_e", lambda e: e[title]).alias("examples"))


def component_shares(labelled: DataFrame, component: str = "component") -> DataFrame:
    """(component, n, share): of the items whose component is known, how many each has."""
    counts = labelled.filter(F.col(component).isNotNull()).groupBy(component).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(component, "n", (F.col("n") / total).alias("share"))

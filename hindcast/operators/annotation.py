"""Table jobs around human labelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.latest import last_line_wins
from hindcast.operators.ordering import running_totals

EVIDENCE_FILES = 40  # fixed value: files shown per fixing PR


def todo(items: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(pass, key): items nobody answered yet, and items with a blind answer but no final one."""
    stage = records.groupBy(key).agg(F.bool_or("has_final").alias("_final"))
    rows = items.select(key).join(stage, key, "left")
    step = F.when(F.col("_final").isNull(), "blind").when(~F.col("_final"), "final")
    return rows.select(step.alias("pass"), key).filter(F.col("pass").isNotNull())


def batches(items: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, opaque_id, key) in key order: fixed-size batches whose ids reveal nothing.

    The position is a bucketed running count: batches stay global without sorting in one task.
    """
    placed = running_totals(items.select(key).withColumn("_one", F.lit(1).cast("long")), key, ["_one"])
    batch = F.floor((F.col("cum__one") - 1) / size) + 1
    slot = (F.col("cum__one") - 1) % size + 1
    return placed.select(batch.alias("batch"), F.format_string("r%02d-%02d", batch, slot).alias("opaque_id"), key)


def answer_violations(
    answers: DataFrame, known: DataFrame, key: str, vocabulary: Sequence[str], types: Sequence[str], components: Sequence[str]
) -> DataFrame:
    """(key, violation): one row per broken rule."""
    refs = known.select(key).withColumn("_known", F.lit(True))
    rows = answers.join(refs, key, "left")
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    rules = {
        "unknown_ref": F.col("_known").isNull(),
        "unknown_label": F.size(F.array_except("labels", vocab)) > 0,
        "not_one_type": F.size(F.filter("labels", lambda x: x.isin(*types))) != 1,
        "unknown_component": F.col("component").isNotNull() & ~F.coalesce(F.col("component").isin(*components), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("violation"))


def accept_all_or_none(answers: DataFrame, violations: DataFrame) -> DataFrame:
    """The answers, or nothing when any row breaks a rule: a file is stored whole or not at all."""
    return answers.filter(violations.agg(F.count(F.lit(1))).scalar() == 0)


def rating_violations(ratings: DataFrame, key: str, criteria: Sequence[str], scale: Sequence[int]) -> DataFrame:
    """(key, violation) of ratings (key, scores MAP) missing a criterion or off the scale."""
    names = F.array(*[F.lit(c) for c in sorted(criteria)])
    wrong = F.array_sort(F.map_keys("scores")) != names
    off = F.exists(F.map_values("scores"), lambda s: ~s.isin(*scale))
    broken = F.array_compact(F.array(F.when(wrong, F.lit("criteria")), F.when(off, F.lit("off_scale"))))
    return ratings.select(key, F.explode(broken).alias("violation"))


def rubric_covers_scale(levels: Mapping[str, Sequence[int]], scale: Sequence[int]) -> None:
    for name, described in levels.items():
        if sorted(described) != sorted(scale):
            raise ValueError(f"criterion {name!r} must describe every level {list(scale)}")


def evidence_pack(fixes: DataFrame, files: DataFrame, verdicts: DataFrame, issue: str) -> DataFrame:
    """(issue, number, title, files, files_total, component, votes): what an adjudicator is shown.

    The file list is cut by a ranked window that Spark prunes before the shuffle, so a PR with
    millions of files gathers forty.
    """
    first = Window.partitionBy("number").orderBy("path")
    shown = files.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= EVIDENCE_FILES).groupBy("number").agg(
        F.array_sort(F.collect_list("path")).alias("files"))
    totals = files.groupBy("number").agg(F.count(F.lit(1)).alias("files_total"))
    rows = fixes.join(shown, "number", "left").join(totals, "number", "left").join(verdicts, issue, "left")
    return rows.withColumn("files_total", F.coalesce("files_total", F.lit(0)))


def latest_tags(tags: DataFrame, seq: str) -> DataFrame:
    return last_line_wins(tags, ["run_id", "issue"], seq)


def codes_in_use(tags: DataFrame, seed_codes: Sequence[str]) -> DataFrame:
    """(code, seed, uses): seed codes, used or not, and every other code in use."""
    used = tags.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("uses"))
    seeds = tags.sparkSession.createDataFrame([(c,) for c in seed_codes], "code string").withColumn("seed", F.lit(True))
    return used.join(seeds, "code", "full").select(
        "code", F.coalesce("seed", F.lit(False)).alias("seed"), F.coalesce("uses", F.lit(0)).alias("uses"))

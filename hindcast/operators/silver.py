"""Label derivation from evidence, each with where it came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The duplicate-comment convention and who may state it.
DUPLICATE_COMMENT = r"(?im)^\s*duplicate of #(\d+)\b"
TRIAGE_ASSOCIATIONS = ("OWNER", "MEMBER", "COLLABORATOR")


def fix_prs(linked: DataFrame, main_branch: str, title_pattern: str) -> DataFrame:
    """Linked PRs that fixed their issue: merged into main, and closing it by link or by title.

    `title_pattern` has a {number} placeholder; the regex is built per row from the issue.
    """
    pattern = F.replace(F.lit("^(?:" + title_pattern + ")"), F.lit("{number}"), F.col("issue").cast("string"))
    named = F.regexp_like("title", pattern)
    return linked.filter(
        F.col("merged") & (F.col("base_ref") == main_branch) & ((F.col("via") == "closing_reference") | named)
    )


def label_source(current: DataFrame, label_events: DataFrame) -> DataFrame:
    """(issue, label, source) of labels now present, from the latest event that added them."""
    actor = F.struct("actor", "is_bot", "author")
    last = label_events.filter("added").groupBy("issue", "label").agg(
        F.max_by(actor, F.struct(F.col("at"), -F.col("seq"))).alias("_by"))
    source = (
        F.when(F.col("_by").isNull(), "unknown")
        .when(F.col("_by.is_bot"), "bot")
        .when(F.col("_by.actor") == F.col("_by.author"), "author")
        .otherwise("triager")
    )
    return current.join(last, ["issue", "label"], "left").select("issue", "label", source.alias("source"))


def label_group(label: Column, types: Sequence[str], areas: Sequence[str], prefixes: Sequence[str]) -> Column:
    """type > area > family; null when the label is outside the taxonomy."""
    family = F.lit(False)
    for p in prefixes:
        family = family | F.startswith(label, F.lit(p))
    return F.when(label.isin(*types), "type").when(label.isin(*areas), "area").when(family, "family")


def taxonomy_labels(
    issues: DataFrame, key: str, labels: str, types: Sequence[str], areas: Sequence[str], prefixes: Sequence[str]
) -> DataFrame:
    """(key, label, grp): distinct current labels that are in the taxonomy."""
    rows = issues.select(key, F.explode(F.array_distinct(labels)).alias("label"))
    return rows.withColumn("grp", label_group(F.col("label"), types, areas, prefixes)).filter("grp IS NOT NULL")


def human_triaged(issues: DataFrame, label_events: DataFrame, relevant: Column) -> DataFrame:
    """(issue, human_triaged): someone known, not a bot and not the author touched a triage label."""
    by_human = ~F.col("is_bot") & F.col("actor").isNotNull() & (
        F.col("author").isNull() | (F.col("actor") != F.col("author")))
    touched = label_events.groupBy("issue").agg(F.bool_or(relevant & by_human).alias("_touched"))
    return issues.select("issue").join(touched, "issue", "left").select(
        "issue", F.coalesce("_touched", F.lit(False)).alias("human_triaged"))


def active_mark(marks: DataFrame, key: str = "issue") -> DataFrame:
    """(key, canonical): the duplicate mark still active after all marks and unmarks, in time order.

    A mark replaces whatever was active; an unmark clears it when it names the active one or
    names nothing. So the outcome is the last mark, unless a matching unmark follows it: two
    small aggregates instead of an ordered fold over the group.
    """
    order = F.struct("at", "seq")
    last = marks.filter(~F.col("unmarked")).groupBy(key).agg(
        F.max_by(F.struct("canonical"), order).alias("_m"), F.max(order).alias("_at"))
    undo = marks.filter("unmarked").groupBy(key, "canonical").agg(F.max(order).alias("_undone"))
    named = undo.filter("canonical IS NOT NULL")
    blanket = undo.filter("canonical IS NULL").select(key, F.col("_undone").alias("_blanket"))
    state = last.select(key, F.col("_m.canonical").alias("canonical"), "_at").join(
        named, [key, "canonical"], "left").join(blanket, key, "left")
    cleared = F.coalesce(F.col("_undone") > F.col("_at"), F.lit(False)) | F.coalesce(
        F.col("_blanket") > F.col("_at"), F.lit(False))
    return state.filter(~cleared & F.col("canonical").isNotNull()).select(key, "canonical")


def duplicate_comment(comments: DataFrame, key: str = "issue") -> DataFrame:
    """(key, canonical): from the earliest comment by someone with triage rights that names an
    earlier issue as the original."""
    named = F.regexp_extract("body", DUPLICATE_COMMENT, 1)
    found = comments.filter(F.col("association").isin(*TRIAGE_ASSOCIATIONS) & ~F.col("is_bot")).select(
        key, "at", "seq", named.alias("_n")).filter("_n <> ''")
    earlier = found.withColumn("canonical", F.expr("try_cast(_n AS BIGINT)")).filter(F.col("canonical") < F.col(key))
    return earlier.groupBy(key).agg(F.min_by("canonical", F.struct("at", "seq")).alias("canonical"))


def duplicate_of(issues: DataFrame, marks: DataFrame, comments: DataFrame, key: str = "issue") -> DataFrame:
    """(key, duplicate_of, duplicate_source): state reason, then active mark, then comment.

    `issues` has state_reason and state_original. The original must have a smaller number.
    """
    joined = (
        issues.join(active_mark(marks, key).withColumnRenamed("canonical", "_mark"), key, "left")
        .join(duplicate_comment(comments, key).withColumnRenamed("canonical", "_comment"), key, "left")
    )
    by_state = F.when(
        (F.col("state_reason") == "DUPLICATE") & (F.col("state_original") < F.col(key)), F.col("state_original"))
    by_mark = F.when(F.col("_mark") < F.col(key), F.col("_mark"))
    source = (
        F.when(by_state.isNotNull(), "state_reason").when(by_mark.isNotNull(), "marked")
        .when(F.col("_comment").isNotNull(), "comment")
    )
    return joined.select(
        key, F.coalesce(by_state, by_mark, F.col("_comment")).alias("duplicate_of"), source.alias("duplicate_source"))


def component_of(path: Column, rules: Sequence[tuple[str, str, str]], ignored: Sequence[str]) -> Column:
    """{component, role} of the first rule whose prefix matches; null when none or ignored.

    The rule list is configuration (tens of rows), so it becomes one CASE expression that stays
    inside generated code: no join.
    """
    skip = F.lit(False)
    for p in ignored:
        skip = skip | F.startswith(path, F.lit(p))
    case = F.when(skip, F.lit(None))
    for name, prefix, role in rules:
        case = case.when(
            F.startswith(path, F.lit(prefix)), F.struct(F.lit(name).alias("component"), F.lit(role).alias("role")))
    return case


def component_vote(fixes: DataFrame, files: DataFrame, rules, ignored) -> DataFrame:
    """(issue, component, votes): majority component over files changed by the fixing PRs.

    Primary components decide; supporting ones only when no primary was touched; a tie at the
    top gives null. Counts are per (issue, component) before the vote, so the per-issue list is
    as long as the rule list, never as long as the file list.
    """
    mapped = files.withColumn("_c", component_of(F.col("path"), rules, ignored)).filter("_c IS NOT NULL").select(
        "number", "_c.*")
    counts = (
        mapped.groupBy("number", "component", "role").agg(F.count(F.lit(1)).alias("n"))
        .join(fixes.select("issue", "number"), "number")
        .groupBy("issue", "component", "role").agg(F.sum("n").alias("n"))
    )
    primary = F.col("role") == "primary"
    per_issue = counts.groupBy("issue").agg(
        F.array_sort(F.collect_list(F.struct("component", "n"))).alias("_all"),
        F.max(F.when(primary, F.struct("n", "component"))).alias("_p"),
        F.max(F.when(~primary, F.struct("n", "component"))).alias("_s"),
        F.collect_list(F.when(primary, F.col("n"))).alias("_pn"),
        F.collect_list(F.when(~primary, F.col("n"))).alias("_sn"),
    )
    top = F.coalesce("_p", "_s")
    ns = F.when(F.col("_p").isNotNull(), F.col("_pn")).otherwise(F.col("_sn"))
    alone = F.size(F.filter(ns, lambda n: n == top["n"])) == 1
    return per_issue.select(
        "issue", F.when(alone, top["component"]).alias("component"), F.map_from_entries("_all").alias("votes"))


def needs_info(issues: DataFrame, label_events: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(issue, needs_info, needs_info_at): when a human first added a wanted label; failing that,
    whether one is present now (then without a time). `issues` has labels_current."""
    hit = F.col("added") & F.col("label").isin(*wanted) & ~F.col("is_bot")
    first = label_events.filter(hit).groupBy("issue").agg(F.min("at").alias("needs_info_at"))
    present = F.arrays_overlap("labels_current", F.array(*[F.lit(w) for w in wanted]))
    return issues.select("issue", "labels_current").join(first, "issue", "left").select(
        "issue", (F.col("needs_info_at").isNotNull() | present).alias("needs_info"), "needs_info_at")


def family_vocabulary(labelled: DataFrame, min_count: int) -> DataFrame:
    """(label, n): family labels on at least `min_count` human-triaged training rows.

    labelled: labels, label_groups, human_triaged.
    """
    rows = labelled.filter("human_triaged").select(F.explode("label_groups").alias("label", "grp"))
    return rows.filter("grp = 'family'").groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_count)


def confidence_floor(labels: Column, confidences: Column, family: Column, floor: float) -> Column:
    """Labels without the family labels given less than the floor; other groups always stay."""
    pairs = F.arrays_zip(labels.alias("label"), confidences.alias("conf"))
    kept = F.filter(pairs, lambda p: ~family_member(p["label"], family) | (p["conf"] >= floor))
    return F.transform(kept, lambda p: p["label"])


def family_member(label: Column, family: Column) -> Column:
    return F.array_contains(family, label)


def vocabulary_reject(labels: Column, vocabulary: Sequence[str]) -> tuple[Column, Column]:
    """(allowed, rejected): both de-duplicated, both in the proposed order."""
    allowed = F.array(*[F.lit(v) for v in vocabulary])
    return F.array_intersect(labels, allowed), F.array_except(labels, allowed)

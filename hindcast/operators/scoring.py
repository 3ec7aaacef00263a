"""Scoring predictions against reference answers.

One frame serves point estimates, weighted estimates, resamples and paired comparisons: item statistics are
summed once per resample inside the tasks, and every registered metric is an expression over those
sums. Label metrics need one extra level, sums per (resample, label). `register_metric` adds a metric to all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.numeric import prf, ratio
from hindcast.operators import uncertainty



@dataclass(frozen=True)
class Metric:
    """A headline metric: additive item statistics (by name; one name always means one statistic) and a value over their sums.

    Both are functions, so that a metric can be declared without a session. `subset` narrows the items that its own statistics
    count. A value may also use the label sums `all_*`, `type_*`, `area_*` (tp, fp, fn) and `macro`, and is null without support.
    """

    name: str
    value: Callable[[], Column]
    sums: Callable[[], Mapping[str, Column]] = dict
    subset: Callable[[], Column] | None = None

    def statistics(self) -> dict[str, Column]:
        own = dict(self.sums())
        return own if self.subset is None else {n: F.when(self.subset(), c.cast("double")).otherwise(0.0) for n, c in own.items()}


REGISTRY: dict[str, Metric] = {}  # in report order


def register_metric(metric: Metric) -> None:
    """Score, resample and compare `metric` from now on, beside the others."""
    if metric.name in REGISTRY:
        raise ValueError(f"metric {metric.name} is registered already")
    REGISTRY[metric.name] = metric


def scored_items(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Reference and prediction of each item side by side (g_*, p_*)."""
    g = gold.select(
        key, F.col("labels").alias("g_labels"), F.col("label_groups").alias("g_groups"), "human_triaged",
        F.col("duplicate_of").alias("g_dup"), F.col("component").alias("g_comp"), F.col("needs_info").alias("g_info"),
        "weight")
    p = predictions.select(
        key, "run_id", F.col("labels").alias("p_labels"), F.col("duplicate_of").alias("p_dup"),
        F.col("component").alias("p_comp"), F.col("component_candidates").alias("p_cands"),
        F.col("needs_info").alias("p_info"), "error", "cost_usd", "latency_ms")
    return g.join(p, key)


def _duplicates() -> dict[str, Column]:
    g, p = F.col("g_dup"), F.col("p_dup")
    right = F.coalesce(g == p, F.lit(False))
    return {
        "link_tp": right, "link_fp": p.isNotNull() & ~right, "link_fn": g.isNotNull() & ~right,
        "det_tp": g.isNotNull() & p.isNotNull(), "det_fp": g.isNull() & p.isNotNull(), "det_fn": g.isNotNull() & p.isNull()}


def _components() -> dict[str, Column]:
    known = F.col("g_comp").isNotNull()
    ranked = F.when(F.size("p_cands") > 0, F.col("p_cands")).otherwise(F.array_compact(F.array("p_comp")))
    return {
        "comp_n": known, "comp_hit": known & F.coalesce(F.col("g_comp") == F.col("p_comp"), F.lit(False)),
        "comp_top3": known & F.coalesce(F.array_contains(F.slice(ranked, 1, 3), F.col("g_comp")), F.lit(False))}


def _needs_info() -> dict[str, Column]:
    g, p = F.col("g_info"), F.col("p_info")
    return {"info_tp": g & p, "info_fp": ~g & p, "info_fn": g & ~p}


def _task(prefix: str, which: int) -> Callable[[], Column]:
    """Precision, recall or F1 (0, 1, 2) of a task with reference positives."""
    def value() -> Column:
        tp, fp, fn = (F.col(f"{prefix}_{c}") for c in ("tp", "fp", "fn"))
        return F.when(tp + fn > 0, prf(tp, fp, fn)[which])

    return value


def _micro(group: str) -> Callable[[], Column]:
    def value() -> Column:
        f1 = prf(F.col(f"{group}_tp"), F.col(f"{group}_fp"), F.col(f"{group}_fn"))[2]
        return F.when(F.col("triaged") > 0, F.coalesce(f1, F.lit(0.0)))

    return value


def _share(hits: str) -> Callable[[], Column]:
    return lambda: F.when(F.col("comp_n") > 0, F.col(hits) / F.col("comp_n"))


def _triaged() -> dict[str, Column]:
    return {"triaged": F.col("human_triaged")}


for _metric in (
    Metric("t1_micro_f1", _micro("all"), _triaged),
    Metric("t1_macro_f1", lambda: F.when(F.col("triaged") > 0, F.coalesce("macro", F.lit(0.0))), _triaged),
    Metric("t1_type_micro_f1", _micro("type"), _triaged), Metric("t1_area_micro_f1", _micro("area"), _triaged),
    Metric("t2_link_f1", _task("link", 2), _duplicates), Metric("t2_link_precision", _task("link", 0), _duplicates),
    Metric("t2_link_recall", _task("link", 1), _duplicates), Metric("t2_detect_f1", _task("det", 2), _duplicates),
    Metric("t3_accuracy", _share("comp_hit"), _components), Metric("t3_top3_accuracy", _share("comp_top3"), _components),
    Metric("t4_f1", _task("info", 2), _needs_info), Metric("t4_precision", _task("info", 0), _needs_info),
    Metric("t4_recall", _task("info", 1), _needs_info),
):
    register_metric(_metric)


def label_rows(items: DataFrame, by: Sequence[str], key: str, weight: str | None = None) -> DataFrame:
    """(by..., key, weight, label, grp, held, tp, fp, fn): a row per human-triaged item and label that either side gives."""
    kept = dict.fromkeys([*by, key, *([weight] if weight else [])])
    long = items.filter("human_triaged").select(
        *kept, "g_labels", "p_labels", "g_groups", F.explode(F.array_union("g_labels", "p_labels")).alias("label"))
    g, p = F.array_contains("g_labels", F.col("label")), F.array_contains("p_labels", F.col("label"))
    return long.select(
        *kept, "label", F.when(g, F.element_at("g_groups", F.col("label"))).alias("grp"), g.alias("held"), (g & p).alias("tp"),
        (~g & p).alias("fp"), (g & ~p).alias("fn"))


def _summed_labels(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., r, macro, all_tp, ..., area_fn) from sums per (by..., r, label).

    A label's group counts in a resample only where the reference holds the label there; labels nobody gives there drop out.
    """
    there = labels.filter("tp + fp + fn > 0")
    aggs = [F.avg(prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]).alias("macro")]
    for name in ("all", "type", "area"):
        inside = F.lit(True) if name == "all" else (F.col("grp") == name) & (F.col("held") > 0)
        aggs += [F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0.0)).alias(f"{name}_{c}") for c in ("tp", "fp", "fn")]
    return there.groupBy(*by, "r").agg(*aggs)


def metric_frame(
    items: DataFrame, key: str, by: Sequence[str] = (), *, resamples: int = uncertainty.RESAMPLES, weight: str | None = None, seed: str = "0",
) -> DataFrame:
    """(by..., r, n, every registered metric); null where the metric has no support. r as in `resample_totals`."""
    by = list(by)
    sums: dict[str, Column] = {"n": F.lit(1)}
    for metric in REGISTRY.values():
        sums.update(metric.statistics())
    draw = {"resamples": resamples, "seed": seed, "weight": weight}
    totals = uncertainty.resample_totals(items, key, sums, by, **draw)
    rows = label_rows(items, by, key, weight)
    per_label = uncertainty.resample_totals(rows, key, {c: F.col(c) for c in ("held", "tp", "fp", "fn")}, [*by, "label"], **draw)
    groups = rows.groupBy(*by, "label").agg(F.max("grp").alias("grp"))
    labelled = per_label.join(groups.withColumnsRenamed({c: f"_g_{c}" for c in [*by, "label"]}), [
        F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*by, "label"]]).drop(*[f"_g_{c}" for c in [*by, "label"]])
    summed = _summed_labels(labelled, by).withColumnsRenamed({c: f"_l_{c}" for c in [*by, "r"]})
    joined = totals.join(summed, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in [*by, "r"]], "left")
    return joined.filter((F.col("n") > 0) | (F.col("r") <= 0)).select(*by, "r", "n", *[m.value().alias(m.name) for m in REGISTRY.values()])


def point_scores(items: DataFrame, by: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
    """(by..., metric, point, weighted): no resampling."""
    frame = metric_frame(items, key if key in items.columns else items.columns[0], by, resamples=0, weight="weight")
    return uncertainty.intervals(frame, list(REGISTRY), by).select(*by, "metric", "point", "weighted")


def scorecard(
    items: DataFrame, key: str, by: Sequence[str] = (), resamples: int = uncertainty.RESAMPLES, stats: bool = False,
) -> DataFrame:
    """(by..., metric, point, low, high, weighted, valid_resamples): every registered metric with its interval and weighted estimate.

    With `stats` also one row per label (`label_f1:<label>`) and per system statistic (`system:<name>`), as points.
    """
    out = uncertainty.intervals(metric_frame(items, key, by, resamples=resamples, weight="weight"), list(REGISTRY), by)
    if not stats:
        return out
    labels = per_label_f1(items, by).select(*by, F.concat(F.lit("label_f1:"), "label").alias("metric"), F.col("f1").alias("point"))
    system = system_stats(items, list(by), F.col("error").isNotNull(), F.col("cost_usd"), F.col("latency_ms").cast("double"))
    names = [c for c in system.columns if c not in by]
    long = system.select(*by, F.explode(F.array(*[
        F.struct(F.concat(F.lit("system:"), F.lit(n)).alias("metric"), F.col(n).cast("double").alias("point")) for n in names])).alias("x"))
    both = labels.unionByName(long.select(*by, "x.metric", "x.point"))
    none = F.lit(None).cast("double")
    return out.unionByName(both.select(
        *by, "metric", "point", none.alias("low"), none.alias("high"), none.alias("weighted"), F.lit(0).cast("long").alias("valid_resamples")))


def per_label_f1(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    key = items.columns[0]
    counts = label_rows(items, by, key).groupBy(*by, "label").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*by, "label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def system_stats(
    items: DataFrame, by: str | list[str], error: Column, cost: Column, latency: Column, tokens_in: Column | None = None,
    tokens_out: Column | None = None,
) -> DataFrame:
    """Errors, cost, latency percentiles and, where given, tokens in and out per issue, of each run."""
    by = [by] if isinstance(by, str) else list(by)
    means = [F.avg(c).alias(f"{n}_per_issue") for n, c in (("tokens_in", tokens_in), ("tokens_out", tokens_out)) if c is not None]
    counts = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(error).alias("errors"), F.sum(cost).alias("cost_total"),
        F.avg(cost).alias("cost_per_issue"), *means)
    waits = uncertainty.percentiles(items, by, latency, {"latency_p50": 50, "latency_p95": 95}).withColumnsRenamed({c: f"_p_{c}" for c in by})
    return counts.join(waits, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in by]).drop(*[f"_p_{c}" for c in by])


def aligned(examples: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """(examples, missing, sample): what `require_aligned` would refuse, with three example keys."""
    seen = predictions.select(key).distinct().withColumn("_hit", F.lit(1))
    joined = examples.select(key).join(seen, key, "left")
    missing = F.col("_hit").isNull()
    # Three smallest missing keys: bounded by a top-n, never a full list.
    few = examples.select(key).join(predictions.select(key), key, "left_anti").orderBy(key).limit(3)
    text = few.agg(F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ",")).scalar()
    return joined.agg(F.count(F.lit(1)).alias("examples"), F.count_if(missing).alias("missing")).withColumn("sample", text)


def require_aligned(examples: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Examples joined with predictions; the job fails when an example has none."""
    joined = examples.join(predictions.withColumn("_hit", F.lit(True)), key, "left")
    checked = F.when(F.col("_hit"), True).otherwise(
        F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast("boolean"))
    return joined.filter(checked).drop("_hit")


def load_split(snapshots: DataFrame, silver: DataFrame, splits: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    kept = splits.filter(F.col("split").isin(*wanted)).select(key, "split", "weight")
    return snapshots.join(kept, key).join(silver, key).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def compared_items(
    comparisons: DataFrame, gold: DataFrame, predictions: DataFrame, key: str, exclude_errors: bool = False, splits: DataFrame | None = None,
) -> DataFrame:
    """Items of declared comparisons (comparison, a, b), each on the keys both runs answered.

    `splits` (run_id, split) names what each run was run on: the job fails when a comparison's runs differ in it.
    """
    if splits is not None:
        named = [splits.select(F.col("run_id").alias(s), F.col("split").alias(f"_{s}")) for s in ("a", "b")]
        known = comparisons.join(named[0], "a", "left").join(named[1], "b", "left")
        same = F.when(F.col("_a").eqNullSafe(F.col("_b")), True).otherwise(F.raise_error(F.concat(
            F.lit("runs of different splits: "), "a", F.lit(" and "), "b")).cast("boolean"))
        comparisons = known.filter(same).select("comparison", "a", "b")
    sides = comparisons.select("comparison", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("a").alias("run_id")),
        F.struct(F.lit("b").alias("side"), F.col("b").alias("run_id")))).alias("x")).select("comparison", "x.side", "x.run_id")
    items = scored_items(gold, predictions, key).join(sides, "run_id")
    usable = items.filter("error IS NULL") if exclude_errors else items
    shared = usable.groupBy("comparison", key).agg(F.count_distinct("side").alias("_s")).filter("_s = 2").select("comparison", key)
    return usable.join(shared, ["comparison", key], "left_semi")


def compare_runs(items: DataFrame, key: str, resamples: int = uncertainty.RESAMPLES) -> DataFrame:
    """(comparison, metric, a, b, delta, low, high, ...) from `compared_items`.

    Draws depend on the resample number and the item only, so both sides see the same ones.
    """
    frame = metric_frame(items, key, ["comparison", "side"], resamples=resamples)
    wide = frame.groupBy("comparison", "r").agg(*[
        F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{s}_{m}") for s in ("a", "b") for m in REGISTRY])
    return uncertainty.paired_deltas(wide, list(REGISTRY), ["comparison"])


def leaderboard(runs: DataFrame, config: str, columns: Sequence[str]) -> DataFrame:
    """One run per config: repeats excluded, most issues first, then the latest."""
    best = runs.filter("sample = 0").groupBy(config).agg(
        F.max_by(F.struct(*columns), F.struct("issues", "created_at", "run_id")).alias("_b"))
    return best.select(config, "_b.*")


def replayed_flag(calls: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    out = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("hits"))
    return out.withColumn("replayed", (F.col("calls") > 0) & (F.col("hits") == F.col("calls")))


def usable_gold(records: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Latest record per item, where adjudicated and usable."""
    from hindcast.operators.latest import last_line_wins

    return last_line_wins(records, [key], seq).filter("has_final AND NOT unusable")


def with_gold(gold: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Adjudicated answers in place of the derived ones; every adjudicated item counts as triaged."""
    final = usable_gold(records, key).select(key, "f_labels", "f_groups", "f_dup", "f_comp", "f_info")
    return gold.select(key, "weight").join(final, key).select(
        key, F.col("f_labels").alias("labels"), F.col("f_groups").alias("label_groups"), F.lit(True).alias("human_triaged"),
        F.col("f_dup").alias("duplicate_of"), F.col("f_comp").alias("component"), F.col("f_info").alias("needs_info"), "weight")


def find_failures(items: DataFrame, key: str) -> DataFrame:
    """(key, run_id, task, code, said, truth): what each prediction got wrong.

    For labels, `said` lists those given too many and `truth` those left out.
    """
    def finding(task: str, wrong: Column, code: Column, said: Column, truth: Column) -> Column:
        return F.when(wrong, F.struct(
            F.lit(task).alias("task"), code.alias("code"), said.cast("string").alias("said"), truth.cast("string").alias("truth")))

    left_out = F.array_sort(F.array_except("g_labels", "p_labels"))
    too_many = F.array_sort(F.array_except("p_labels", "g_labels"))
    g, p = F.col("g_dup"), F.col("p_dup")
    link = F.when(g.isNull(), "link_invented").when(p.isNotNull(), "link_wrong").when(
        F.array_contains("p_dups", g), "link_only_candidate").otherwise("link_absent")
    checks = F.array(
        finding(
            "T1", F.col("human_triaged") & (F.size(left_out) + F.size(too_many) > 0),
            F.when(F.size(left_out) > 0, "labels_left_out").otherwise("labels_too_many"),
            F.array_join(too_many, ","), F.array_join(left_out, ",")),
        finding("T2", ~g.eqNullSafe(p), link, p, g),
        finding(
            "T3", F.col("g_comp").isNotNull() & ~F.col("g_comp").eqNullSafe(F.col("p_comp")), F.lit("component"),
            F.col("p_comp"), F.col("g_comp")),
        finding("T4", F.col("g_info") != F.col("p_info"), F.lit("info"), F.col("p_info"), F.col("g_info")))
    return items.select(key, "run_id", F.explode(F.array_compact(checks)).alias("t")).select(key, "run_id", "t.*")


def failure_counts(rows: DataFrame, category: str, runs: Sequence[str], key: str, top: int | None = None) -> DataFrame:
    """(category, one column per run, delta of the last over the first) on keys every run has."""
    shared = rows.groupBy(key).agg(F.count_distinct("run_id").alias("_n")).filter(F.col("_n") == len(runs)).select(key)
    kept = rows.join(shared, key, "left_semi")
    wide = kept.groupBy(category).pivot("run_id", list(runs)).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(r) for r in runs[1:]), F.col(runs[0]))
    counted = wide.withColumn("total", total).withColumn("delta", F.col(runs[-1]) - F.col(runs[0]))
    return counted if top is None else counted.orderBy(F.desc("total"), F.asc(category)).limit(top)


def binary_counts(gold: Column, pred: Column, weight: Column) -> list[Column]:
    count = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0))
    return [count(gold & pred).alias("tp"), count(~gold & pred).alias("fp"), count(gold & ~pred).alias("fn")]


def with_prf(counts: DataFrame) -> DataFrame:
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1).withColumn(
        "support", F.col("tp") + F.col("fn"))


def link_counts(weight: Column) -> list[Column]:
    g, p = F.col("g_dup"), F.col("p_dup")
    right = F.coalesce(g == p, F.lit(False))
    count = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0))
    return [count(right).alias("tp"), count(p.isNotNull() & ~right).alias("fp"), count(g.isNotNull() & ~right).alias("fn")]


def weighted_accuracy(hit: Column, weight: Column) -> Column:
    return ratio(F.sum(F.when(hit, weight).otherwise(0.0)), F.sum(weight))

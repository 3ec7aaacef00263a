"""Confidence cascades: a cheap answer stands when its signal is at least tau, else it escalates.

Everything about a threshold is a sum over items below it plus a sum over items at or above it,
so a whole curve is one pair of running sums over distinct signals: no item-by-threshold join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators import uncertainty
from hindcast.operators.ordering import running_totals
from hindcast.sources.scratch import materialise

ESCALATE_ALL = 1.01  # fixed value: above any confidence


def self_signal(error: Column, type_conf: Column, component_conf: Column) -> Column:
    zero = F.lit(0.0)
    return F.when(error.isNotNull(), zero).otherwise(F.least(F.coalesce(type_conf, zero), F.coalesce(component_conf, zero)))


def agreement_signal(cheap: str, gate: str) -> Column:
    """Least gate confidence where both answers agree, else 0.

    `cheap` and `gate` are struct columns {error, type, type_conf, component, component_conf}.
    """
    c, g = (lambda f: F.col(f"{cheap}.{f}")), (lambda f: F.col(f"{gate}.{f}"))
    agree = (c("type") == g("type")) & c("component").eqNullSafe(g("component"))
    ok = c("error").isNull() & g("error").isNull() & F.coalesce(agree, F.lit(False))
    return F.when(ok, F.least(g("type_conf"), F.coalesce(g("component_conf"), F.lit(0.0)))).otherwise(F.lit(0.0))


def cascade_curve(
    items: DataFrame, sums: Sequence[str], metrics: Mapping[str, Column]
) -> DataFrame:
    """(tau, escalated, cost_per_1000, metrics...) at every tau that changes a routing.

    items: signal, cheap_<s> and full_<s> for each additive statistic s, base_cost (cheap tier
    plus gate, paid always) and full_cost (paid when escalated). `metrics` are expressions over
    the statistics' names.
    """
    parts = [f"{t}_{s}" for s in sums for t in ("cheap", "full")]
    names = ["n", "base_cost", "full_cost", *parts]
    per = items.withColumn("n", F.lit(1).cast("long")).groupBy("signal").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in names])
    ends = items.sparkSession.createDataFrame([(0.0,), (ESCALATE_ALL,)], "signal double")
    for c in names:
        ends = ends.withColumn(c, F.lit(0.0))
    points = per.unionByName(ends).groupBy("signal").agg(*[F.sum(c).alias(c) for c in names])
    total = per.agg(F.struct(*[F.sum(c).alias(c) for c in names]).alias("t")).scalar()
    run = running_totals(points, "signal", names, inclusive=False).withColumn("_t", total)
    n = F.col("_t.n")
    mixed = [(F.col(f"_t.cheap_{s}") - F.col(f"cum_cheap_{s}") + F.col(f"cum_full_{s}")).alias(s) for s in sums]
    staged = run.select(
        F.col("signal").alias("tau"), (F.col("cum_n") / n).alias("escalated"),
        (1000 * (F.col("_t.base_cost") + F.col("cum_full_cost")) / n).alias("cost_per_1000"), *mixed)
    return staged.select("tau", "escalated", "cost_per_1000", *[c.alias(m) for m, c in metrics.items()])


def choose_tau(curve: DataFrame, metrics: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """One row (tau): the cheapest tau whose metrics all stay within tolerance of escalating
    everything; equal costs go to the larger tau; null when none qualifies."""
    target = curve.filter(F.col("tau") == ESCALATE_ALL).agg(F.struct(*[F.max(m).alias(m) for m in metrics]).alias("t")).scalar()
    ok = F.lit(True)
    staged = curve.withColumn("_t", target)
    for m in metrics:
        ok = ok & (F.round(F.col(m), 12) >= F.round(F.col(f"_t.{m}") - tolerance, 12))
    return staged.filter(ok).agg(F.min_by("tau", F.struct(F.round("cost_per_1000", 9), -F.col("tau"))).alias("tau"))


def cross_fitted(
    items: DataFrame, fold: str, folds: int, sums: Sequence[str], metrics: Mapping[str, Column], tolerance: float = 0.0
) -> DataFrame:
    """One row: each fold's tau chosen on the other folds, and the pooled result of using them."""
    taus = [
        choose_tau(cascade_curve(items.filter(F.col(fold) != k), sums, metrics), list(metrics), tolerance).scalar()
        for k in range(folds)]
    # Each scalar is evaluated once for the whole table, not per row.
    staged = items.select("*", *[t.alias(f"tau_{k}") for k, t in enumerate(taus)])
    tau = F.coalesce(*[F.when(F.col(fold) == k, F.col(f"tau_{k}")) for k in range(folds)])
    up = F.col("signal") < tau
    aggs = [F.sum(F.when(up, F.col(f"full_{s}").cast("double")).otherwise(F.col(f"cheap_{s}").cast("double"))).alias(s) for s in sums]
    pooled = staged.agg(
        *[F.max(f"tau_{k}").alias(f"tau_{k}") for k in range(folds)], F.avg(up.cast("double")).alias("escalated"),
        (1000 * F.avg(F.col("base_cost") + F.when(up, F.col("full_cost")).otherwise(0.0))).alias("cost_per_1000"), *aggs)
    return pooled.select(
        *[f"tau_{k}" for k in range(folds)], "escalated", "cost_per_1000", *[c.alias(m) for m, c in metrics.items()])


def cascade_report(
    gates: Mapping[str, DataFrame], key: str, fold: str, folds: int, sums: Sequence[str], metrics: Callable[[str], Mapping[str, Column]],
    tolerance: float = 0.0, resamples: int = uncertainty.RESAMPLES,
) -> DataFrame:
    """(gate, point, tau, escalated, cost_per_1000, metric, value, delta, low, high, significant): what each way of escalating buys.

    `gates` maps a gate's name to items as in `cascade_curve` (with `key` and `fold`); `metrics(prefix)` are expressions over prefixed sums. Points
    are each tier alone (once, from the first gate, whose base cost is the cheap tier's own), the chosen tau and the cross-fitted result.
    At the chosen tau the deltas compare the cascade with the full tier on the same resampled items.
    """
    names = list(metrics(""))
    out = None

    def rows(frame: DataFrame, gate: str, point: str) -> DataFrame:
        none = F.lit(None).cast("double")
        tau = F.col("tau") if "tau" in frame.columns else none
        values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]))
        return frame.select(
            F.lit(gate).alias("gate"), F.lit(point).alias("point"), tau.alias("tau"), "escalated", "cost_per_1000", values.alias("x")).select(
            "gate", "point", "tau", "escalated", "cost_per_1000", "x.metric", "x.value")

    for gate, items in gates.items():
        found = []
        if out is None:
            for tier, share, cost in (("cheap", 0.0, "base_cost"), ("full", 1.0, "full_cost")):
                alone = items.agg(*[F.sum(F.col(f"{tier}_{s}").cast("double")).alias(s) for s in sums], (1000 * F.avg(cost)).alias("cost_per_1000"))
                found.append(rows(alone.select(
                    F.lit(share).alias("escalated"), "cost_per_1000", *[c.alias(m) for m, c in metrics("").items()]), "", f"{tier} tier alone"))
        curve = materialise(cascade_curve(items, sums, metrics("")), "cascade-curve")
        chosen = choose_tau(curve, names, tolerance)
        found.append(rows(curve.join(chosen, "tau"), gate, "chosen"))
        found.append(rows(cross_fitted(items, fold, folds, sums, metrics(""), tolerance), gate, "cross-fitted"))
        tau = chosen.scalar()
        stats = {f"full_{s}": F.col(f"full_{s}") for s in sums} | {
            f"mix_{s}": F.when(F.col("signal") < F.col("_tau"), F.col(f"full_{s}")).otherwise(F.col(f"cheap_{s}")) for s in sums}
        deltas = uncertainty.paired_bootstrap(
            items.withColumn("_tau", tau), key, stats, metrics("full_"), metrics("mix_"), resamples=resamples).select(
            F.lit(gate).alias("gate"), F.lit("chosen").alias("point"), "metric", "delta", "low", "high", "significant")
        part = found[0]
        for more in found[1:]:
            part = part.unionByName(more)
        part = part.join(deltas, ["gate", "point", "metric"], "left")
        out = part if out is None else out.unionByName(part)
    return out


def route_decisions(base: DataFrame, typed: DataFrame, component: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """Base predictions with the type label and component overwritten where a backend answered.

    typed(key, t_answer, t_cost), component(key, c_answer, c_conf, c_cost).
    """
    rows = base.join(typed, key, "left").join(component, key, "left")
    others = F.filter("labels", lambda x: ~x.isin(*types))
    labels = F.when(F.col("t_answer").isNotNull(), F.concat(F.array("t_answer"), others)).otherwise(F.col("labels"))
    ranked = F.slice(F.array_distinct(F.concat(F.array("c_answer"), F.col("component_candidates"))), 1, 3)
    answered = F.col("c_answer").isNotNull()
    zero = F.lit(0.0)
    return rows.select(
        key, labels.alias("labels"), F.coalesce("c_answer", "component").alias("component"),
        F.when(answered, F.col("c_conf")).otherwise(F.col("component_confidence")).alias("component_confidence"),
        F.when(answered, ranked).otherwise(F.col("component_candidates")).alias("component_candidates"),
        (F.col("cost_usd") + F.coalesce("t_cost", zero) + F.coalesce("c_cost", zero)).alias("cost_usd"),
        F.when(F.col("t_answer").isNotNull(), "backend").otherwise("base").alias("type_by"),
        F.when(answered, "backend").otherwise("base").alias("component_by"))


def apply_cascade(cheap: DataFrame, full: DataFrame, key: str, tau: float) -> DataFrame:
    """The chosen tau applied row by row; an escalated row pays for both tiers.

    cheap(key, signal, answer, cost), full(key, answer, cost).
    """
    f = full.select(key, F.col("answer").alias("_fa"), F.col("cost").alias("_fc"))
    up = F.col("signal") < tau
    return cheap.join(f, key).select(
        key, "signal", up.alias("escalated"), F.when(up, F.col("_fa")).otherwise(F.col("answer")).alias("answer"),
        (F.col("cost") + F.when(up, F.col("_fc")).otherwise(0.0)).alias("cost"),
        F.when(up, "escalated").otherwise("cheap tier").alias("decided_by"))


def decisions_to_prediction(decisions: DataFrame, key: str) -> DataFrame:
    """One row per (key, question, answer, confidence, distribution, cost) -> one prediction row.

    An empty answer abstains. Component candidates are the top three of the distribution (ties
    by name), or the answer alone.
    """
    def of(question: str, column: str) -> Column:
        answered = (F.col("question") == question) & (F.col("answer") != "")
        return F.first(F.when(answered, F.col(column)), ignorenulls=True)

    wide = decisions.groupBy(key).agg(
        of("type", "answer").alias("type"), of("type", "confidence").alias("type_confidence"),
        of("component", "answer").alias("component"), of("component", "confidence").alias("component_confidence"),
        of("component", "distribution").alias("_d"), F.sum("cost").alias("cost_usd"))
    entries = F.array_sort(F.transform(F.map_entries("_d"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    top = F.transform(F.slice(entries, 1, 3), lambda e: e["k"])
    ranked = F.when(F.size("_d") > 0, top).when(F.col("component").isNotNull(), F.array("component")).otherwise(
        F.array().cast("array<string>"))
    return wide.select(
        key, F.array_compact(F.array("type")).alias("labels"), "type_confidence", "component", "component_confidence",
        ranked.alias("component_candidates"), "cost_usd")


def restrict_renormalise(distribution: Column, options: Sequence[str]) -> Column:
    """{answer, confidence, distribution} over the offered options; no mass abstains with ''."""
    kept = F.map_filter(distribution, lambda k, v: k.isin(*options))
    total = F.aggregate(F.map_values(kept), F.lit(0.0).cast("double"), lambda a, v: a + v)
    shares = F.transform_values(kept, lambda k, v: v / total)
    best = F.array_max(F.transform(F.map_entries(shares), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    some = total > 0
    return F.struct(
        F.when(some, best["k"]).otherwise("").alias("answer"), F.when(some, best["p"]).otherwise(0.0).alias("confidence"),
        F.when(some, shares).alias("distribution"))

"""Regression gates over run comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.numeric import ratio
from hindcast.operators.latest import last_line_wins
from hindcast.sources.scratch import materialise

SEVERITY = ("pass", "warn", "fail")


def gate_metric(deltas: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, delta, verdict): fail on a drop over the rule's limit, warn on a significant drop.

    A metric without a rule passes. A rule for a metric that was not compared fails the job: it would guard nothing.
    """
    unknown = rules.join(deltas.select("metric"), "metric", "left_anti").select("metric", F.lit(True).alias("_unknown"))
    known = rules.join(unknown, "metric", "left").filter(F.when(F.col("_unknown").isNull(), True).otherwise(
        F.raise_error(F.concat(F.lit("rule for an unknown metric: "), "metric")).cast("boolean"))).drop("_unknown")
    rows = deltas.join(known, "metric", "left")
    ruled = F.col("max_drop").isNotNull() & F.col("delta").isNotNull()
    verdict = (
        F.when(ruled & (F.col("delta") < -F.col("max_drop")), "fail")
        .when(ruled & F.col("significant") & (F.col("delta") < 0), "warn").otherwise("pass"))
    return rows.select("metric", "delta", "low", "high", "max_drop", verdict.alias("verdict"))


def _sides(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    b = candidate.select(key, F.col("cost").alias("_cb"), F.col("error").alias("_eb"))
    return baseline.select(key, "cost", "error").join(b, key)


def gate_system(baseline: DataFrame, candidate: DataFrame, key: str, max_rise: float, max_errors: float) -> DataFrame:
    """(metric, baseline, candidate, delta, verdict) for cost and error rate on shared items."""
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    t = _sides(baseline, candidate, key).agg(
        zero("cost").alias("ca"), zero("_cb").alias("cb"), zero(F.col("error").cast("double")).alias("ea"),
        zero(F.col("_eb").cast("double")).alias("eb"))
    rise = F.when(F.col("ca") > 0, (F.col("cb") - F.col("ca")) / F.col("ca")).otherwise(0.0)
    rows = F.explode(F.array(
        F.struct(F.lit("cost_per_issue").alias("metric"), F.col("ca").alias("baseline"), F.col("cb").alias("candidate"),
                 (rise > max_rise).alias("bad")),
        F.struct(F.lit("error_rate").alias("metric"), F.col("ea").alias("baseline"), F.col("eb").alias("candidate"),
                 (F.col("eb") > max_errors).alias("bad"))))
    return t.select(rows.alias("x")).select(
        "x.metric", "x.baseline", "x.candidate", (F.col("x.candidate") - F.col("x.baseline")).alias("delta"),
        F.when(F.col("x.bad"), "fail").otherwise("pass").alias("verdict"))


def gate_coverage(baseline: DataFrame, candidate: DataFrame, key: str, minimum: float) -> DataFrame:
    hits = candidate.select(key).distinct().withColumn("_hit", F.lit(1))
    t = baseline.select(key).distinct().join(hits, key, "left").agg(
        F.count("_hit").alias("shared"), F.count(F.lit(1)).alias("baseline"))
    share = ratio(F.col("shared"), F.col("baseline"))
    return t.withColumn("coverage", share).withColumn("verdict", F.when(share < minimum, "fail").otherwise("pass"))


def gate_run(
    deltas: DataFrame, rules: DataFrame, baseline: DataFrame, candidate: DataFrame, key: str, *, max_rise: float, max_errors: float,
    min_coverage: float,
) -> DataFrame:
    """(check, delta, low, high, verdict): every gate of a candidate run and, as `(gate)`, the worst verdict.

    `deltas` are paired resampled differences on the shared items (`scoring.compare_runs`); both runs are (key, cost, error).
    """
    none = F.lit(None).cast("double")
    metrics = gate_metric(deltas, rules).select(F.col("metric").alias("check"), "delta", "low", "high", "verdict")
    system = gate_system(baseline, candidate, key, max_rise, max_errors).select(
        F.col("metric").alias("check"), "delta", none.alias("low"), none.alias("high"), "verdict")
    coverage = gate_coverage(baseline, candidate, key, min_coverage).select(
        F.lit("coverage").alias("check"), (F.col("coverage") - 1.0).alias("delta"), none.alias("low"), none.alias("high"), "verdict")
    checks = materialise(metrics.unionByName(system).unionByName(coverage), "gate-checks")
    whole = gate_verdict(checks).select(
        F.lit("(gate)").alias("check"), none.alias("delta"), none.alias("low"), none.alias("high"), "verdict")
    return checks.unionByName(whole)


def gate_verdict(rows: DataFrame) -> DataFrame:
    """One row: the worst verdict; a gate with no rows passes."""
    rank = F.coalesce(F.max(F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("verdict"))), F.lit(1))
    return rows.agg(F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), rank.cast("int")).alias("verdict"), F.count(F.lit(1)).alias("checks"))


def bless_baseline(log: DataFrame, key: str, seq: str, subset: DataFrame | None, path: str) -> DataFrame:
    """Freeze the latest prediction per item (of the subset) as a table, and return that table."""
    kept = log if subset is None else log.join(subset.select(key), key, "left_semi")
    last_line_wins(kept, [key], seq).write.mode("errorifexists").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)

"""Section M, first part: regression gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.numeric import uniform
from hindcast.operators import gate
from hindcast.plans import fixtures as fx
from hindcast.plans.oracle import u
from hindcast.plans.registry import query
from hindcast.plans.scoring import deltas, deltas_sql, rounded
from hindcast.sources.scratch import materialise, scratch_path
from hindcast.sources.tables import read_table

AB = ("gold", "pred_a", "pred_b")
RULES = (("t1_micro_f1", 0.05), ("t3_accuracy", 0.02), ("t4_f1", 0.15), ("t2_link_recall", 0.3))
DELTA_SQL = f"""{deltas_sql('a', 'b')},
ru AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {d}::DOUBLE)" for m, d in RULES)}) t(metric, max_drop)),
gm AS (SELECT metric, delta, low, high, CASE WHEN max_drop IS NOT NULL AND delta < -max_drop THEN 'fail'
  WHEN max_drop IS NOT NULL AND significant AND delta < 0 THEN 'warn' ELSE 'pass' END AS verdict FROM d_b LEFT JOIN ru USING (metric))"""


def rules(spark):
    """Limits of some metrics; the others are compared without one."""
    return spark.createDataFrame(list(RULES), "metric string, max_drop double")


def run_deltas(spark, sf):
    """Paired bootstrap of run b over run a, written once for the checks."""
    return materialise(deltas(spark, sf, [("a", "b")]), "gate-deltas")


def gated(spark, sf):
    return gate.gate_metric(run_deltas(spark, sf), rules(spark))


@query("gate_metric", *AB, sql=f"WITH {DELTA_SQL} SELECT metric, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, verdict FROM gm")
def gate_metric(spark, sf):
    return rounded(gated(spark, sf).select("metric", "delta", "low", "high", "verdict"), "delta", "low", "high")


GATE_SQL = f"""WITH {DELTA_SQL},
s AS (SELECT avg(a.cost_usd) AS ca, avg(b.cost_usd) AS cb, avg((a.error IS NOT NULL)::INT) AS ea, avg((b.error IS NOT NULL)::INT) AS eb
  FROM pred_a a JOIN pred_b b USING (doc_id)),
ch AS (SELECT metric AS "check", delta, low, high, verdict FROM gm
  UNION ALL SELECT 'cost_per_issue', cb - ca, NULL, NULL, CASE WHEN ca > 0 AND (cb - ca) / ca > 0.01 THEN 'fail' ELSE 'pass' END FROM s
  UNION ALL SELECT 'error_rate', eb - ea, NULL, NULL, CASE WHEN eb > 0.1 THEN 'fail' ELSE 'pass' END FROM s
  UNION ALL SELECT 'coverage', 0.0, NULL, NULL, 'pass')
SELECT "check", round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, verdict FROM ch
UNION ALL SELECT '(gate)', NULL, NULL, NULL,
  CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'warn') THEN 'warn' ELSE 'pass' END FROM ch"""


@query("gate_check", *AB, sql=GATE_SQL)
def gate_check(spark, sf):
    """The whole gate of run b against run a: resampled metrics, cost, errors, coverage and the verdict."""
    side = lambda run: fx.predictions(spark, sf, run).select(
        "doc_id", F.col("cost_usd").alias("cost"), F.col("error").isNotNull().alias("error"))
    out = gate.gate_run(
        run_deltas(spark, sf), rules(spark), side("a"), side("b"), "doc_id", max_rise=0.01, max_errors=0.1, min_coverage=0.9)
    return rounded(out, "delta", "low", "high")


def order_runs(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    base = o.filter(k % 9 != 0).select(k.alias("key"), F.col("o_totalprice").alias("cost"), (k % 17 == 0).alias("error"))
    cand = o.filter(k % 8 != 0).select(
        k.alias("key"), (F.col("o_totalprice") * (1 + (k % 5) * 0.1)).alias("cost"), (k % 13 == 0).alias("error"))
    return base, cand


@query("gate_system", sql="""
WITH s AS (SELECT avg(o_totalprice) AS ca, avg(o_totalprice * (1 + (o_orderkey % 5) * 0.1::DOUBLE)) AS cb, avg((o_orderkey % 17 = 0)::INT) AS ea,
  avg((o_orderkey % 13 = 0)::INT) AS eb FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0)
SELECT 'cost_per_issue' AS metric, round(ca, 4) AS baseline, round(cb, 4) AS candidate, round(cb - ca, 4) AS delta,
  CASE WHEN (cb - ca) / ca > 0.15 THEN 'fail' ELSE 'pass' END AS verdict FROM s
UNION ALL SELECT 'error_rate', round(ea, 4), round(eb, 4), round(eb - ea, 4), CASE WHEN eb > 0.1 THEN 'fail' ELSE 'pass' END FROM s""")
def gate_system(spark, sf):
    out = gate.gate_system(*order_runs(spark, sf), "key", 0.15, 0.1)
    return out.select("metric", *[F.round(c, 4).alias(c) for c in ("baseline", "candidate", "delta")], "verdict")


@query("gate_coverage", sql="""
SELECT count(*) FILTER (WHERE o_orderkey % 8 <> 0) AS shared, count(*) AS baseline,
  round(count(*) FILTER (WHERE o_orderkey % 8 <> 0)::DOUBLE / count(*), 6) AS coverage,
  CASE WHEN count(*) FILTER (WHERE o_orderkey % 8 <> 0)::DOUBLE / count(*) < 0.9 THEN 'fail' ELSE 'pass' END AS verdict
FROM orders WHERE o_orderkey % 9 <> 0""")
def gate_coverage(spark, sf):
    return rounded(gate.gate_coverage(*order_runs(spark, sf), "key", 0.9), "coverage")


@query("gate_verdict", *AB, sql=f"""WITH {DELTA_SQL}
SELECT CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'warn') THEN 'warn' ELSE 'pass' END AS verdict, count(*) AS checks FROM gm""")
def gate_verdict(spark, sf):
    return gate.gate_verdict(gated(spark, sf))


@query("bless_baseline", sql=f"""
SELECT doc_id, CASE WHEN {u("'retry'", 'doc_id')} < 0.3 THEN 2 ELSE 1 END AS attempt, quality FROM labels
WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def bless_baseline(spark, sf):
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    attempts = F.when(uniform("retry", F.col("doc_id")) < 0.3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    log = lab.withColumn("attempt", F.explode(attempts))
    subset = read_table(spark, sf, "documents").filter("lang = 'en'").select("doc_id")
    return gate.bless_baseline(log, "doc_id", "attempt", subset, scratch_path(spark, "baseline"))

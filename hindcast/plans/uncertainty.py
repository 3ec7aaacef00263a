"""Section H: intervals and paired comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.numeric import prf, r6, zero_failure_bound
from hindcast.operators import uncertainty as un
from hindcast.operators.scoring import scored_items
from hindcast.plans import fixtures as fx
from hindcast.plans.oracle import poisson_one, u
from hindcast.plans.registry import query
from hindcast.sources.tables import read_table


def info_items(spark, sf, run):
    gi, pi = F.col("g_info"), F.col("p_info")
    items = scored_items(fx.gold(spark, sf), fx.predictions(spark, sf, run), "doc_id")
    return items.select("doc_id", (gi & pi).alias("tp"), (~gi & pi).alias("fp"), (gi & ~pi).alias("fn"))


DRAWS_SQL = f"""it AS (SELECT g.doc_id,
  (g.needs_info AND a.needs_info)::INT AS tp, (NOT g.needs_info AND a.needs_info)::INT AS fp, (g.needs_info AND NOT a.needs_info)::INT AS fn,
  (g.needs_info AND b.needs_info)::INT AS tp2, (NOT g.needs_info AND b.needs_info)::INT AS fp2, (g.needs_info AND NOT b.needs_info)::INT AS fn2
  FROM gold g JOIN pred_a a USING (doc_id) JOIN pred_b b USING (doc_id)),
du AS (SELECT r, it.*, {u("'0'", 'r', 'doc_id')} AS uu FROM it, range(1, 1001) t(r)),
dr AS (SELECT r, {poisson_one('uu')} AS w, tp, fp, fn, tp2, fp2, fn2 FROM du),
pr AS (SELECT r, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn, sum(w * tp2) AS tp2, sum(w * fp2) AS fp2, sum(w * fn2) AS fn2
  FROM dr GROUP BY r UNION ALL
  SELECT 0, sum(tp), sum(fp), sum(fn), sum(tp2), sum(fp2), sum(fn2) FROM it),
m AS (SELECT r, CASE WHEN tp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS a,
  CASE WHEN tp2 + fn2 > 0 THEN 2.0::DOUBLE * tp2 / (2 * tp2 + fp2 + fn2) END AS b FROM pr)"""


@query("bootstrap_ci", "gold", "pred_a", "pred_b", sql=f"""WITH {DRAWS_SQL}
SELECT 'f1' AS metric, round(max(a) FILTER (WHERE r = 0), 6) AS point,
  round(quantile_cont(a, 0.025) FILTER (WHERE r > 0), 6) AS low, round(quantile_cont(a, 0.975) FILTER (WHERE r > 0), 6) AS high,
  count(a) FILTER (WHERE r > 0) AS valid_resamples FROM m""")
def bootstrap_ci(spark, sf):
    f1 = F.when(F.col("tp") + F.col("fn") > 0, prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    out = un.bootstrap_ci(info_items(spark, sf, "a"), "doc_id", {c: F.col(c) for c in ("tp", "fp", "fn")}, {"f1": f1})
    return out.select("metric", *[r6(F.col(c)).alias(c) for c in ("point", "low", "high")], "valid_resamples")


def both_runs(spark, sf):
    a, b = info_items(spark, sf, "a"), info_items(spark, sf, "b")
    return a.join(b.select("doc_id", *[F.col(c).alias(f"{c}2") for c in ("tp", "fp", "fn")]), "doc_id")


def f1_of(tp, fp, fn):
    return F.when(F.col(tp) + F.col(fn) > 0, prf(F.col(tp), F.col(fp), F.col(fn))[2])


def paired(spark, sf):
    names = ("tp", "fp", "fn", "tp2", "fp2", "fn2")
    return un.paired_bootstrap(
        both_runs(spark, sf), "doc_id", {c: F.col(c) for c in names}, {"f1": f1_of("tp", "fp", "fn")},
        {"f1": f1_of("tp2", "fp2", "fn2")})


@query("paired_bootstrap", "gold", "pred_a", "pred_b", sql=f"""WITH {DRAWS_SQL}
SELECT 'f1' AS metric, round(max(b - a) FILTER (WHERE r = 0), 6) AS delta,
  round(quantile_cont(b - a, 0.025) FILTER (WHERE r > 0), 6) AS low, round(quantile_cont(b - a, 0.975) FILTER (WHERE r > 0), 6) AS high,
  round(avg((b - a > 0)::INT) FILTER (WHERE r > 0), 6) AS share_b_better FROM m""")
def paired_bootstrap(spark, sf):
    return paired(spark, sf).select("metric", *[r6(F.col(c)).alias(c) for c in ("delta", "low", "high", "share_b_better")])


@query("significant", "gold", "pred_a", "pred_b", sql=f"""WITH {DRAWS_SQL}
SELECT 'f1' AS metric, quantile_cont(b - a, 0.025) FILTER (WHERE r > 0) > 0
  OR quantile_cont(b - a, 0.975) FILTER (WHERE r > 0) < 0 AS significant FROM m""")
def significant(spark, sf):
    return paired(spark, sf).select("metric", "significant")


@query("zero_failure_bound", sql="""
SELECT source, count(*) FILTER (WHERE doc_id % 3 = 0) AS n,
  round(CASE WHEN count(*) FILTER (WHERE doc_id % 3 = 0) = 0 THEN 1.0
    ELSE 1 - pow(0.05, 1.0 / nullif(count(*) FILTER (WHERE doc_id % 3 = 0), 0)) END, 6) AS bound FROM documents GROUP BY source""")
def zero_failure_bound_q(spark, sf):
    n = read_table(spark, sf, "documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 3 == 0).alias("n"))
    return n.withColumn("bound", r6(zero_failure_bound(F.col("n"))))


@query("percentile_linear", sql="""
SELECT o_orderpriority, round(quantile_cont(floor(o_totalprice)::DOUBLE, 0.5), 6) AS p50,
  round(quantile_cont(floor(o_totalprice)::DOUBLE, 0.95), 6) AS p95, 0.0::DOUBLE AS empty FROM orders GROUP BY 1""")
def percentile_linear(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("v", F.floor("o_totalprice").cast("double"))
    held = un.percentiles(o, ["o_orderpriority"], F.col("v"), {"p50": 50, "p95": 95})
    none = un.percentiles(o, ["o_orderpriority"], F.when(F.col("v") < 0, F.col("v")), {"empty": 50})
    return held.join(none, "o_orderpriority").select("o_orderpriority", r6(F.col("p50")).alias("p50"), r6(F.col("p95")).alias("p95"), "empty")

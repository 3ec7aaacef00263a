"""Section K, second half: cascades and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.numeric import prf, r6, uniform
from hindcast.operators import cascade as cs
from hindcast.operators.calibration import best_type
from hindcast.operators.sampling import fold_of
from hindcast.plans import fixtures as fx
from hindcast.plans.oracle import poisson_one, u
from hindcast.plans.registry import query
from hindcast.plans.scoring import rounded
from hindcast.sources.scratch import materialise
from hindcast.sources.tables import read_table

AB = ("gold", "pred_a", "pred_b")
SUMS = ("tp", "fp", "fn")
TAU = 0.7


def answer(run):
    t = best_type(F.col("labels"), F.col("confidences"), fx.LANGS)
    return F.struct("error", t["answer"].alias("type"), t["conf"].alias("type_conf"), "component",
                    F.when(F.col("component").isNotNull(), F.col("component_confidence")).alias("component_conf")).alias(run)


def tconf(run, doc="doc_id"):
    """A run's confidence in its type label; null when it gave none."""
    return f"CASE WHEN list_contains({run}.labels, g.lang) THEN {u(repr(run), f'{run}.{doc}', chr(39) + 'conf' + chr(39), 'g.lang')} END"


def cconf(run):
    return f"CASE WHEN {run}.component IS NOT NULL THEN {run}.component_confidence END"


def self_sql(run):
    return f"CASE WHEN {run}.error IS NOT NULL THEN 0.0 ELSE least(coalesce({tconf(run)}, 0), coalesce({cconf(run)}, 0)) END"


JOIN = "FROM gold g JOIN pred_a a USING (doc_id) JOIN pred_b b USING (doc_id)"


@query("self_signal", *AB, sql=f"SELECT g.doc_id, round({self_sql('a')}, 6) AS signal {JOIN}")
def self_signal(spark, sf):
    p = fx.predictions(spark, sf, "a").select("doc_id", answer("x"))
    return p.select("doc_id", r6(cs.self_signal(F.col("x.error"), F.col("x.type_conf"), F.col("x.component_conf"))).alias("signal"))


@query("agreement_signal", *AB, sql=f"""
SELECT g.doc_id, round(CASE WHEN a.error IS NULL AND b.error IS NULL AND list_contains(a.labels, g.lang) AND list_contains(b.labels, g.lang)
  AND a.component IS NOT DISTINCT FROM b.component THEN least({tconf('b')}, coalesce({cconf('b')}, 0)) ELSE 0.0 END, 6) AS signal {JOIN}""")
def agreement_signal(spark, sf):
    a = fx.predictions(spark, sf, "a").select("doc_id", answer("cheap"))
    b = fx.predictions(spark, sf, "b").select("doc_id", answer("gate"))
    return a.join(b, "doc_id").select("doc_id", r6(cs.agreement_signal("cheap", "gate")).alias("signal"))


def tiers(spark, sf, gate=None):
    """Run a as the cheap tier, b as the full one, on the needs-info task; signals rounded to 2.

    With a `gate` run the signal is its agreement with the cheap tier, and its cost is paid always.
    """
    g = fx.gold(spark, sf).select("doc_id", F.col("needs_info").alias("g"))
    cheap = fx.predictions(spark, sf, "a").select(
        "doc_id", F.col("needs_info").alias("c"), F.col("cost_usd").alias("base_cost"), answer("x"))
    full = fx.predictions(spark, sf, "b").select("doc_id", F.col("needs_info").alias("f"), (F.col("cost_usd") * 5).alias("full_cost"))
    rows = g.join(cheap, "doc_id").join(full, "doc_id")
    signal = F.round(cs.self_signal(F.col("x.error"), F.col("x.type_conf"), F.col("x.component_conf")), 2)
    if gate is not None:
        asked = fx.predictions(spark, sf, gate).select("doc_id", answer("gate"), F.col("cost_usd").alias("gate_cost"))
        rows = rows.join(asked, "doc_id").withColumn("base_cost", F.col("base_cost") + F.col("gate_cost"))
        signal = F.round(cs.agreement_signal("x", "gate"), 2)
    counts = []
    for tier, p in (("cheap", F.col("c")), ("full", F.col("f"))):
        counts += [(F.col("g") & p).alias(f"{tier}_tp"), (~F.col("g") & p).alias(f"{tier}_fp"), (F.col("g") & ~p).alias(f"{tier}_fn"),
                   (F.col("g") == p).alias(f"{tier}_right"), F.lit(1).alias(f"{tier}_items")]
    return materialise(rows.select("doc_id", signal.alias("signal"), "base_cost", "full_cost", *counts,
                                   fold_of(F.concat(F.lit("doc#"), "doc_id")).alias("fold")), "tiers")


def f1_metric(prefix=""):
    return {"t4_f1": prf(*[F.col(f"{prefix}{c}") for c in SUMS])[2]}


def tiers_sql(name, signal, base, more=""):
    return f"""{name} AS (SELECT g.doc_id, round({signal}, 2) AS signal, {base} AS bc, b.cost_usd * 5 AS fc,
  g.needs_info AS g, a.needs_info AS c, b.needs_info AS f,
  CAST(('0x' || substr(sha256('"doc#' || g.doc_id || '"'), 57, 8))::BIGINT % 2 AS INT) AS fold {JOIN}{more})"""


TIERS_SQL = tiers_sql("ti", self_sql("a"), "a.cost_usd")


def curve_sql(name, where, metric, table="ti"):
    return f"""{name} AS (SELECT tau, avg((signal < tau)::INT) AS escalated, 1000 * avg(bc + CASE WHEN signal < tau THEN fc ELSE 0 END) AS cost_per_1000,
  {metric} AS m FROM (SELECT *, CASE WHEN signal < tau THEN f ELSE c END AS p FROM (SELECT * FROM {table} WHERE {where}),
    (SELECT DISTINCT signal AS tau FROM {table} WHERE {where} UNION SELECT 0.0 UNION SELECT 1.01) t) GROUP BY tau),
{name}_tau AS (SELECT min_by(tau, (round(cost_per_1000, 9), -tau)) AS tau FROM {name}
  WHERE round(m, 12) >= round((SELECT m FROM {name} WHERE tau = 1.01) - 0.02, 12))"""


F1_SQL = "2.0 * count(*) FILTER (WHERE g AND p) / (2.0 * count(*) FILTER (WHERE g AND p) + count(*) FILTER (WHERE g <> p))"
ACC_SQL = "avg((g = p)::INT)"


@query("cascade_curve", *AB, sql=f"""WITH {TIERS_SQL}, {curve_sql('cv', 'true', F1_SQL)}
SELECT tau, round(escalated, 6) AS escalated, round(cost_per_1000, 6) AS cost_per_1000, round(m, 6) AS t4_f1 FROM cv""")
def cascade_curve(spark, sf):
    return rounded(cs.cascade_curve(tiers(spark, sf), SUMS, f1_metric()), "escalated", "cost_per_1000", "t4_f1")


@query("choose_tau", *AB, sql=f"WITH {TIERS_SQL}, {curve_sql('cv', 'true', F1_SQL)} SELECT tau FROM cv_tau")
def choose_tau(spark, sf):
    return cs.choose_tau(cs.cascade_curve(tiers(spark, sf), SUMS, f1_metric()), ["t4_f1"], 0.02)


@query("cross_fitted", *AB, sql=f"""WITH {TIERS_SQL}, {curve_sql('c0', 'fold <> 0', F1_SQL)}, {curve_sql('c1', 'fold <> 1', F1_SQL)},
r AS (SELECT *, CASE fold WHEN 0 THEN (SELECT tau FROM c0_tau) ELSE (SELECT tau FROM c1_tau) END AS tau FROM ti),
p AS (SELECT *, CASE WHEN signal < tau THEN f ELSE c END AS p FROM r)
SELECT (SELECT tau FROM c0_tau) AS tau_0, (SELECT tau FROM c1_tau) AS tau_1, round(avg((signal < tau)::INT), 6) AS escalated,
  round(1000 * avg(bc + CASE WHEN signal < tau THEN fc ELSE 0 END), 6) AS cost_per_1000, round({F1_SQL}, 6) AS t4_f1 FROM p""")
def cross_fitted(spark, sf):
    out = cs.cross_fitted(tiers(spark, sf), "fold", 2, SUMS, f1_metric(), 0.02)
    return rounded(out, "escalated", "cost_per_1000", "t4_f1")


def agreed_sql():
    return f"""CASE WHEN a.error IS NULL AND k.error IS NULL AND list_contains(a.labels, g.lang) AND list_contains(k.labels, g.lang)
  AND a.component IS NOT DISTINCT FROM k.component THEN least({tconf('k').replace("'k'", "'c'")}, coalesce({cconf('k')}, 0)) ELSE 0.0 END"""


def report_part_sql(gate, table):
    """The chosen point with its deltas, and the cross-fitted one."""
    x = table
    w = f"CASE WHEN r = 0 THEN 1 ELSE {poisson_one(u(SEED, 'r', 'doc_id'))} END::DOUBLE"
    f1 = lambda p: f"coalesce(2 * sum(w) FILTER (WHERE g AND {p}) / nullif(2 * coalesce(sum(w) FILTER (WHERE g AND {p}), 0) + coalesce(sum(w) FILTER (WHERE g <> {p}), 0), 0), 0)"
    ctes = f"""{curve_sql(f'{x}_cv', 'true', F1_SQL, x)}, {curve_sql(f'{x}_0', 'fold <> 0', F1_SQL, x)}, {curve_sql(f'{x}_1', 'fold <> 1', F1_SQL, x)},
{x}_p AS (SELECT *, CASE WHEN signal < CASE fold WHEN 0 THEN (SELECT tau FROM {x}_0_tau) ELSE (SELECT tau FROM {x}_1_tau) END THEN 1 ELSE 0 END AS up FROM {x}),
{x}_q AS (SELECT *, CASE WHEN up = 1 THEN f ELSE c END AS p FROM {x}_p),
{x}_m AS (SELECT doc_id, g, f, CASE WHEN signal < (SELECT tau FROM {x}_cv_tau) THEN f ELSE c END AS p FROM {x}),
{x}_r AS (SELECT r, {f1('p')} - {f1('f')} AS d FROM (SELECT r, x.*, {w} AS w FROM {x}_m x, range(0, 1001) t(r)) GROUP BY r),
{x}_d AS (SELECT max(d) FILTER (WHERE r = 0) AS delta, quantile_cont(d, 0.025) FILTER (WHERE r > 0) AS low, quantile_cont(d, 0.975) FILTER (WHERE r > 0) AS high FROM {x}_r)"""
    rows = f"""SELECT '{gate}' AS gate, 'chosen' AS point, tau, escalated, cost_per_1000, m AS value, delta, low, high, coalesce(low > 0 OR high < 0, false) AS significant
  FROM {x}_cv JOIN {x}_cv_tau USING (tau), {x}_d
UNION ALL SELECT '{gate}', 'cross-fitted', NULL, avg(up), 1000 * avg(bc + up * fc), {F1_SQL}, NULL, NULL, NULL, NULL FROM {x}_q"""
    return ctes, rows


SEED = "'0'"


def report_sql():
    own, agreed = report_part_sql("self", "ti"), report_part_sql("agreement", "tj")
    alone = " UNION ALL ".join(f"""SELECT '' AS gate, '{tier} tier alone' AS point, NULL::DOUBLE AS tau, {share}::DOUBLE AS escalated, 1000 * avg({cost}) AS cost_per_1000,
  {F1_SQL} AS value, NULL::DOUBLE AS delta, NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::BOOLEAN AS significant FROM (SELECT *, {p} AS p FROM ti)"""
                               for tier, share, cost, p in (("cheap", 0, "bc", "c"), ("full", 1, "fc", "f")))
    return f"""WITH {TIERS_SQL}, {tiers_sql('tj', agreed_sql(), 'a.cost_usd + k.cost_usd', ' JOIN pred_c k USING (doc_id)')}, {own[0]}, {agreed[0]},
al AS ({alone} UNION ALL {own[1]} UNION ALL {agreed[1]})
SELECT gate, point, tau, round(escalated, 6) AS escalated, round(cost_per_1000, 6) AS cost_per_1000, 't4_f1' AS metric, round(value, 6) AS value,
  round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, significant FROM al"""


@query("cascade_report", *AB, "pred_c", sql=report_sql())
def cascade_report(spark, sf):
    """Both gates beside each tier alone: the chosen and the cross-fitted point, and what the cascade loses to the full tier."""
    gates = {"self": tiers(spark, sf), "agreement": tiers(spark, sf, "c")}
    out = cs.cascade_report(gates, "doc_id", "fold", 2, SUMS, f1_metric, 0.02)
    return rounded(out, "escalated", "cost_per_1000", "value", "delta", "low", "high")


@query("decision_cascade", *AB, sql=f"""WITH {TIERS_SQL}, {curve_sql('cv', 'true', ACC_SQL)}
SELECT tau, round(escalated, 6) AS escalated, round(cost_per_1000, 6) AS cost_per_1000, round(m, 6) AS accuracy FROM cv""")
def decision_cascade(spark, sf):
    metric = {"accuracy": F.col("right") / F.col("items")}
    return rounded(cs.cascade_curve(tiers(spark, sf), ("right", "items"), metric), "escalated", "cost_per_1000", "accuracy")


@query("route_decisions", *AB, sql=f"""
SELECT g.doc_id, array_to_string(CASE WHEN list_contains(b.labels, g.lang) THEN [g.lang] || list_filter(a.labels, lambda x: x <> g.lang) ELSE a.labels END, ',') AS labels,
  coalesce(b.component, a.component) AS component, round(CASE WHEN b.component IS NOT NULL THEN b.component_confidence ELSE a.component_confidence END, 6) AS component_confidence,
  array_to_string(CASE WHEN b.component IS NOT NULL THEN [b.component] || list_filter(a.component_candidates, lambda x: x <> b.component) ELSE a.component_candidates END, ',') AS component_candidates,
  round(a.cost_usd + CASE WHEN list_contains(b.labels, g.lang) THEN b.cost_usd ELSE 0 END + CASE WHEN b.component IS NOT NULL THEN b.cost_usd ELSE 0 END, 6) AS cost_usd,
  CASE WHEN list_contains(b.labels, g.lang) THEN 'backend' ELSE 'base' END AS type_by, CASE WHEN b.component IS NOT NULL THEN 'backend' ELSE 'base' END AS component_by {JOIN}""")
def route_decisions(spark, sf):
    backend = fx.predictions(spark, sf, "b")
    t = best_type(F.col("labels"), F.col("confidences"), fx.LANGS)["answer"]
    typed = backend.select("doc_id", t.alias("t_answer"), F.col("cost_usd").alias("t_cost")).filter("t_answer IS NOT NULL")
    comp = backend.filter("component IS NOT NULL").select(
        "doc_id", F.col("component").alias("c_answer"), F.col("component_confidence").alias("c_conf"), F.col("cost_usd").alias("c_cost"))
    out = cs.route_decisions(fx.predictions(spark, sf, "a"), typed, comp, "doc_id", fx.LANGS)
    out = out.withColumn("labels", F.array_join("labels", ",")).withColumn("component_candidates", F.array_join("component_candidates", ","))
    return rounded(out, "component_confidence", "cost_usd")


def live_tiers(spark, sf):
    cheap = fx.predictions(spark, sf, "a").select("doc_id", answer("x"), "component", "cost_usd")
    cheap = cheap.select(
        "doc_id", cs.self_signal(F.col("x.error"), F.col("x.type_conf"), F.col("x.component_conf")).alias("signal"),
        F.col("component").alias("answer"), F.col("cost_usd").alias("cost"))
    full = fx.predictions(spark, sf, "b").select("doc_id", F.col("component").alias("answer"), F.col("cost_usd").alias("cost"))
    return cheap, full


LIVE_SQL = f"""SELECT g.doc_id, round({self_sql('a')}, 6) AS signal, {self_sql('a')} < {TAU} AS escalated,
  CASE WHEN {self_sql('a')} < {TAU} THEN b.component ELSE a.component END AS answer,
  round(a.cost_usd + CASE WHEN {self_sql('a')} < {TAU} THEN b.cost_usd ELSE 0 END, 6) AS cost,
  CASE WHEN {self_sql('a')} < {TAU} THEN 'escalated' ELSE 'cheap tier' END AS decided_by {JOIN}"""


@query("apply_cascade", *AB, sql=LIVE_SQL)
def apply_cascade(spark, sf):
    cheap, full = live_tiers(spark, sf)
    return rounded(cs.apply_cascade(cheap, full, "doc_id", TAU), "signal", "cost")


@query("decisions_to_prediction", sql=f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS d FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN 'c' || (vec_id % 3) ELSE '' END AS labels,
  CASE WHEN vec_id % 5 <> 0 THEN round({u("'t'", 'vec_id')}, 6) END AS type_confidence,
  CASE WHEN vec_id % 7 <> 0 THEN 'c0' END AS component, CASE WHEN vec_id % 7 <> 0 THEN round(d[1], 6) END AS component_confidence,
  CASE WHEN vec_id % 7 = 0 THEN '' WHEN vec_id % 11 = 0 THEN 'c0' ELSE (SELECT string_agg('c' || i, ',' ORDER BY v DESC, i) FROM (
    SELECT i, d[i + 1] AS v FROM range(len(d)) t(i) ORDER BY v DESC, i LIMIT 3)) END AS component_candidates,
  round(0.003, 6)::DOUBLE AS cost_usd FROM e""")
def decisions_to_prediction(spark, sf):
    e = read_table(spark, sf, "embeddings")
    n = F.col("vec_id")
    dist = F.map_from_entries(F.transform("embedding", lambda x, i: F.struct(F.concat(F.lit("c"), i), F.abs(x).cast("double"))))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    asked = F.array(
        F.struct(F.lit("type").alias("question"), F.when(n % 5 != 0, F.concat(F.lit("c"), n % 3)).otherwise("").alias("answer"),
                 uniform("t", n).alias("confidence"), empty.alias("distribution"), F.lit(0.001).alias("cost")),
        F.struct(F.lit("component").alias("question"), F.when(n % 7 != 0, "c0").otherwise("").alias("answer"),
                 F.element_at(dist, F.lit("c0")).alias("confidence"), F.when(n % 11 == 0, empty).otherwise(dist).alias("distribution"),
                 F.lit(0.002).alias("cost")))
    rows = e.select("vec_id", F.explode(asked).alias("x")).select("vec_id", "x.*")
    out = cs.decisions_to_prediction(rows, "vec_id")
    out = out.withColumn("labels", F.array_join("labels", ",")).withColumn("component_candidates", F.array_join("component_candidates", ","))
    return rounded(out, "type_confidence", "component_confidence", "cost_usd")

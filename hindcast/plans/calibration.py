"""Section K, first half: calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.numeric import r6, uniform
from hindcast.functions.text import SLICES
from hindcast.operators import calibration as cal
from hindcast.plans import fixtures as fx
from hindcast.plans.oracle import poisson_one, u
from hindcast.plans.registry import query
from hindcast.plans.scoring import all_predictions, rounded
from hindcast.plans.textual import FENCED_SQL, FOREIGN_SQL, fenced_body
from hindcast.sources.scratch import materialise
from hindcast.sources.tables import read_table


def answers(spark, sf):
    """(doc_id, conf, correct): needs-info answers with a coarse confidence, so values repeat."""
    g = fx.gold(spark, sf).select("doc_id", F.col("needs_info").alias("g"))
    p = fx.predictions(spark, sf, "a").select("doc_id", "needs_info", F.round("confidence", 2).alias("conf"))
    return p.join(g, "doc_id").select("doc_id", "conf", (F.col("g") == F.col("needs_info")).alias("correct"))


AN = """an AS (SELECT doc_id, round(a.confidence, 2) AS conf, g.needs_info = a.needs_info AS correct FROM gold g JOIN pred_a a USING (doc_id))"""
WIDTH = f"""{AN}, wb AS (SELECT least(CAST(floor(conf * 10) AS INT), 9) AS bin, count(*) AS n, avg(conf) AS confidence,
  avg(correct::INT) AS accuracy FROM an GROUP BY 1)"""
MASS = f"""{AN}, pos AS (SELECT *, row_number() OVER (ORDER BY conf, doc_id) - 1 AS p, count(*) OVER () AS n FROM an),
mb AS (SELECT b.bin, count(*) AS n, avg(conf) AS confidence, avg(correct::INT) AS accuracy, min(conf) AS lo, max(conf) AS hi
  FROM pos JOIN (SELECT CAST(range AS INT) AS bin FROM range(10)) b ON p >= round_even(b.bin * (pos.n / 10.0::DOUBLE), 0)
    AND p < round_even((b.bin + 1) * (pos.n / 10.0::DOUBLE), 0) GROUP BY b.bin)"""
BIN = "bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy"
GP = ("gold", "pred_a")


@query("reliability_width", *GP, sql=f"WITH {WIDTH} SELECT {BIN}, bin / 10.0::DOUBLE AS lo, (bin + 1) / 10.0::DOUBLE AS hi FROM wb")
def reliability_width(spark, sf):
    return rounded(cal.reliability_width(answers(spark, sf), "conf", "correct"), "confidence", "accuracy")


@query("reliability_mass", *GP, sql=f"WITH {MASS} SELECT {BIN}, lo, hi FROM mb")
def reliability_mass(spark, sf):
    return rounded(cal.reliability_mass(answers(spark, sf), "conf", "correct", "doc_id"), "confidence", "accuracy")


@query("ece", *GP, sql=f"""WITH {WIDTH}, {MASS[len(AN) + 2:]}
SELECT 'width' AS bins, round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM wb
UNION ALL SELECT 'mass', round(sum(n * abs(accuracy - confidence)) / sum(n), 6) FROM mb""")
def ece(spark, sf):
    rows = answers(spark, sf)
    width = cal.ece(cal.reliability_width(rows, "conf", "correct")).select(F.lit("width").alias("bins"), "ece")
    mass = cal.ece(cal.reliability_mass(rows, "conf", "correct", "doc_id")).select(F.lit("mass").alias("bins"), "ece")
    return rounded(width.unionByName(mass), "ece")


@query("brier", *GP, sql=f"WITH {AN} SELECT round(avg(pow(conf - correct::INT, 2)), 6) AS brier, count(*) AS n FROM an")
def brier(spark, sf):
    return answers(spark, sf).agg(r6(cal.brier(F.col("conf"), F.col("correct"))).alias("brier"), F.count(F.lit(1)).alias("n"))


RISK = f"""{AN}, rc AS (SELECT conf AS threshold, n::DOUBLE / total AS step, cum_n::DOUBLE / total AS coverage, cum_h / cum_n AS accuracy FROM (
  SELECT conf, n, sum(n) OVER (ORDER BY conf DESC) AS cum_n, sum(h) OVER (ORDER BY conf DESC) AS cum_h, (SELECT count(*) FROM an) AS total
  FROM (SELECT conf, count(*) AS n, sum(correct::INT) AS h FROM an GROUP BY conf)))"""


@query("risk_coverage", *GP, sql=f"WITH {RISK} SELECT threshold, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM rc")
def risk_coverage(spark, sf):
    return rounded(cal.risk_coverage(answers(spark, sf), "conf", "correct").drop("step"), "coverage", "accuracy")


@query("aurc", *GP, sql=f"WITH {RISK} SELECT round(sum(step * (1 - accuracy)), 6) AS aurc FROM rc")
def aurc(spark, sf):
    return rounded(cal.aurc(cal.risk_coverage(answers(spark, sf), "conf", "correct")), "aurc")


OUTCOMES = f"""oc AS (SELECT a.doc_id, 'type' AS question,
    CASE WHEN list_contains(a.labels, lang) THEN lang END AS answer,
    CASE WHEN list_contains(a.labels, lang) THEN {u("'a'", 'a.doc_id', "'conf'", 'lang')} ELSE 0.0 END AS confidence,
    list_contains(a.labels, lang) AS correct FROM gold g JOIN pred_a a USING (doc_id)
  UNION ALL SELECT a.doc_id, 'component', a.component, CASE WHEN a.component IS NOT NULL THEN component_confidence ELSE 0.0 END,
    coalesce(a.component = g.component, false) FROM gold g JOIN pred_a a USING (doc_id) WHERE g.component IS NOT NULL)"""


@query("decision_outcomes", *GP, sql=f"WITH {OUTCOMES} SELECT doc_id, question, answer, round(confidence, 6) AS confidence, correct FROM oc")
def decision_outcomes(spark, sf):
    out = cal.decision_outcomes(fx.gold(spark, sf), fx.predictions(spark, sf, "a"), "doc_id", fx.LANGS)
    return rounded(out.drop("run_id"), "confidence")


SEED = "'0'"


def outcomes_sql(run):
    """`OUTCOMES` of any run, with its name."""
    body = OUTCOMES[len("oc AS ("):-1].replace("pred_a", f"pred_{run}").replace("'a' || '|'", f"'{run}' || '|'")
    return f"SELECT '{run}' AS run_id, * FROM ({body})"


def summary_sql():
    w = f"CASE WHEN r = 0 THEN 1 ELSE {poisson_one(u(SEED, 'r', 'doc_id'))} END::DOUBLE"
    gap = " + ".join(
        f"abs(coalesce(sum(w * (correct::INT - confidence)) FILTER (WHERE least(floor(confidence * 10), 9) = {b}), 0))" for b in range(10))
    listed = ", ".join(f"{{'metric': '{n}', 'v': {e}}}" for n, e in (
        ("accuracy", "sum(w * correct::INT) / nullif(sum(w), 0)"), ("mean_confidence", "sum(w * confidence) / nullif(sum(w), 0)"),
        ("brier", "sum(w * pow(confidence - correct::INT, 2)) / nullif(sum(w), 0)"), ("ece", f"({gap}) / nullif(sum(w), 0)")))
    return f"""WITH oc AS ({outcomes_sql('a')} UNION ALL {outcomes_sql('b')}),
dr AS (SELECT r, doc_id, {w} AS w FROM gold, range(0, 1001) t(r)),
mx AS (SELECT run_id, question, r, unnest([{listed}]) AS x FROM oc JOIN dr USING (doc_id) GROUP BY run_id, question, r),
m AS (SELECT run_id, question, r, x.metric AS metric, x.v AS v FROM mx),
pos AS (SELECT *, row_number() OVER (PARTITION BY run_id, question ORDER BY confidence, doc_id) - 1 AS p, count(*) OVER (PARTITION BY run_id, question) AS n FROM oc),
mb AS (SELECT run_id, question, b.bin, count(*) AS n, avg(confidence) AS c, avg(correct::INT) AS a
  FROM pos JOIN (SELECT CAST(range AS INT) AS bin FROM range(10)) b ON p >= round_even(b.bin * (pos.n / 10.0::DOUBLE), 0)
    AND p < round_even((b.bin + 1) * (pos.n / 10.0::DOUBLE), 0) GROUP BY ALL),
rc AS (SELECT run_id, question, n / sum(n) OVER (PARTITION BY run_id, question) AS step,
  sum(h) OVER (PARTITION BY run_id, question ORDER BY confidence DESC) / sum(n) OVER (PARTITION BY run_id, question ORDER BY confidence DESC) AS acc
  FROM (SELECT run_id, question, confidence, count(*)::DOUBLE AS n, sum(correct::INT)::DOUBLE AS h FROM oc GROUP BY ALL)),
co AS (SELECT 'a' AS run_id, avg(cost_usd) AS c FROM pred_a UNION ALL SELECT 'b', avg(cost_usd) FROM pred_b)
SELECT run_id, question, metric, round(max(v) FILTER (WHERE r = 0), 6) AS point, round(quantile_cont(v, 0.025) FILTER (WHERE r > 0), 6) AS low,
  round(quantile_cont(v, 0.975) FILTER (WHERE r > 0), 6) AS high, count(v) FILTER (WHERE r > 0) AS valid_resamples FROM m GROUP BY ALL
UNION ALL SELECT run_id, question, 'n', count(*), NULL, NULL, 0 FROM oc GROUP BY ALL
UNION ALL SELECT run_id, question, 'ece_mass', round(sum(n * abs(a - c)) / sum(n), 6), NULL, NULL, 0 FROM mb GROUP BY ALL
UNION ALL SELECT run_id, question, 'aurc', round(sum(step * (1 - acc)), 6), NULL, NULL, 0 FROM rc GROUP BY ALL
UNION ALL SELECT run_id, question, 'cost_per_issue', round(c, 6), NULL, NULL, 0 FROM co, (VALUES ('type'), ('component')) q(question)"""


@query("calibration_summary", "gold", "pred_a", "pred_b", sql=summary_sql())
def calibration_summary(spark, sf):
    predictions = all_predictions(spark, sf, ("a", "b"))
    rows = materialise(cal.decision_outcomes(fx.gold(spark, sf), predictions, "doc_id", fx.LANGS), "outcomes")
    costs = predictions.select("run_id", F.col("cost_usd").alias("cost"))
    return rounded(cal.calibration_summary(rows, "doc_id", "confidence", "correct", ["run_id", "question"], costs), "point", "low", "high")


@query("calibration_slices", *GP, "issue", sql=f"""WITH {OUTCOMES}, {FENCED_SQL},
m AS (SELECT oc.*, length(trim(body)) < 300 AS short, share > 0.5 AS fenced, {FOREIGN_SQL.format("(title || body)")} > 0.1 AS far
  FROM oc JOIN issue i ON i.number = oc.doc_id JOIN fs ON fs.doc_id = oc.doc_id WHERE question = 'type'),
s AS (SELECT 'all' AS slice, * FROM m UNION ALL SELECT 'short', * FROM m WHERE short
  UNION ALL SELECT 'mostly_fenced', * FROM m WHERE fenced UNION ALL SELECT 'non_english', * FROM m WHERE far),
b AS (SELECT slice, count(*) AS n, sum(correct::INT) AS h, sum(confidence) AS c FROM s GROUP BY slice, least(floor(confidence * 10), 9))
SELECT t.slice, coalesce(CAST(sum(n) AS BIGINT), 0) AS n, round(sum(h) / sum(n), 6) AS accuracy, round(sum(c) / sum(n), 6) AS mean_confidence,
  round(sum(abs(h - c)) / sum(n), 6) AS ece FROM (VALUES ('all'), ('short'), ('mostly_fenced'), ('non_english')) t(slice)
LEFT JOIN b USING (slice) GROUP BY t.slice""")
def calibration_slices(spark, sf):
    rows = cal.decision_outcomes(fx.gold(spark, sf), fx.predictions(spark, sf, "a"), "doc_id", fx.LANGS).filter("question = 'type'")
    docs = read_table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(80)).alias("title"), "text", fenced_body().alias("fenced"))
    joined = rows.join(docs, "doc_id")
    # Fence lines are injected into a copy of the text; the other slices look at the text itself.
    slices = {n: f(F.col("title"), F.col("fenced" if n == "mostly_fenced" else "text")) for n, f in SLICES.items()}
    return rounded(cal.calibration_slices(joined, slices, "confidence", "correct"), "accuracy", "mean_confidence", "ece")


TOKENS = (" B", "b", "B)", "**C**", "hello", "A.")


@query("letter_distribution", sql=f"""
WITH t AS (SELECT conv_id, [0, 0, 0, 0, -1, 0][1 + turn % 6] AS ok, [1, 1, 1, 2, 9, 0][1 + turn % 6] AS option,
  ln({u("'lp'", 'conv_id', 'turn')} * 0.9 + 0.05) AS lp FROM conversations),
m AS (SELECT conv_id, option, sum(exp(lp)) AS mass FROM t WHERE option < 3 GROUP BY ALL)
SELECT conv_id, option, round(mass / sum(mass) OVER (PARTITION BY conv_id), 6) AS p FROM m""")
def letter_distribution(spark, sf):
    c = read_table(spark, sf, "conversations")
    token = F.get(F.array(*[F.lit(t) for t in TOKENS]), (F.col("turn") % 6).cast("int"))
    rows = c.select("conv_id", token.alias("token"), F.log(uniform("lp", F.col("conv_id"), F.col("turn")) * 0.9 + 0.05).alias("logprob"))
    return rounded(cal.letter_distribution(rows, "conv_id", 3), "p")

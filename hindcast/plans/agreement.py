"""Section L: agreement and consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.numeric import uniform
from hindcast.operators import agreement as ag
from hindcast.operators import uncertainty as un
from hindcast.operators.calibration import best_type
from hindcast.plans import fixtures as fx
from hindcast.plans.oracle import poisson_one, u
from hindcast.plans.registry import query
from hindcast.plans.scoring import all_predictions, rounded
from hindcast.sources.scratch import materialise
from hindcast.sources.tables import read_table


def kappa_join_sql(rows, by="task"):
    return f"""SELECT k.{by}, k.n, round(o, 6) AS exact, round(CASE WHEN abs(1 - e) > 1e-12 THEN (o - e) / (1 - e) END, 6) AS kappa
FROM (SELECT {by}, count(*) AS n, avg((a IS NOT DISTINCT FROM b)::INT) AS o FROM {rows} GROUP BY {by}) k
JOIN (SELECT m.{by}, sum(na * nb)::DOUBLE / max(t) / max(t) AS e FROM (
    SELECT {by}, coalesce(a::VARCHAR, '~') AS c, count(*) AS na FROM {rows} GROUP BY ALL) m
  LEFT JOIN (SELECT {by}, coalesce(b::VARCHAR, '~') AS c, count(*) AS nb FROM {rows} GROUP BY ALL) p USING ({by}, c)
  JOIN (SELECT {by}, count(*) AS t FROM {rows} GROUP BY {by}) w ON w.{by} = m.{by} GROUP BY m.{by}) x ON x.{by} = k.{by}"""


GA = ("gold", "pred_a")
JOINED = "FROM gold g JOIN pred_a p USING (doc_id)"


@query("cohen_kappa", *GA, sql=f"WITH t AS (SELECT lang AS task, g.component AS a, p.component AS b {JOINED}) {kappa_join_sql('t')}")
def cohen_kappa(spark, sf):
    g = fx.gold(spark, sf).select("doc_id", F.col("lang").alias("task"), F.col("component").alias("a"))
    p = fx.predictions(spark, sf, "a").select("doc_id", F.col("component").alias("b"))
    return rounded(ag.cohen_kappa(g.join(p, "doc_id"), "a", "b", ["task"]), "exact", "kappa")


def score_pairs(spark, sf, a="human", b="judge"):
    x = fx.rubric_scores(spark, sf, a).withColumnRenamed("score", "a")
    return x.join(fx.rubric_scores(spark, sf, b).withColumnRenamed("score", "b"), ["item", "criterion"])


QWK = """SELECT {by} count(*) AS n, round(1 - sum(pow(a - b, 2)) / count(*) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)), 6) AS qwk,
  round(avg((a = b)::INT), 6) AS exact, round(avg((abs(a - b) <= 1)::INT), 6) AS adjacent, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b
FROM (SELECT criterion, h.score AS a, j.score AS b FROM score_human h JOIN score_judge j USING (item, criterion)) {tail}"""
SCORES = ("score_human", "score_judge")
NUMS = ("qwk", "exact", "adjacent", "mean_a", "mean_b")


@query("weighted_kappa", *SCORES, sql=QWK.format(by="", tail=""))
def weighted_kappa(spark, sf):
    return rounded(ag.weighted_kappa(score_pairs(spark, sf), "a", "b", (1, 2, 3, 4)), *NUMS)


@query("exact_adjacent", *SCORES, sql=f"SELECT exact, adjacent FROM ({QWK.format(by='', tail='')})")
def exact_adjacent(spark, sf):
    return rounded(ag.weighted_kappa(score_pairs(spark, sf), "a", "b", (1, 2, 3, 4)).select("exact", "adjacent"), "exact", "adjacent")


VOCAB = (*fx.LANGS, "q0", "q1", "t0", "t1")


@query("agreement_by_task", *GA, sql=f"""
WITH t AS (SELECT 'T1 type label' AS task, list_min(list_filter(g.labels, lambda x: x IN ('en', 'fr', 'de', 'es')))::VARCHAR AS a,
    list_min(list_filter(p.labels, lambda x: x IN ('en', 'fr', 'de', 'es')))::VARCHAR AS b {JOINED} WHERE human_triaged
  UNION ALL SELECT 'T2 is a duplicate', (g.duplicate_of IS NOT NULL)::VARCHAR, (p.duplicate_of IS NOT NULL)::VARCHAR {JOINED}
  UNION ALL SELECT 'T3 component', g.component, p.component {JOINED} WHERE g.component IS NOT NULL AND p.component IS NOT NULL
  UNION ALL SELECT 'T4 needs info', g.needs_info::VARCHAR, p.needs_info::VARCHAR {JOINED}
  UNION ALL SELECT 'T1 labels (pooled)', list_contains(g.labels, v)::VARCHAR, list_contains(p.labels, v)::VARCHAR {JOINED},
    (SELECT unnest({list(VOCAB)}) AS v) WHERE human_triaged)
SELECT task, CASE task WHEN 'T1 labels (pooled)' THEN n // {len(VOCAB)} ELSE n END AS n, exact, kappa FROM ({kappa_join_sql('t')})""")
def agreement_by_task(spark, sf):
    g = fx.gold(spark, sf).select(
        "doc_id", F.col("labels").alias("a_labels"), F.col("human_triaged").alias("a_triaged"), F.col("duplicate_of").alias("a_dup"),
        F.col("component").alias("a_comp"), F.col("needs_info").alias("a_info"))
    p = fx.predictions(spark, sf, "a").select(
        "doc_id", F.col("labels").alias("b_labels"), F.col("duplicate_of").alias("b_dup"), F.col("component").alias("b_comp"),
        F.col("needs_info").alias("b_info"))
    return rounded(ag.agreement_by_task(g.join(p, "doc_id"), VOCAB, fx.LANGS), "exact", "kappa")


@query("rubric_agreement", *SCORES, sql=QWK.format(by="criterion,", tail="GROUP BY criterion"))
def rubric_agreement(spark, sf):
    return rounded(ag.weighted_kappa(score_pairs(spark, sf), "a", "b", (1, 2, 3, 4), ["criterion"]), *NUMS)


@query("bias_shift", "score_judge", "score_terse", sql="""
SELECT criterion, round(avg(t.score - j.score), 6) AS shift, count(*) AS n FROM score_judge j JOIN score_terse t USING (item, criterion) GROUP BY criterion""")
def bias_shift(spark, sf):
    return rounded(ag.bias_shift(fx.rubric_scores(spark, sf, "judge"), fx.rubric_scores(spark, sf, "terse"), "item"), "shift")


CRITERIA = ("correctness", "actionability", "tone")


@query("system_rubric_scores", sql=f"""
WITH c AS (SELECT role AS system, criterion, conv_id * 1000 + turn AS item, {u("'e'", 'conv_id', 'turn')} < 0.1 AS empty,
    CASE WHEN {u("'e'", 'conv_id', 'turn')} < 0.1 THEN 1 ELSE 1 + floor({u("'s'", 'conv_id', 'turn', 'criterion')} * 4) END::DOUBLE AS v
  FROM conversations, (VALUES {', '.join(f"('{k}')" for k in CRITERIA)}) k(criterion)),
d AS (SELECT system, criterion, r, v, {u("'0'", 'r', 'item')} AS uu FROM c, range(1, 1001) t(r)),
m AS (SELECT system, criterion, r, sum(w * v) / sum(w) AS m FROM (SELECT system, criterion, r, v, {poisson_one('uu')} AS w FROM d) GROUP BY ALL HAVING sum(w) > 0),
n AS (SELECT system, criterion, count(*) AS comments, count(*) FILTER (WHERE empty) AS empty, avg(v) AS mean FROM c GROUP BY ALL)
SELECT system, criterion, any_value(comments) AS comments, any_value(empty) AS empty, round(any_value(mean), 6) AS mean,
  round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m JOIN n USING (system, criterion) GROUP BY system, criterion""")
def system_rubric_scores(spark, sf):
    """Mean score of each role per criterion, with an interval."""
    c = read_table(spark, sf, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    empty = uniform("e", conv, turn) < 0.1
    rated = c.withColumn("criterion", F.explode(F.array(*[F.lit(k) for k in CRITERIA])))
    # A comment that was never written scores the bottom of the scale.
    judged = F.when(~empty, 1 + F.floor(uniform("s", conv, turn, F.col("criterion")) * 4))
    items = rated.select(
        F.col("role").alias("system"), "criterion", (conv * 1000 + turn).alias("item"), F.coalesce(judged, F.lit(1)).alias("v"), empty.alias("empty"))
    by = ["system", "criterion"]
    ci = un.bootstrap_ci(items, "item", {"n": F.lit(1), "v": F.col("v")}, {"mean": F.col("v") / F.col("n")}, by=by)
    counts = items.groupBy(*by).agg(F.count(F.lit(1)).alias("comments"), F.count_if("empty").alias("empty"))
    return rounded(ci.join(counts, by).select(*by, "comments", "empty", F.col("point").alias("mean"), "low", "high"), "mean", "low", "high")


CODES = ("c0", "c1", "c2", "c3", "c4")
CATEGORY_OF = {"c0": "retrieval", "c1": "retrieval", "c2": "labels", "c3": "routing"}


def tag_codes(rater):
    return F.filter(F.array(*[F.lit(c) for c in CODES]), lambda c: uniform(rater, F.col("doc_id"), c) < 0.4)


def tags_sql(rater):
    return f"list_filter({list(CODES)}, lambda c: {u(repr(rater), 'doc_id', 'c')} < 0.4)"


@query("tag_agreement", sql=f"""
WITH t AS (SELECT doc_id, {tags_sql('h')} AS h, {tags_sql('m')} AS m FROM documents),
c AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE list_contains(h, category)) AS human, count(*) FILTER (WHERE list_contains(m, category)) AS model,
  avg((list_contains(h, category) = list_contains(m, category))::INT) AS o FROM t, (SELECT unnest({list(CODES)}) AS category) GROUP BY category)
SELECT category, n, human, model, round((o - (human * model + (n - human) * (n - model))::DOUBLE / n / n) / (1 - (human * model + (n - human) * (n - model))::DOUBLE / n / n), 6) AS kappa,
  NULL::DOUBLE AS exact, NULL::DOUBLE AS jaccard FROM c
UNION ALL SELECT '(all)', count(*), NULL, NULL, NULL, round(avg((h = m)::INT), 6),
  round(avg(len(list_intersect(h, m))::DOUBLE / greatest(len(list_distinct(h || m)), 1)), 6) FROM t""")
def tag_agreement(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    tags = d.select(F.col("doc_id").alias("item"), tag_codes("h").alias("human"), tag_codes("m").alias("model"))
    return rounded(ag.tag_agreement(tags, CODES), "kappa", "exact", "jaccard")


@query("code_to_category", sql=f"""
WITH t AS (SELECT doc_id, unnest({tags_sql('h')}) AS code FROM documents)
SELECT doc_id, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories FROM t
LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in CATEGORY_OF.items())}) c(code, category) USING (code) GROUP BY doc_id""")
def code_to_category(spark, sf):
    mapping = spark.createDataFrame(list(CATEGORY_OF.items()), "code string, category string")
    d = read_table(spark, sf, "documents").select("doc_id", tag_codes("h").alias("codes"))
    return ag.code_to_category(d, "doc_id", "codes", mapping).withColumn("categories", F.array_join("categories", ","))


def run_answers(spark, sf):
    g = fx.gold(spark, sf).select(
        "doc_id", "lang", "human_triaged", F.col("component").alias("g_comp"), F.col("duplicate_of").alias("g_dup"),
        F.array_join(F.array_sort("labels"), ",").alias("g_labels"))
    p = all_predictions(spark, sf)
    rows = p.join(g, "doc_id")
    t = best_type(F.col("labels"), F.col("confidences"), fx.LANGS)["answer"]

    def decision(name, answer, truth, counted):
        return F.struct(F.lit(name).alias("decision"), answer.cast("string").alias("answer"), truth.cast("string").alias("truth"), counted.alias("counted"))

    four = F.array(
        decision("type label", t, F.col("lang"), F.col("human_triaged")),
        decision("all labels", F.array_join(F.array_sort("labels"), ","), F.col("g_labels"), F.col("human_triaged")),
        decision("component", F.col("component"), F.col("g_comp"), F.col("g_comp").isNotNull()),
        decision("duplicate link", F.col("duplicate_of"), F.col("g_dup"), F.lit(True)))
    return rows.select("doc_id", "run_id", F.explode(four).alias("x")).select("doc_id", "run_id", "x.*")


def answers_sql(run=""):
    """Every answer beside the truth; `run` may add the run's column."""
    return f"""SELECT 'type label' AS decision, doc_id, {run}CASE WHEN list_contains(p.labels, lang) THEN lang END AS answer, lang AS truth FROM p JOIN gold g USING (doc_id) WHERE human_triaged
  UNION ALL SELECT 'all labels', doc_id, {run}array_to_string(list_sort(p.labels), ','), array_to_string(list_sort(g.labels), ',') FROM p JOIN gold g USING (doc_id) WHERE human_triaged
  UNION ALL SELECT 'component', doc_id, {run}p.component, g.component FROM p JOIN gold g USING (doc_id) WHERE g.component IS NOT NULL
  UNION ALL SELECT 'duplicate link', doc_id, {run}p.duplicate_of::VARCHAR, g.duplicate_of::VARCHAR FROM p JOIN gold g USING (doc_id)"""


ANSWERS = f"""p AS (SELECT * FROM pred_a UNION ALL SELECT * FROM pred_b UNION ALL SELECT * FROM pred_c),
an AS ({answers_sql()}),
it AS (SELECT decision, doc_id, avg((answer IS NOT DISTINCT FROM truth)::INT) AS accuracy, bool_and(answer IS NOT DISTINCT FROM truth) AS every,
  bool_or(answer IS NOT DISTINCT FROM truth) AS ever, count(DISTINCT coalesce(answer, '~')) = 1 AS same FROM an GROUP BY ALL)"""


@query("consistency", "pred_a", "pred_b", "pred_c", sql=f"""WITH {ANSWERS}
SELECT decision, count(*) AS n, round(avg(accuracy), 6) AS accuracy, round(avg(every::INT), 6) AS pass_k,
  round(avg(ever::INT), 6) AS ever_right, round(avg(same::INT), 6) AS unanimous FROM it GROUP BY decision""")
def consistency(spark, sf):
    out = ag.consistency(ag.consistency_items(run_answers(spark, sf), "doc_id", 3))
    return rounded(out, "accuracy", "pass_k", "ever_right", "unanimous")


SEED = "'0'"


def consistency_report_sql():
    w = f"CASE WHEN r = 0 THEN 1 ELSE {poisson_one(u(SEED, 'r', 'doc_id'))} END::DOUBLE"
    shares = ", ".join(f"{{'metric': '{m}', 'v': sum(w * {c}::DOUBLE) / nullif(sum(w), 0)}}" for m, c in (
        ("accuracy", "accuracy"), ("pass_k", '"every"'), ("ever_right", "ever"), ("unanimous", "same")))
    return f"""WITH {ANSWERS},
dr AS (SELECT r, doc_id, {w} AS w FROM gold, range(0, 1001) t(r)),
mi AS (SELECT decision, r, unnest([{shares}]) AS x FROM it JOIN dr USING (doc_id) GROUP BY decision, r),
an2 AS ({answers_sql('run_id, ')}),
mr AS (SELECT decision, r, 'accuracy_' || run_id AS metric, sum(w * (answer IS NOT DISTINCT FROM truth)::INT) / nullif(sum(w), 0) AS v
  FROM an2 JOIN dr USING (doc_id) GROUP BY ALL),
m AS (SELECT decision, r, x.metric AS metric, x.v AS v FROM mi UNION ALL SELECT * FROM mr)
SELECT decision, metric, round(max(v) FILTER (WHERE r = 0), 6) AS point, round(quantile_cont(v, 0.025) FILTER (WHERE r > 0), 6) AS low,
  round(quantile_cont(v, 0.975) FILTER (WHERE r > 0), 6) AS high, count(v) FILTER (WHERE r > 0) AS valid_resamples FROM m GROUP BY ALL"""


@query("consistency_report", "pred_a", "pred_b", "pred_c", sql=consistency_report_sql())
def consistency_report(spark, sf):
    """Accuracy, pass^k, ever right and unanimity per decision, and each run's own accuracy, with intervals."""
    answers = run_answers(spark, sf)
    items = materialise(ag.consistency_items(answers, "doc_id", 3), "consistency-items")
    sums = {"n": F.lit(1), **{c: F.col(c) for c in ("accuracy", "every", "ever", "same")}}
    share = lambda c: F.col(c) / F.col("n")
    metrics = {"accuracy": share("accuracy"), "pass_k": share("every"), "ever_right": share("ever"), "unanimous": share("same")}
    whole = un.bootstrap_ci(items, "doc_id", sums, metrics, by=["decision"])
    runs = un.bootstrap_ci(
        ag.run_accuracy(answers, items, "doc_id"), "doc_id", {"n": F.lit(1), "right": F.col("right")}, {"accuracy": share("right")},
        by=["decision", "run_id"])
    both = whole.unionByName(runs.withColumn("metric", F.concat("metric", F.lit("_"), "run_id")).drop("run_id"))
    return rounded(both.drop("weighted"), "point", "low", "high")

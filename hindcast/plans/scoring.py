"""Section I: scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.numeric import r6, uniform
from hindcast.operators import scoring as sc
from hindcast.plans import fixtures as fx
from hindcast.plans.oracle import poisson_one, ratio, u
from hindcast.plans.registry import query
from hindcast.sources.tables import read_table

GP = ("gold", "pred_a")


def items(spark, sf, run="a"):
    return sc.scored_items(fx.gold(spark, sf), fx.predictions(spark, sf, run), "doc_id")


def all_predictions(spark, sf, runs=fx.RUNS):
    return reduce(DataFrame.unionByName, [fx.predictions(spark, sf, r) for r in runs])


def rounded(df, *names):
    return df.select(*[r6(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


PRF_COLS = ("tp", "fp", "fn", "precision", "recall", "f1", "support")


def prf_sql(tp="tp", fp="fp", fn="fn"):
    return f"""{tp}::DOUBLE AS tp, {fp}::DOUBLE AS fp, {fn}::DOUBLE AS fn, round({ratio(tp, f'{tp} + {fp}')}, 6) AS "precision",
  round({ratio(tp, f'{tp} + {fn}')}, 6) AS recall, round({ratio(f'2.0 * {tp}', f'2.0 * {tp} + {fp} + {fn}')}, 6) AS f1,
  ({tp} + {fn})::DOUBLE AS support"""


def counts_sql(g, p, w="1"):
    s = lambda c: f"coalesce(sum({w}) FILTER (WHERE {c}), 0)"
    return f"{s(f'{g} AND {p}')} AS tp, {s(f'NOT ({g}) AND {p}')} AS fp, {s(f'{g} AND NOT ({p})')} AS fn"


JOINED = "FROM gold g JOIN pred_a a USING (doc_id)"


@query("prf", *GP, sql=f"""SELECT lang, {prf_sql()} FROM (
SELECT lang, {counts_sql('g.needs_info', 'a.needs_info')} {JOINED} GROUP BY lang)""")
def prf_q(spark, sf):
    rows = items(spark, sf).join(fx.gold(spark, sf).select("doc_id", "lang"), "doc_id")
    counts = rows.groupBy("lang").agg(*sc.binary_counts(F.col("g_info"), F.col("p_info"), F.lit(1.0)))
    return rounded(sc.with_prf(counts), *PRF_COLS)


@query("binary_prf", *GP, sql=f"SELECT {prf_sql()} FROM (SELECT {counts_sql('g.needs_info', 'a.needs_info', 'weight')} {JOINED})")
def binary_prf(spark, sf):
    return rounded(sc.with_prf(items(spark, sf).agg(*sc.binary_counts(F.col("g_info"), F.col("p_info"), F.col("weight")))), *PRF_COLS)


LAB_SQL = """lab AS (SELECT doc_id, label, bool_or(g) AS g, bool_or(p) AS p, max(w) AS w FROM (
  SELECT doc_id, unnest(labels) AS label, true AS g, false AS p, weight AS w FROM gold WHERE human_triaged
  UNION ALL SELECT a.doc_id, unnest(a.labels), false, true, gold.weight FROM pred_a a JOIN gold USING (doc_id) WHERE human_triaged)
  GROUP BY doc_id, label),
pl AS (SELECT label, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp,
  count(*) FILTER (WHERE g AND NOT p) AS fn, coalesce(sum(w) FILTER (WHERE g AND p), 0) AS wtp,
  coalesce(sum(w) FILTER (WHERE p AND NOT g), 0) AS wfp, coalesce(sum(w) FILTER (WHERE g AND NOT p), 0) AS wfn,
  CASE WHEN NOT bool_or(g) THEN NULL WHEN label[1] = 'q' THEN 'area' WHEN label[1] = 't' THEN 'family' ELSE 'type' END AS grp
  FROM lab GROUP BY label)"""
F1 = "2.0 * {0}tp / (2.0 * {0}tp + {0}fp + {0}fn)"


@query("multilabel_prf", *GP, sql=f"""WITH {LAB_SQL}
SELECT label, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, round({F1.format('')}, 6) AS f1 FROM pl
UNION ALL SELECT '(micro)', sum(tp), sum(fp), sum(fn), round(2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn)), 6) FROM pl
UNION ALL SELECT '(macro)', NULL, NULL, NULL, round(avg({F1.format('')}), 6) FROM pl""")
def multilabel_prf(spark, sf):
    per = sc.per_label_f1(items(spark, sf)).select("label", "tp", "fp", "fn", "f1")
    micro = sc.with_prf(per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])).select(
        F.lit("(micro)").alias("label"), "tp", "fp", "fn", "f1")
    none = F.lit(None).cast("double")
    macro = per.agg(F.avg("f1").alias("f1")).select(
        F.lit("(macro)").alias("label"), none.alias("tp"), none.alias("fp"), none.alias("fn"), "f1")
    return rounded(per.unionByName(micro).unionByName(macro), "f1")


LINK = "coalesce(sum({w}) FILTER (WHERE g.duplicate_of = a.duplicate_of), 0) AS tp, " \
    "coalesce(sum({w}) FILTER (WHERE a.duplicate_of IS NOT NULL AND g.duplicate_of IS DISTINCT FROM a.duplicate_of), 0) AS fp, " \
    "coalesce(sum({w}) FILTER (WHERE g.duplicate_of IS NOT NULL AND g.duplicate_of IS DISTINCT FROM a.duplicate_of), 0) AS fn"


@query("duplicate_prf", *GP, sql=f"SELECT {prf_sql()} FROM (SELECT {LINK.format(w='weight')} {JOINED})")
def duplicate_prf(spark, sf):
    return rounded(sc.with_prf(items(spark, sf).agg(*sc.link_counts(F.col("weight")))), *PRF_COLS)


@query("duplicate_detection_prf", *GP, sql=f"""SELECT {prf_sql()} FROM (
SELECT {counts_sql('g.duplicate_of IS NOT NULL', 'a.duplicate_of IS NOT NULL')} {JOINED})""")
def duplicate_detection_prf(spark, sf):
    counts = sc.binary_counts(F.col("g_dup").isNotNull(), F.col("p_dup").isNotNull(), F.lit(1.0))
    return rounded(sc.with_prf(items(spark, sf).agg(*counts)), *PRF_COLS)


@query("accuracy", *GP, sql=f"""
SELECT round(sum(weight) FILTER (WHERE g.component = a.component) / sum(weight), 6) AS accuracy, count(*) AS n
{JOINED} WHERE g.component IS NOT NULL""")
def accuracy(spark, sf):
    hit = F.coalesce(F.col("g_comp") == F.col("p_comp"), F.lit(False))
    return items(spark, sf).filter("g_comp IS NOT NULL").agg(
        r6(sc.weighted_accuracy(hit, F.col("weight"))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("topk_accuracy", *GP, sql=f"""
SELECT k, round(sum(weight) FILTER (WHERE list_contains(component_candidates[1:k], g.component)) / sum(weight), 6) AS accuracy
{JOINED}, (VALUES (1), (2), (3)) t(k) WHERE g.component IS NOT NULL GROUP BY k""")
def topk_accuracy(spark, sf):
    rows = items(spark, sf).filter("g_comp IS NOT NULL").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    hit = F.array_contains(F.slice("p_cands", 1, F.col("k")), F.col("g_comp"))
    return rows.groupBy("k").agg(r6(sc.weighted_accuracy(hit, F.col("weight"))).alias("accuracy"))


def _registry_sql():
    def task(name, counts, stat):
        tp, fp, fn = "tp", "fp", "fn"
        return {"f1": f"2.0 * {tp} / (2.0 * {tp} + {fp} + {fn})", "precision": ratio(tp, f"{tp} + {fp}"), "recall": ratio(tp, f"{tp} + {fn}")}[stat], counts

    rows = []
    for m, agg in (("t1_micro_f1", "true"), ("t1_type_micro_f1", "grp = 'type'"), ("t1_area_micro_f1", "grp = 'area'")):
        e = "2.0 * sum({0}tp) / (2.0 * sum({0}tp) + sum({0}fp) + sum({0}fn))"
        rows.append(f"SELECT '{m}' AS metric, round({e.format('')}, 6) AS point, round({e.format('w')}, 6) AS weighted FROM pl WHERE {agg}")
    rows.append(f"SELECT 't1_macro_f1', round(avg({F1.format('')}), 6), round(avg({F1.format('w')}), 6) FROM pl")
    info = lambda w: counts_sql("g.needs_info", "a.needs_info", w)
    det = lambda w: counts_sql("g.duplicate_of IS NOT NULL", "a.duplicate_of IS NOT NULL", w)
    link = lambda w: LINK.format(w=w)
    for m, counts, stat in (
        ("t2_link_f1", link, "f1"), ("t2_link_precision", link, "precision"), ("t2_link_recall", link, "recall"),
        ("t2_detect_f1", det, "f1"), ("t4_f1", info, "f1"), ("t4_precision", info, "precision"), ("t4_recall", info, "recall"),
    ):
        e, _ = task(m, counts, stat)
        rows.append(f"SELECT '{m}', (SELECT round({e}, 6) FROM (SELECT {counts('1')} {JOINED})), (SELECT round({e}, 6) FROM (SELECT {counts('weight')} {JOINED}))")
    for m, hit in (("t3_accuracy", "g.component = a.component"), ("t3_top3_accuracy", "list_contains(component_candidates[1:3], g.component)")):
        rows.append(f"""SELECT '{m}', round(count(*) FILTER (WHERE {hit})::DOUBLE / count(*), 6),
  round(sum(weight) FILTER (WHERE {hit}) / sum(weight), 6) {JOINED} WHERE g.component IS NOT NULL""")
    return f"WITH {LAB_SQL} " + "\nUNION ALL ".join(rows)


@query("metric_registry", *GP, sql=_registry_sql())
def metric_registry(spark, sf):
    return rounded(sc.point_scores(items(spark, sf)), "point", "weighted")


QUOTED_SEED = "'0'"


def sampled_sql(runs, where="true", lowest=-1):
    """`m` (k, r, metric, v): every headline metric of each run in the data (r = 0), by weight (-1) and in 1,000 resamples."""
    w = f"CASE WHEN r = 0 THEN 1 WHEN r = -1 THEN weight ELSE {poisson_one(u(QUOTED_SEED, 'r', 'doc_id'))} END::DOUBLE"
    flags = {
        "triaged": "human_triaged", "link_tp": "g.duplicate_of = p.duplicate_of",
        "link_fp": "p.duplicate_of IS NOT NULL AND g.duplicate_of IS DISTINCT FROM p.duplicate_of",
        "link_fn": "g.duplicate_of IS NOT NULL AND g.duplicate_of IS DISTINCT FROM p.duplicate_of",
        "det_tp": "g.duplicate_of IS NOT NULL AND p.duplicate_of IS NOT NULL", "det_fp": "g.duplicate_of IS NULL AND p.duplicate_of IS NOT NULL",
        "det_fn": "g.duplicate_of IS NOT NULL AND p.duplicate_of IS NULL", "comp_n": "g.component IS NOT NULL",
        "comp_hit": "g.component = p.component", "comp_top3": "list_contains(component_candidates[1:3], g.component)",
        "info_tp": "g.needs_info AND p.needs_info", "info_fp": "NOT g.needs_info AND p.needs_info", "info_fn": "g.needs_info AND NOT p.needs_info"}
    sums = ", ".join(f"coalesce(sum(w) FILTER (WHERE {c}), 0) AS {n}" for n, c in flags.items())
    group = "CASE WHEN label[1] = 'q' THEN 'area' WHEN label[1] = 't' THEN 'family' ELSE 'type' END"
    parts = ", ".join(
        f"coalesce(sum({c}) FILTER (WHERE {cond}), 0) AS {n}_{c}" for n, cond in (
            ("all", "true"), ("type", f"held > 0 AND {group} = 'type'"), ("area", f"held > 0 AND {group} = 'area'")) for c in ("tp", "fp", "fn"))

    def stat(prefix, which):
        tp, fp, fn = (f"{prefix}_{c}" for c in ("tp", "fp", "fn"))
        value = {"f1": ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), "precision": ratio(tp, f"{tp} + {fp}"), "recall": ratio(tp, f"{tp} + {fn}")}[which]
        return f"CASE WHEN {tp} + {fn} > 0 THEN {value} END"

    def micro(prefix):
        return f"CASE WHEN triaged > 0 THEN coalesce({ratio(f'2 * {prefix}_tp', f'2 * {prefix}_tp + {prefix}_fp + {prefix}_fn')}, 0) END"

    values = {
        "t1_micro_f1": micro("all"), "t1_macro_f1": "CASE WHEN triaged > 0 THEN coalesce(macro, 0) END", "t1_type_micro_f1": micro("type"),
        "t1_area_micro_f1": micro("area"), "t2_link_f1": stat("link", "f1"), "t2_link_precision": stat("link", "precision"),
        "t2_link_recall": stat("link", "recall"), "t2_detect_f1": stat("det", "f1"),
        "t3_accuracy": "CASE WHEN comp_n > 0 THEN comp_hit / comp_n END", "t3_top3_accuracy": "CASE WHEN comp_n > 0 THEN comp_top3 / comp_n END",
        "t4_f1": stat("info", "f1"), "t4_precision": stat("info", "precision"), "t4_recall": stat("info", "recall")}
    listed = ", ".join(f"{{'metric': '{n}', 'v': ({e})::DOUBLE}}" for n, e in values.items())
    return f"""pr AS ({runs}),
dr AS (SELECT r, doc_id, {w} AS w FROM gold, range({lowest}, 1001) t(r)),
pg AS (SELECT p.*, g.labels AS gl, human_triaged FROM pr p JOIN gold g USING (doc_id) WHERE {where}),
tot AS (SELECT p.k, r, {sums} FROM pr p JOIN gold g USING (doc_id) JOIN dr USING (doc_id) WHERE {where} GROUP BY ALL),
lr AS (SELECT k, doc_id, label, bool_or(g) AS g, bool_or(p) AS p FROM (
  SELECT k, doc_id, unnest(gl) AS label, true AS g, false AS p FROM pg WHERE human_triaged
  UNION ALL SELECT k, doc_id, unnest(labels), false, true FROM pg WHERE human_triaged) GROUP BY ALL),
lt AS (SELECT k, r, label, coalesce(sum(w) FILTER (WHERE g), 0) AS held, coalesce(sum(w) FILTER (WHERE g AND p), 0) AS tp,
  coalesce(sum(w) FILTER (WHERE p AND NOT g), 0) AS fp, coalesce(sum(w) FILTER (WHERE g AND NOT p), 0) AS fn FROM lr JOIN dr USING (doc_id) GROUP BY ALL),
ls AS (SELECT k, r, avg(2 * tp / (2 * tp + fp + fn)) AS macro, {parts} FROM lt WHERE tp + fp + fn > 0 GROUP BY ALL),
mx AS (SELECT k, r, unnest([{listed}]) AS x FROM tot LEFT JOIN ls USING (k, r)),
m AS (SELECT k, r, x.metric AS metric, x.v AS v FROM mx)"""


TWO_RUNS = "SELECT run_id AS k, * FROM pred_a UNION ALL SELECT run_id, * FROM pred_b"
SCORECARD_SQL = f"""WITH {sampled_sql(TWO_RUNS)},
iv AS (SELECT k AS run_id, metric, max(v) FILTER (WHERE r = 0) AS point, quantile_cont(v, 0.025) FILTER (WHERE r > 0) AS low,
  quantile_cont(v, 0.975) FILTER (WHERE r > 0) AS high, max(v) FILTER (WHERE r = -1) AS weighted, count(v) FILTER (WHERE r > 0) AS valid FROM m GROUP BY ALL),
st AS (SELECT k, unnest([{{'metric': 'issues', 'v': count(*)::DOUBLE}}, {{'metric': 'errors', 'v': count(error)::DOUBLE}},
  {{'metric': 'cost_total', 'v': sum(cost_usd)}}, {{'metric': 'cost_per_issue', 'v': avg(cost_usd)}},
  {{'metric': 'latency_p50', 'v': quantile_cont(latency_ms::DOUBLE, 0.5)}}, {{'metric': 'latency_p95', 'v': quantile_cont(latency_ms::DOUBLE, 0.95)}}]) AS x FROM pr GROUP BY k)
SELECT run_id, metric, round(point, 6) AS point, CASE WHEN point IS NOT NULL THEN round(low, 6) END AS low,
  CASE WHEN point IS NOT NULL THEN round(high, 6) END AS high, round(weighted, 6) AS weighted, CASE WHEN point IS NULL THEN 0 ELSE valid END AS valid_resamples FROM iv
UNION ALL SELECT k, 'label_f1:' || label, round(2 * tp / (2 * tp + fp + fn), 6), NULL, NULL, NULL, 0 FROM lt WHERE r = 0
UNION ALL SELECT k, 'system:' || x.metric, round(x.v, 6), NULL, NULL, NULL, 0 FROM st"""


@query("scorecard", "gold", "pred_a", "pred_b", sql=SCORECARD_SQL)
def scorecard(spark, sf):
    rows = sc.scored_items(fx.gold(spark, sf), all_predictions(spark, sf, ("a", "b")), "doc_id")
    return rounded(sc.scorecard(rows, "doc_id", ["run_id"], stats=True), "point", "low", "high", "weighted")


@query("system_stats", sql="""
SELECT user_id, count(*) AS issues, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 4) AS cost_total,
  round(avg(value), 4) AS cost_per_issue, round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 6) AS tokens_in_per_issue,
  round(avg(length(event_type)), 6) AS tokens_out_per_issue, round(quantile_cont(floor(value * 10)::DOUBLE, 0.5), 6) AS latency_p50,
  round(quantile_cont(floor(value * 10)::DOUBLE, 0.95), 6) AS latency_p95 FROM events GROUP BY user_id""")
def system_stats(spark, sf):
    e = read_table(spark, sf, "events")
    out = sc.system_stats(
        e, "user_id", F.col("event_type") == "error", F.col("value"), F.floor(F.col("value") * 10).cast("double"), fx.event_k(), F.length("event_type"))
    out = out.withColumn("cost_total", F.round("cost_total", 4)).withColumn("cost_per_issue", F.round("cost_per_issue", 4))
    return rounded(out, "tokens_in_per_issue", "tokens_out_per_issue", "latency_p50", "latency_p95")


@query("align", sql="""
SELECT count(*) AS examples, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing,
  (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    ORDER BY doc_id LIMIT 3)) AS sample FROM documents d LEFT JOIN labels l USING (doc_id)""")
def align(spark, sf):
    return sc.aligned(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"), "doc_id")


@query("load_split", sql="""
SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'test' ELSE 'dev' END AS split, quality, toxic,
  CASE WHEN d.doc_id % 3 = 0 THEN 2.5 ELSE 1.0 END::DOUBLE AS weight, left(text, 80) AS title
FROM documents d JOIN labels USING (doc_id) WHERE d.doc_id % 5 <> 0""")
def load_split(spark, sf):
    d = fx.documents(spark, sf).select(F.col("number").alias("doc_id"), "title")
    n = F.col("doc_id")
    splits = d.select("doc_id", F.when(n % 5 == 0, "train").when(n % 4 == 0, "test").otherwise("dev").alias("split"),
                      F.when(n % 3 == 0, 2.5).alias("weight"))
    return sc.load_split(d, read_table(spark, sf, "labels"), splits, "doc_id", ("dev", "test"))


def comparison_list(spark, pairs):
    rows = [(f"{b}-{a}", a, b) for a, b in pairs]
    return spark.createDataFrame(rows, "comparison string, a string, b string")


def deltas(spark, sf, pairs, exclude_errors=False):
    runs = sorted({r for p in pairs for r in p})
    splits = spark.createDataFrame([(r, "test") for r in runs], "run_id string, split string")  # all runs answered the same documents
    compared = sc.compared_items(
        comparison_list(spark, pairs), fx.gold(spark, sf), all_predictions(spark, sf, runs), "doc_id", exclude_errors, splits)
    return sc.compare_runs(compared, "doc_id")


def deltas_sql(a, b, where="true"):
    """`d_<b>`: the paired deltas of run b over run a."""
    both = f"SELECT 'a' AS k, * FROM pred_{a} UNION ALL SELECT 'b', * FROM pred_{b}"
    return f"""d_{b} AS (WITH {sampled_sql(both, where, 0)},
  wide AS (SELECT r, metric, max(v) FILTER (WHERE k = 'a') AS a, max(v) FILTER (WHERE k = 'b') AS b FROM m GROUP BY ALL),
  dl AS (SELECT metric, max(a) FILTER (WHERE r = 0) AS a, max(b) FILTER (WHERE r = 0) AS b, max(b - a) FILTER (WHERE r = 0) AS delta,
    quantile_cont(b - a, 0.025) FILTER (WHERE r > 0) AS low, quantile_cont(b - a, 0.975) FILTER (WHERE r > 0) AS high,
    avg((b - a > 0)::INT) FILTER (WHERE r > 0) AS share_b_better, count(b - a) FILTER (WHERE r > 0) AS valid FROM wide GROUP BY metric)
  SELECT '{b}-{a}' AS comparison, metric, a, b, delta, low, high, share_b_better, valid AS valid_resamples,
    coalesce(low > 0 OR high < 0, false) AS significant FROM dl WHERE delta IS NOT NULL AND valid > 0)"""


NO_ERRORS = "doc_id IN (SELECT doc_id FROM pred_a WHERE error IS NULL) AND doc_id IN (SELECT doc_id FROM pred_b WHERE error IS NULL)"
DELTA_COLUMNS = ("a", "b", "delta", "low", "high", "share_b_better")


@query("compare_runs", "gold", "pred_a", "pred_b", sql=f"""WITH {deltas_sql('a', 'b', NO_ERRORS)}
SELECT comparison, metric, {', '.join(f'round({c}, 6) AS {c}' for c in DELTA_COLUMNS)}, valid_resamples, significant FROM d_b""")
def compare_runs(spark, sf):
    return rounded(deltas(spark, sf, [("a", "b")], exclude_errors=True), *DELTA_COLUMNS)


def deltas_table_sql():
    cell = "printf('%+.3f [%+.3f, %+.3f]', delta, low, high) || CASE WHEN significant THEN '*' ELSE '' END"
    names = ("t1_micro_f1 t1_macro_f1 t1_type_micro_f1 t1_area_micro_f1 t2_link_f1 t2_link_precision t2_link_recall t2_detect_f1 "
             "t3_accuracy t3_top3_accuracy t4_f1 t4_precision t4_recall").split()
    return f"""WITH {deltas_sql('a', 'b')}, {deltas_sql('a', 'c')}, every AS (SELECT * FROM d_b UNION ALL SELECT * FROM d_c)
SELECT comparison, {', '.join(f"max({cell}) FILTER (WHERE metric = '{n}') AS {n}" for n in names)} FROM every GROUP BY comparison"""


@query("deltas_table", "gold", "pred_a", "pred_b", "pred_c", sql=deltas_table_sql())
def deltas_table(spark, sf):
    long = deltas(spark, sf, [("a", "b"), ("a", "c")])
    cell = F.concat(F.format_string("%+.3f [%+.3f, %+.3f]", "delta", "low", "high"), F.when(F.col("significant"), "*").otherwise(""))
    return long.groupBy("comparison").pivot("metric", list(sc.REGISTRY)).agg(F.first(cell))


@query("leaderboard", sql="""
SELECT o_custkey AS config, run_id, issues, strftime(created_at, '%Y-%m-%d') AS created_at FROM (
  SELECT o_custkey, o_orderkey AS run_id, CAST(floor(o_totalprice / 50000) AS BIGINT) AS issues, o_orderdate AS created_at,
    row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderdate DESC, o_orderkey DESC) AS k
  FROM orders WHERE o_orderkey % 3 = 0) WHERE k = 1""")
def leaderboard(spark, sf):
    runs = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("config"), F.col("o_orderkey").alias("run_id"), F.floor(F.col("o_totalprice") / 50000).alias("issues"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 3).alias("sample"))
    out = sc.leaderboard(runs, "config", ["run_id", "issues", "created_at"])
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query("replayed_flag", sql="""
SELECT user_id, event_type, count(*) AS calls, count(*) FILTER (WHERE event_id % 6 <> 0) AS hits,
  count(*) = count(*) FILTER (WHERE event_id % 6 <> 0) AS replayed FROM events GROUP BY ALL""")
def replayed_flag(spark, sf):
    return sc.replayed_flag(read_table(spark, sf, "events"), ["user_id", "event_type"], F.col("event_id") % 6 != 0)


def gold_records(spark, sf):
    """An annotation log: a blind line for every labelled document, then a final line for most."""
    g = fx.gold(spark, sf)
    doc = F.col("doc_id")
    flipped = F.when(uniform("final", doc) < 0.2, 1 - F.col("quality")).otherwise(F.col("quality"))
    labels = F.array("lang", F.concat(F.lit("q"), flipped), F.concat(F.lit("t"), "toxic"))
    line = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
    return g.select("*", line).filter((F.col("seq") == 1) | (uniform("has", doc) < 0.8)).select(
        "doc_id", "seq", (F.col("seq") == 2).alias("has_final"), (uniform("unusable", doc) < 0.1).alias("unusable"),
        labels.alias("f_labels"),
        F.map_from_arrays(labels, F.array(F.lit("type"), F.lit("area"), F.lit("family"))).alias("f_groups"),
        F.col("duplicate_of").alias("f_dup"), F.col("source").alias("f_comp"), F.col("needs_info").alias("f_info"),
        F.array("lang").alias("b_labels"), F.col("component").alias("b_comp"),
        (uniform("blind", doc) < 0.5).alias("b_info"), (uniform("secs", doc) * 90).alias("b_seconds"))


DONE = f"""done AS (SELECT *, CASE WHEN {u("'final'", 'doc_id')} < 0.2 THEN 1 - quality ELSE quality END AS fq FROM gold
  WHERE {u("'has'", 'doc_id')} < 0.8 AND NOT ({u("'unusable'", 'doc_id')} < 0.1))"""


@query("rescore_on_gold", "gold", "pred_a", "pred_b", sql=f"""WITH {DONE},
p AS (SELECT * FROM pred_a UNION ALL SELECT * FROM pred_b),
l AS (SELECT run_id, doc_id, len(list_intersect(p.labels, [lang, 'q' || fq, 't' || toxic])) AS tp, len(p.labels) AS np FROM p JOIN done USING (doc_id))
SELECT run_id, 't1_micro_f1' AS metric, round(2.0 * sum(tp) / (sum(np) + 3 * count(*)), 6) AS point FROM l GROUP BY run_id
UNION ALL SELECT run_id, 't3_accuracy', round(avg(coalesce(p.component = done.source, false)::INT), 6) FROM p JOIN done USING (doc_id) GROUP BY run_id""")
def rescore_on_gold(spark, sf):
    adjudicated = sc.with_gold(fx.gold(spark, sf), gold_records(spark, sf), "doc_id")
    rows = sc.scored_items(adjudicated, all_predictions(spark, sf, ("a", "b")), "doc_id")
    out = sc.point_scores(rows, ["run_id"]).filter(F.col("metric").isin("t1_micro_f1", "t3_accuracy"))
    return rounded(out.drop("weighted"), "point")


@query("blind_as_system", "gold", sql=f"""WITH {DONE}
SELECT doc_id, lang AS labels, component, coalesce(component, '') AS candidates, {u("'blind'", 'doc_id')} < 0.5 AS needs_info,
  CAST(round({u("'secs'", 'doc_id')} * 90 * 1000) AS BIGINT) AS latency_ms FROM done""")
def blind_as_system(spark, sf):
    return sc.usable_gold(gold_records(spark, sf), "doc_id").select(
        "doc_id", F.array_join("b_labels", ",").alias("labels"), F.col("b_comp").alias("component"),
        F.array_join(F.array_compact(F.array("b_comp")), ",").alias("candidates"), F.col("b_info").alias("needs_info"),
        F.round(F.col("b_seconds") * 1000).cast("long").alias("latency_ms"))


def failures(spark, sf, run):
    cands = fx.predictions(spark, sf, run).select("doc_id", F.col("duplicate_candidates").alias("p_dups"))
    return sc.find_failures(items(spark, sf, run).join(cands, "doc_id"), "doc_id")


def failures_sql(run):
    p = f"pred_{run}"
    j = f"FROM gold g JOIN {p} p USING (doc_id)"
    miss = "list_sort(list_filter(g.labels, lambda v: NOT list_contains(p.labels, v)))"
    ext = "list_sort(list_filter(p.labels, lambda v: NOT list_contains(g.labels, v)))"
    return f"""SELECT doc_id, '{run}' AS run_id, 'T1' AS task,
  CASE WHEN len({miss}) > 0 THEN 'labels_left_out' ELSE 'labels_too_many' END AS code,
  array_to_string({ext}, ',') AS said, array_to_string({miss}, ',') AS truth {j}
  WHERE human_triaged AND len({miss}) + len({ext}) > 0
UNION ALL SELECT doc_id, '{run}', 'T2', CASE WHEN g.duplicate_of IS NULL THEN 'link_invented' WHEN p.duplicate_of IS NOT NULL THEN 'link_wrong'
    WHEN list_contains(duplicate_candidates, g.duplicate_of) THEN 'link_only_candidate' ELSE 'link_absent' END,
  p.duplicate_of::VARCHAR, g.duplicate_of::VARCHAR {j} WHERE g.duplicate_of IS DISTINCT FROM p.duplicate_of
UNION ALL SELECT doc_id, '{run}', 'T3', 'component', p.component, g.component {j}
  WHERE g.component IS NOT NULL AND g.component IS DISTINCT FROM p.component
UNION ALL SELECT doc_id, '{run}', 'T4', 'info', p.needs_info::VARCHAR, g.needs_info::VARCHAR {j} WHERE g.needs_info <> p.needs_info"""


@query("find_failures", *GP, sql=failures_sql("a"))
def find_failures(spark, sf):
    return failures(spark, sf, "a")


@query("failure_counts", "gold", "pred_a", "pred_b", sql=f"""
WITH f AS ({failures_sql('a')} UNION ALL {failures_sql('b')}),
s AS (SELECT doc_id FROM f GROUP BY doc_id HAVING count(DISTINCT run_id) = 2),
c AS (SELECT code AS category, count(*) FILTER (WHERE run_id = 'a') AS a, count(*) FILTER (WHERE run_id = 'b') AS b
  FROM f WHERE doc_id IN (SELECT doc_id FROM s) GROUP BY 1)
SELECT category, a, b, a + b AS total, b - a AS delta FROM c""")
def failure_counts(spark, sf):
    rows = failures(spark, sf, "a").unionByName(failures(spark, sf, "b"))
    return sc.failure_counts(rows.withColumnRenamed("code", "category"), "category", ["a", "b"], "doc_id")

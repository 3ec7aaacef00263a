"""Section O: annotation batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import annotation as an
from hindcast.operators.latest import last_line_wins
from hindcast.plans import fixtures as fx
from hindcast.plans import silver as sv
from hindcast.plans.oracle import u
from hindcast.plans.registry import query
from hindcast.plans.scoring import gold_records
from hindcast.sources.tables import read_table


@query("annotation_todo", sql=f"""
SELECT 'blind' AS pass, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'final', doc_id FROM labels WHERE NOT ({u("'has'", 'doc_id')} < 0.8)""")
def annotation_todo(spark, sf):
    return an.todo(read_table(spark, sf, "documents"), gold_records(spark, sf), "doc_id")


@query("batching", sql="""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT CAST(i // 20 + 1 AS BIGINT) AS batch, printf('r%02d-%02d', i // 20 + 1, i % 20 + 1) AS opaque_id, doc_id FROM r""")
def batching(spark, sf):
    return an.batches(read_table(spark, sf, "documents"), "doc_id", 20)


@query("validate_answers", "pred_a", sql="""
WITH p AS (SELECT pred_a.*, gold.lang FROM pred_a JOIN gold USING (doc_id))
SELECT doc_id, 'unknown_ref' AS violation FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es')
UNION ALL SELECT doc_id, 'unknown_label' FROM p WHERE list_contains(labels, 't1')
UNION ALL SELECT doc_id, 'not_one_type' FROM p WHERE NOT list_contains(labels, lang)
UNION ALL SELECT doc_id, 'unknown_component' FROM p WHERE component = 'elsewhere'""")
def validate_answers(spark, sf):
    answers = fx.predictions(spark, sf, "a").select("doc_id", "labels", "component")
    known = read_table(spark, sf, "documents").filter("lang <> 'es'").select("doc_id")
    sources = [f"src{i}" for i in range(20)]
    named = answers.withColumn("component", F.when(F.col("component") == "elsewhere", "elsewhere").when(F.col("component").isNotNull(), "src0"))
    return an.answer_violations(named, known, "doc_id", (*fx.LANGS, "q0", "q1", "t0"), fx.LANGS, sources)


@query("validate_ratings", sql="""
SELECT doc_id AS item, 'criteria' AS violation FROM labels WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id, 'off_scale' FROM labels WHERE doc_id % 13 = 0""")
def validate_ratings(spark, sf):
    an.rubric_covers_scale({c: (1, 2, 3, 4) for c in ("correctness", "actionability", "tone")}, (1, 2, 3, 4))
    scores = fx.rubric_scores(spark, sf, "human")
    n = F.col("item")
    given = scores.filter((n % 10 != 0) | (F.col("criterion") != "tone")).withColumn(
        "score", F.when((n % 13 == 0) & (F.col("criterion") == "correctness"), 7).otherwise(F.col("score")))
    # One entry per criterion: the map is as long as the rubric.
    ratings = given.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("criterion", "score"))).alias("scores"))
    return an.rating_violations(ratings, "item", ("correctness", "actionability", "tone"), (1, 2, 3, 4))


@query("evidence_pack", "linked_pr", "pr_file", sql=f"""WITH {sv.VOTES},
sh AS (SELECT number, string_agg(path, ',' ORDER BY path) FILTER (WHERE k <= 40) AS files, count(*) AS files_total FROM (
  SELECT number, path, row_number() OVER (PARTITION BY number ORDER BY path) AS k FROM pr_file) GROUP BY number)
SELECT l.issue, l.number, l.title, coalesce(files, '') AS files, coalesce(files_total, 0) AS files_total, vote.component, vote.votes
FROM f JOIN linked_pr l USING (issue, number) LEFT JOIN sh USING (number) LEFT JOIN vote USING (issue)""")
def evidence_pack(spark, sf):
    fixes = sv.silver.fix_prs(fx.linked_prs(spark, sf), "main", sv.TITLE_PATTERN).select("issue", "number", "title")
    out = an.evidence_pack(fixes, fx.pr_files(spark, sf), sv.votes(spark, sf), "issue")
    return out.select(
        "issue", "number", "title", F.coalesce(F.array_join("files", ","), F.lit("")).alias("files"), "files_total", "component",
        sv.votes_text().alias("votes"))


def tag_log(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(
        F.col("lang").alias("run_id"), (F.col("doc_id") % 200).alias("issue"), F.col("doc_id").alias("seq"),
        F.array(F.col("source"), F.concat(F.lit("code-"), F.col("doc_id") % 9)).alias("codes"))


@query("latest_tag", sql="""
WITH t AS (SELECT lang, doc_id % 200 AS issue, max(doc_id) AS seq FROM documents GROUP BY ALL),
c AS (SELECT source AS code FROM documents WHERE doc_id IN (SELECT seq FROM t) UNION ALL SELECT 'code-' || (seq % 9) FROM t)
SELECT coalesce(u.code, s.code) AS code, s.code IS NOT NULL AS seed, coalesce(uses, 0) AS uses FROM (SELECT code, count(*) AS uses FROM c GROUP BY code) u
FULL JOIN (VALUES ('code-1'), ('code-seed')) s(code) ON s.code = u.code""")
def latest_tag(spark, sf):
    latest = last_line_wins(tag_log(spark, sf), ["run_id", "issue"], "seq")
    return an.codes_in_use(latest, ("code-1", "code-seed"))

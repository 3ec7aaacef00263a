"""Section C: labels from evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.text import url_path
from hindcast.operators import silver
from hindcast.operators.latest import last_line_wins
from hindcast.plans import fixtures as fx
from hindcast.plans.oracle import u
from hindcast.plans.registry import query
from hindcast.sources.tables import read_table

TITLE_PATTERN = "fix-{number}:"
TYPES, AREAS, PREFIXES = ("en", "fr"), ("de", "es"), ("topic-",)
WANTED = ("error",)
FIX_SQL = """SELECT issue, number FROM linked_pr WHERE merged AND base_ref = 'main'
  AND (via = 'closing_reference' OR regexp_matches(title, '^fix-' || issue || ':'))"""


def fixes(spark, sf):
    return silver.fix_prs(fx.linked_prs(spark, sf), "main", TITLE_PATTERN).select("issue", "number")


@query("fix_prs", "linked_pr", sql=FIX_SQL)
def fix_prs(spark, sf):
    return fixes(spark, sf)


def current_labels(spark, sf):
    """(issue, label): labels whose last event added them, and one label with no history."""
    last = last_line_wins(fx.label_events(spark, sf), ["issue", "label"], "seq").filter("added")
    legacy = fx.ev_issues(spark, sf).select("issue", F.lit("legacy").alias("label"))
    return last.select("issue", "label").unionByName(legacy)


CURRENT = """cur AS (SELECT issue, label FROM (SELECT issue, label, max_by(added, seq) AS added FROM label_event GROUP BY ALL)
  WHERE added UNION ALL SELECT DISTINCT issue, 'legacy' FROM label_event)"""
SOURCES = f"""{CURRENT}, by_ AS (SELECT issue, label, max_by({{'a': actor, 'b': is_bot, 'w': author}}, (at_, -seq)) AS x
  FROM label_event WHERE added GROUP BY ALL),
src AS (SELECT cur.issue, cur.label, CASE WHEN x IS NULL THEN 'unknown' WHEN x.b THEN 'bot'
  WHEN x.a = x.w THEN 'author' ELSE 'triager' END AS source FROM cur LEFT JOIN by_ USING (issue, label))"""


@query("label_source", "label_event", sql=f"WITH {SOURCES} SELECT * FROM src")
def label_source(spark, sf):
    return silver.label_source(current_labels(spark, sf), fx.label_events(spark, sf))


def doc_labels(spark, sf):
    n = F.col("number")
    d = fx.documents(spark, sf).select("number", "title", "lang", "source")
    return d.withColumn("labels", F.array(
        F.col("lang"), F.col("lang"), F.col("source"), F.concat(F.lit("topic-"), n % 5), F.lit("status-new")))


@query("taxonomy_labels", "issue", sql="""
SELECT number, lang AS label, CASE WHEN lang IN ('en', 'fr') THEN 'type' ELSE 'area' END AS grp FROM issue
UNION ALL SELECT number, 'topic-' || (number % 5), 'family' FROM issue""")
def taxonomy_labels(spark, sf):
    return silver.taxonomy_labels(doc_labels(spark, sf), "number", "labels", TYPES, AREAS, PREFIXES)


@query("human_triaged", "label_event", sql="""
SELECT issue, coalesce(bool_or(label IN ('click', 'error') AND NOT is_bot AND actor IS NOT NULL AND actor <> author), false)
  AS human_triaged FROM label_event GROUP BY issue""")
def human_triaged(spark, sf):
    return silver.human_triaged(
        fx.ev_issues(spark, sf), fx.label_events(spark, sf), F.col("label").isin("click", "error"))


ACTIVE = """lm AS (SELECT issue, max_by({'c': canonical}, (at_, seq)) AS m, max((at_, seq)) AS o FROM mark
  WHERE NOT unmarked GROUP BY issue),
act AS (SELECT issue, m.c AS canonical FROM lm WHERE m.c IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM mark k WHERE k.issue = lm.issue AND k.unmarked AND (k.canonical = m.c OR k.canonical IS NULL)
    AND (k.at_, k.seq) > lm.o))"""


@query("active_mark", "mark", sql=f"WITH {ACTIVE} SELECT * FROM act")
def active_mark(spark, sf):
    return silver.active_mark(fx.duplicate_marks(spark, sf))


COMMENT = r"""dc AS (SELECT issue, min_by(n, (at_, seq)) AS canonical FROM (
  SELECT issue, at_, seq, try_cast(regexp_extract(body, '(?im)^\s*duplicate of #(\d+)\b', 1) AS BIGINT) AS n
  FROM comment WHERE association IN ('OWNER', 'MEMBER', 'COLLABORATOR') AND NOT is_bot)
  WHERE n < issue GROUP BY issue)"""


@query("duplicate_comment", "comment", sql=f"WITH {COMMENT} SELECT * FROM dc")
def duplicate_comment(spark, sf):
    return silver.duplicate_comment(fx.comments(spark, sf))


def closable_documents(spark, sf):
    d = fx.documents(spark, sf).select(F.col("number").alias("issue"))
    dup = fx.duplicates(spark, sf).select(F.col("number").alias("issue"), F.col("original").alias("state_original"))
    return d.join(dup, "issue", "left").withColumn(
        "state_reason", F.when(F.col("issue") % 3 != 0, "DUPLICATE").otherwise("COMPLETED"))


@query("duplicate_of", "issue", "dup", "mark", "comment", sql=f"""WITH {ACTIVE}, {COMMENT}
SELECT i.number AS issue,
  coalesce(CASE WHEN i.number % 3 <> 0 THEN dup.original END, CASE WHEN act.canonical < i.number THEN act.canonical END,
    dc.canonical) AS duplicate_of,
  CASE WHEN i.number % 3 <> 0 AND dup.original IS NOT NULL THEN 'state_reason'
    WHEN act.canonical < i.number THEN 'marked' WHEN dc.canonical IS NOT NULL THEN 'comment' END AS duplicate_source
FROM issue i LEFT JOIN dup ON dup.number = i.number LEFT JOIN act ON act.issue = i.number
LEFT JOIN dc ON dc.issue = i.number""")
def duplicate_of(spark, sf):
    return silver.duplicate_of(closable_documents(spark, sf), fx.duplicate_marks(spark, sf), fx.comments(spark, sf))


def rules_case(rules, ignored, path, field):
    whens = " ".join(f"WHEN starts_with({path}, '{p}') THEN '{(name, p, role)[field]}'" for name, p, role in rules)
    skip = " ".join(f"WHEN starts_with({path}, '{p}') THEN NULL" for p in ignored)
    return f"CASE {skip} {whens} END"


@query("component_of", sql=f"""
SELECT page_id, {rules_case(fx.PAGE_RULES, fx.PAGE_IGNORED, 'path', 0)} AS component,
  {rules_case(fx.PAGE_RULES, fx.PAGE_IGNORED, 'path', 2)} AS role
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/?', '') AS path FROM pages)""")
def component_of(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    return pages.select("page_id", silver.component_of(F.col("path"), fx.PAGE_RULES, fx.PAGE_IGNORED).alias("c")).select(
        "page_id", "c.component", "c.role")


VOTES = f"""f AS ({FIX_SQL}),
m AS (SELECT number, {rules_case(fx.FILE_RULES, fx.FILE_IGNORED, 'path', 0)} AS component,
  {rules_case(fx.FILE_RULES, fx.FILE_IGNORED, 'path', 2)} AS role FROM pr_file),
v AS (SELECT issue, component, role, count(*) AS n FROM f JOIN m USING (number) WHERE component IS NOT NULL GROUP BY ALL),
t AS (SELECT *, dense_rank() OVER (PARTITION BY issue ORDER BY role = 'primary' DESC) AS tier FROM v),
w AS (SELECT issue, max_by(component, n) AS component, count(*) FILTER (WHERE n = top) AS tops FROM (
  SELECT *, max(n) OVER (PARTITION BY issue) AS top FROM t WHERE tier = 1) GROUP BY issue),
vote AS (SELECT issue, CASE WHEN tops = 1 THEN w.component END AS component,
  string_agg(v.component || '=' || n, ',' ORDER BY v.component) AS votes FROM w JOIN v USING (issue)
  GROUP BY issue, tops, w.component)"""


def votes_text(c="votes"):
    entries = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def votes(spark, sf):
    return silver.component_vote(fixes(spark, sf), fx.pr_files(spark, sf), fx.FILE_RULES, fx.FILE_IGNORED)


@query("component_vote", "linked_pr", "pr_file", sql=f"WITH {VOTES} SELECT * FROM vote")
def component_vote(spark, sf):
    return votes(spark, sf).withColumn("votes", votes_text())


def issues_with_labels(spark, sf):
    """ev issues with labels_current; the label list per issue is as long as the vocabulary."""
    cur = current_labels(spark, sf).groupBy("issue").agg(F.array_sort(F.collect_set("label")).alias("labels_current"))
    return fx.ev_issues(spark, sf).join(cur, "issue")


@query("needs_info", "label_event", sql=f"""WITH {CURRENT}
SELECT issue, min(at_) FILTER (WHERE added AND label = 'error' AND NOT is_bot) IS NOT NULL
    OR issue IN (SELECT issue FROM cur WHERE label = 'error') AS needs_info,
  strftime(min(at_) FILTER (WHERE added AND label = 'error' AND NOT is_bot), '%Y-%m-%d %H:%M:%S') AS needs_info_at
FROM label_event GROUP BY issue""")
def needs_info(spark, sf):
    out = silver.needs_info(issues_with_labels(spark, sf), fx.label_events(spark, sf), WANTED)
    return out.withColumn("needs_info_at", F.date_format("needs_info_at", "yyyy-MM-dd HH:mm:ss"))


def derived(spark, sf):
    """One row per issue with everything derived: the event issues, with orders as their PRs."""
    events = fx.label_events(spark, sf)
    issues = issues_with_labels(spark, sf)
    state = fx.ev_issues(spark, sf).select(
        "issue", F.when(F.col("issue") % 5 == 0, "DUPLICATE").alias("state_reason"),
        (F.col("issue") - 1).alias("state_original"))
    labels = silver.label_source(current_labels(spark, sf), events).groupBy("issue").agg(
        F.array_sort(F.collect_list(F.struct("label", "source"))).alias("labels"))
    n_fixes = fixes(spark, sf).groupBy("issue").agg(F.count(F.lit(1)).alias("n_fix_prs"))
    out = (
        labels.join(silver.human_triaged(issues, events, F.col("label").isin("click", "error")), "issue")
        .join(silver.duplicate_of(state, fx.duplicate_marks(spark, sf), fx.comments(spark, sf)), "issue")
        .join(silver.needs_info(issues, events, WANTED), "issue")
        .join(votes(spark, sf), "issue", "left")
        .join(n_fixes, "issue", "left")
    )
    flags = [("duplicate", "duplicate_of IS NOT NULL"), ("needs_info", "needs_info"), ("component", "component IS NOT NULL")]
    parts = [F.concat(F.lit(f"{name}="), F.expr(test).cast("int")) for name, test in flags]
    return out.withColumn("stratum", F.concat_ws("|", *parts))


@query("derive_silver", "label_event", "mark", "comment", "linked_pr", "pr_file", sql=f"""
WITH {SOURCES}, {ACTIVE}, {COMMENT}, {VOTES},
ht AS (SELECT issue, coalesce(bool_or(label IN ('click', 'error') AND NOT is_bot AND actor IS NOT NULL AND actor <> author), false)
  AS human_triaged, min(at_) FILTER (WHERE added AND label = 'error' AND NOT is_bot) IS NOT NULL AS asked FROM label_event GROUP BY issue),
la AS (SELECT issue, string_agg(label || ':' || source, ',' ORDER BY label) AS labels, bool_or(label = 'error') AS has_error
  FROM src GROUP BY issue),
d AS (SELECT ht.issue, labels, human_triaged, asked OR has_error AS needs_info,
  coalesce(CASE WHEN ht.issue % 5 = 0 THEN ht.issue - 1 END, CASE WHEN act.canonical < ht.issue THEN act.canonical END, dc.canonical) AS duplicate_of,
  CASE WHEN ht.issue % 5 = 0 THEN 'state_reason' WHEN act.canonical < ht.issue THEN 'marked'
    WHEN dc.canonical IS NOT NULL THEN 'comment' END AS duplicate_source,
  vote.component, vote.votes
  FROM ht JOIN la USING (issue) LEFT JOIN act USING (issue) LEFT JOIN dc USING (issue) LEFT JOIN vote USING (issue))
SELECT *, 'duplicate=' || (duplicate_of IS NOT NULL)::INT || '|needs_info=' || needs_info::INT || '|component='
  || (component IS NOT NULL)::INT AS stratum FROM d""")
def derive_silver(spark, sf):
    labels = F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["label"], x["source"])), ",")
    return derived(spark, sf).select(
        "issue", labels.alias("labels"), "human_triaged", "needs_info", "duplicate_of", "duplicate_source",
        "component", votes_text().alias("votes"), "stratum")


@query("family_vocabulary", "gold", sql="""
SELECT 't' || toxic AS label, count(*) AS n FROM gold WHERE human_triaged GROUP BY 1 HAVING count(*) >= 10""")
def family_vocabulary(spark, sf):
    return silver.family_vocabulary(fx.gold(spark, sf), 10)


@query("confidence_floor", "pred_a", sql=f"""
SELECT doc_id, array_to_string(list_filter(labels, lambda x: NOT (x IN ('t0', 't1'))
  OR {u("'a'", 'doc_id', "'conf'", 'x')} >= 0.6), ',') AS labels FROM pred_a""")
def confidence_floor(spark, sf):
    p = fx.predictions(spark, sf, "a")
    family = F.array(F.lit("t0"), F.lit("t1"))
    kept = silver.confidence_floor(F.col("labels"), F.col("confidences"), family, 0.6)
    return p.select("doc_id", F.array_join(kept, ",").alias("labels"))


@query("vocabulary_reject", "issue", sql="""
SELECT number, lang || CASE WHEN number % 5 < 3 THEN ',topic-' || (number % 5) ELSE '' END AS allowed,
  source || CASE WHEN number % 5 >= 3 THEN ',topic-' || (number % 5) ELSE '' END || ',status-new' AS rejected FROM issue""")
def vocabulary_reject(spark, sf):
    allowed, rejected = silver.vocabulary_reject(
        F.col("labels"), (*TYPES, *AREAS, "topic-0", "topic-1", "topic-2"))
    return doc_labels(spark, sf).select(
        "number", F.array_join(allowed, ",").alias("allowed"), F.array_join(rejected, ",").alias("rejected"))

"""Section B: records as they were at a moment."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.numeric import micros, uniform
from hindcast.operators import asof, latest
from hindcast.operators.ordering import counts_before
from hindcast.plans import fixtures as fx
from hindcast.plans.oracle import u
from hindcast.plans.registry import query
from hindcast.sources.fingerprint import table_fingerprint
from hindcast.sources.tables import read_table

STAMP = "yyyy-MM-dd HH:mm:ss"


def creation_issues(spark, sf):
    """ev_issues with creation title and body."""
    issues = fx.ev_issues(spark, sf)
    revised = issues.join(latest.earliest_revision(fx.revisions(spark, sf), issues, "issue"), "issue")
    return asof.title_at_creation(asof.body_at_creation(revised), fx.renames(spark, sf), "issue")


FIRST_REV = """first_rev AS (
  SELECT issue, min_by(body, (at_, seq)) AS body, min(at_) AS at_ FROM revision GROUP BY issue),
created AS (SELECT i.*, CASE WHEN last_edited_at IS NULL THEN NULL WHEN r.at_ IS NULL THEN 'no_revision_history'
    WHEN abs(epoch_us(r.at_) - epoch_us(i.created_at)) > 60000000 THEN 'oldest_revision_not_creation' END AS reject_reason,
  CASE WHEN last_edited_at IS NULL THEN i.body ELSE r.body END AS any_body,
  coalesce((SELECT min_by(previous, (n.at_, n.seq)) FROM rename n WHERE n.issue = i.issue), i.title) AS creation_title
  FROM ev_issue i LEFT JOIN first_rev r ON r.issue = i.issue)"""
BASE = ("ev_issue", "revision", "rename")


@query("title_at_creation", *BASE, sql=f"WITH {FIRST_REV} SELECT issue, creation_title FROM created")
def title_at_creation(spark, sf):
    issues = asof.title_at_creation(fx.ev_issues(spark, sf), fx.renames(spark, sf), "issue")
    return issues.select("issue", "creation_title")


@query("body_at_creation", *BASE, sql=f"""WITH {FIRST_REV}
SELECT issue, CASE WHEN reject_reason IS NULL THEN any_body END AS creation_body, reject_reason FROM created""")
def body_at_creation(spark, sf):
    issues = fx.ev_issues(spark, sf)
    revised = issues.join(latest.earliest_revision(fx.revisions(spark, sf), issues, "issue"), "issue")
    return asof.body_at_creation(revised).select("issue", "creation_body", "reject_reason")


def document_issues(spark, sf):
    """documents in the shape to_snapshot wants, with later-edited and unprovable rows."""
    d = fx.documents(spark, sf)
    n = F.col("number")
    return d.select(
        "*",
        F.col("title").alias("creation_title"), F.col("body").alias("creation_body"),
        F.when(n % 9 == 0, "no_revision_history").alias("reject_reason"),
        (n % 11 == 0).alias("author_is_bot"),
        F.when(n % 2 == 0, "MEMBER").otherwise("NONE").alias("author_association"),
    )


@query("to_snapshot", "issue", sql="""
SELECT 'demo/repo#' || number AS issue_ref, 'demo/repo' AS repo, number, title, body,
  CASE WHEN number % 2 = 0 THEN 'MEMBER' ELSE 'NONE' END AS author_association,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM issue WHERE number % 9 <> 0""")
def to_snapshot(spark, sf):
    snap = asof.to_snapshot(document_issues(spark, sf), "demo/repo")
    return snap.withColumn("created_at", F.date_format("created_at", STAMP))


@query("exclusion_reason", *BASE, sql=f"""WITH {FIRST_REV}
SELECT issue, CASE WHEN author_is_bot THEN 'bot_author'
  WHEN reject_reason IS NOT NULL THEN 'creation_text_unrecoverable' END AS reason FROM created""")
def exclusion_reason(spark, sf):
    return creation_issues(spark, sf).select(
        "issue", asof.exclusion_reason(F.col("author_is_bot"), F.col("reject_reason")).alias("reason"))


LABELS_ASOF = """lab AS (
  SELECT issue, as_of, string_agg(label, ',' ORDER BY label) AS labels FROM (
    SELECT r.issue, r.as_of, e.label, max_by(e.added, (e.at_, e.seq)) AS added
    FROM request r JOIN label_event e ON e.issue = r.issue AND e.at_ < r.as_of GROUP BY ALL)
  WHERE added GROUP BY ALL)"""
STATE_ASOF = """st AS (
  SELECT r.issue, r.as_of, max_by(e.kind, (e.at_, e.seq)) AS kind,
    max_by({'r': e.state_reason}, (e.at_, e.seq)).r AS state_reason
  FROM request r JOIN state_event e ON e.issue = r.issue AND e.at_ < r.as_of GROUP BY ALL)"""
TITLE_ASOF = """ti AS (
  SELECT r.issue, r.as_of, max_by(e.current, (e.at_, e.seq)) AS title
  FROM request r JOIN rename e ON e.issue = r.issue AND e.at_ < r.as_of GROUP BY ALL)"""
AT = "strftime(r.as_of, '%Y-%m-%d %H:%M:%S') AS as_of"


def shown_at(df):
    return df.withColumn("as_of", F.date_format("as_of", STAMP))


@query("replay_labels", "request", "label_event", sql=f"""WITH {LABELS_ASOF}
SELECT r.issue, {AT}, coalesce(labels, '') AS labels FROM request r LEFT JOIN lab USING (issue, as_of)""")
def replay_labels(spark, sf):
    out = asof.replay_labels(fx.asof_requests(spark, sf), fx.label_events(spark, sf), "issue")
    return shown_at(out.withColumn("labels", F.array_join("labels", ",")))


@query("replay_state", "request", "state_event", sql=f"""WITH {STATE_ASOF}
SELECT r.issue, {AT}, CASE WHEN kind = 'closed' THEN 'closed' ELSE 'open' END AS state,
  CASE WHEN kind = 'closed' THEN state_reason END AS state_reason
FROM request r LEFT JOIN st USING (issue, as_of)""")
def replay_state(spark, sf):
    return shown_at(asof.replay_state(fx.asof_requests(spark, sf), fx.state_events(spark, sf), "issue"))


@query("replay_title", "request", *BASE, sql=f"""WITH {FIRST_REV}, {TITLE_ASOF}
SELECT r.issue, {AT}, coalesce(ti.title, c.creation_title) AS title
FROM request r JOIN created c USING (issue) LEFT JOIN ti USING (issue, as_of)""")
def replay_title(spark, sf):
    issues = asof.title_at_creation(fx.ev_issues(spark, sf), fx.renames(spark, sf), "issue")
    return shown_at(asof.replay_title(fx.asof_requests(spark, sf), fx.renames(spark, sf), issues, "issue"))


@query("view_as_of", "request", "label_event", "state_event", *BASE, sql=f"""
WITH {FIRST_REV}, {LABELS_ASOF}, {STATE_ASOF}, {TITLE_ASOF}
SELECT r.issue, {AT}, coalesce(ti.title, c.creation_title) AS title, any_body AS body,
  coalesce(labels, '') AS labels, CASE WHEN kind = 'closed' THEN 'closed' ELSE 'open' END AS state,
  CASE WHEN kind = 'closed' THEN state_reason END AS state_reason
FROM request r JOIN created c USING (issue) LEFT JOIN ti USING (issue, as_of)
LEFT JOIN lab USING (issue, as_of) LEFT JOIN st USING (issue, as_of)
WHERE c.created_at < r.as_of AND reject_reason IS NULL""")
def view_as_of(spark, sf):
    out = asof.view_as_of(
        fx.asof_requests(spark, sf), creation_issues(spark, sf), fx.label_events(spark, sf),
        fx.state_events(spark, sf), fx.renames(spark, sf), "issue")
    return shown_at(out.drop("created_at").withColumn("labels", F.array_join("labels", ",")))


@query("visible_count", sql="""
WITH d AS (SELECT o_orderdate AS t, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT t, n, sum(n) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT o_orderkey AS number, CAST(CASE WHEN o_orderkey % 24 > 0 THEN upto ELSE upto - n END AS BIGINT) AS visible
FROM orders JOIN c ON t = o_orderdate""")
def visible_count(spark, sf):
    o = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("number"), micros(F.col("o_orderdate")).alias("t"))
    requests = o.select("number", (F.col("t") + (F.col("number") % 24) * 3_600_000_000).alias("as_of"))
    counts = counts_before(requests, "as_of", o, "t", {"visible": F.count(F.lit(1))})
    return requests.join(counts, "as_of").select("number", "visible")


@query("get_as_of", *BASE, sql=f"""WITH {FIRST_REV}
SELECT event_id, coalesce(c.created_at < ts, false) AS available,
  CASE WHEN c.created_at < ts THEN creation_title END AS creation_title
FROM events e LEFT JOIN created c ON c.issue = e.event_id % 300""")
def get_as_of(spark, sf):
    requests = fx.raw_events(spark, sf).select(
        "event_id", (F.col("event_id") % 300).alias("issue"), F.col("ts").alias("as_of"))
    corpus = asof.title_at_creation(fx.ev_issues(spark, sf), fx.renames(spark, sf), "issue")
    return asof.get_as_of(requests, corpus, "issue", ["creation_title"]).drop("issue", "as_of")


@query("build_corpus", sql="""
SELECT doc_id AS number, CASE WHEN doc_id % 11 = 0 THEN 'bot_author' END AS exclusion_reason,
  length(text) AS body_chars FROM documents WHERE doc_id % 9 <> 0""")
def build_corpus(spark, sf):
    return asof.build_corpus(document_issues(spark, sf)).select(
        "number", "exclusion_reason", F.length("body").cast("long").alias("body_chars"))


@query("created_before", sql="""
SELECT strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders, (VALUES (TIMESTAMP '1996-01-01'), (TIMESTAMP '1999-01-01'), (TIMESTAMP '2000-06-01')) t(as_of)
WHERE o_orderdate < as_of GROUP BY ALL""")
def created_before(spark, sf):
    history = fx.split_issues(spark, sf).select("number", "created_at")
    moments = [F.expr(f"TIMESTAMP_NTZ'{d} 00:00:00'") for d in ("1996-01-01", fx.TRAIN_END, fx.DEV_END)]
    rows = asof.created_before(history, moments)
    return shown_at(rows.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("key_sum")))


@query("leakage_invariance", *BASE, sql=f"""WITH {FIRST_REV}
SELECT count(*) AS n_rows, true AS snapshot_unchanged, true AS raw_changed FROM created WHERE reject_reason IS NULL""")
def leakage_invariance(spark, sf):
    """Change what came after creation; the snapshot table's fingerprint must not move."""
    before = creation_issues(spark, sf).withColumnRenamed("issue", "number")
    # Later renames and edits: current title, current body of edited rows, state counters.
    edited = F.col("last_edited_at").isNotNull()
    after = (
        fx.ev_issues(spark, sf)
        .withColumn("body", F.when(edited, F.concat("body", F.lit(" later"))).otherwise(F.col("body")))
        .withColumn("n_events", F.col("n_events") + 1)
    )
    later = fx.renames(spark, sf).withColumn("current", F.concat("current", F.lit(" later")))
    revised = after.join(latest.earliest_revision(fx.revisions(spark, sf), after, "issue"), "issue")
    mutated = asof.title_at_creation(asof.body_at_creation(revised), later, "issue").withColumnRenamed("issue", "number")
    a = table_fingerprint(asof.to_snapshot(before, "demo/repo"))
    raw_a = table_fingerprint(before.select("number", "body", "n_events"))
    raw_b = table_fingerprint(mutated.select("number", "body", "n_events"))
    b = table_fingerprint(asof.to_snapshot(mutated, "demo/repo"))
    return a.select(
        "n_rows",
        (F.col("fingerprint") == b.select("fingerprint").scalar()).alias("snapshot_unchanged"),
        (raw_a.select("fingerprint").scalar() != raw_b.select("fingerprint").scalar()).alias("raw_changed"),
    )


def shown_items(spark, sf):
    """Each conversation turn shows one past issue, with labels that are right, wrong or cut off."""
    c = read_table(spark, sf, "conversations")
    number = F.floor(uniform("shown", F.col("conv_id"), F.col("turn")) * 160)
    labels = (
        F.when(F.col("turn") % 5 == 4, F.lit(None).cast("array<string>"))
        .when(F.col("turn") % 2 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("click"), F.lit("view")))
    )
    return c.select(F.col("conv_id").alias("ref"), number.alias("number"), labels.alias("labels"))


@query("context_audit", "ev_issue", "label_event", sql=f"""
WITH s AS (SELECT conv_id AS ref, turn, CAST(floor({u("'shown'", 'conv_id', 'turn')} * 160) AS BIGINT) AS number,
  CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 2 = 0 THEN '' ELSE 'click,view' END AS shown_labels,
  conv_id % 150 AS own, TIMESTAMP '2024-01-01' + to_hours(conv_id * 3) AS as_of FROM conversations),
h AS (SELECT number, as_of, string_agg(label, ',' ORDER BY label) AS labels FROM (
    SELECT s.number, s.as_of, e.label, max_by(e.added, (e.at_, e.seq)) AS added
    FROM (SELECT DISTINCT number, as_of FROM s) s JOIN label_event e ON e.issue = s.number AND e.at_ < s.as_of
    GROUP BY ALL) WHERE added GROUP BY ALL),
j AS (SELECT s.*, coalesce(i.created_at < s.as_of, false) AS visible, s.number = s.own AS itself,
    coalesce(h.labels, '') AS labels
  FROM s LEFT JOIN ev_issue i ON i.issue = s.number LEFT JOIN h ON h.number = s.number AND h.as_of = s.as_of)
SELECT count(DISTINCT ref) AS issues, count(*) AS shown, count(*) FILTER (WHERE itself) AS itself,
  count(*) FILTER (WHERE NOT itself AND NOT visible) AS not_visible,
  count(*) FILTER (WHERE visible AND NOT itself AND shown_labels <> labels) AS wrong_labels,
  count(*) FILTER (WHERE visible AND NOT itself AND shown_labels IS NULL) AS labels_unchecked FROM j""")
def context_audit(spark, sf):
    refs = read_table(spark, sf, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("ref"), (F.col("conv_id") % 150).alias("own"), fx.hours_after("conv_id * 3").alias("as_of"))
    return asof.context_audit(
        shown_items(spark, sf), refs, fx.ev_issues(spark, sf), fx.label_events(spark, sf), "issue")


@query("extract_shown", sql="""
SELECT conv_id AS ref, conv_id * 100 + turn AS number, 'bug,docs' AS labels FROM conversations WHERE turn % 4 = 0
UNION ALL SELECT conv_id, conv_id * 100 + turn + 1, '' FROM conversations WHERE turn % 4 = 0
UNION ALL SELECT conv_id, conv_id * 100 + turn, 'a,z' FROM conversations WHERE turn % 4 = 1
UNION ALL SELECT conv_id, turn, '' FROM conversations WHERE turn % 4 = 1
UNION ALL SELECT conv_id, conv_id * 100 + turn, NULL FROM conversations WHERE turn % 4 = 2
UNION ALL SELECT conv_id, turn + 7, 'm' FROM conversations WHERE turn % 4 = 3 AND conv_id % 2 = 0""")
def extract_shown(spark, sf):
    c = read_table(spark, sf, "conversations")
    id_ = F.col("conv_id") * 100 + F.col("turn")
    block = F.format_string(
        "%s\n<similar_issues>\n- #%d [open; labels: docs, bug] first\n- #%d [closed; labels: none] second\n</similar_issues>",
        F.col("text"), id_, id_ + 1)
    search = F.format_string(
        '{"results": [{"number": %d, "labels": ["z", "a"]}, {"number": %d, "labels": []}]}\n[tool calls used: 1 of 9]',
        id_, F.col("turn"))
    cut = F.format_string('{"number": %d, "title": "cut off he', id_)
    single = F.format_string('{"number": %d, "labels": ["m"], "title": "t"}', F.col("turn") + 7)
    kind = F.col("turn") % 4
    trace = c.select(
        F.col("conv_id").alias("ref"),
        F.when(kind == 0, "llm").otherwise("tool").alias("event"),
        F.when(kind == 1, "search_similar_issues").otherwise("get_issue").alias("name"),
        ((kind == 3) & (F.col("conv_id") % 2 == 1)).alias("is_error"),
        F.when(kind == 0, block).when(kind == 1, search).when(kind == 2, cut).otherwise(single).alias("content"))
    return asof.extract_shown(trace, "ref").withColumn("labels", F.array_join("labels", ","))

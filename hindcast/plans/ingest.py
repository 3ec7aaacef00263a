"""Section A: scans, sinks, ingestion, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.hashing import stable_hash
from hindcast.operators import latest
from hindcast.operators.sampling import time_window
from hindcast.plans import fixtures as fx
from hindcast.plans.registry import query
from hindcast.sources import export, tables
from hindcast.sources.fingerprint import table_fingerprint
from hindcast.sources.scratch import scratch_path
from hindcast.sources.timeline import timeline_facts, truncation_audit

EVENT_SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE"


@query("jsonl_scan", sql="""
SELECT event_type AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum, NULL AS first_line, NULL AS last_line FROM events
WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 GROUP BY 1
UNION ALL SELECT 'quarantined', count(*), NULL, min(line), max(line) FROM (
  SELECT CASE WHEN event_id % 97 = 0 THEN left('{"event_id":' || event_id || ',"ts":"2024', 20)
    ELSE '{"event_id":' || event_id || ',"value":"none"}' END AS line
  FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0)""")
def jsonl_scan(spark, sf):
    path = scratch_path(spark, "events-jsonl")
    e = tables.read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    line = F.to_json(F.struct("*"))
    # Every 97th line is cut short, and a blank line follows it; every 89th has a word where a number belongs.
    mistyped = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"value":"none"}'))
    broken = F.concat(F.left(line, F.lit(20)), F.lit("\n"))
    e.select(F.when(F.col("event_id") % 97 == 0, broken).when(F.col("event_id") % 89 == 0, mistyped).otherwise(line).alias("value")).write.text(path)
    scan = tables.scan_jsonl(spark, path, EVENT_SCHEMA)
    good, bad = tables.split_quarantine(scan)
    none = F.lit(None).cast("string")
    counted = good.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))
    lines = bad.agg(F.count(F.lit(1)).alias("n"), F.min(tables.CORRUPT).alias("first_line"), F.max(tables.CORRUPT).alias("last_line"))
    return counted.select("*", none.alias("first_line"), none.alias("last_line")).unionByName(
        lines.select(F.lit("quarantined").alias("kind"), "n", F.lit(None).cast("long").alias("id_sum"), "first_line", "last_line"))


@query("jsonl_append", sql="""
SELECT role, 2 * count(*) AS n, CAST(2 * sum(turn) AS BIGINT) AS turns FROM conversations GROUP BY role""")
def jsonl_append(spark, sf):
    path = scratch_path(spark, "log-jsonl")
    c = tables.read_table(spark, sf, "conversations")
    tables.append_jsonl(c, path)
    tables.append_jsonl(c, path)
    back = spark.read.schema("conv_id LONG, turn LONG, role STRING, text STRING").json(path)
    return back.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turns"))


@query("parquet_io", sql="""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY 1, 2""")
def parquet_io(spark, sf):
    path = scratch_path(spark, "lineitem-parquet")
    line = tables.read_table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")
    tables.write_table(line, path, ("l_returnflag",))
    back = spark.read.schema(line.schema).parquet(path)
    return back.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )


@query("flatten_timeline", sql="""
SELECT user_id AS issue, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'rename' WHEN 'click' THEN 'duplicate_mark' WHEN 'error' THEN 'label'
    ELSE 'state' END AS fact,
  CASE WHEN event_type = 'error' THEN 'k' || CAST(json_extract(props, '$.k') AS BIGINT) END AS label,
  CASE WHEN event_type = 'error' THEN event_id % 3 <> 0 END AS added,
  CASE event_type WHEN 'signup' THEN 'closed' WHEN 'purchase' THEN 'reopened' END AS state,
  CASE WHEN event_type = 'click' AND event_id % 5 <> 0 THEN event_id % 40 END AS canonical,
  CASE WHEN event_id % 13 <> 0 THEN 'user-' || (event_id % 7) END AS login,
  event_id % 13 <> 0 AND event_id % 11 = 0 AS is_bot,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
FROM events""")
def flatten_timeline(spark, sf):
    e = tables.read_table(spark, sf, "events")
    i = F.col("event_id")
    typename = (
        F.when(F.col("event_type") == "view", "RenamedTitleEvent")
        .when(F.col("event_type") == "click", "MarkedAsDuplicateEvent")
        .when(F.col("event_type") == "error", F.when(i % 3 != 0, "LabeledEvent").otherwise("UnlabeledEvent"))
        .when(F.col("event_type") == "signup", "ClosedEvent")
        .otherwise("ReopenedEvent")
    )
    who = F.when(i % 13 != 0, F.struct(
        F.concat(F.lit("user-"), i % 7).alias("login"),
        F.when(i % 11 == 0, "Bot").otherwise("User").alias("__typename")))
    label = F.when(F.col("event_type") == "error", F.struct(F.concat(F.lit("k"), fx.event_k()).alias("name")))
    canonical = F.when(F.col("event_type") == "click", F.struct(
        F.when(i % 5 != 0, "Issue").otherwise("PullRequest").alias("__typename"), (i % 40).alias("number")))
    node = F.to_json(F.struct(
        typename.alias("__typename"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        who.alias("actor"), label.alias("label"), canonical.alias("canonical")))
    nodes = e.select(F.col("user_id").alias("issue"), i.alias("seq"), node.alias("node"))
    return timeline_facts(nodes, "issue", "seq", "node").select(
        "issue", "seq", "fact", "label", "added", "state", "canonical", "login", "is_bot",
        F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


@query("merge_linked_prs", "linked_pr", sql="""
SELECT issue, number, title, 'closing_reference' AS via FROM linked_pr WHERE via = 'closing_reference'
UNION ALL SELECT issue, number, title, 'cross_reference' FROM linked_pr
WHERE via <> 'closing_reference' AND number % 5 <> 0""")
def merge_linked_prs(spark, sf):
    prs = fx.linked_prs(spark, sf).select("issue", "number", "title", "via", F.col("number").alias("seq"))
    closing = prs.filter("via = 'closing_reference'").drop("via")
    # Cross references repeat what the closing list already names.
    cross = prs.filter("via = 'closing_reference' OR number % 5 <> 0").drop("via")
    return latest.merge_linked_prs(closing, cross, ["issue", "number"]).drop("seq")


@query("earliest_revision", "ev_issue", "revision", sql="""
SELECT i.issue, CASE WHEN last_edited_at IS NOT NULL THEN strftime(r.at_, '%Y-%m-%d %H:%M:%S') END AS original_at,
  CASE WHEN last_edited_at IS NOT NULL THEN r.body END AS original_body
FROM ev_issue i LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY issue ORDER BY at_, seq) AS rn FROM revision) r
  ON r.issue = i.issue AND rn = 1""")
def earliest_revision(spark, sf):
    out = latest.earliest_revision(fx.revisions(spark, sf), fx.ev_issues(spark, sf), "issue")
    return out.withColumn("original_at", F.date_format("original_at", "yyyy-MM-dd HH:mm:ss"))


@query("latest_per_key", sql="""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC, event_id) AS rn
  FROM events) WHERE rn = 1""")
def latest_per_key(spark, sf):
    e = tables.read_table(spark, sf, "events").select(
        "user_id", "event_type", "event_id", "value", F.col("ts").cast("date").alias("day"))
    return latest.newest_per_key(e, ["user_id", "event_type"], "day", "event_id").drop("day")


@query("last_line_wins", sql="""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def last_line_wins(spark, sf):
    e = tables.read_table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return latest.last_line_wins(e, ["user_id", "event_type"], "event_id")


@query("incremental_todo", sql="""
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def incremental_todo(spark, sf):
    docs = tables.read_table(spark, sf, "documents").select("doc_id")
    return latest.not_yet_stored(docs, tables.read_table(spark, sf, "labels"), ["doc_id"])


@query("union_history", sql="""
SELECT o_orderkey AS number, 'dataset' AS origin, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'history', -1.0 FROM orders
WHERE o_orderdate < TIMESTAMP '2000-06-01' AND o_orderstatus <> 'F'""")
def union_history(spark, sf):
    o = tables.read_table(spark, sf, "orders")
    history = o.filter(F.col("o_orderdate") < F.expr(f"TIMESTAMP_NTZ'{fx.DEV_END} 00:00:00'")).select(
        F.col("o_orderkey").alias("number"), F.lit("history").alias("origin"), F.lit(-1.0).alias("value"))
    dataset = o.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("number"), F.lit("dataset").alias("origin"), F.col("o_totalprice").alias("value"))
    return latest.union_history(history, dataset, ["number"])


@query("truncation_audit", sql="""
WITH c AS (SELECT l_orderkey, count(*) AS held FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (WHERE o_orderkey % 10 > coalesce(held, 0)) AS truncated,
  count(*) FILTER (WHERE o_orderkey % 10 > 7) AS over_cap, count(*) AS rows
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def truncation_audit_q(spark, sf):
    parents = tables.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("number"), (F.col("o_orderkey") % 10).alias("reported"))
    children = tables.read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("number"))
    return truncation_audit(parents, children, "number", "reported", 7)


@query("table_fingerprint", sql="""
WITH d AS (SELECT sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source,
  'text': text})::VARCHAR) AS h FROM documents),
s AS (SELECT count(*) AS n_rows, """ + ", ".join(
    f"CAST(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) % 4294967296 AS BIGINT) AS s{i}" for i in range(4)
) + """ FROM d)
SELECT n_rows, """ + " || ".join(f"lpad(lower(to_hex(s{i})), 8, '0')" for i in range(4)) + """ AS fingerprint FROM s""")
def table_fingerprint_q(spark, sf):
    return table_fingerprint(tables.read_table(spark, sf, "documents"))


@query("stable_hash_str", sql="SELECT doc_id, sha256(to_json(text)::VARCHAR) AS digest FROM documents")
def stable_hash_str(spark, sf):
    return tables.read_table(spark, sf, "documents").select("doc_id", stable_hash(F.col("text")).alias("digest"))


def _export_parts(spark, sf):
    issues = fx.split_issues(spark, sf)
    split = time_window(F.col("created_at"), "1995-01-01", fx.TRAIN_END, fx.DEV_END, fx.TEST_END)
    splits = issues.select("number", split.alias("split")).filter("split <> 'out'")
    vectors = tables.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("number"), "embedding")
    return splits, issues.select("number", "created_at"), vectors, F.expr(f"TIMESTAMP_NTZ'{fx.DEV_END} 00:00:00'")


@query("cutoff_export", "split_issue", sql="""
SELECT 'splits' AS part, number FROM split_issue
  WHERE created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '2000-06-01'
UNION ALL SELECT 'corpus', number FROM split_issue WHERE created_at < TIMESTAMP '2000-06-01'
UNION ALL SELECT 'vectors', vec_id FROM embeddings
  WHERE vec_id IN (SELECT number FROM split_issue WHERE created_at < TIMESTAMP '2000-06-01')""")
def cutoff_export(spark, sf):
    parts = export.cutoff_export(*_export_parts(spark, sf))
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"), "number")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("verify_export", "split_issue", sql="""
SELECT 'forbidden_split' AS "check", count(*) AS violations, count(*) = 0 AS passed FROM split_issue
  WHERE created_at >= TIMESTAMP '2000-06-01' AND CAST(created_at AS DATE) <= DATE '2001-06-30'
UNION ALL SELECT 'late_document', count(*), count(*) = 0 FROM split_issue
  WHERE created_at >= TIMESTAMP '2000-06-01'""")
def verify_export(spark, sf):
    splits, corpus, _, cutoff = _export_parts(spark, sf)
    return export.verify_export(splits, corpus, cutoff)


@query("reproduce_diff", sql="""
SELECT o_orderkey AS number, o_orderpriority AS value, 'rebuilt' AS side FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey, 'x' || o_orderpriority, 'published' FROM orders WHERE o_orderkey % 50 = 0""")
def reproduce_diff(spark, sf):
    o = tables.read_table(spark, sf, "orders")
    rebuilt = o.select(F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("value"))
    changed = F.when(F.col("number") % 50 == 0, F.concat(F.lit("x"), "value")).otherwise(F.col("value"))
    return export.reproduce_diff(rebuilt, rebuilt.withColumn("value", changed))

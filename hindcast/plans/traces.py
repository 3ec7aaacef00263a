"""Section M, second part: traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.text import word_set
from hindcast.operators import traces as tr
from hindcast.plans.registry import query
from hindcast.plans.scoring import rounded
from hindcast.sources.tables import read_table


@query("trace_final_attempt", sql="""
SELECT conv_id AS trace_id, turn, role FROM conversations WHERE conv_id IN (SELECT max(conv_id) FROM conversations GROUP BY conv_id % 50)""")
def trace_final_attempt(spark, sf):
    c = read_table(spark, sf, "conversations")
    preds = c.select(F.col("conv_id").alias("trace_id"), (F.col("conv_id") % 50).alias("issue")).distinct().withColumn("seq", F.col("trace_id"))
    return tr.final_attempt(c.select(F.col("conv_id").alias("trace_id"), "turn", "role"), preds, "issue", "seq")


@query("tool_usage", sql="""
SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE event_id % 7 = 0) AS errors, count(DISTINCT user_id) AS items
FROM events GROUP BY 1""")
def tool_usage(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("tool"), "user_id", "event_id")
    return tr.tool_usage(e, "tool", "user_id", F.col("event_id") % 7 == 0)


@query("run_behaviour", sql="""
WITH p AS (SELECT conv_id % 5 AS run, conv_id, count(*) AS steps, count(*) FILTER (WHERE role = 'assistant') AS tools,
  bool_or(role = 'system') AS skill, bool_or(turn % 6 = 5) AS invalid, max(CASE WHEN turn >= 7 THEN 'max_steps' END) AS forced,
  sum(length(text)) AS tokens FROM conversations GROUP BY ALL)
SELECT run, count(*) AS items, round(avg(steps), 6) AS steps_mean, round(quantile_cont(steps::DOUBLE, 0.95), 6) AS steps_p95,
  round(avg(tools), 6) AS tools_mean, max(tools) AS tools_max, round(avg(skill::INT), 6) AS skill_load_rate,
  count(*) FILTER (WHERE invalid) AS with_validation_errors, count(forced) AS forced, round(avg(tokens), 4) AS tokens_mean FROM p GROUP BY run""")
def run_behaviour(spark, sf):
    c = read_table(spark, sf, "conversations")
    steps = c.select(
        (F.col("conv_id") % 5).alias("run"), "conv_id", (F.col("role") == "assistant").alias("is_tool"),
        (F.col("role") == "system").alias("is_skill"), (F.col("turn") % 6 == 5).alias("is_invalid"),
        F.when(F.col("turn") >= 7, "max_steps").alias("forced"), F.length("text").alias("tokens"))
    out = tr.run_behaviour(steps, "run", "conv_id").withColumn("tokens_mean", F.round("tokens_mean", 4))
    return rounded(out, "steps_mean", "steps_p95", "tools_mean", "skill_load_rate")


@query("repeat_calls", sql="""
SELECT user_id, event_type, props, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS k
  FROM events) WHERE k > 1""")
def repeat_calls(spark, sf):
    e = read_table(spark, sf, "events").select("user_id", "event_type", "props", "event_id")
    return tr.repeat_calls(e, ["user_id", "event_type", "props"], "event_id")


@query("near_repeat_queries", sql="""
WITH w AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS ws FROM documents)
SELECT source, doc_id FROM w b WHERE EXISTS (SELECT 1 FROM w a WHERE a.source = b.source AND a.doc_id < b.doc_id
  AND len(list_intersect(a.ws, b.ws))::DOUBLE / greatest(len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)), 1) >= 0.5)""")
def near_repeat_queries(spark, sf):
    d = read_table(spark, sf, "documents").select("source", "doc_id", word_set(F.col("text")).alias("words"))
    return tr.near_repeats(d, "source", "doc_id", "words")


@query("trace_digest", sql="""
WITH t AS (SELECT conv_id, count(*) AS events, string_agg('step ' || turn || ': ' || role || ' ' || left(text, 160), chr(10) ORDER BY turn) AS s
  FROM conversations GROUP BY conv_id)
SELECT conv_id, events, CASE WHEN length(s) > 600 THEN left(s, 600) || chr(10) || '[... trace truncated]' ELSE s END AS digest FROM t""")
def trace_digest(spark, sf):
    c = read_table(spark, sf, "conversations")
    line = F.concat(F.lit("step "), "turn", F.lit(": "), "role", F.lit(" "), F.left("text", F.lit(tr.LINE_CHARS)))
    return tr.trace_digest(c, "conv_id", "turn", line, 600)


@query("output_limit_rate", sql="""
SELECT role, count(*) AS calls, count(*) FILTER (WHERE length(text) >= 1000) AS hits, round(avg((length(text) >= 1000)::INT), 6) AS rate
FROM conversations GROUP BY role""")
def output_limit_rate(spark, sf):
    return rounded(tr.output_limit_rate(read_table(spark, sf, "conversations"), "role", F.length("text"), 1000), "rate")

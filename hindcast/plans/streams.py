"""Section N: streams, each compared with its batch twin. And A14, the whole dataset job."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import asof, sampling
from hindcast.plans import cascades
from hindcast.plans import fixtures as fx
from hindcast.plans import history as hist
from hindcast.plans import silver as sv
from hindcast.plans.registry import query
from hindcast.plans.scoring import rounded
from hindcast.sources import tables
from hindcast.sources.fingerprint import table_fingerprint
from hindcast.sources.scratch import scratch_path
from hindcast.streaming import jobs

EVENT = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"
CAP = 120.0


def event_stream(spark, sf, files_per_batch=None):
    """The events table as a log of JSON files, one folder per day, read as a stream."""
    path = scratch_path(spark, "event-log")
    e = tables.read_table(spark, sf, "events")
    e.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).withColumn(
        "day", F.substring("ts", 1, 10)).write.partitionBy("day").json(path)
    reader = spark.readStream.schema(f"{EVENT}, day STRING")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).drop("day")


@query("stream_latest_prediction", sql="""
SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL""")
def stream_latest_prediction(spark, sf):
    stream = event_stream(spark, sf, 12).select("user_id", "event_type", "event_id", "value")
    return jobs.latest_per_key(stream, ["user_id", "event_type"], "event_id")


@query("stream_cascade_router", *cascades.AB, sql=cascades.LIVE_SQL)
def stream_cascade_router(spark, sf):
    cheap, full = cascades.live_tiers(spark, sf)
    path = scratch_path(spark, "cheap-log")
    cheap.write.json(path)
    stream = spark.readStream.schema("doc_id LONG, signal DOUBLE, answer STRING, cost DOUBLE").json(path)
    return rounded(jobs.route_cascade(stream, full, "doc_id", cascades.TAU), "signal", "cost")


CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"


def spend_of(spark, sf, window):
    """Spend per user in closed windows of a log that holds every event twice."""
    once = event_stream(spark, sf).select("event_id", "user_id", "ts", "value")
    stream = once.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out = jobs.spend_windows(stream, "user_id", "ts", "value", CAP, window, unique=["event_id"])
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).withColumn("spent", F.round("spent", 4))


def spend_sql(windows):
    """`windows`: (user_id, start, stop, value) rows."""
    return f"""SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, round(sum(value), 4) AS spent, count(*) AS calls, sum(value) > {CAP} AS alert,
  0::BIGINT AS late_rows FROM ({windows}) WHERE stop {CLOSED} GROUP BY user_id, start"""


@query("stream_spend", sql=spend_sql(
    "SELECT user_id, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS stop, value FROM events"))
def stream_spend(spark, sf):
    return spend_of(spark, sf, F.window("ts", "1 day"))


@query("stream_spend_sliding", sql=spend_sql("""
  SELECT user_id, date_trunc('day', ts) + to_hours(h) AS start, date_trunc('day', ts) + to_hours(h + 24) AS stop, value
  FROM events, (VALUES (-12), (0), (12)) t(h)
  WHERE ts >= date_trunc('day', ts) + to_hours(h) AND ts < date_trunc('day', ts) + to_hours(h + 24)"""))
def stream_spend_sliding(spark, sf):
    return spend_of(spark, sf, F.window("ts", "24 hours", "12 hours"))


@query("stream_spend_sessions", sql=spend_sql("""
  SELECT user_id, min(ts) OVER w AS start, max(ts) OVER w + INTERVAL 6 HOUR AS stop, value FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT *, (coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR, true))::INT AS fresh FROM events))
  WINDOW w AS (PARTITION BY user_id, s)"""))
def stream_spend_sessions(spark, sf):
    return spend_of(spark, sf, F.session_window("ts", "6 hours"))


@query("stream_label_state", "label_event", sql="""
SELECT issue, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE added), '') AS labels FROM (
  SELECT issue, label, max_by(added, (at_, seq)) AS added FROM label_event GROUP BY ALL) GROUP BY issue""")
def stream_label_state(spark, sf):
    stream = event_stream(spark, sf, 12).select(
        F.col("user_id").alias("issue"), F.col("event_type").alias("label"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 3 != 0).alias("added"))
    return jobs.label_state(stream, "issue", "label", "added", "at", "seq").withColumn("labels", F.array_join("labels", ","))


@query("dataset_build")
def dataset_build(spark, sf):
    """Raw histories to snapshots, derived labels, splits and their fingerprints, written as tables."""
    root = scratch_path(spark, "dataset")
    issues = hist.creation_issues(spark, sf).withColumnRenamed("issue", "number")
    tables.write_table(issues, f"{root}/issues")
    issues = spark.read.schema(issues.schema).parquet(f"{root}/issues")
    snapshots = asof.to_snapshot(issues, "demo/repo")
    silver = sv.derived(spark, sf).withColumnRenamed("issue", "number")
    tables.write_table(snapshots, f"{root}/snapshots")
    tables.write_table(silver, f"{root}/silver")
    silver = spark.read.schema(silver.schema).parquet(f"{root}/silver")
    flags = silver.select(
        "number", F.col("duplicate_of").isNotNull().alias("duplicate"), "needs_info", F.col("component").isNotNull().alias("component"))
    pool = issues.select(
        "number", "created_at", asof.exclusion_reason(F.col("author_is_bot"), F.col("reject_reason")).alias("exclusion_reason")).join(flags, "number")
    window = sampling.time_window(F.col("created_at"), "2024-01-01", "2024-01-05", "2024-01-09", "2024-12-31")
    sizes = {"dev": 20, "test": 10}
    minimums = {s: {"duplicate": 3, "needs_info": 3, "component": 5} for s in sizes}
    splits = sampling.assign_splits(pool, "number", window, sizes, minimums, "build")
    tables.write_table(splits, f"{root}/splits", ("split",))
    out = None
    for name in ("snapshots", "silver", "splits"):
        df = spark.read.parquet(f"{root}/{name}")
        # Maps have no canonical order of their own.
        plain = df.withColumn("votes", sv.votes_text()) if "votes" in df.columns else df
        part = table_fingerprint(plain).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out



"""Streams: replayed batches, a bounded log, late and repeated rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hindcast.sources import scratch
from hindcast.streaming import jobs


def test_replayed_batches_change_nothing_and_the_log_stays_bounded(spark):
    path = scratch.scratch_path(spark, "log")
    log = jobs.ChangeLog(spark, path, ["k"], every=3)
    schema = "k int, v int"
    expected = {}
    for batch in range(10):
        rows = [(k, 100 * batch + k) for k in range(batch % 4 + 1)]
        expected.update(rows)
        for _ in range(2 if batch in (1, 2, 5, 7) else 1):  # batches 2 and 5 fold the log
            log.write(spark.createDataFrame(rows, schema), batch)
        assert {(r["k"], r["v"]) for r in log.current(None).collect()} == set(expected.items())
        assert len([f for f in scratch.folders(spark, path) if f.startswith("base")]) <= 1
    kept = scratch.folders(spark, path)
    assert kept == ["base-8", "part-9"]
    assert spark.read.parquet(f"{path}/base-8").count() == len(expected)


def test_a_log_without_batches_is_an_empty_table(spark):
    log = jobs.ChangeLog(spark, scratch.scratch_path(spark, "log"), ["k"])
    assert log.current("k int").count() == 0


def test_late_rows_are_counted_and_repeats_count_once(spark):
    source, out, state = (scratch.scratch_path(spark, n) for n in ("source", "out", "state"))
    at = lambda hour: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)
    schema = "id long, run string, ts timestamp, cost double"

    def arrives(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        return jobs.spend_windows(stream, "run", "ts", "cost", 5.0, F.window("ts", "4 hours"), unique=["id"], path=out, state=state)

    first = arrives([(1, "a", at(1), 2.0), (1, "a", at(1), 2.0), (2, "a", at(2), 4.0), (3, "a", at(12), 1.0)])
    assert [(r["spent"], r["calls"], r["alert"], r["late_rows"]) for r in first.collect()] == [(6.0, 2, True, 0)]
    second = arrives([(4, "a", at(3), 9.0), (5, "a", at(3), 9.0), (6, "a", at(13), 1.0), (7, "a", at(30), 1.0)]).collect()
    assert sorted((r["spent"], r["calls"]) for r in second) == [(2.0, 2), (6.0, 2)] and {r["late_rows"] for r in second} == {2}


def test_clear_removes_what_a_session_has_written(spark):
    other = spark.newSession()
    path = scratch.scratch_path(other, "thing")
    other.range(3).write.parquet(path)
    scratch.remove(other, path)
    assert scratch.folders(other, path.rsplit("/", 1)[0]).count(path.rsplit("/", 1)[1]) == 0

"""Streaming jobs. State lives in Spark's state store; changed rows go to a compacted log and are read back with
the same newest-wins operator the batch side uses, so a replayed batch changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.latest import last_line_wins
from hindcast.sources.scratch import folders, remove, scratch_path


COMPACT_EVERY = 8  # batches


def run_available(query_writer, name: str, spark, state: str | None = None):
    """Process everything there is, then stop; returns the finished query. `state`: a checkpoint to go on from."""
    where = state or scratch_path(spark, f"{name}-state")
    query = query_writer.option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class ChangeLog:
    """Changed rows of a keyed state, one folder per batch, folded into one base table every few batches.

    The log holds a row per key and what at most `every` batches changed. A batch that is replayed overwrites its own folder, and a base
    that is complete is not made again; what a base covers is removed only once it stands.
    """

    def __init__(self, spark, path: str, keys: Sequence[str], every: int = COMPACT_EVERY):
        self.spark, self.path, self.keys, self.every = spark, path, list(keys), every

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.removeprefix(f"{kind}-")) for n in folders(self.spark, self.path) if n.startswith(f"{kind}-"))

    def _upto(self, last: int | None = None) -> DataFrame | None:
        bases = [b for b in self._numbers("base") if last is None or b <= last]
        base = bases[-1] if bases else -1
        parts = [p for p in self._numbers("part") if p > base and (last is None or p <= last)]
        paths = ([f"{self.path}/base-{base}"] if bases else []) + [f"{self.path}/part-{p}" for p in parts]
        return last_line_wins(self.spark.read.parquet(*paths), self.keys, "_batch") if paths else None

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/part-{batch_id}")
        if (batch_id + 1) % self.every or batch_id in self._numbers("base"):
            return
        self._upto(batch_id).write.mode("overwrite").parquet(f"{self.path}/base-{batch_id}")
        for kind, last in (("base", batch_id - 1), ("part", batch_id)):
            for number in self._numbers(kind):
                if number <= last:
                    remove(self.spark, f"{self.path}/{kind}-{number}")

    def current(self, schema) -> DataFrame:
        """The newest row of each key."""
        rows = self._upto()
        return self.spark.createDataFrame([], schema) if rows is None else rows.drop("_batch")


def _kept_state(state: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Run a stateful aggregate to its end; returns the newest row of each key."""
    spark = state.sparkSession
    log = ChangeLog(spark, scratch_path(spark, name), keys)
    run_available(state.writeStream.outputMode("update").foreachBatch(log.write), name, spark)
    return log.current(state.schema)


def latest_per_key(stream: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Newest row per key of an append log, kept incrementally by the state store."""
    rest = [c for c in stream.columns if c not in keys]
    state = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(*keys, "_row.*")
    return _kept_state(state, list(keys), "latest")


def label_state(stream: DataFrame, key: str, label: str, added: str, at: str, seq: str) -> DataFrame:
    """(key, labels): the current label set per key from an event stream.

    State is one row per (key, label), not a growing set in one group, so a key with a third of
    all events spreads over its labels and combines map-side.
    """
    state = stream.groupBy(key, label).agg(F.max_by(added, F.struct(at, seq)).alias("held"))
    current = _kept_state(state, [key, label], "labels")
    held = F.collect_set(F.when(F.col("held"), F.col(label)))
    return current.groupBy(key).agg(F.array_sort(held).alias("labels"))


def route_cascade(cheap: DataFrame, full: DataFrame, key: str, tau: float) -> DataFrame:
    """Route arriving cheap answers: kept and escalated rows go to two sinks plus a routing log.

    cheap is a stream (key, signal, answer, cost); full is the other tier's table.
    """
    spark = cheap.sparkSession
    path = scratch_path(spark, "router")
    f = full.select(key, F.col("answer").alias("_fa"), F.col("cost").alias("_fc"))
    routed = cheap.withColumn("escalated", F.col("signal") < tau)

    def sink(batch: DataFrame, batch_id: int) -> None:
        part = f"part={batch_id}"
        batch = batch.persist()  # three sinks, one computation of the micro-batch
        try:
            batch.select(key, "signal", "escalated").write.mode("overwrite").parquet(f"{path}/log/{part}")
            kept = batch.filter(~F.col("escalated")).withColumn("decided_by", F.lit("cheap tier"))
            kept.write.mode("overwrite").parquet(f"{path}/kept/{part}")
            up = batch.filter("escalated").join(f, key).select(
                key, "signal", F.col("_fa").alias("answer"), (F.col("cost") + F.col("_fc")).alias("cost"), "escalated",
                F.lit("escalated").alias("decided_by"))
            up.write.mode("overwrite").parquet(f"{path}/escalated/{part}")
        finally:
            batch.unpersist()

    run_available(routed.writeStream.foreachBatch(sink), "router", spark)
    columns = [key, "signal", "escalated", "answer", "cost", "decided_by"]
    return spark.read.parquet(f"{path}/kept").select(*columns).unionByName(spark.read.parquet(f"{path}/escalated").select(*columns))


def spend_windows(
    stream: DataFrame, run: str, at: str, cost: str, cap: float, window: Column, delay: str = "2 hours", unique: Sequence[str] = (),
    path: str | None = None, state: str | None = None,
) -> DataFrame:
    """(run, start, spent, calls, alert, late_rows) of closed windows.

    `window` is a tumbling, sliding or session window expression over `at`. A row whose `unique` columns came before within the
    watermark counts once. Rows later than the watermark are left out and counted: `late_rows` is their number in this run of
    the job, the same on every row. `path` and `state` let a later run go on where this one stopped.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "spend")
    timed = stream.withWatermark(at, delay)
    once = timed.dropDuplicatesWithinWatermark(list(unique)) if unique else timed
    sums = once.groupBy(run, window.alias("w")).agg(F.sum(cost).alias("spent"), F.count(F.lit(1)).alias("calls"))
    out = sums.select(run, F.col("w.start").alias("start"), "spent", "calls", (F.col("spent") > cap).alias("alert"))
    schema = out.schema
    query = run_available(out.writeStream.outputMode("append").format("parquet").option("path", path), "spend", spark, state)
    late = sum(int(op["numRowsDroppedByWatermark"]) for progress in query.recentProgress for op in progress["stateOperators"])
    return spark.read.schema(schema).parquet(path).withColumn("late_rows", F.lit(late).cast("long"))

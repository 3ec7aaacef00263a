"""Bootstrap intervals and paired comparisons from additive sufficient statistics.

A metric is a function of sums over items, so a resample is a weighted sum: no metric is ever
recomputed row by row. In each resample an item has an independent Poisson(1) weight, drawn from a hash
of (seed, resample, item): one law at every size, no join, no shuffle of draws, no count beforehand. A task multiplies
the weights of its items (items x resamples) with their statistics (items x sums), group by group, and returns one row per group:
items are never repeated per resample. `exact=True` asks for draws of exactly n items instead; that numbers the items of
a group in one window and is meant for small groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.numeric import POISSON_ONE, poisson_one, uniform
from hindcast.operators.ordering import running_totals

RESAMPLES = 1000
CONFIDENCE = 0.95
POINT, WEIGHTED = 0, -1  # values of `r` that are not resamples


def resampled(
    items: DataFrame, key: str, *, by: Sequence[str] = (), resamples: int = RESAMPLES, seed: str = "0",
    weight: str | None = None, exact: bool = False,
) -> DataFrame:
    """Items repeated as (r, w, ...): r = 0 the data itself, r = -1 with sampling weights, r >= 1
    the resamples. An item's weight in a resample depends on (seed, r, key) only, or with `exact` on its place in its group."""
    by = list(by)
    columns = list(items.columns)
    numbers = F.sequence(F.lit(1), F.lit(resamples))
    own = [F.struct(F.lit(POINT).alias("r"), F.lit(1.0).alias("w"))]
    if weight:
        own.append(F.struct(F.lit(WEIGHTED).alias("r"), F.col(weight).cast("double").alias("w")))
    if not exact:
        drawn = F.transform(numbers, lambda r: F.struct(
            r.alias("r"), poisson_one(uniform(seed, r, F.col(key))).cast("double").alias("w")))
        every = F.concat(F.array(*own), F.filter(drawn, lambda x: x["w"] > 0))
        return items.select(*columns, F.explode(every).alias("_x")).select(*columns, "_x.r", "_x.w")
    plain = items.select(*columns, F.explode(F.array(*own)).alias("_x")).select(*columns, "_x.r", "_x.w")
    group = Window.partitionBy(*(by or [F.lit(0)]))
    placed = items.withColumn("_i", F.row_number().over(group.orderBy(key)) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(group))
    draws = placed.select(*by, "_i", "_n", F.explode(numbers).alias("r")).select(
        *by, "r", F.floor(uniform(seed, F.col("r"), F.col("_i")) * F.col("_n")).cast("int").alias("_i"))
    counted = draws.groupBy(*by, "r", "_i").agg(F.count(F.lit(1)).cast("double").alias("w"))
    drawn = counted.join(placed.drop("_n"), [*by, "_i"])
    return plain.unionByName(drawn.select(*columns, "r", "w"))


def _statistics(items: DataFrame, key: str, sums: Mapping[str, Column], by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Only what a resample needs of an item: its statistics travel on, not its row."""
    kept = [*by, *([weight] if weight and weight not in by else [])]
    return items.select(
        *kept, *([key] if key not in kept else []), *[c.cast("double").alias(f"_sum_{n}") for n, c in sums.items()])


def poisson_weights(keys: Sequence[str], resamples: int, seed: str) -> np.ndarray:
    """(keys x resamples): the draws that `resampled` makes, for distinct keys."""
    starts = [f"{seed}|{r}|".encode() for r in range(1, resamples + 1)]
    md5 = hashlib.md5
    heads = b"".join([md5(s + k).digest()[:4] for k in (key.encode() for key in keys) for s in starts])
    uniforms = np.frombuffer(heads, ">u4").reshape(len(keys), resamples) / 4294967296.0
    return np.searchsorted(POISSON_ONE, uniforms, side="right").astype(float)


CHUNK = 256    # items whose weights a task holds at once
GROUPS = 2000  # groups whose sums a task holds before it passes them on


def _totals(by: Sequence[str], names: Sequence[str], resamples: int, seed: str, weighted: bool):
    """Rows (by..., _k, _w, sums...) to one row per group: each sum as a list over (point, weighted, resamples)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # group -> [row of the by columns, totals]

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                groups = pa.concat_tables([pa.Table.from_batches([g[0]]) for g in held.values()]).combine_chunks()
                stacked = np.stack([g[1] for g in held.values()])  # groups x draws x sums
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(stacked[:, :, i].ravel()), stacked.shape[1]).cast(pa.list_(pa.float64()))
                         for i in range(len(names))]
                columns = [groups.column(b).chunk(0) for b in by]
                yield pa.RecordBatch.from_arrays([*columns, *lists], [*by, *names])
                held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                keys, place = np.unique(np.array(part.column("_k").to_pylist(), dtype=object).astype(str), return_inverse=True)
                draws = poisson_weights(keys.tolist(), resamples, seed)
                own = part.column("_w").to_numpy(zero_copy_only=False) if weighted else np.zeros(part.num_rows)
                stats = np.column_stack([np.nan_to_num(part.column(n).to_numpy(zero_copy_only=False).astype(float)) for n in names])
                group = part.select(list(by)).to_pandas().groupby(list(by), dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(part.num_rows, int)
                for g in range(group.max(initial=-1) + 1):
                    rows = np.flatnonzero(group == g)
                    weights = np.column_stack([np.ones(len(rows)), own[rows], draws[place[rows]]])
                    first = part.slice(int(rows[0]), 1).select(list(by))
                    name = tuple(first.to_pylist()[0].values()) if by else ()
                    total = weights.T @ stats[rows]
                    if name in held:
                        held[name][1] += total
                    else:
                        held[name] = [first, total]
                if len(held) >= GROUPS:
                    yield from out()
        if not by and held:
            stacked = held[()][1]
            yield pa.RecordBatch.from_arrays([pa.array([stacked[:, i].tolist()]) for i in range(len(names))], list(names))
        else:
            yield from out()

    return run


def resample_totals(
    items: DataFrame, key: str, sums: Mapping[str, Column], by: Sequence[str] = (), *, resamples: int = RESAMPLES, seed: str = "0",
    weight: str | None = None,
) -> DataFrame:
    """(by..., r, sums...): weighted sums of item columns per group and resample; r = 0 the data itself, r = -1 with `weight`.

    Null statistics add nothing. A resample in which a group drew nobody has sums of 0.
    """
    by, names = list(by), list(sums)
    kept = items.select(
        *by, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"),
        *[c.cast("double").alias(n) for n, c in sums.items()])
    # Rows of an item come together, so that its weights are drawn once for all its groups, and every core has its share of the drawing.
    kept = kept.repartition(items.sparkSession.sparkContext.defaultParallelism, "_k").sortWithinPartitions("_k")
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + [f"`{n}` array<double>" for n in names])
    # One row per group and task; only here are resamples laid out as rows.
    lists = kept.mapInArrow(_totals(by, names, resamples, seed, weight is not None), schema)
    long = lists.select(*by, F.posexplode(F.arrays_zip(*names)).alias("_at", "_x"))
    r = F.when(F.col("_at") == 0, POINT).when(F.col("_at") == 1, WEIGHTED).otherwise(F.col("_at") - 1)
    out = long.groupBy(*by, r.alias("r")).agg(*[F.sum(F.col("_x")[n]).alias(n) for n in names])
    return out if weight else out.filter(F.col("r") != WEIGHTED)


def resample_sums(rows: DataFrame, sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by..., r, sums...): weighted sums of item columns per resample."""
    return rows.groupBy(*by, "r").agg(*[F.sum(F.col("w") * c.cast("double")).alias(n) for n, c in sums.items()])


def _per_resample(items, key, sums, by, resamples, seed, weight, exact) -> DataFrame:
    if not exact:
        return resample_totals(items, key, sums, by, resamples=resamples, seed=seed, weight=weight)
    rows = resampled(
        _statistics(items, key, sums, by, weight), key, by=by, resamples=resamples, seed=seed, weight=weight, exact=True)
    return resample_sums(rows, {n: F.col(f"_sum_{n}") for n in sums}, by)


def intervals(per_r: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), confidence: float = CONFIDENCE) -> DataFrame:
    """(by..., metric, point, low, high, weighted, valid_resamples) from one row per resample.

    Undefined (null) resamples are dropped and counted out; an undefined point voids the row.
    """
    tail = (1 - confidence) / 2
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics]))
    long = per_r.select(*by, "r", stacked.alias("x")).select(*by, "r", "x.metric", "x.v")
    value = F.when(F.col("r") > 0, F.col("v"))
    out = long.groupBy(*by, "metric").agg(
        F.max(F.when(F.col("r") == POINT, F.col("v"))).alias("point"),
        F.percentile(value, F.lit(tail)).alias("low"),
        F.percentile(value, F.lit(1 - tail)).alias("high"),
        F.max(F.when(F.col("r") == WEIGHTED, F.col("v"))).alias("weighted"),
        F.count(value).alias("valid_resamples"),
    )
    defined = F.col("point").isNotNull()
    return out.select(
        *by, "metric", "point", F.when(defined, F.col("low")).alias("low"), F.when(defined, F.col("high")).alias("high"),
        "weighted", F.when(defined, F.col("valid_resamples")).otherwise(0).alias("valid_resamples"))


def bootstrap_ci(
    items: DataFrame, key: str, sums: Mapping[str, Column], metrics: Mapping[str, Column], *,
    by: Sequence[str] = (), resamples: int = RESAMPLES, seed: str = "0", weight: str | None = None,
    confidence: float = CONFIDENCE, exact: bool = False,
) -> DataFrame:
    """Percentile intervals of several metrics in one job. `sums` are item columns, `metrics`
    expressions over their sums."""
    totals = _per_resample(items, key, sums, by, resamples, seed, weight, exact)
    per_r = totals.select(*by, "r", *[c.alias(n) for n, c in metrics.items()])
    return intervals(per_r, list(metrics), by, confidence)


def paired_deltas(
    per_r: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), confidence: float = CONFIDENCE
) -> DataFrame:
    """(by..., metric, a, b, delta, low, high, share_b_better, valid_resamples, significant).

    `per_r` has columns a_<metric> and b_<metric> per resample: both systems on the same draws.
    """
    tail = (1 - confidence) / 2
    stacked = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("a"), F.col(f"b_{m}").alias("b")) for m in metrics]))
    long = per_r.select(*by, "r", stacked.alias("x")).select(
        *by, "r", "x.metric", "x.a", "x.b", (F.col("x.b") - F.col("x.a")).alias("d"))
    draw = F.when(F.col("r") > 0, F.col("d"))
    at_point = F.col("r") == POINT
    out = long.groupBy(*by, "metric").agg(
        F.max(F.when(at_point, F.col("a"))).alias("a"),
        F.max(F.when(at_point, F.col("b"))).alias("b"),
        F.max(F.when(at_point, F.col("d"))).alias("delta"),
        F.percentile(draw, F.lit(tail)).alias("low"),
        F.percentile(draw, F.lit(1 - tail)).alias("high"),
        F.avg(F.when(draw.isNotNull(), (draw > 0).cast("double"))).alias("share_b_better"),
        F.count(draw).alias("valid_resamples"),
    )
    ok = F.col("delta").isNotNull() & (F.col("valid_resamples") > 0)
    gated = ["delta", "low", "high", "share_b_better"]
    return out.select(
        *by, "metric", "a", "b", *[F.when(ok, F.col(c)).alias(c) for c in gated],
        F.when(ok, F.col("valid_resamples")).otherwise(0).alias("valid_resamples"),
        (ok & significant(F.col("low"), F.col("high"))).alias("significant"))


def significant(low: Column, high: Column) -> Column:
    """The interval excludes zero."""
    return F.coalesce((low > 0) | (high < 0), F.lit(False))


def paired_bootstrap(
    items: DataFrame, key: str, sums: Mapping[str, Column], a: Mapping[str, Column], b: Mapping[str, Column], *,
    by: Sequence[str] = (), resamples: int = RESAMPLES, seed: str = "0", confidence: float = CONFIDENCE,
    exact: bool = False,
) -> DataFrame:
    """B minus A on the same draws; an item row carries both systems' statistics."""
    if set(a) != set(b):
        raise ValueError("both systems need the same metrics")
    per_r = _per_resample(items, key, sums, by, resamples, seed, None, exact).select(
        *by, "r", *[c.alias(f"a_{n}") for n, c in a.items()], *[c.alias(f"b_{n}") for n, c in b.items()])
    return paired_deltas(per_r, list(a), by, confidence)


def percentiles(df: DataFrame, by: Sequence[str], value: Column, wanted: Mapping[str, float]) -> DataFrame:
    """(by..., one column per name of `wanted`): exact percentiles, q in [0, 100], linear between neighbouring ranks; 0 for no value.

    Values are counted per (group, value) and ranked by running totals, so no group's values meet in one buffer.
    """
    by = list(by)
    rows = df.select(*by, value.cast("double").alias("_v"))
    counts = rows.filter("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, "_v", ["_n"], inclusive=False, by=by).select(*by, "_v", "_n", F.col("cum__n").alias("_before"))
    sizes = rows.groupBy(*by).agg(F.count("_v").alias("_size"))
    same = [F.col(f"_s_{c}").eqNullSafe(F.col(c)) for c in by]
    joined = sizes.withColumnsRenamed({c: f"_s_{c}" for c in by}).join(ranked, same or F.lit(True), "left")
    picks, out = [], []
    for name, q in wanted.items():
        rank = F.lit(q / 100) * (F.col("_size") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{name}"))
        low = F.col(f"_lo_{name}")
        out.append(F.coalesce(low + (rank - F.floor(rank)) * (F.col(f"_hi_{name}") - low), F.lit(0.0)).alias(name))
    kept = [F.col(f"_s_{c}").alias(c) for c in by]
    return joined.groupBy(*[f"_s_{c}" for c in by], "_size").agg(*picks).select(*kept, *out)


def percentile_linear(value: Column, q: float) -> Column:
    """Linear-interpolation percentile, q in [0, 100], as an aggregate; empty gives 0.

    Its buffer holds a group's distinct values: for groups known to be small. `percentiles` has no such bound.
    """
    return F.coalesce(F.percentile(value, F.lit(q / 100)), F.lit(0.0))

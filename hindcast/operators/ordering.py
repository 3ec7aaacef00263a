"""Global ranks and running totals without a single-task window.

A window with no partition key sorts the whole table in one task. Here rows are first put in
value-ordered buckets whose edges are approximate quantiles (one small aggregate, read back as
a scalar subquery). Totals per bucket are few, so their running sum is cheap; the row-level
window then runs inside each bucket. The edges only balance the work: any edges give exact
results. The number of buckets follows the number of rows, and the input is written once before it is read for
edges, totals and rows.

A value so frequent that it is an edge itself gets a bucket of its own, and such a bucket is
split further by the tie-break column, so a third of all rows on one value is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.sources.scratch import materialise

BUCKETS = 128
ROWS_PER_BUCKET = 20_000
MOST_BUCKETS = 4096  # edges are one array in every task


def bucket_count(df: DataFrame) -> int:
    """Buckets of about ROWS_PER_BUCKET rows; beyond MOST_BUCKETS of them buckets grow instead."""
    return max(8, min(MOST_BUCKETS, df.count() // ROWS_PER_BUCKET + 1))


def _edges(df: DataFrame, column: str, buckets: int) -> Column:
    points = [i / buckets for i in range(1, buckets)]
    return df.agg(F.percentile_approx(F.col(column).cast("double"), points, max(10_000, 10 * buckets))).scalar()


def _edges_passed(edges: str, value: Column, strict: bool) -> Column:
    """How many edges lie below (or up to) the value, by binary search; none for null.

    The value goes in as a one-element array, so it is computed once per row: written straight
    into the search, the optimiser would inline its whole expression and run it once per step.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_BUCKETS.bit_length()))])

    def search(v: Column) -> Column:
        def further(at: Column, step: Column) -> Column:
            edge = F.get(F.col(edges), at + step - 1)  # null beyond the last edge
            return F.when(edge < v if strict else edge <= v, at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), further)

    return F.transform(F.array(value), search)[0]


def with_buckets(df: DataFrame, key: str, tie: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Add `_bucket` (a struct that sorts like (key, tie)) with balanced bucket sizes."""
    value = F.col(key).cast("double")
    staged = df.withColumn("_edges", _edges(df, key, buckets))
    below = F.coalesce(_edges_passed("_edges", value, strict=True), F.lit(0))
    upto = F.coalesce(_edges_passed("_edges", value, strict=False), F.lit(0))
    staged = staged.withColumn("_lo", below).withColumn("_hi", upto).drop("_edges")
    if tie is None:
        sub = F.lit(0)
    else:
        tied = F.col(tie).cast("double")
        staged = staged.withColumn("_tie_edges", _edges(df, tie, buckets))
        sub = F.when(
            F.col("_hi") > F.col("_lo"), _edges_passed("_tie_edges", tied, strict=True)
        ).otherwise(F.lit(0))
    bucket = F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), sub.alias("sub"))
    return staged.withColumn("_bucket", bucket).drop("_lo", "_hi", "_tie_edges")


def running_totals(
    df: DataFrame,
    key: str,
    sums: Sequence[str],
    *,
    tie: str | None = None,
    descending: bool = False,
    inclusive: bool = True,
    prefix: str = "cum_",
    buckets: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Running sums of `sums` over the whole table, or within each group of `by`, in (key, tie) order, as `cum_<name>`.

    (key, tie) must be unique in a group: aggregate by key first, or pass a unique tie-break. Groups share the buckets, so one
    group with a third of all rows is cut like the whole table is. Nulls in `by` are a group.
    """
    df = materialise(df, "ordering")
    staged = with_buckets(df, key, tie, bucket_count(df) if buckets is None else buckets)
    group = ["_group"] if by else []
    if by:
        staged = staged.withColumn("_group", F.struct(*by))
    per_bucket = staged.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    # One row per bucket, and group: the number in a window is bounded by the number of edges, whatever the data size.
    over_buckets = Window.partitionBy(*group).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *group, "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(over_buckets), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    order = [direction(key)] + ([direction(tie)] if tie else [])
    frame = Window.partitionBy(*group, "_bucket").orderBy(*order)
    inside = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    # Without groups the offsets are one row per bucket; with groups their number is not bounded, so the engine picks the join.
    joined = staged.join(offsets if by else F.broadcast(offsets), [*group, "_bucket"])
    return joined.select(
        *[c for c in df.columns],
        *[
            (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{c}")).alias(f"{prefix}{c}")
            for c in sums
        ],
    )


def counts_before(
    requests: DataFrame, request_time: str, rows: DataFrame, row_time: str, sums: dict[str, Column]
) -> DataFrame:
    """For each distinct request time, totals of `sums` over rows strictly earlier.

    Rows and requests are first collapsed to distinct times, so equal times cost one row.
    Returns (request_time, *sums).
    """
    per_time = rows.groupBy(F.col(row_time).alias("_t")).agg(*[c.alias(n) for n, c in sums.items()])
    asked = requests.select(F.col(request_time).alias("_t")).distinct()
    zeros = [F.lit(0).cast("long").alias(n) for n in sums]
    points = (
        per_time.withColumn("_asked", F.lit(0))
        .unionByName(asked.select("_t", *zeros, F.lit(1).alias("_asked")))
        .groupBy("_t")
        .agg(*[F.sum(n).alias(n) for n in sums], F.max("_asked").alias("_asked"))
    )
    totals = running_totals(points, "_t", list(sums), inclusive=False)
    return totals.filter("_asked = 1").select(
        F.col("_t").alias(request_time), *[F.col(f"cum_{n}").alias(n) for n in sums]
    )

"""Ratios, scores and seeded uniforms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """a / b where 0/0 (and x/0) counts as 0.0."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 from (possibly weighted) counts.

    F1 is computed as 2tp / (2tp + fp + fn), the same number with one division.
    """
    return (
        ratio(tp.cast("double"), tp + fp),
        ratio(tp.cast("double"), tp + fn),
        ratio(2.0 * tp, 2.0 * tp + fp + fn),
    )


def uniform(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1) from the MD5 of the parts joined with '|'."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch for a zone-less timestamp (no session-zone arithmetic)."""
    days = F.unix_date(ts.cast("date")).cast("long")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    fraction = (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("long")
    return seconds * 1000000 + fraction


# Cumulative Poisson(1) probabilities P(X <= k), k = 0..9.
POISSON_ONE = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217,
)


def poisson_one(u: Column) -> Column:
    """A Poisson(1) draw by inverting its distribution function at the uniform `u`."""
    expr = F.when(u < POISSON_ONE[0], F.lit(0))
    for k, edge in enumerate(POISSON_ONE[1:], start=1):
        expr = expr.when(u < edge, F.lit(k))
    return expr.otherwise(F.lit(len(POISSON_ONE)))


def zero_failure_bound(n: Column, confidence: float = 0.95) -> Column:
    """Largest failure rate still consistent with no failure in n trials."""
    if not 0.0 < confidence < 1.0:
        raise ValueError(f"confidence must be in (0, 1), got {confidence}")
    bound = 1.0 - F.pow(F.lit(1.0 - confidence), 1.0 / F.nullif(n, F.lit(0)))
    return (
        F.when(n == 0, F.lit(1.0))
        .when(n > 0, bound)
        .otherwise(F.raise_error(F.lit("n must be >= 0")).cast("double"))
    )


def r6(c: Column) -> Column:
    """Output rounding: float sums depend on order past about the ninth digit."""
    return F.round(c.cast("double"), 6)

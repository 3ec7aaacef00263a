"""Vectors as whole numbers: which of them take part, and at which length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_numbers(vector: Column, scale: int, bits: int, offset: int = 0) -> Column:
    """floor(scale * entry) + offset of each entry; null for a vector that is null, empty, or holds an entry that is null,
    not finite, or of `bits` bits or more when scaled."""
    limit = float(1 << bits) / scale
    fit = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(limit), F.lit(False)))
    return F.when(
        vector.isNotNull() & (F.size(vector) > 0) & fit,
        F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long")))


def usual_length(df: DataFrame, vector: str) -> int:
    """The length that most vectors have (of equally frequent ones the larger); 0 without vectors."""
    lengths = df.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return lengths.agg(F.max_by("l", F.struct("n", "l"))).first()[0] or 0


def matrix(lists: pa.Array, dtype=np.int64) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    values = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(dtype, copy=False) if len(values) else np.zeros((0, 0), dtype)

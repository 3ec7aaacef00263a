"""Embedding whitening from exact cross-products by bit-sliced scatter.

Entries become whole numbers x = floor(64 c) + 1,000,000. In a block of rows each dimension is shifted by its smallest
value, and every bit of the shifted numbers becomes a plane: one bit a row, 64 rows a word. The cross-product of two
dimensions is the sum over their planes a, b of 2^(a+b) times the ones of plane AND plane, so it comes from ANDs and
popcounts alone and is exact. Tasks add up blocks, Spark adds up tasks, and the driver gets one number per pair of dimensions:
it centres them as integers (n * C - S * S') before the one division and the eigendecomposition.

The fit list is the distinct vectors; it is written once. What reaches the driver is bounded by dimensions squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.columns import field, pack, packed, unpack
from hindcast.llm.vectors import matrix, usual_length, whole_numbers
from hindcast.sources.scratch import materialise

SCALE, OFFSET, BITS = 64, 1_000_000, 52
COMPONENTS = 16
BLOCK_VALUES = 1 << 22
#: Eigenvalues below this share of the largest are rank deficiency: such a component has no whitened value.
RANK = 1e-12
COUNT = -1  # the place of totals that belong to no pair


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes as rows of 64-bit words, bit number of each, first plane of each dimension) of non-negative numbers (rows, dims)."""
    rows, dims = shifted.shape
    tops = shifted.max(axis=0)
    sizes = np.array([max(1, int(t).bit_length()) for t in tops])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words = -(-rows // 64)
    out = np.zeros((int(sizes.sum()), words * 8), np.uint8)
    for i in range(dims):
        column = shifted[:, i]
        for a in range(sizes[i]):
            bits = np.packbits(((column >> a) & 1).astype(np.uint8))
            out[firsts[i] + a, : len(bits)] = bits
    return out.view(np.uint64), np.concatenate([np.arange(s) for s in sizes]), firsts


def cross_products(values: np.ndarray) -> np.ndarray:
    """The exact matrix of sums over rows of value_i * value_j, as Python integers once 62 bits don't hold them."""
    rows, dims = values.shape
    lows = values.min(axis=0)
    shifted = values - lows
    words, bit, firsts = planes(shifted)
    largest = max(int(np.abs(values).max()), int(shifted.max()), 1)
    kind = np.int64 if 4 * rows * largest * largest < 1 << 62 else object
    weight = np.array([1 << int(b) for b in bit], dtype=kind)
    raw = np.zeros((dims, dims), kind)
    ends = [*firsts[1:], len(words)]
    for i in range(dims):
        rest, total = words[firsts[i]:], 0
        for p in range(firsts[i], ends[i]):
            ones = np.bitwise_count(rest & words[p]).sum(axis=1, dtype=np.int64)
            total = total + ones.astype(kind) * weight[p]
        raw[i, i:] = np.add.reduceat(total * weight[firsts[i]:], firsts[i:] - firsts[i])
    raw = raw + np.triu(raw, 1).T
    sums, low = shifted.sum(axis=0, dtype=np.int64).astype(kind), lows.astype(kind)
    return raw + np.multiply.outer(low, sums) + np.multiply.outer(sums, low) + rows * np.multiply.outer(low, low)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, total) of one task: cross-products for i <= j, sums at (i, COUNT), rows at (COUNT, COUNT)."""
    held: list[np.ndarray] = []
    cross = sums = None
    rows = 0

    def add(block: np.ndarray) -> None:
        nonlocal cross, sums, rows
        found = cross_products(block).astype(object)
        total = block.sum(axis=0, dtype=np.int64).astype(object)
        cross, sums = (found, total) if cross is None else (cross + found, sums + total)
        rows += len(block)

    waiting = 0
    for batch in batches:
        values = matrix(batch.column("x")) - OFFSET
        size = max(64, BLOCK_VALUES // max(1, values.shape[1]))
        for at in range(0, len(values), size):
            held.append(values[at : at + size])
            waiting += len(held[-1])
            if waiting >= size:
                add(np.concatenate(held))
                held, waiting = [], 0
    if waiting:
        add(np.concatenate(held))
    if cross is None:
        return
    dims = len(sums)
    i, j = np.triu_indices(dims)
    where = [*i.tolist(), *range(dims), COUNT], [*j.tolist(), *[COUNT] * (dims + 1)]
    totals = [Decimal(int(t)) for t in [*cross[i, j], *sums, rows]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(where[0], pa.int32()), pa.array(where[1], pa.int32()), pa.array(totals, pa.decimal128(38, 0))], ["i", "j", "total"])


@dataclass(frozen=True)
class Whitening:
    """A fitted model: `sums` of x over the n vectors of the fit list, unit components as columns, all as of the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(sum over dimensions of (n x - S)^2, whitened values) of rows of x."""
        reach = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        kind = np.int64 if reach < 1 << 62 else object
        apart = x.astype(kind) * kind(self.n) - np.array(self.sums, kind) if kind is np.int64 else x.astype(object) * self.n - np.array(self.sums, object)
        widest = int(np.abs(apart).max(initial=0))
        squares = apart if widest * widest * x.shape[1] < 1 << 62 else apart.astype(object)
        return (squares * squares).sum(axis=1).tolist(), (apart.astype(float) / self.n) @ (self.components / np.sqrt(self.eigenvalues))


def fit(distinct: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Moments of the table of distinct vectors `x`, centred as integers, and their eigenvectors."""
    parts = distinct.mapInArrow(_scatter, "i int, j int, total decimal(38,0)")
    totals = {(r.i, r.j): int(r.t) for r in parts.groupBy("i", "j").agg(F.sum("total").alias("t")).toLocalIterator()}
    n = totals.get((COUNT, COUNT), 0)
    if not n:
        return Whitening(0, [0] * dims, np.zeros((dims, 0)), np.zeros(0), np.zeros(0))
    small = [totals[i, COUNT] for i in range(dims)]
    centred = np.empty((dims, dims))
    trace = 0
    for i in range(dims):
        for j in range(i, dims):
            apart = n * totals[i, j] - small[i] * small[j]
            centred[i, j] = centred[j, i] = apart / (n * n)
            trace += apart if i == j else 0
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > RANK * max(values.max(), 0.0)]
    explained = values[order] / (trace / (n * n)) if trace else np.zeros(0)
    return Whitening(n, [s + n * OFFSET for s in small], vectors[:, order], values[order], explained)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured over its rows."""
    width = len(model.eigenvalues)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("x"))
            size = max(64, BLOCK_VALUES // max(1, x.shape[1]))
            for at in range(0, len(x), size):
                y = model.project(x[at : at + size])[1]
                total += y.T @ y
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "total"])

    if not width:
        return 0.0
    parts = distinct.mapInArrow(gram, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("t"))
    apart = F.abs(F.col("t") / model.n - (F.col("i") == F.col("j")).cast("double"))
    return parts.agg(F.round(F.max(apart), 12)).first()[0]


def whiten(docs: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """(rows with `white`, the model, its identity error).

    `white` is a struct (deviation decimal(38,0): sum over dimensions of (n x - S)^2; whitened array<double>, one entry per
    component by falling eigenvalue). Rows are left out when their vector is null or empty, holds a null, NaN, infinite or
    over-long entry (52 bits once scaled), or has another length than most vectors (of equally frequent lengths the larger
    counts). Repeated vectors count once in the fit and keep a row each. Components of no variance are left out: one vector,
    or only equal ones, leave empty lists. A deviation over 38 digits is null. Empty table: no rows. Other columns are
    kept; one named `white` is replaced.
    """
    staged = pack(docs).select("_doc", whole_numbers(packed(vector), SCALE, BITS, OFFSET).alias("_x")).filter("_x is not null")
    dims = usual_length(docs.select(whole_numbers(field(vector), SCALE, BITS, OFFSET).alias("x")), "x")
    staged = staged.filter(F.size("_x") == dims)
    distinct = materialise(staged.select(F.col("_x").alias("x")).distinct(), "whitening-fit")
    model = fit(distinct, dims, components)
    kind = pa.struct([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<deviation: decimal(38,0), whitened: array<double>>")
    def projected(rows: pa.Array) -> pa.Array:
        out = []
        size = max(64, BLOCK_VALUES // max(1, dims))
        for at in range(0, len(rows), size):
            deviations, white = model.project(matrix(rows.slice(at, size)))
            exact = [Decimal(d) if d < 10**38 else None for d in deviations]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(exact) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            out.append(pa.StructArray.from_arrays([pa.array(exact, pa.decimal128(38, 0)), lists], fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    rows = staged.withColumn("_white", projected("_x"))
    return unpack(rows, docs.columns, white=F.col("_white")), model, identity_error(distinct, model)

"""Near copies of whole texts for corpus building: wider SimHash fingerprints, sampled tables, the Gray-order search.

`gray_index` links fingerprints of 64 bits within 3 bits and finds every such pair. Texts of a five-word shingle similarity of 0.8 differ in
some 15 % of their bits, which no set of exact tables of bearable number can cover. Here a fingerprint has 128 bits, so that a radius of
24 still keeps unrelated texts apart (a chance of 2e-13 a pair), and each of a number of tables groups by sampled bits of it. The
width of a key follows the number of distinct fingerprints, so groups stay small; the number of tables follows from the width, so that a
pair of similarity 0.8 misses all tables with the chance MISS at every size.

In a group fingerprints lie in Gray order and runs of FANOUT become nodes, which keep the bits all below agree on. A search adds up
differences on its way down and leaves a node past the radius. Neighbours in the order are linked first, and a node whose members all belong
to the query's own component is left as well: a large group of near copies costs its size, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm import bytetext
from hindcast.llm.columns import field
from hindcast.llm.gray_index import components, gray_rank, smallest_reachable
from hindcast.sources.scratch import materialise

BITS = 128
SHINGLE = 5
RADIUS = 24
DIFFER = 0.152  # share of bits in which texts of similarity 0.8 differ: acos(2 * 0.8 / 1.8) / pi
MISS = 0.05
FANOUT = 8
NEIGHBOURS = 4
FRONTIER = 1 << 17
SLICE = 1 << 15
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.array([(2 * i + 3) * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for i in range(64)], np.uint64)


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """(n, 2) words of 64 bits: a bit is 1 when over half of the shingles vote for it. No words: 0."""
    data = bytetext.LOWER[data]
    starts, ends, bounds = bytetext.words(data, offsets)
    word = bytetext.word_hashes(data, starts, ends)
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    votes = np.zeros((len(n), BITS), np.int64)
    doc = np.repeat(np.arange(len(n)), count)
    first = bytetext.ranges(bounds[:-1], count)
    for at in range(0, len(first), SLICE):
        head, owner = first[at : at + SLICE], doc[at : at + SLICE]
        term = np.zeros(len(head), np.uint64)
        for j in range(shingle):
            inside = head + j < bounds[owner + 1]
            term[inside] += word[head[inside] + j] * _ODD[j]
        hashes = np.stack([bytetext.mix(term), bytetext.mix(term ^ _ODD[-1])], axis=1)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        votes[owner[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > count[:, None], axis=1, bitorder="little").view(np.uint64)


@F.arrow_udf(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
def fingerprint(texts: pa.Array) -> pa.Array:
    made = [np.zeros((0, 2), np.uint64)]
    made += [text_fingerprints(data, offsets) for _, _, data, offsets in bytetext.chunks(texts)]
    both = np.concatenate(made).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["lo", "hi"])


def table_masks(distinct: int) -> list[tuple[int, int]]:
    """The key bits of every table, as signed (lo, hi)."""
    width = max(16, math.ceil(math.log2(max(distinct, 2))) - 4)
    tables = math.ceil(math.log(MISS) / math.log1p(-((1 - DIFFER) ** width)))
    rng, masks = np.random.default_rng(17), []
    while len(masks) < tables:
        order = rng.permutation(BITS)
        for at in range(0, BITS - width + 1, width):  # tables of one round share no bit
            halves = [sum(1 << int(b % 64) for b in order[at : at + width] if b // 64 == half) for half in (0, 1)]
            masks.append(tuple(h - ((h >> 63) << 64) for h in halves))
    return masks[:tables]


class _Level:
    def __init__(self, mask, value, first, last, group, child, n, low, high):
        self.mask, self.value, self.fresh = mask, value, None
        self.first, self.last, self.group, self.child, self.n, self.low, self.high = first, last, group, child, n, low, high


def _levels(values: np.ndarray, group: np.ndarray, part: np.ndarray) -> list[_Level]:
    """From the leaves to one root per group; low and high: the smallest and largest component below a node."""
    every, none = np.arange(len(values)), np.zeros(len(values), np.int64)
    out = [_Level(np.full_like(values, FULL), values, every, every + 1, group, none, none, part, part)]
    while (out[-1].group[1:] == out[-1].group[:-1]).any():
        low = out[-1]
        at = np.arange(len(low.group))
        head = np.maximum.accumulate(np.where(np.append(True, low.group[1:] != low.group[:-1]), at, 0))
        cut = np.flatnonzero((at - head) % FANOUT == 0)
        n = np.diff(np.append(cut, len(at)))
        differ = np.bitwise_or.reduceat(low.value ^ np.repeat(low.value[cut], n, axis=0), cut, axis=0)
        mask = np.bitwise_and.reduceat(low.mask, cut, axis=0) & ~differ
        low.fresh = low.mask & ~np.repeat(mask, n, axis=0)
        out.append(_Level(
            mask, low.value[cut] & mask, low.first[cut], low.last[cut + n - 1], low.group[cut], cut, n,
            np.minimum.reduceat(low.low, cut), np.maximum.reduceat(low.high, cut)))
    out[-1].fresh = out[-1].mask
    return out


def links(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each leaf the smallest leaf it reaches inside its group by steps of up to `radius` bits; sorted by (group, order)."""
    n = len(values)
    pairs = []
    for step in range(1, min(NEIGHBOURS, n - 1) + 1):
        near = np.bitwise_count(values[step:] ^ values[:-step]).sum(axis=1) <= radius
        a = np.flatnonzero(near & (group[step:] == group[:-step]))
        pairs.append((a, a + step))
    part = smallest_reachable(n, *(np.concatenate([p[i] for p in pairs] or [np.zeros(0, int)]) for i in (0, 1)))
    levels = _levels(values, group, part)
    root_of = np.searchsorted(levels[-1].first, np.arange(n), side="right") - 1
    size = (levels[-1].last - levels[-1].first)[root_of]
    at = 0
    while at < n:
        last = at + max(1, int(np.searchsorted(np.cumsum(size[at : at + FRONTIER]), FRONTIER, side="right")))
        query = np.arange(at, min(last, n))
        node, spent = root_of[query], np.zeros(len(query), np.int64)
        at = last
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            spent = spent + np.bitwise_count((values[query] ^ level.value[node]) & level.fresh[node]).sum(axis=1)
            own = part[query]
            live = (spent <= radius) & (level.last[node] > query + 1) & ((level.low[node] != own) | (level.high[node] != own))
            query, node, spent = query[live], node[live], spent[live]
            if depth == 0:
                pairs.append((query, node))
                break
            children = level.n[node]
            query, spent = np.repeat(query, children), np.repeat(spent, children)
            node = bytetext.ranges(level.child[node], children)
    return smallest_reachable(n, *(np.concatenate([p[i] for p in pairs]) for i in (0, 1)))


def _forest(group: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    odd = (np.bitwise_count(values[:, 0]) & 1).astype(bool)
    order = np.lexsort((np.where(odd, ~gray_rank(values[:, 1]), gray_rank(values[:, 1])), gray_rank(values[:, 0]), group))
    group, values = group[order], values[order]
    together = np.zeros(len(group), bool)
    same = group[1:] == group[:-1]
    together[1:] |= same
    together[:-1] |= same
    group, values = group[together], values[together]
    child = root = np.zeros(0, np.int64)
    if len(values):
        root = links(values, group)
        child = np.flatnonzero(root != np.arange(len(values)))
        root = root[child]
    both = np.unique(np.concatenate([values[child], values[root]], axis=1), axis=0).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, i]) for i in range(4)], ["a_lo", "a_hi", "b_lo", "b_hi"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; the last group of a batch waits for the next batch."""
    held_group, held = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    for batch in batches:
        group, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "lo", "hi"))
        group = np.concatenate([held_group, group])
        values = np.concatenate([held, np.stack([lo, hi], axis=1).view(np.uint64)])
        if not len(group):
            continue
        cut = int(np.searchsorted(group, group[-1]))
        held_group, held = group[cut:], values[cut:]
        if cut:
            yield _forest(group[:cut], values[:cut])
            bytetext.release()
    if len(held_group):
        yield _forest(held_group, held)
    bytetext.release()


def near_links(fingerprints: DataFrame) -> DataFrame:
    """(a, b), structs (lo, hi): links between the distinct fingerprints (lo, hi) of `fingerprints` that lie within RADIUS bits."""
    spark = fingerprints.sparkSession
    masks = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in table_masks(fingerprints.count())])
    dealt = fingerprints.select("lo", "hi", F.posexplode(masks).alias("_t", "_m")).select(
        "lo", "hi", F.xxhash64("_t", F.col("lo").bitwiseAND(F.col("_m.lo")), F.col("hi").bitwiseAND(F.col("_m.hi"))).alias("group"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(
        _search, "a_lo bigint, a_hi bigint, b_lo bigint, b_hi bigint")
    return found.distinct().select(*[F.struct(F.col(f"{s}_lo").alias("lo"), F.col(f"{s}_hi").alias("hi")).alias(s) for s in "ab"])


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, copies, component_id): one row per distinct (key, text).

    `component_id` is the smallest key reachable over links of up to RADIUS bits. Texts are lower-cased (A-Z); fewer than SHINGLE words
    are one shingle. Null or empty text: fingerprint 0, linked like any other. Null key: never the smallest, unless all are null. Repeated
    rows: one row, counted in `copies`. Texts of any length are read whole. Empty table: no rows.
    """
    prints = materialise(
        docs.select(field(key).alias("_key"), F.coalesce(field(text), F.lit("")).alias("_text")).select(
            "_key", F.xxhash64("_text").alias("text_hash"), fingerprint("_text").alias("_f")).select("_key", "text_hash", "_f.lo", "_f.hi"),
        "near-prints")
    distinct = materialise(prints.groupBy("lo", "hi").agg(F.min("_key").alias("_first")), "near-distinct")
    roots = components(near_links(distinct.select("lo", "hi"))).select(
        F.col("node.lo").alias("_lo"), F.col("node.hi").alias("_hi"), "root")
    named = distinct.join(roots, (distinct["lo"] == roots["_lo"]) & (distinct["hi"] == roots["_hi"]), "left").select(
        "lo", "hi", "_first", F.coalesce("root", F.struct("lo", "hi")).alias("_root"))
    heads = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    member = named.join(heads, "_root").select("lo", "hi", "component_id")
    rows = prints.groupBy("_key", "text_hash", "lo", "hi").agg(F.count("*").alias("copies"))
    return rows.join(member, ["lo", "hi"]).select(F.col("_key").alias(key), "text_hash", "copies", "component_id")

"""SimHash near-duplicates: a hierarchical index over fingerprints in Gray order, and the components of its links.

Distinct fingerprints are dealt to groups so that fingerprints within three bits share at least one: two of
four blocks, the second taken inside the other three, must agree (16 groups of 28 bits each). Inside a group
they are sorted by Gray rank, which puts fingerprints of few differing bits side by side. Runs of eight become
nodes; a node keeps the bits on which all below agree and hands them down no further, so each level tests only
bits that are new. A search adds up the differences on its way down: past the radius a whole node is pruned, and
where even the undecided bits cannot exceed the radius a whole node is linked without a look at its members.

Searches of a group run together as arrays. Each group gives back a forest, at most one link per
fingerprint, never its pairs. Copies are one fingerprint, and a ball of few bits holds a bounded number of distinct ones, so a
group stays small however many documents are near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import simhash
from hindcast.llm.columns import field, pack, packed, unpack
from hindcast.sources.scratch import materialise

RADIUS = 3
FANOUT = 8
FRONTIER = 1 << 20
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def group_masks() -> list[int]:
    """28-bit group keys: one 16-bit block, and one of the four 12-bit parts of what remains."""
    masks = []
    for b in range(4):
        rest = [i for i in range(64) if i // 16 != b]
        for part in range(4):
            bits = [*range(16 * b, 16 * b + 16), *rest[12 * part : 12 * part + 12]]
            mask = sum(1 << i for i in bits)
            masks.append(mask - ((mask >> 63) << 64))
    return masks


class _Level:
    def __init__(self, mask, value, fresh, first_leaf, last_leaf, group, first_child, n_children):
        self.mask, self.value, self.fresh = mask, value, fresh
        self.first_leaf, self.last_leaf, self.group = first_leaf, last_leaf, group
        self.first_child, self.n_children = first_child, n_children


def build(values: np.ndarray, group: np.ndarray) -> list[_Level]:
    """Levels from the leaves to one root per group; values sorted by (group, Gray rank)."""
    n = len(values)
    every = np.arange(n)
    none = np.zeros(n, np.int64)
    levels = [_Level(np.full(n, FULL), values, None, every, every + 1, group, none, none)]
    while True:
        low = levels[-1]
        starts_group = np.ones(len(low.group), bool)
        starts_group[1:] = low.group[1:] != low.group[:-1]
        if starts_group.all():
            break
        head = np.maximum.accumulate(np.where(starts_group, np.arange(len(low.group)), 0))
        cut = np.flatnonzero((np.arange(len(low.group)) - head) % FANOUT == 0)
        counts = np.diff(np.append(cut, len(low.group)))
        lead = np.repeat(low.value[cut], counts)
        differ = np.bitwise_or.reduceat(low.value ^ lead, cut)
        mask = np.bitwise_and.reduceat(low.mask, cut) & ~differ
        low.fresh = low.mask & ~np.repeat(mask, counts)
        levels.append(_Level(
            mask, low.value[cut] & mask, None, low.first_leaf[cut], low.last_leaf[cut + counts - 1], low.group[cut], cut, counts))
    levels[-1].fresh = levels[-1].mask
    return levels


def links(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs that connect whatever lies within `radius`, inside each group (a spanning set, not all pairs)."""
    levels = build(values, group)
    roots = levels[-1]
    root_of = np.searchsorted(roots.first_leaf, np.arange(len(values)), side="right") - 1
    size = (roots.last_leaf - roots.first_leaf)[root_of]
    out_a, out_b, whole = [], [], []
    at = 0
    while at < len(values):
        # Queries at once: as many as keep even an unpruned frontier small; one at least.
        load = np.cumsum(size[at : at + FRONTIER])
        last = at + max(1, int(np.searchsorted(load, FRONTIER, side="right")))
        query = np.arange(at, last)
        node, spent = root_of[at:last], np.zeros(len(query), np.int64)
        at = last
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            differ = (values[query] ^ level.value[node]) & level.fresh[node]
            spent = spent + np.bitwise_count(differ)
            live = (spent <= radius) & (level.last_leaf[node] > query + 1)  # links go to later leaves
            query, node, spent = query[live], node[live], spent[live]
            if depth == 0:
                out_a.append(query)
                out_b.append(node)
                break
            sure = (spent + np.bitwise_count(~level.mask[node]) <= radius) & (level.first_leaf[node] > query)
            if sure.any():
                out_a.append(query[sure])
                out_b.append(level.first_leaf[node[sure]])
                whole.append(np.unique(np.stack([level.first_leaf[node[sure]], level.last_leaf[node[sure]]]), axis=1))
                query, node, spent = query[~sure], node[~sure], spent[~sure]
            children = level.n_children[node]
            query, spent = np.repeat(query, children), np.repeat(spent, children)
            first = np.repeat(level.first_child[node] - (np.cumsum(children) - children), children)
            node = first + np.arange(len(first))
    if whole:  # members of a node linked as a whole: each to the next
        step = np.zeros(len(values) + 1, np.int64)
        for a, b in whole:
            np.add.at(step, a, 1)
            np.add.at(step, b - 1, -1)
        chained = np.flatnonzero(np.cumsum(step)[:-1] > 0)
        out_a.append(chained)
        out_b.append(chained + 1)
    return np.concatenate(out_a), np.concatenate(out_b)


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node in its component: hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _forest(groups: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Links (value, smallest value of its component in the group) of all groups with two members or more."""
    order = np.lexsort((gray_rank(values), groups))
    groups, values = groups[order], values[order]
    together = np.zeros(len(groups), bool)
    same = groups[1:] == groups[:-1]
    together[1:] |= same
    together[:-1] |= same
    groups, values = groups[together], values[together]
    if len(values):
        a, b = links(values, groups)
        root = smallest_reachable(len(values), a, b)
        child = np.flatnonzero(root != np.arange(len(values)))
        pairs = np.unique(np.stack([values[child], values[root[child]]]), axis=1) if len(child) else np.zeros((2, 0), np.uint64)
    else:
        pairs = np.zeros((2, 0), np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], ["a", "b"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; the last group of a batch waits for the next batch."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    for batch in batches:
        group = np.concatenate([held[0], batch.column("group").to_numpy(zero_copy_only=False)])
        value = np.concatenate([held[1], batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(group):
            continue
        cut = int(np.searchsorted(group, group[-1]))
        held = (group[cut:], value[cut:])
        if cut:
            yield _forest(group[:cut], value[:cut])
    if len(held[0]):
        yield _forest(*held)


def near_links(fingerprints: DataFrame) -> DataFrame:
    """(a, b), a != b: links that join exactly the fingerprints connected by steps of up to RADIUS bits."""
    spark = fingerprints.sparkSession
    masks = F.array(*[F.lit(m) for m in group_masks()])
    dealt = fingerprints.select("fingerprint", F.posexplode(masks).alias("_t", "_m")).select(
        "fingerprint", F.xxhash64(F.col("_t"), F.col("fingerprint").bitwiseAND(F.col("_m"))).alias("group"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_search, "a bigint, b bigint")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the smallest node it reaches.

    Alternating large-star and small-star steps: each is a minimum per node and a join, and the number of edges never
    grows. Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        now = materialise(
            small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "stars")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, text_hash, copies, fingerprint, component_id): one row per distinct (key, text).

    `component_id` is the smallest key reachable over links of up to RADIUS differing bits. Null or empty text: fingerprint
    0, linked like any other. Null key: a document that is never the smallest, unless all are null. Repeated rows: one row,
    counted in `copies`. Empty table: no rows.
    """
    seen = docs.select(
        field(key).alias("_key"), F.xxhash64(F.coalesce(field(text), F.lit(""))).alias("text_hash"),
        simhash.ascii_lower(field(text)).alias("_text"))
    prints = materialise(simhash.fingerprints(seen, ["_key", "text_hash"], "_text", shingle=shingle), "simhash")
    distinct = prints.groupBy("fingerprint").agg(F.min("_key").alias("_first"))
    roots = components(near_links(distinct.select("fingerprint")))
    named = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root"))
    heads = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    member = named.join(heads, "_root").select("fingerprint", "component_id")
    return prints.join(member, "fingerprint").select(
        F.col("_key").alias(key), "text_hash", "copies", "fingerprint", "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", search=near_duplicates) -> DataFrame:
    """The rows of `docs`, one of each component: the smallest key (then text hash); a repeated row stays once.

    `search` names the components: a function like `near_duplicates`.
    """
    found = search(docs, key=key, text=text).withColumnRenamed(key, "_k")
    best = found.groupBy("component_id").agg(
        F.min(F.struct(F.col("_k").isNull().alias("n"), F.col("_k").alias("k"), F.col("text_hash").alias("h"))).alias("b"))
    chosen = best.select(F.col("b.k").alias("_bk"), F.col("b.h").alias("_h")).join(
        found, F.col("_bk").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("text_hash"))).select(
        "_bk", "_h", F.col("copies").alias("_copies"))
    staged = pack(docs).select("_doc", packed(key).alias("_key"), F.xxhash64(F.coalesce(packed(text), F.lit(""))).alias("_own"))
    kept = staged.join(chosen, F.col("_key").eqNullSafe(F.col("_bk")) & (F.col("_own") == F.col("_h")))
    once = kept.filter("_copies = 1").select("_doc")
    many = kept.filter("_copies > 1").dropDuplicates(["_bk", "_h"]).select("_doc")
    return unpack(once.unionByName(many), docs.columns)

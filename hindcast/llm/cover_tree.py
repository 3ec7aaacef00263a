"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors become whole numbers floor(256 x), so scores are exact. Queries and data are indexed together: both go to the
nearest of a few hundred pivots, far from each other, which are the top level of one cover tree. Below a pivot, data lie in cells of
bounded size and queries in blocks of bounded size; a task builds the lower levels of both trees and searches them
against each other. For a query node (centre q, radius r) and a data node (centre p, radius s) no pair below can score over

    <q, p> + r |p| + s |q| + r s,

so the pair of nodes is dropped when that lies below the worst k-th score of the queries under the query node.

Two rounds: every query first meets the cells of its own pivot, which gives each a k-th score to beat. Then the same bound, with
the pivots as nodes, decides which other pivots a block of queries has to meet at all; the rest of the search starts from
the scores of the first round. Bounds only ever drop pairs that cannot matter, whatever the data look like.

Of equal vectors only the k + 1 smallest ids can be among the k best of anything, so hot vectors shrink before any shuffle, and
equal queries are searched once. A cell and a block of queries are all a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.columns import field
from hindcast.llm.vectors import matrix, usual_length, whole_numbers
from hindcast.sources.scratch import materialise

SCALE, BITS = 256, 26
K = 5
CELL = 4096      # data vectors that a task holds
BLOCK = 1024     # queries that a task holds
PIVOTS = 256     # at most
SAMPLE = 2048    # vectors among which pivots are looked for
SHRINK = 0.5     # a child's reach against its parent's
LEAF = 16
LEADS = 64
WIDE = 1024      # data nodes met at once
TASKS = 8192     # at most
LOWEST = -(1 << 62)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers (rows of a, rows of b): by float products while those are exact."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 1 << 53:
        return a.astype(float) @ b.astype(float).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.astype(np.int64), a.astype(np.int64))


class CoverTree:
    """Rows of whole numbers in nested balls: each node has a centre (a row), the exact radius around it, and children.

    A child's centre lies further than the node's reach times SHRINK from the other children's centres, and its rows within that;
    the first child has its parent's centre. Small nodes have their rows as children at once.
    Rows are reordered so that those under a node stand together: `rows[low[v]:high[v]]`.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.square = squares(points)
        self.norm = np.sqrt(self.square.astype(float))
        everything = np.arange(len(points))
        gaps = self._gaps(everything[:1], everything)[0]
        self.centre, self.radius = [0], [float(gaps.max())]
        self.first, self.last, self.up = [0], [0], [-1]
        waiting = [(0, everything, gaps)]
        at = 0
        while at < len(waiting):
            node, rows, gaps = waiting[at]
            waiting[at] = None
            at += 1
            if len(rows) == 1:
                continue
            self.first[node] = len(self.centre)
            for child, members, apart in self._children(self.centre[node], rows, gaps):
                self.centre.append(child)
                self.radius.append(float(apart.max()))
                self.first.append(0)
                self.last.append(0)
                self.up.append(node)
                waiting.append((len(self.centre) - 1, members, apart))
            self.last[node] = len(self.centre)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.first, self.last = np.array(self.first), np.array(self.last)
        self.single = self.last == self.first
        size = self.single.astype(np.int64)
        for v in range(len(size) - 1, 0, -1):
            size[self.up[v]] += size[v]
        self.low = np.zeros(len(size), np.int64)
        for v in np.flatnonzero(~self.single):
            kids = slice(self.first[v], self.last[v])
            self.low[kids] = self.low[v] + np.concatenate([[0], np.cumsum(size[kids])[:-1]])
        self.high = self.low + size
        self.rows = np.empty(len(points), np.int64)
        self.rows[self.low[self.single]] = self.centre[self.single]

    def _gaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between rows a and rows b."""
        between = dots(self.points[a], self.points[b])
        return np.sqrt(np.maximum((self.square[a][:, None] + self.square[b][None, :] - 2 * between).astype(float), 0.0))

    def _children(self, centre: int, rows: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        reach = float(gaps.max()) * SHRINK
        if len(rows) <= LEAF or reach == 0:
            for row in rows:
                yield int(row), np.array([row]), np.zeros(1)
            return
        near = gaps <= reach
        yield centre, np.concatenate([[centre], rows[near & (rows != centre)]]), np.concatenate([[0.0], gaps[near & (rows != centre)]])
        rest = rows[~near]
        while len(rest):
            leads = rest[:LEADS]
            apart = self._gaps(leads, rest)
            left = np.ones(len(rest), bool)
            for i, lead in enumerate(leads):
                if left[i]:
                    taken = left & (apart[i] <= reach)
                    yield int(lead), rest[taken], apart[i][taken]
                    left &= ~taken
            rest = rest[left]


class Best:
    """The k best (score, id) of each query, by falling score, then rising id; `floor` is a score known to be reached k times."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3] * len(floor)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= kth
            scores, ids, same = scores[keep], ids[keep], same[keep]
        old = self.found[query]
        scores, ids, same = np.concatenate([old[0], scores]), np.concatenate([old[1], ids]), np.concatenate([old[2], same])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[query] = scores[order], ids[order], same[order]
        if len(order) == self.k:
            self.floor[query] = max(self.floor[query], scores[order[-1]])


def dual_search(queries: CoverTree, data: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Offer every data row that may be among the best to every query; returns how many pairs of rows were scored."""
    scored = 0

    def floors(nodes: np.ndarray) -> np.ndarray:
        """Worst k-th score under each query node."""
        out = best.floor[queries.centre[nodes]].astype(float)
        for i in np.flatnonzero(~queries.single[nodes]):
            out[i] = best.floor[queries.rows[queries.low[nodes[i]] : queries.high[nodes[i]]]].min()
        return out

    stack = [(np.array([0]), 0, np.array([np.inf]))]
    while stack:
        nodes, node, bounds = stack.pop()
        nodes = nodes[bounds >= floors(nodes)]
        if not len(nodes):
            continue
        open_ = nodes[~queries.single[nodes]]
        nodes = np.concatenate([nodes[queries.single[nodes]], *[np.arange(queries.first[v], queries.last[v]) for v in open_]])
        kids = np.array([node]) if data.single[node] else np.arange(data.first[node], data.last[node])
        q = queries.centre[nodes]
        r, q_norm = queries.radius[nodes][:, None], queries.norm[q][:, None]
        deeper = []
        for at in range(0, len(kids), WIDE):
            part = kids[at : at + WIDE]
            p = data.centre[part]
            score = dots(queries.points[q], data.points[p])
            s, p_norm = data.radius[part][None, :], data.norm[p][None, :]
            bound = score + r * p_norm + s * q_norm + r * s
            bound = bound + 1e-9 * np.abs(bound) + 1e-3  # rounding never drops a pair
            flat_q, flat_p = np.flatnonzero(queries.single[nodes]), np.flatnonzero(data.single[part])
            if len(flat_q) and len(flat_p):
                scored += len(flat_q) * len(flat_p)
                exact = score[np.ix_(flat_q, flat_p)].astype(np.int64)
                rows = q[flat_q]
                hit = exact >= best.floor[rows][:, None]
                p_ids, p_square = ids[p[flat_p]], data.square[p[flat_p]]
                for i in np.flatnonzero(hit.any(axis=1)):
                    h, row = hit[i], rows[i]
                    best.offer(row, exact[i][h], p_ids[h], ((exact[i][h] == p_square[h]) & (p_square[h] == queries.square[row])).astype(np.int64))
            worst = floors(nodes)
            alive = bound >= worst[:, None]
            alive[np.ix_(flat_q, flat_p)] = False
            for c in np.flatnonzero(alive.any(axis=0)):
                deeper.append((nodes[alive[:, c]], int(part[c]), bound[alive[:, c], c]))
        deeper.sort(key=lambda x: x[2].max())  # the most promising is popped first
        stack.extend(deeper)
    return scored


def _search(k: int):
    """Rows (cell, kind, block, id, floor, x), data before queries in each cell: the k best of each query in the cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = block = tree = ids = None
        data: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal tree, ids, data, asked
            if asked and (data or tree is not None):
                if tree is None:
                    ids = np.concatenate([d[0] for d in data])
                    tree, data = CoverTree(np.concatenate([d[1] for d in data])), []
                names = np.concatenate([a[0] for a in asked])
                best = Best(np.concatenate([a[1] for a in asked]), k)
                dual_search(CoverTree(np.concatenate([a[2] for a in asked])), tree, ids, best)
                sizes = [len(f[0]) for f in best.found]
                found = [np.concatenate([f[i] for f in best.found]) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, sizes)), pa.array(found[0]), pa.array(found[1]), pa.array(found[2] == 1)],
                    ["qid", "score", "vec_id", "same"])
            asked = []

        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            blocks = batch.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0) | (np.diff(blocks) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if low == high:
                    continue
                if (cells[low], blocks[low]) != (cell, block):
                    yield from answers()
                    if cells[low] != cell:
                        tree, ids, data = None, None, []
                    cell, block = cells[low], blocks[low]
                part = batch.slice(low, high - low)
                name, x = part.column("id").to_numpy(), matrix(part.column("x"))
                if kinds[low]:
                    asked.append((name, part.column("floor").to_numpy(), x))
                else:
                    data.append((name, x))
        yield from answers()

    return run


def far_apart(points: np.ndarray, wanted: int) -> np.ndarray:
    """Up to `wanted` rows of `points`, each the one furthest from those before it; copies of a chosen row are never chosen."""
    chosen = [0]
    square = squares(points).astype(float)
    gap = square + square[0] - 2 * dots(points, points[:1])[:, 0]
    while len(chosen) < wanted and gap.max() > 0:
        i = int(gap.argmax())
        chosen.append(i)
        gap = np.minimum(gap, square + square[i] - 2 * dots(points, points[i : i + 1])[:, 0])
    return points[chosen]


def _nearest(pivots: np.ndarray):
    """(number, distance) of the nearest pivot; of equally near ones the first."""
    square = squares(pivots)

    @F.arrow_udf("struct<pivot: int, gap: double>")
    def nearest(rows: pa.Array) -> pa.Array:
        x = matrix(rows)
        apart = square[None, :] + squares(x)[:, None] - 2 * dots(x, pivots) if len(x) else np.zeros((0, len(pivots)))
        at = apart.argmin(axis=1)
        gap = np.sqrt(np.maximum(apart[np.arange(len(x)), at].astype(float), 0.0))
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(gap)], ["pivot", "gap"])

    return nearest


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)


def _deal(members: Column, size: Column, most: int) -> Column:
    """Which of ceil(size / most) parts of its pivot a row falls into."""
    return F.pmod(F.xxhash64(members), F.ceil(size / most)).cast("int")


def top_k(
    queries: DataFrame, data: DataFrame, *, k: int = K, key: str = "vec_id", vector: str = "embedding", cell: int = CELL, block: int = BLOCK,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `data` with the highest inner product of floor(256 x).

    Equal scores go to the smaller id. A query never meets its own row: one with its id and its vector. Fewer than k rows: all of them.
    Left out on both sides: vectors that are null, empty, hold null or non-finite entries or entries of 2^26 or more once scaled, vectors of
    another length than most of `data` (of equally frequent lengths the larger counts), and rows with a null id. Repeated
    rows (same id, same vector) count once; an id with several vectors is a row for each. Empty tables: no rows. Other columns play no part,
    whatever their names.
    """
    spark = data.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        return df.select(field(key).cast("long").alias("id"), whole_numbers(field(vector), SCALE, BITS).cast("array<int>").alias("x")).filter(
            "id is not null and x is not null")

    dims = usual_length(usable(data), "x")
    rows = usable(data).filter(F.size("x") == dims).distinct()
    copies = Window.partitionBy("x").orderBy("id")
    points = materialise(rows.withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k + 1).drop("_r"), "cover-points")
    wanted = usable(queries).filter(F.size("x") == dims).distinct()
    asked = materialise(wanted.select("x").distinct().withColumn("id", F.monotonically_increasing_id()), "cover-queries")

    total = points.count()
    sample = [r.x for r in points.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    tops = far_apart(np.array(sample, np.int64), min(pivots, 2 * (total // cell) + 4))
    place = _nearest(tops)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_p", place("x")).select("id", "x", "_p.pivot", "_p.gap")

    points, asked = materialise(placed(points), "cover-data"), materialise(placed(asked), "cover-asked")
    # One row per pivot: at most PIVOTS of them.
    groups = {r.pivot: r for r in points.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("reach")).collect()}
    counts = {r.pivot: r.n for r in asked.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = [-(-groups[g].n // cell) if g in groups else 0 for g in range(len(tops))]
    firsts = np.concatenate([[0], np.cumsum(shards)]).tolist()

    tasks = min(2 * firsts[-1], TASKS)  # left to itself, the engine would merge small partitions into few long tasks

    def of_pivot(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("pivot"))

    cells = points.select(
        (of_pivot(firsts[:-1], "int") + _deal(F.col("id"), of_pivot([groups[g].n if g in groups else 1 for g in range(len(tops))], "long"), cell)).alias("cell"),
        F.lit(0).alias("kind"), F.lit(-1).alias("block"), "id", F.lit(LOWEST).cast("long").alias("floor"), "x")
    # Blocks are numbered over all pivots, so that a block is one node.
    blocks = np.concatenate([[0], np.cumsum([-(-counts.get(g, 0) // block) for g in range(len(tops))])]).tolist()
    asked = asked.withColumn("block", of_pivot(blocks[:-1], "int") + _deal(
        F.col("id"), of_pivot([counts.get(g, 1) for g in range(len(tops))], "long"), block))

    def meet(visits: DataFrame, name: str) -> DataFrame:
        """`visits`: queries with the cells that they go to."""
        sent = visits.select(F.explode("cells").alias("cell"), F.lit(1).alias("kind"), "block", "id", "floor", "x")
        together = cells.unionByName(sent).repartition(tasks, "cell").sortWithinPartitions("cell", "kind", "block")
        return materialise(together.mapInArrow(_search(k + 1), "qid bigint, score bigint, vec_id bigint, same boolean"), name)

    own = F.when(of_pivot(shards, "int") > 0, F.sequence(of_pivot(firsts[:-1], "int"), of_pivot(firsts[1:], "int") - 1))
    near = meet(asked.select("id", "x", "block", F.lit(LOWEST).cast("long").alias("floor"), own.alias("cells")), "cover-near")
    reached = _ranked(near, k + 1).groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_s"))
    floors = reached.filter(F.col("_n") == k + 1).select("qid", F.col("_s").alias("floor"))

    norm = np.sqrt(squares(tops).astype(float))
    between = dots(tops, tops).astype(float)
    reach = np.array([groups[g].reach if g in groups else 0.0 for g in range(len(tops))])
    there = np.array([g in groups for g in range(len(tops))])

    @F.arrow_udf("array<int>")
    def elsewhere(pivot: pa.Array, radius: pa.Array, worst: pa.Array) -> pa.Array:
        """Cells of the other pivots that a block of queries has to meet."""
        out = []
        for g, r, low in zip(pivot.to_pylist(), radius.to_pylist(), worst.to_pylist(), strict=True):
            bound = between[g] + r * norm + reach * norm[g] + r * reach
            alive = there & (bound + 1e-9 * np.abs(bound) + 1e-3 >= low)
            alive[g] = False
            out.append([c for h in np.flatnonzero(alive) for c in range(firsts[h], firsts[h + 1])])
        return pa.array(out, pa.list_(pa.int32()))

    known = asked.join(floors, asked["id"] == floors["qid"], "left").select(
        "id", "x", "pivot", "gap", "block", F.coalesce("floor", F.lit(LOWEST)).alias("floor"))
    nodes = known.groupBy("block").agg(
        F.first("pivot").alias("_p"), F.max("gap").alias("_radius"), F.min("floor").alias("_worst")).select(
        F.col("block").alias("_b"), elsewhere("_p", "_radius", "_worst").alias("cells"))
    far = meet(known.join(nodes, known["block"] == nodes["_b"]).select("id", "x", "block", "floor", "cells"), "cover-far")

    best = _ranked(near.unionByName(far), k + 1).groupBy("qid").agg(F.collect_list(F.struct("score", "vec_id", "same")).alias("_best"))
    named = asked.select(F.col("id").alias("_q"), F.col("x").alias("_x")).join(best, F.col("_q") == F.col("qid"))
    # Each query id takes the list of its vector without its own row.
    each = wanted.join(named, wanted["x"] == named["_x"]).select(
        F.col("id").alias("query_id"), F.filter("_best", lambda b: ~(b["same"] & (b["vec_id"] == F.col("id")))).alias("_best"))
    ordered = F.array_sort("_best", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(
        a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0))
    return each.select("query_id", F.posexplode(F.slice(ordered, 1, k)).alias("_at", "_b")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), "_b.vec_id", "_b.score")

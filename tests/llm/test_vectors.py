"""Whitening and exact top-k search beside brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hindcast.llm import cover_tree, queries, whitening

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


ODD = [
    (1, None), (2, []), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [1.0, float("inf"), 2.0]), (6, [1.0, 2.0]),
    (None, [0.5, -0.25, 3.0]), (7, [0.5, -0.25, 3.0]), (7, [0.5, -0.25, 3.0]), (8, [-0.0, 0.0, 1.0]), (9, [1e-9, -1e-9, 2.0]), (10, [1e30, 0.0, 0.0]),
    (11, [2.5, 1.5, -1.0]), (12, [0.1, 0.7, 0.3]),
]


def numbers(embedding, scale, offset=0):
    return [math.floor(scale * float(np.float32(c))) + offset for c in embedding]


def whitened_by_hand(rows):
    """{vec_id: (deviation, whitened)}, n, explained of plain rows, by exact integers and one eigendecomposition."""
    xs = [(k, numbers(e, 64, 1_000_000)) for k, e in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, dims = len(fit), len(fit[0])
    total = [sum(x[i] for x in fit) for i in range(dims)]
    cov = np.array([[sum((n * x[i] - total[i]) * (n * x[j] - total[j]) for x in fit) / n**3 for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:16]
    out = []
    for k, x in xs:
        apart = [n * a - b for a, b in zip(x, total)]
        out.append((k, sum(a * a for a in apart), (np.array(apart) / n) @ vectors[:, order] / np.sqrt(values[order])))
    return out, n, values[order] / np.trace(cov)


def test_cross_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high in ((-40, 40), (0, 1), (-(1 << 30), 1 << 30), (-(1 << 45), 1 << 45)):
        values = rng.integers(low, high, (333, 5))
        exact = values.astype(object).T @ values.astype(object)
        assert (whitening.cross_products(values) == exact).all()


def test_whitening_query_equals_brute_force(spark):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expected, n, explained = whitened_by_hand(given)
    got = {}
    for r in queries.op11_embedding_whitening(spark, SF).collect():
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        got.setdefault(r.vec_id, (r.deviation, {}))[1][r.component] = r.whitened
    assert len(got) == len(given)
    signs = None
    for k, deviation, white in expected:
        assert got[k][0] == deviation and sorted(got[k][1]) == list(range(1, 17))
        mine = np.array([got[k][1][c] for c in range(1, 17)])
        signs = np.sign(mine * white) if signs is None else signs
        assert np.allclose(mine, signs * white, atol=1e-8)


def test_whitening_of_odd_rows(spark):
    df = frame(spark, ODD).selectExpr("*", "'own' as white", "'own' as x")
    rows, model, error = whitening.whiten(df)
    kept = [(k, e) for k, e in ODD if e and len(e) == 3 and all(c is not None and math.isfinite(c) and abs(c) < 1e13 for c in e)]
    expected, n, _ = whitened_by_hand(kept)
    got = rows.collect()
    assert model.n == n and error < 1e-9 and rows.columns == ["vec_id", "embedding", "x", "white"]
    assert sorted((str(r.vec_id), int(r.white.deviation)) for r in got) == sorted((str(k), d) for k, d, _ in expected)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance(spark, rows):
    out, model, error = whitening.whiten(frame(spark, rows))
    assert [r.white.whitened for r in out.collect()] == [[]] * sum(e is not None for _, e in rows)
    assert len(model.eigenvalues) == 0 and error == 0.0


def nearest_by_hand(queries_, data, k):
    """{(query id, rank): (vec id, score)} over distinct (id, vector) rows."""
    rows = sorted({(i, tuple(numbers(e, 256))) for i, e in data})
    asked = sorted({(i, tuple(numbers(e, 256))) for i, e in queries_})
    out = []
    for i, q in asked:
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in rows if (j, x) != (i, q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def usable(rows, dims):
    return [(i, e) for i, e in rows if i is not None and e and len(e) == dims and all(c is not None and abs(c) < 1e4 for c in e)]


def answers(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_cover_tree_is_nested_covering_and_separated():
    points = np.random.default_rng(2).integers(-300, 300, (700, 3))
    tree = cover_tree.CoverTree(points)
    assert sorted(tree.rows) == list(range(700)) and (tree.high - tree.low)[0] == 700
    for v in np.flatnonzero(~tree.single):
        under = tree.rows[tree.low[v] : tree.high[v]]
        gaps = np.linalg.norm(points[under] - points[tree.centre[v]], axis=1)
        assert gaps.max() == pytest.approx(tree.radius[v])
        kids = np.arange(tree.first[v], tree.last[v])
        assert tree.centre[v] in tree.centre[kids] and (tree.radius[kids] <= tree.radius[v]).all()
        if tree.high[v] - tree.low[v] > cover_tree.LEAF:
            apart = np.linalg.norm(points[tree.centre[kids]][:, None] - points[tree.centre[kids]][None], axis=2)
            assert (apart[~np.eye(len(kids), dtype=bool)] > tree.radius[v] * cover_tree.SHRINK).all()


@pytest.mark.parametrize("spread", [4, 400, 1 << 25])
def test_dual_search_equals_brute_force_and_prunes(spread):
    rng = np.random.default_rng(spread)
    middles = rng.integers(-spread, spread, (30, 4))
    data = middles[rng.integers(0, 30, 2000)] + rng.integers(-3, 4, (2000, 4))
    asked = data[::40]
    ids = rng.permutation(2000)
    best = cover_tree.Best(np.full(len(asked), cover_tree.LOWEST), 6)
    scored = cover_tree.dual_search(cover_tree.CoverTree(asked), cover_tree.CoverTree(data), ids, best)
    exact = asked @ data.T
    for i in range(len(asked)):
        order = np.lexsort((ids, -exact[i]))[:6]
        assert best.found[i][0].tolist() == exact[i][order].tolist() and best.found[i][1].tolist() == ids[order].tolist()
    assert spread == 4 or scored < exact.size / 3


def test_top_k_query_equals_brute_force(spark):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert answers(queries.op13_exact_top_k(spark, SF)) == nearest_by_hand([g for g in given if g[0] % 50 == 0], given, 5)


def test_top_k_of_odd_rows_ties_and_hot_vectors(spark):
    rng = np.random.default_rng(3)
    hot = [(i, [1.0, 2.0, 0.5]) for i in range(100, 160)]
    rows = ODD + hot + [(200 + i, [float(c) for c in rng.normal(size=3)]) for i in range(150)] + [(0, [0.0, 0.0, 0.0]), (50, [-1.0, 0.25, 0.25])] * 2
    df = frame(spark, rows).selectExpr("*", "'own' as x", "'own' as id", "'own' as cell", "1 as pivot")
    asked = df.filter("vec_id % 50 = 0 or vec_id = 7")
    kept = usable(rows, 3)
    expected = nearest_by_hand([r for r in kept if r[0] % 50 == 0 or r[0] == 7], kept, 5)
    assert answers(cover_tree.top_k(asked, df)) == expected
    assert answers(cover_tree.top_k(asked, df, cell=16, block=2, pivots=5)) == expected


@pytest.mark.parametrize("rows", [[], [(50, None)], [(50, [1.0, 2.0])], [(50, [1.0, 2.0]), (51, [3.0, -1.0])]])
def test_top_k_of_few_rows(spark, rows):
    df = frame(spark, rows)
    kept = usable(rows, 2)
    assert answers(cover_tree.top_k(df.filter("vec_id % 50 = 0"), df)) == nearest_by_hand([r for r in kept if r[0] % 50 == 0], kept, 5)

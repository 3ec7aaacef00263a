"""Work per row and memory of a task that must not grow with the table, the vectors or the groups."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hindcast.functions.text import tokenize
from hindcast.operators import blocks, dense, lexical, models, traces, uncertainty


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_norm_is_not_computed_again_for_every_component(spark):
    """Fails if the norm stands inside the division of a component (embed_backfill, 6 GB)."""
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<double>")
    out = df.select("id", dense.l2_normalise(F.col("v")).alias("v"))
    assert "/ greatest(" not in plan(out)
    assert {r["id"]: r["v"] for r in out.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}


def test_dense_cell_ranks_only_what_may_enter_the_top(monkeypatch):
    """Fails if every similarity of a cell is sorted (dense_topk, 6 GB)."""
    rng = np.random.default_rng(1)
    n, k = 3000, 5
    v = rng.integers(-3, 4, (n, 8)).astype(float)  # many ties
    v[7] = np.nan
    docs = pa.table({"number": np.arange(n), "created": np.arange(n), "vector": v.tolist()})
    at = np.array([0, 3, 8, 1500, 2999])
    excluded = [[], [1], [2, 4], [], [5]]
    asked = pa.table({"q": at, "as_of": at, "excluded": pa.array(excluded, pa.list_(pa.int64())), "vector": v[at].tolist()})
    sorted_sizes = []
    lexsort = np.lexsort

    def counted(keys, axis=-1):
        sorted_sizes.append(np.size(keys[0]))
        return lexsort(keys, axis=axis)

    monkeypatch.setattr(np, "lexsort", counted)
    monkeypatch.setattr(dense, "STRIP", 500)
    got = dense._cell(k, "number")(asked, docs).to_pylist()
    assert sum(sorted_sizes) < len(at) * n / 4
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), dense.NORM_FLOOR)
    want = []
    for q, out in zip(at, excluded, strict=True):
        sims = np.round(unit[:q] @ unit[q], dense.SIM_DIGITS)
        best = sorted((-s, i) for i, s in enumerate(sims) if i not in out and not np.isnan(s))[:k]
        want += [(q, i, -s) for s, i in best]
    assert [(r["q"], r["number"]) for r in got] == [(q, i) for q, i, _ in want]
    assert np.allclose([r["score"] for r in got], [s for *_, s in want], atol=2e-9)


def test_weights_of_an_item_are_drawn_once_for_all_its_groups(spark):
    """Fails if rows of an item lie in several tasks, each drawing its weights (consistency_report, deltas_table, gate_check, 6 GB)."""
    rows = [(i, g, float(i % 3)) for g in ("a", "b", "c") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(5)
    out = uncertainty.resample_totals(df, "id", {"x": F.col("x")}, ["g"], resamples=20, seed="s")
    assert "RepartitionByExpression [_k" in plan(out)
    draws = uncertainty.poisson_weights([str(i) for i in range(40)], 20, "s")
    want = draws.T @ np.array([i % 3 for i in range(40)], float)
    got = {(r["g"], r["r"]): r["x"] for r in out.collect()}
    assert all(np.isclose(got[g, r + 1], want[r]) for g in "abc" for r in range(20)) and got["a", 0] == 39.0


def test_memory_of_a_resampling_task_is_bounded():
    """Fails if a task holds the draws of thousands of items (cascade_report, significant, scorecard, 6 GB)."""
    n = 2048
    batch = pa.RecordBatch.from_pydict({"_k": [str(i) for i in range(n)], "_w": np.ones(n), "x": np.ones(n)})
    tracemalloc.start()
    list(uncertainty._totals([], ["x"], 200, "0", False)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6


def test_near_repeats_meet_in_cells_without_words_beside_pairs(spark, monkeypatch):
    """Fails if the words of both sets are sent with every candidate pair (near_repeat_queries, 1 GB)."""
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 2}", i, [str(w) for w in rng.choice(16, rng.integers(0, 9), replace=False)]) for i in range(120)]
    rows += [("g0", 200 + i, ["a", "b", "c", f"u{i}"]) for i in range(30)]  # a family of near copies
    rows += [("g0", 7, ["a", "b", "c", "v"]), ("g0", 7, ["a", "b", "c", "v"]), ("g0", None, ["a", "b", "c", "v"]), (None, 1, ["a"]), (None, 2, ["a"]),
             ("g1", 300, None)]
    df = spark.createDataFrame(rows, "g string, seq long, words array<string>").repartition(3)

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5

    known = [(g, s, ws) for g, s, ws in rows if g and s is not None and ws]
    want = sorted((g, s) for g, s, ws in known if any(g == h and t < s and alike(ws, vs) for h, t, vs in known))
    code = traces.word_code
    for chunk, matches, collide in ((4_096, 1 << 20, False), (8, 5, False), (30, 1 << 20, True)):
        monkeypatch.setattr(traces, "LEAST_CHUNK", chunk)
        monkeypatch.setattr(traces, "MOST_CHUNK", chunk)
        monkeypatch.setattr(traces, "MATCHES", matches)
        monkeypatch.setattr(traces, "word_code", lambda w, seed, c=collide: F.pmod(code(w, seed), F.lit(40)) if c and not seed else code(w, seed))
        out = traces.near_repeats(df, "g", "seq", "words")
        assert "array_intersect" not in plan(out)
        assert sorted((r["g"], r["seq"]) for r in out.collect() if r["seq"] is not None) == want


def test_norm_of_entries_is_computed_once_a_document(spark):
    """Fails if a document's norm is summed anew for each of its entries (tfidf_features and the classifiers, 1 GB)."""
    rows = [("a", 1, 2), ("b", 1, 1), ("a", 2, 1), ("b", 2, 1), ("c", 3, 1), ("c", 4, 3), ("once", 4, 1)]
    index = spark.createDataFrame(rows, "term string, number long, tf long")
    train = spark.createDataFrame([(1,), (2,), (3,), (4,)], "number long")
    out, size = models.tfidf_entries(index, train, "number")
    assert size == 3 and "/ sqrt(" not in plan(out).lower()
    got = {r["number"]: [e["w"] for e in r["entries"]] for r in out.collect()}
    a = 1 + np.log(2)  # a, b and c are equally rare
    assert np.allclose(sorted(got[1]), sorted([a / np.hypot(a, 1), 1 / np.hypot(a, 1)]))
    assert np.allclose(got[2], [0.5**0.5] * 2) and np.allclose(got[3], [1]) and np.allclose(got[4], [1])


def test_tokens_are_made_once(spark):
    """Fails if a filter on the number of tokens makes them a second time (tfidf_features, tfidf_neighbours, bm25_topk, 1 GB and 6 GB)."""
    docs = spark.createDataFrame([(1, 5, "One two two"), (2, 6, ""), (3, 7, None)], "number long, created long, text string").repartition(2, "number")
    once = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    posts = lexical.postings(docs, "number", "created", tokenize(F.col("text")))
    assert once(posts) and sorted(map(tuple, posts.collect())) == [("one", 1, 1, 3, 5), ("two", 1, 2, 3, 5)]
    asked = lexical.query_terms(docs.withColumnRenamed("number", "q"), "q", "created", tokenize(F.col("text")))
    assert once(asked) and sorted(map(tuple, asked.collect())) == [(1, 5, "one"), (1, 5, "two")]


def test_queries_by_term_numbers_travel_as_few_bytes(spark, monkeypatch):
    """Fails if strings and weights of a query's terms are sent to every shard (tfidf_neighbours and tune_threshold, 1 GB)."""
    rng, written = np.random.default_rng(6), {}
    words = [" ".join(f"w{int(60 * x * x)}" for x in rng.random(rng.integers(0, 40))).split() for _ in range(60)]
    words[7] = ["w1"] * 300 + ["w2"]  # frequencies of more than a byte
    words[9] = words[7]
    docs = spark.createDataFrame([(i, i // 2, w) for i, w in enumerate(words)], "number long, created long, tokens array<string>")
    train = spark.createDataFrame([(i,) for i in range(0, 60, 3)] + [(9,)], "number long")
    keep = blocks.materialise
    monkeypatch.setattr(blocks, "materialise", lambda frame, name: written.setdefault(name, keep(frame, name)))
    monkeypatch.setattr(blocks, "SHARD_DOCS", 8)
    found = {}
    for r in lexical.tfidf_neighbours(docs, train, "number", F.col("tokens"), 3).collect():
        found.setdefault(r["q"], []).append((-r["score"], r["number"]))
    assert {"packed", "norm"} <= set(written["index-queries"].columns) and "terms" not in written["index-queries"].columns
    fit = [set(words[i]) for i in {*range(0, 60, 3), 9} if words[i]]
    idf = {t: np.log((1 + len(fit)) / (1 + n)) + 1 for t in set().union(*fit) if (n := sum(t in s for s in fit)) > 1}

    def vector(ws):
        v = {t: (1 + np.log(ws.count(t))) * idf[t] for t in set(ws) if t in idf}
        return {t: x / np.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}

    vectors = [vector(ws) for ws in words]
    for q in {*range(0, 60, 3), 9}:
        scores = [(-round(sum(x * vectors[i].get(t, 0.0) for t, x in vectors[q].items()), 9), i) for i in range(60) if i // 2 < q // 2]
        want = sorted(s for s in scores if s[0] < 0)[:3]
        assert [i for _, i in sorted(found.get(q, []))] == [i for _, i in want]
        assert np.allclose([s for s, _ in sorted(found.get(q, []))], [s for s, _ in want], atol=2e-9)
    numbers = np.sort(rng.choice(1 << 28, 500, replace=False))
    batch = pa.RecordBatch.from_pydict({"q": [1], "terms": [numbers.tolist()], "weights": [[70_000] * 500]})
    row = next(blocks._packed(iter([batch]))).column("packed")[0].as_py()
    planes = np.frombuffer(row, np.uint8).reshape(8, -1)
    assert (np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel()) == numbers).all()
    assert (np.ascontiguousarray(planes[4:].T).view("<u4") == 70_000).all()

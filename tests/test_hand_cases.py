"""Small cases worked out by hand, and properties that must hold on any data."""

from __future__ import annotations

import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hindcast.functions import text as tx
from hindcast.functions.numeric import zero_failure_bound
from hindcast.operators import agreement, annotation, asof, blocks, dense, fusion, gate, lexical, scoring, silver, spend, traces, uncertainty
from hindcast.operators.ordering import counts_before, running_totals


def one(df):
    return df.collect()[0]


def items(spark, rows):
    """(id, gold labels, predicted labels, gold link, predicted link)"""
    schema = "id long, g_labels array<string>, p_labels array<string>, g_dup long, p_dup long"
    df = spark.createDataFrame(rows, schema)
    groups = F.map_from_arrays("g_labels", F.transform("g_labels", lambda _: F.lit("type")))
    return (
        df.withColumn("g_groups", groups).withColumn("human_triaged", F.lit(True)).withColumn("weight", F.lit(1.0))
        .withColumn("g_comp", F.lit(None).cast("string")).withColumn("p_comp", F.lit(None).cast("string"))
        .withColumn("p_cands", F.array().cast("array<string>")).withColumn("g_info", F.lit(False)).withColumn("p_info", F.lit(False)))


def test_multilabel_and_links(spark):
    rows = [
        (1, ["a", "b", "c"], ["a", "b"], 11, 11), (2, ["a"], ["a", "c"], 22, 22), (3, ["c"], ["c", "a"], None, 7),
        (4, [], ["b"], None, None), (5, ["b"], [], 33, 50)]
    scores = {r["metric"]: r["point"] for r in scoring.point_scores(items(spark, rows)).collect()}
    assert scores["t1_micro_f1"] == pytest.approx(8 / 13)
    assert scores["t1_macro_f1"] == pytest.approx(0.6)
    assert scores["t2_link_f1"] == pytest.approx(4 / 7)
    assert scores["t2_detect_f1"] == pytest.approx(6 / 7)
    # No component and no needs-info positives: undefined, not zero.
    assert scores["t3_accuracy"] is None and scores["t4_f1"] is None


def test_weighted_binary(spark):
    df = spark.createDataFrame([(True, True, 2.0), (True, False, 1.0), (False, True, 4.0)], "g boolean, p boolean, w double")
    counts = scoring.with_prf(df.agg(*scoring.binary_counts(F.col("g"), F.col("p"), F.col("w"))))
    assert one(counts)["f1"] == pytest.approx(4 / 9)


def test_percentile_and_bound(spark):
    df = spark.createDataFrame([(3.0,), (50.0,), (8.0,), (7.0,), (20.0,)], "v double")
    r = one(df.agg(uncertainty.percentile_linear(F.col("v"), 50).alias("a"), uncertainty.percentile_linear(F.col("v"), 95).alias("b")))
    assert (r["a"], r["b"]) == (8.0, pytest.approx(44.0))
    b = one(spark.range(1).select(zero_failure_bound(F.lit(50)).alias("n"), zero_failure_bound(F.lit(0)).alias("z")))
    assert b["n"] == pytest.approx(0.058, abs=1e-3) and b["z"] == 1.0


def test_kappa_is_null_when_chance_is_certain(spark):
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert one(agreement.cohen_kappa(same, "a", "b"))["kappa"] is None
    mixed = spark.createDataFrame([("y", "y"), ("y", "n"), ("n", "n"), ("n", "n")], "a string, b string")
    assert one(agreement.cohen_kappa(mixed, "a", "b"))["kappa"] == pytest.approx(0.5)
    scores = spark.createDataFrame([(1, 2), (2, 2), (3, 4), (4, 4)], "a int, b int")
    assert 0 < one(agreement.weighted_kappa(scores, "a", "b", (1, 2, 3, 4)))["qwk"] < 1
    with pytest.raises(Exception, match="outside the scale"):
        agreement.weighted_kappa(scores, "a", "b", (1, 2, 3)).collect()


def test_tokenize_takes_no_pass_for_single_characters(spark):
    df = spark.createDataFrame([("1abc 12ab3 x é_ _1 The a1 İS 2the ٣4 9 77",)], "t string").select(tx.tokenize(F.col("t")).alias("t"))
    assert one(df)["t"] == ["abc", "12", "ab3", "_1", "a1", "77"]
    assert df._jdf.queryExecution().analyzed().toString().count("filter(") == 1


def test_tokenize(spark):
    df = spark.createDataFrame([("asyncio.run 12ab The x_1 a 9",)], "t string")
    assert one(df.select(tx.tokenize(F.col("t")).alias("t")))["t"] == ["asyncio", "run", "12", "ab", "x_1"]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("*.js", "a/b.js", True), ("/docs/", "docs/x/y", True), ("/docs/", "a/docs/x", False), ("docs/*", "docs/a", True),
        ("docs/*", "docs/a/b", False), ("apps/", "x/apps/y", True), ("**/logs", "a/b/logs/c", True), ("/a/?.py", "a/b.py", True),
        ("a.b", "axb", False)])
def test_owner_patterns(spark, pattern, path, hit):
    import re

    assert bool(re.match(tx.owner_pattern_regex(pattern), path)) is hit


def test_active_mark_follows_time_order(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [
        (1, t(1), 1, 5, False), (1, t(2), 2, 6, False), (1, t(3), 3, 5, True),   # unmark of another: 6 stays
        (2, t(1), 1, 5, False), (2, t(2), 2, 5, True),                            # cleared
        (3, t(1), 1, 5, False), (3, t(2), 2, None, True), (3, t(3), 3, 7, False),  # cleared, marked again
        (4, t(2), 1, 5, True), (4, t(1), 2, 5, False)]                            # out of order in the table
    df = spark.createDataFrame(rows, "issue long, at timestamp_ntz, seq long, canonical long, unmarked boolean")
    assert {r["issue"]: r["canonical"] for r in silver.active_mark(df).collect()} == {1: 6, 3: 7}


def test_parse_issue(spark):
    from hindcast.sources.timeline import parse_issues

    node = {
        "number": 7, "title": "t", "createdAt": "2024-01-01T00:00:00Z", "lastEditedAt": "2024-01-02T00:00:00Z", "author": None,
        "labels": {"nodes": [{"name": "bug"}]},
        "originalBody": {"nodes": [{"editedAt": "2024-01-01T00:00:00Z", "diff": "first", "editor": None}]},
        "closedByPullRequestsReferences": {"nodes": [{"number": 3, "title": "fix", "merged": True}]},
        "timelineItems": {"totalCount": 2, "nodes": [
            {"__typename": "LabeledEvent", "createdAt": "2024-01-01T01:00:00Z", "label": {"name": "bug"}, "actor": {"login": "b", "__typename": "Bot"}},
            {"__typename": "CrossReferencedEvent", "source": {"__typename": "PullRequest", "number": 3, "title": "other"}},
            {"__typename": "CrossReferencedEvent", "source": {"__typename": "PullRequest", "number": 2, "title": "two"}},
            {"__typename": "CrossReferencedEvent", "source": {"__typename": "Issue", "number": 9}}]}}
    df = spark.createDataFrame([(json.dumps(node), dt.datetime(2024, 2, 1))], "j string, at timestamp_ntz")
    r = one(parse_issues(df, "demo/repo", "j", "at"))
    assert r["author"]["login"] is None and r["author"]["is_bot"] is False
    assert r["original_body"]["body"] == "first" and r["label_events"][0]["actor"]["is_bot"]
    assert [(p["number"], p["via"]) for p in r["linked_prs"]] == [(2, "cross_reference"), (3, "closing_reference")]


def corpus(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, i * 10, [rng.choice(words[: 5 + i % 35]) for _ in range(12)]) for i in range(n)]
    return spark.createDataFrame(rows, "number long, created long, tokens array<string>")


def ranking(spark, docs, k, exclude=None, **kw):
    index = blocks.build_index(docs, "number", "created", F.col("tokens"), **kw)
    flat = lexical.postings(docs, "number", "created", F.col("tokens"))
    lengths = lexical.document_lengths(docs, "number", "created", F.col("tokens"))
    queries = docs.filter("number BETWEEN 20 AND 40").select(F.col("number").alias("q"), F.col("created").alias("as_of"), "tokens")
    terms = lexical.query_terms(queries, "q", "as_of", F.col("tokens"))
    stats = lexical.asof_stats(terms, flat, lengths)
    assert sorted(lexical.index_stats(terms, index).collect()) == sorted(stats.select(lexical.index_stats(terms, index).columns).collect())
    weighted = stats.withColumn("idf", lexical.idf(F.col("n_docs"), F.col("df")))
    top = lexical.bm25_topk(queries, index, "number", k, F.col("tokens"), exclude)
    brute = weighted.join(flat, "term").filter("created < as_of").groupBy("q", "number").agg(
        F.round(F.sum(lexical.bm25_part()), 9).alias("score"))
    if exclude is not None:
        brute = brute.join(exclude, ["q", "number"], "left_anti")
    expected = {}
    rows = sorted(((r["q"], -r["score"], r["number"]) for r in brute.collect()))
    for q in {r[0] for r in rows}:
        for rank, r in enumerate([r for r in rows if r[0] == q][:k], start=1):
            expected[(q, rank)] = (r[2], pytest.approx(-r[1], abs=2e-9))
    return {(r["q"], r["rank"]): (r["number"], r["score"]) for r in top.collect()}, expected


def test_block_search_equals_brute_force_and_ignores_the_future(spark):
    docs = corpus(spark)
    top, expected = ranking(spark, docs, 5, shard_docs=20)
    assert top == expected
    future = spark.createDataFrame([(900 + i, 10_000 + i, ["w1", "w2"] * 9) for i in range(20)], docs.schema)
    assert ranking(spark, docs.unionByName(future), 5)[0] == expected


def test_block_search_with_copies_hot_times_and_exclusions(spark):
    docs = corpus(spark, 40).unionByName(corpus(spark, 40).selectExpr("number + 100 AS number", "created", "tokens")).unionByName(
        spark.createDataFrame([(300 + i, 5, ["w1", "w2", "w3"]) for i in range(30)], "number long, created long, tokens array<string>"))
    out = spark.createDataFrame([(q, n) for q in range(20, 41) for n in (0, 300, 301)], "q long, number long")
    top, expected = ranking(spark, docs, 8, exclude=out, shard_docs=12)
    assert top == expected


def test_cosine_neighbours_skip_postings_but_lose_nothing(spark):
    rng = random.Random(4)
    rows = [(i, i, [f"t{i // 4}_{j}" for j in range(6)] + [rng.choice(["a", "b", "c"]) for _ in range(9)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "number long, created long, tokens array<string>")
    train = docs.select("number").filter("number % 2 = 1")
    both = [
        sorted(map(tuple, lexical.tfidf_neighbours(docs, train, "number", F.col("tokens"), 2, two_rounds=t).collect())) for t in (True, False)]
    assert both[0] == both[1]
    shard = blocks.Shard(pa.Table.from_pylist(
        [{"term": "", "cids": [], "tfs": [], "top": 0, "least": 0, "idf": None, "documents": [
            {"cid": i, "doc_len": 3, "keys": [i], "created": [i]} for i in range(100)]}]
        + [{"term": t, "cids": c, "tfs": [1] * len(c), "top": 1, "least": 3, "idf": w, "documents": []}
           for t, c, w in (("common", list(range(100)), 0.1), ("rare", [7], 5.0))]).to_batches(), blocks.Cosine())
    asked = (["common", "rare"], [0.1, 0.995], 1.0, 1000)
    full = shard.search(*asked, 0.0, [], 1)
    scored = shard.postings
    assert full[0].tolist() == [7] and scored == 101
    assert shard.search(*asked, 0.99, [], 1)[0].tolist() == [7]  # the common block opens only as the rare one left somebody alive
    shard.postings = 0
    assert shard.search(["common"], [1.0], 1.0, 1000, 1.1, [], 1)[0].tolist() == [] and shard.postings == 0
    assert shard.search(*asked, 0.5, [7], 1)[0].tolist() == [] and shard.postings == 1


def test_dense_blocks_agree(spark):
    rng = random.Random(3)
    rows = [(i, i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)]
    v = spark.createDataFrame(rows, "number long, created long, embedding array<double>")
    q = v.select(F.col("number").alias("q"), F.col("created").alias("as_of"), "embedding")
    whole = {tuple(r) for r in dense.dense_topk(q, v, "number", 3).collect()}
    assert whole == {tuple(r) for r in dense.dense_topk(q, v, "number", 3, block=7, chunk=11).collect()}
    out = spark.createDataFrame([(r[0], r[1]) for r in whole if r[3] == 1], "q long, number long")
    without = dense.dense_topk(q, v, "number", 2, block=7, chunk=11, exclude=out).collect()
    assert {(r["q"], r["number"], r["rank"] + 1) for r in without} == {(r[0], r[1], r[3]) for r in whole if r[3] > 1}


def test_running_totals_with_a_hot_value(spark):
    rng = random.Random(5)
    rows = [(i, 0.5 if i % 3 == 0 else round(rng.random(), 3), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v double, one long").repartition(7)
    got = {r["id"]: r["cum_one"] for r in running_totals(df, "v", ["one"], tie="id", buckets=16).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order, start=1)}
    asked = spark.createDataFrame([(0.5,), (0.0,), (2.0,)], "t double")
    counts = {r["t"]: r["n"] for r in counts_before(asked, "t", df, "v", {"n": F.count(F.lit(1))}).collect()}
    assert counts == {t: sum(r[1] < t for r in rows) for t in (0.5, 0.0, 2.0)}


def test_last_before_is_strict_and_uses_the_same_day(spark):
    d = lambda *a: dt.datetime(2024, 1, *a)
    events = spark.createDataFrame(
        [(1, "bug", d(1, 9), 1, True), (1, "bug", d(2, 9), 2, False), (1, "bug", d(2, 10), 3, True), (1, "doc", d(2, 9), 4, True)],
        "issue long, label string, at timestamp_ntz, seq long, added boolean")
    asked = spark.createDataFrame([(1, d(2, 9)), (1, d(2, 10)), (1, d(5, 0)), (1, d(1, 9))], "issue long, as_of timestamp_ntz")
    got = {r["as_of"]: r["labels"] for r in asof.replay_labels(asked, events, "issue").collect()}
    assert got == {d(2, 9): ["bug"], d(2, 10): ["doc"], d(5, 0): ["bug", "doc"], d(1, 9): []}


def test_near_repeats_send_no_words_to_meet_their_counts(spark, monkeypatch):
    """Prefixes are cut where their sets lie, under any head of frequent words, and carry a number for their set."""
    rng, written = random.Random(8), {}
    sets = [["w%d" % min(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randint(1, 8))] for _ in range(80)]
    rows = [(i % 2, i, sorted(set(ws))) for i, ws in enumerate(sets)]
    df = spark.createDataFrame(rows, "g int, seq bigint, words array<string>")
    keep = traces.materialise
    monkeypatch.setattr(traces, "materialise", lambda frame, name: (written.update({name: frame}), keep(frame, name))[1])

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5

    expected = {i for g, i, ws in rows if any(h == g and j < i and alike(ws, vs) for h, j, vs in rows)}
    for head in (1 << 17, 5, 0):
        monkeypatch.setattr(traces, "HEAD_WORDS", head)
        assert {r["seq"] for r in traces.near_repeats(df, "g", "seq", "words").collect()} == expected
        assert "Exchange" not in written["prefixes"]._jdf.queryExecution().executedPlan().toString()
        assert dict(written["prefixes"].dtypes)["_id"] == "bigint" and "_h" not in written["prefixes"].columns


def test_near_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [("g", i, sorted({f"w{rng.randrange(14)}" for _ in range(6)})) for i in range(80)]
    rows += [("g", 80 + i, ["a", "b", "c", f"u{i}"]) for i in range(40)]  # a family of near copies
    df = spark.createDataFrame(rows, "g string, seq long, words array<string>")
    got = {r["seq"] for r in traces.near_repeats(df, "g", "seq", "words").collect()}
    sets = [(s, set(w)) for _, s, w in rows]
    want = {s for s, w in sets if any(e < s and len(w & o) / len(w | o) >= 0.5 for e, o in sets)}
    assert got == want


def test_poisson_and_exact_bootstrap_agree(spark):
    df = spark.range(3000).select("id", (F.col("id") % 4 == 0).alias("hit"))
    args = ({"n": F.lit(1), "hit": F.col("hit")}, {"rate": F.col("hit") / F.col("n")})
    exact = one(uncertainty.bootstrap_ci(df, "id", *args, resamples=200, exact=True))
    poisson = one(uncertainty.bootstrap_ci(df, "id", *args, resamples=200))
    assert exact["point"] == poisson["point"] == 0.25
    for side in ("low", "high"):
        assert exact[side] == pytest.approx(poisson[side], abs=0.006)
        assert abs(exact[side] - 0.25) == pytest.approx(1.96 * (0.25 * 0.75 / 3000) ** 0.5, abs=0.004)


def test_bootstrap_has_one_law_at_every_size(spark):
    """An item's weights depend on seed, resample and item only: the same among ten items and among 20,001."""
    draws = lambda n: uncertainty.resampled(spark.range(n), "id", resamples=20).filter("id < 10 AND r > 0")
    few, many = ({(r["id"], r["r"]): r["w"] for r in draws(n).collect()} for n in (10, 20_001))
    assert few == many and 100 < len(few) < 150


def test_malformed_lines_come_back_whole(spark, tmp_path):
    from hindcast.sources import tables

    lines = ['{"a":1,"b":2.5}', '{"a":2,"b":"zzz"}', '{"a":3,', "", '{"a":4}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    good, bad = tables.split_quarantine(tables.scan_jsonl(spark, str(tmp_path), "a LONG, b DOUBLE"))
    assert {r[0] for r in bad.collect()} == {lines[1], lines[2]}
    assert {r["a"] for r in good.select("a").collect()} == {1, 4}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from hindcast import session

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.temporary_folder("spark://host:7077")
    assert session.temporary_folder("local[8]")


def test_threshold_sweeps_all_similarities(spark):
    rows = [(i, None, i + 0.5, 1 - i / 2000) for i in range(900)] + [(5000 + i, 7.0, 7.0, 0.4 - i / 1000) for i in range(200)]
    best = spark.createDataFrame(rows, "number long, gold double, found double, sim double")
    assert one(lexical.tune_threshold(best))["threshold"] == pytest.approx(0.4 - 199 / 1000)


def test_whole_file_is_refused(spark):
    answers = spark.createDataFrame([(1, ["bug"], None), (2, ["bug", "feature"], "core")], "id long, labels array<string>, component string")
    known = answers.select("id")
    bad = annotation.answer_violations(answers, known, "id", ("bug", "feature"), ("bug", "feature"), ("core",))
    assert [(r["id"], r["violation"]) for r in bad.collect()] == [(2, "not_one_type")]
    assert annotation.accept_all_or_none(answers, bad).count() == 0


def test_unpriced_models_and_missing_predictions_fail(spark):
    from hindcast.operators.spend import priced

    calls = spark.createDataFrame([("m1",), ("m2",)], "model string")
    with pytest.raises(Exception, match="no price"):
        priced(calls, spark.createDataFrame([("m1", 1.0)], "model string, input_per_mtok double"), "model").collect()
    with pytest.raises(Exception, match="no prediction"):
        scoring.require_aligned(spark.range(3), spark.range(2), "id").collect()


def test_a_registered_metric_is_scored_and_compared(spark):
    rows = items(spark, [(i, ["a"], ["a"] if i % 3 else ["b"], i if i % 2 else None, i if i % 5 else None) for i in range(30)])
    metric = scoring.Metric(
        "x_links_given", lambda: F.col("x_given") / F.col("n"), lambda: {"x_given": F.col("p_dup").isNotNull()}, lambda: F.col("id") >= 10)
    scoring.register_metric(metric)
    try:
        with pytest.raises(ValueError):
            scoring.register_metric(metric)
        card = {r["metric"]: r for r in scoring.scorecard(rows, "id", resamples=50).collect()}
        assert card["x_links_given"]["point"] == 16 / 30 and card["x_links_given"]["low"] < 16 / 30 < card["x_links_given"]["high"]
        sides = rows.withColumn("comparison", F.lit("b-a")).withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b"))))
        delta = {r["metric"]: r for r in scoring.compare_runs(sides, "id", resamples=20).collect()}
        assert delta["x_links_given"]["delta"] == 0 and delta["t1_micro_f1"]["a"] == card["t1_micro_f1"]["point"]
    finally:
        del scoring.REGISTRY["x_links_given"]


def test_runs_of_different_splits_are_not_compared(spark):
    pairs = spark.createDataFrame([("b-a", "a", "b")], "comparison string, a string, b string")
    splits = spark.createDataFrame([("a", "dev"), ("b", "test")], "run_id string, split string")
    gold = spark.createDataFrame([(1, ["x"])], "id long, labels array<string>").selectExpr(
        "id", "labels", "map('x', 'type') AS label_groups", "true AS human_triaged", "CAST(NULL AS LONG) AS duplicate_of",
        "'c' AS component", "false AS needs_info", "1.0D AS weight")
    given = gold.crossJoin(spark.createDataFrame([("a",), ("b",)], "run_id string")).selectExpr(
        "id", "run_id", "labels", "duplicate_of", "component", "array('c') AS component_candidates", "needs_info", "CAST(NULL AS STRING) AS error",
        "0.1D AS cost_usd", "5L AS latency_ms")
    with pytest.raises(Exception, match="different splits"):
        scoring.compared_items(pairs, gold, given, "id", splits=splits).collect()
    assert scoring.compared_items(pairs, gold, given, "id", splits=splits.withColumn("split", F.lit("dev"))).count() == 2


def test_in_task_draws_equal_the_expressions(spark):
    df = spark.range(300).selectExpr("id", "id % 3 AS g", "id * 1.5D AS v", "CAST(NULL AS DOUBLE) AS none")
    rows = uncertainty.resampled(df, "id", by=["g"], resamples=25, seed="s", weight="v")
    sums = {"n": F.lit(1), "v": F.col("v")}
    plain = {(r["g"], r["r"]): (r["n"], r["v"]) for r in uncertainty.resample_sums(rows, sums, ["g"]).collect()}
    found = uncertainty.resample_totals(df, "id", {**sums, "none": F.col("none")}, ["g"], resamples=25, seed="s", weight="v").collect()
    assert {(r["g"], r["r"]): (r["n"], pytest.approx(r["v"])) for r in found} == plain and {r["none"] for r in found} == {0.0}


def test_percentiles_of_groups_one_of_which_is_hot(spark):
    rng = random.Random(8)
    rows = [("hot", float(rng.randrange(50))) for _ in range(3000)] + [(g, float(rng.randrange(10))) for g in ("a", "b", None) for _ in range(7)]
    rows += [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = uncertainty.percentiles(df, ["g"], F.col("v"), {"p0": 0, "p50": 50, "p95": 95, "p100": 100}).collect()
    plain = df.groupBy("g").agg(*[uncertainty.percentile_linear(F.col("v"), q).alias(f"p{q}") for q in (0, 50, 95, 100)]).collect()
    assert sorted(map(str, found)) == sorted(map(str, plain)) and len(found) == 6


def test_running_totals_within_groups(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b"]), rng.randrange(6), rng.randrange(100)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, k long, v long")
    for kw in ({}, {"descending": True}, {"inclusive": False}):
        got = {r["id"]: r["cum_v"] for r in running_totals(df, "k", ["v"], tie="id", by=["g"], **kw).collect()}
        sign = -1 if kw.get("descending") else 1
        for g in ("hot", "a", "b"):
            total = 0
            for i, _, k, v in sorted((r for r in rows if r[1] == g), key=lambda r: (sign * r[2], sign * r[0])):
                assert got[i] == total + (v if kw.get("inclusive", True) else 0)
                total += v


def test_a_hot_run_day_breaches_at_the_right_row(spark):
    rows = [("hot", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 4), i, 1.0, 700.5) for i in range(2000)]
    rows += [("small", dt.datetime(2024, 1, d), d, 2.0, 5.0) for d in range(1, 6)] + [("fine", dt.datetime(2024, 1, 1), 1, 1.0, 9.0)]
    ledger = spark.createDataFrame(rows, "run string, at timestamp_ntz, seq long, cost double, cap double")
    found = {r["run"]: (r["seq"], r["running"]) for r in spend.run_breaches(ledger, "run", "at", "seq", "cost", "cap").collect()}
    assert found == {"hot": (700, 701.0), "small": (3, 6.0)}


def test_retrievers_asked_different_queries_are_not_compared(spark):
    a = spark.createDataFrame([(1, 3), (2, None)], "q long, rank int")
    assert {tuple(r) for r in fusion.paired_ranks({"x": a, "y": a}, "q").collect()} == {(1, 3, 3), (2, None, None)}
    with pytest.raises(Exception, match="query sets differ"):
        fusion.paired_ranks({"x": a, "y": a.filter("q = 1")}, "q").collect()


def test_gate_refuses_rules_for_unknown_metrics(spark):
    deltas = spark.createDataFrame(
        [("f1", -0.2, -0.3, -0.1, True), ("recall", -0.01, -0.02, -0.001, True), ("free", -0.9, -1.0, -0.8, True)],
        "metric string, delta double, low double, high double, significant boolean")
    rules = spark.createDataFrame([("f1", 0.1), ("recall", 0.1)], "metric string, max_drop double")
    found = {r["metric"]: r["verdict"] for r in gate.gate_metric(deltas, rules).collect()}
    assert found == {"f1": "fail", "recall": "warn", "free": "pass"}
    with pytest.raises(Exception, match="unknown metric: f2"):
        gate.gate_metric(deltas, rules.unionByName(spark.createDataFrame([("f2", 0.1)], rules.schema))).collect()


def test_blocks_of_queries_find_what_single_queries_find():
    rng = random.Random(6)
    n, created, found = 120, 1000, []
    documents = [{"cid": i, "doc_len": rng.randint(5, 40), "keys": [i, 500 + i], "created": [i, created]} for i in range(n)]
    rows = [{"term": "", "cids": [], "tfs": [], "top": 0, "least": 0, "idf": None, "documents": documents}]
    for t in range(60):
        cids = sorted(rng.sample(range(n), 1 + t * 2 if t < 50 else 2))
        tfs = [rng.randint(1, 5) for _ in cids]
        rows.append({"term": f"t{t}", "cids": cids, "tfs": tfs, "top": max(tfs), "least": 5, "idf": 1.0 + t / 9, "documents": []})
    batches = pa.Table.from_pylist(rows).to_batches()
    for scoring in (blocks.Bm25(1.2, 0.75), blocks.Cosine()):
        asked = [
            (q, rng.choice([0, 40, 90, 2000]), rng.sample([f"t{t}" for t in range(64)], rng.randint(0, 30)), 10.0 + q / 7, rng.choice([0.0, 0.0, 3.0, 99.0]),
             rng.sample(range(n), rng.choice([0, 3, 60]))) for q in range(300)]
        queries = [(q, at, terms, [0.1 + int(t[1:]) / 50 for t in terms], mean, floor, out) for q, at, terms, mean, floor, out in asked]
        names = ("q", "as_of", "terms", "weights", "mean", "floor", "excluded")
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.int64()))
        part = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*queries, strict=True), kinds, strict=True)], names)
        together = dict(blocks._searches(blocks.Shard(batches, scoring), part, 5))
        alone = blocks.Shard(batches, scoring)
        for q, at, terms, weights, mean, floor, out in queries:
            best = [sorted(((-round(s, 7), k) for k, s in zip(*r, strict=True) if s >= floor), key=lambda x: x)[:5] for r in (
                together[q], alone.search(terms, weights, mean, at, floor, out, 5))]
            assert best[0] == best[1] and together[q][1].dtype == float
            found += best[0]
    assert len(found) > 500


def test_shards_grow_with_the_table(spark):
    docs = spark.range(50_000).select(F.col("id").alias("number"), F.col("id").alias("created"), F.array(F.lit("a")).alias("tokens"))
    index = blocks.build_index(docs, "number", "created", F.col("tokens"))
    assert sum(n for _, _, n in index.ranges) <= 2 * blocks.FEW_SHARDS  # copies of each query; one per 1,024 documents before


def test_postings_of_dealt_documents_send_no_terms(spark):
    docs = lexical.dealt(corpus(spark), "number")
    posts = lexical.postings(docs, "number", "created", F.col("tokens")).groupBy("number", "doc_len").agg(F.sum("tf"))
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and {r[0]: r[2] for r in posts.collect()} == {i: 12 for i in range(60)}

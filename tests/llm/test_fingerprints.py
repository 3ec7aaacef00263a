"""SimHash, its tables, the Gray-order index and components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hindcast.llm import gray_index, simhash
from tests.llm.cases import ROWS, empty, frame


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, weighted=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    if not shingles:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    power = np.array([min(16, max(1, len(s) // 4)) if weighted else 1 for s in shingles])
    return sum(1 << b for b in range(64) if 2 * (((hashes >> np.uint64(b)) & np.uint64(1)).astype(int) * power).sum() > power.sum())


@pytest.mark.parametrize("weighted", [False, True])
def test_fingerprints(spark, weighted):
    df = frame(spark).withColumn("i", F.monotonically_increasing_id())
    got = simhash.fingerprints(df.select("i", "text"), ["i"], "text", weight=simhash.by_length if weighted else None)
    rows = got.join(df, "i").select(got["fingerprint"], got["terms"], "text").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r[0] & (2**64 - 1) == fingerprint(r["text"], weighted)


def cluster(rng, n, bits=64):
    base = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    values = base[rng.integers(0, 6, n)]
    for _ in range(4):
        values = np.where(rng.random(n) < 0.6, values ^ (np.uint64(1) << rng.integers(0, bits, n).astype(np.uint64)), values)
    return np.unique(values)


def brute(values, group=None):
    a, b = [], []
    for i in range(len(values)):
        near = np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3
        if group is not None:
            near &= group[i + 1 :] == group[i]
        j = np.flatnonzero(near) + i + 1
        a += [i] * len(j)
        b += j.tolist()
    return gray_index.smallest_reachable(len(values), np.array(a, int), np.array(b, int))


@pytest.mark.parametrize("seed", range(8))
def test_links_in_groups(seed):
    rng = np.random.default_rng(seed)
    values = cluster(rng, 500, 64 if seed % 2 else 9)
    group = rng.integers(0, 3, len(values))
    order = np.lexsort((gray_index.gray_rank(values), group))
    values, group = values[order], group[order]
    a, b = gray_index.links(values, group)
    assert (group[a] == group[b]).all()
    assert (gray_index.smallest_reachable(len(values), a, b) == brute(values, group)).all()


def test_near_values_share_a_group():
    masks, rng = gray_index.group_masks(), np.random.default_rng(0)
    for _ in range(500):
        flipped = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(flipped & (m & (2**64 - 1)) == 0 for m in masks)


def test_links_and_components(spark):
    values = cluster(np.random.default_rng(9), 800)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint bigint")
    roots = {r.node: r.root for r in gray_index.components(gray_index.near_links(df)).collect()}
    ours = [roots.get(int(v), int(v)) for v in values.view(np.int64)]
    expected = brute(values)
    assert len(set(zip(ours, expected.tolist(), strict=True))) == len(set(ours)) == len(set(expected.tolist()))


def test_long_chains_reach_one_root(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in gray_index.components(chain).collect()} == {0}


def test_near_counts(spark):
    values = cluster(np.random.default_rng(4), 300)
    df = spark.createDataFrame([(int(v), i % 5) for i, v in enumerate(values.view(np.int64))], "fingerprint bigint, weight int")
    got = {r.fingerprint: r.near for r in simhash.near_counts(df, df.filter("weight > 0")).collect()}
    for v in values:
        expected = sum(i % 5 for i, q in enumerate(values) if bin(int(q) ^ int(v)).count("1") <= 3)
        assert got.get(int(np.uint64(v).view(np.int64)), 0) == expected


def test_near_duplicates_edge_rows(spark):
    got = gray_index.near_duplicates(frame(spark), key="doc_id").collect()
    texts = {(r[0], r[1] or "") for r in ROWS}
    assert len(got) == len(texts) and sum(r.copies for r in got) == len(ROWS)
    by = {(r.doc_id, r.fingerprint & (2**64 - 1)): r for r in got}
    zero = {r.component_id for r in got if r.fingerprint == 0}
    assert zero == {1} and by[(8, fingerprint(lower(ROWS[5][1])))].component_id == 6
    assert gray_index.near_duplicates(empty(spark)).count() == 0


def test_keep_one_edge_rows(spark):
    kept = gray_index.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 in ids and 7 not in ids and 8 not in ids and ids.count(1) == 1 and 2 not in ids
    assert gray_index.keep_one(empty(spark)).count() == 0
    twice = frame(spark, [(7, "same text here", "en", "a", 1)] * 3)
    assert gray_index.keep_one(twice).count() == 1

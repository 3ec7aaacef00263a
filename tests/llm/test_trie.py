"""The prefix trie beside a plain one, on long, equal, odd and absent conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from hindcast.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: y[:2])] for c, v in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in children[path])
        ends = ",".join(str(c) for c in sorted(members[path]) if len(whole[c]) == len(path))
        out.append((
            min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]), leaves[path],
            saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed: int):
    """Few different turns, so that prefixes are shared; lengths around the ends of blocks; copies; gaps in the ids."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-30, 90), *rng.sample(range(1000, 5000), 60)]:
        if c % 7 == 3:
            continue
        length = rng.choice([1, 1, 2, 3, 7, 8, 9, 15, 16, 17, 25])
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a b", "a  b", "", None, "x y z"]) if rng.random() < 0.2 else "same words here") for t in range(length)]
    rng.shuffle(rows)
    return rows


def test_trie_equals_a_plain_one(spark):
    rows = conversations(1)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as base", "'own' as block", "1 as depth", "'own' as key", "'own' as t1")
    assert rows_of(prefix_trie.prefix_trie(df)) == trie_by_hand(rows)


def test_trie_query_equals_a_plain_one(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_prefix_trie(spark, sf)) == trie_by_hand(rows)


def test_long_member_lists_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "bucket_count", lambda df: 64)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "user", "hello there") for c in range(500) for t in range(4)]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == trie_by_hand(rows)


@pytest.mark.parametrize("rows", [
    [], [(None, 1, "user", "x")], [(5, None, None, None)], [(40, 1, "user", "x"), (40, None, "user", "first"), (41, 1, "user", "x")],
    [(1, 1, "user", "x"), (1, 1, "user", "x"), (21, 1, "user", "x"), (21, 2, "user", "word " * 200_000)],
])
def test_trie_of_odd_tables(spark, rows):
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == trie_by_hand(rows)

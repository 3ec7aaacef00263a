"""Near copies of five-word shingles: fingerprints, search and recall by similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import bytetext, gray_index, near_copies
from tests.llm.cases import ROWS, empty, frame


def prints(texts):
    data, offsets = bytetext.string_bytes(pa.array(texts))
    return near_copies.text_fingerprints(data, offsets)


def edited(rng, words, similarity):
    """The words with single ones replaced until the five-word Jaccard similarity has just fallen to `similarity`."""
    shingles = lambda w: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    own, out = shingles(words), list(words)
    for i in rng.permutation(len(words)):
        before = list(out)
        out[i] = f"new{i}"
        other = shingles(out)
        if len(own & other) / len(own | other) < similarity:
            return before
    return out


def found(a, b):
    masks = [np.array(m, np.int64).view(np.uint64) for m in near_copies.table_masks(100_000)]
    near = np.bitwise_count(a ^ b).sum(axis=1) <= near_copies.RADIUS
    met = np.zeros(len(a), bool)
    for m in masks:
        met |= (((a ^ b) & m) == 0).all(axis=1)
    return near & met


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.75), (0.85, 0.9), (0.9, 0.97), (0.95, 0.99)])
def test_recall_by_similarity(similarity, least):
    rng = np.random.default_rng(8)
    texts, copies = [], []
    for t in range(300):
        words = [f"w{t}x{i}" for i in range(250)]
        texts.append(" ".join(words))
        copies.append(" ".join(edited(rng, words, similarity)))
    rate = found(prints(texts), prints(copies)).mean()
    print(similarity, rate)
    assert rate >= least
    assert not found(prints(texts), prints(texts[1:] + texts[:1])).any()


@pytest.mark.parametrize("seed", range(6))
def test_links_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (8, 2)).astype(np.uint64)
    values = base[rng.integers(0, 8, 700)]
    for _ in range(18):
        flip = np.uint64(1) << rng.integers(0, 64, (700, 2)).astype(np.uint64)
        values = np.where(rng.random((700, 2)) < 0.7, values ^ flip, values)
    values, group = np.unique(values, axis=0), None
    group = np.sort(rng.integers(0, 3, len(values)))
    for g in range(3):  # Gray order inside the groups
        mine = np.flatnonzero(group == g)
        values[mine] = values[mine][np.argsort(gray_index.gray_rank(values[mine, 0]))]
    near = np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2) <= near_copies.RADIUS
    a, b = np.nonzero(near & (group[:, None] == group[None]))
    assert (near_copies.links(values, group) == gray_index.smallest_reachable(len(values), a, b)).all()


def test_components_of_texts(spark):
    rng = np.random.default_rng(2)
    rows, family = [], {}
    for t in range(40):
        words = [f"t{t}w{i}" for i in range(200)]
        for c in range(1 if t % 2 else 4):
            family[len(rows)] = t
            rows.append((len(rows), " ".join(edited(rng, words, 0.93) if c else words), "en", "a", 0))
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(frame(spark, rows)).collect()}
    first = {}
    for i, t in family.items():
        first.setdefault(t, i)
    assert got == {i: first[t] for i, t in family.items()}


def test_edge_rows(spark):
    rows = near_copies.near_duplicates(frame(spark)).collect()
    assert len(rows) == len({(r[0], r[1] or "") for r in ROWS}) and sum(r.copies for r in rows) == len(ROWS)
    assert near_copies.near_duplicates(empty(spark)).count() == 0
    kept = gray_index.keep_one(frame(spark), search=near_copies.near_duplicates)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == frame(spark).columns and ids.count(1) == 1 and not {2, 3, 7, 8} & set(ids) and {4, 5, 6, 9, 11, 12} <= set(ids)
    assert gray_index.keep_one(frame(spark, [(7, "same text here", "en", "a", 1)] * 3), search=near_copies.near_duplicates).count() == 1

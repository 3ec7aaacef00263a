"""Suffix arrays, wavelet ranks, substring dedup and decontamination against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import bytetext, decontaminate, substring
from hindcast.llm.fm_index import FMIndex, suffix_array
from tests.llm.cases import ROWS, empty, frame

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize(("n", "sigma"), [(60, 3), (400, 5), (200, 2), (1, 2), (150, 60)])
def test_index_finds_and_locates(n, sigma):
    rng = np.random.default_rng(n)
    text = rng.integers(1, sigma, n)
    closed = [*text.tolist(), 0]
    assert suffix_array(np.array(closed)).tolist() == sorted(range(n + 1), key=lambda i: closed[i:])
    full, part = FMIndex(text, sample=4), FMIndex(text, depth=5)
    for size in (1, 3, 4):
        patterns = rng.integers(1, sigma + 1, (20, size))
        for (p, a, b), (c, d) in zip(zip(patterns, *full.search(patterns), strict=True), zip(*part.search(patterns), strict=True), strict=True):
            places = [i for i in range(n - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(full.locate(np.arange(a, b))) == places
            assert sorted(part.order[c:d]) == places


def test_words_and_hashes():
    texts = ["a b", "", None, "é\tñ", "b  a", "x" * 5000]
    data, offsets = bytetext.string_bytes(pa.array(texts))
    starts, ends, bounds = bytetext.words(data, offsets)
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert got == [w for t in texts for w in WORDS.findall(t or "")] and bounds.tolist() == [0, 2, 2, 2, 4, 6, 7]
    hashes = bytetext.word_hashes(data, starts, ends)
    assert hashes[0] == hashes[5] == bytetext.hash_of(b"a") and len(set(hashes.tolist())) == 5
    assert [x.as_py() for x in bytetext.slices(data, starts, ends)] == got


def removed(docs, window):
    """(words, removed) by document, documents in their order."""
    first, out = {}, {}
    lists = {k: WORDS.findall(t or "") for k, t in docs}
    for k in lists:
        for i in range(len(lists[k]) - window + 1):
            first.setdefault(tuple(lists[k][i : i + window]), (k, i))
    for k, words in lists.items():
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] != (k, i):
                gone |= set(range(i, i + window))
        out[k] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_substrings_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rng = np.random.default_rng(3)
    pool = [" ".join(f"p{j}x{k}" for k in range(30)) for j in range(4)]
    docs = [(i, " ".join(
        str(rng.choice(pool)) if rng.random() < 0.3 else " ".join(map(str, rng.integers(0, 3, 9))) for _ in range(6))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.repeat for r in substring.dedup_substrings(df).collect()}
    for k, (n, gone, kept) in removed(docs, 20).items():
        assert (got[k].n_words, sum(s.end - s.start for s in got[k].spans), got[k].kept) == (n, gone, kept)


def test_substring_edge_rows(spark):
    got = substring.dedup_substrings(frame(spark)).collect()
    assert len(got) == len(ROWS) and all(r.n == "own" for r in got)
    by = {(r.doc_id, r.text): r.repeat for r in got}
    assert by[(1, None)].n_words == 0 and by[(1, None)].kept == ""
    assert by[(7, ROWS[6][1])].kept == "" and by[(8, ROWS[8][1])].spans == []
    assert sum(s.end - s.start for s in by[(12, ROWS[-1][1])].spans) == 22
    # Null ids come first, so the copy under a null id keeps its words and id 6 loses them.
    assert by[(None, ROWS[10][1])].spans == [] and by[(6, ROWS[5][1])].kept == ""
    assert substring.dedup_substrings(empty(spark)).count() == 0


def leaked(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for _, text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


ITEMS = [(1, " ".join(f"Q{i}" for i in range(25))), (2, "short Item"), (3, None), (4, ""), (None, "null owner words"), (2, "short item")]


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = np.random.default_rng(5)
    quiz = ITEMS[0][1].split()
    docs = []
    for i in range(60):
        at = int(rng.integers(0, 16))
        docs.append((i, " ".join([
            "the, words", *quiz[at : at + int(rng.integers(5, 20))], "SHORT item" if i % 7 == 0 else "other", *quiz[3:14], "null owner words" if i % 9 == 0 else ""])))
    docs += [(100, None), (101, ""), (102, "short")]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.leak for r in decontaminate.decontaminate(df, items, cut=True).collect()}
    for (k, text), (n, hit, found) in zip(docs, leaked(docs, ITEMS), strict=True):
        leak = got[k]
        assert (leak.n_words, sum(s.end - s.start for s in leak.spans), sorted(leak.items)) == (n, hit, found)
        if text:
            assert len(ALNUM.findall(lower(leak.kept))) == n - hit
        else:
            assert leak.kept == text


def test_decontamination_edge_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.decontaminate(frame(spark), items).collect()
    assert len(got) == len(ROWS) and all(r.leak.spans == [] for r in got)
    assert all(r.leak.n_words == len(ALNUM.findall(lower(r.text))) for r in got)
    assert decontaminate.decontaminate(empty(spark), items).count() == 0
    assert decontaminate.decontaminate(frame(spark), items.limit(0)).filter("size(leak.spans) > 0").count() == 0

"""Toxicity, language model, token counts, Huffman files, pseudonyms and mixing."""

from __future__ import annotations

import collections
import datetime
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from hindcast.llm import huffman, lbl, mixing, pii, toxicity, viterbi
from hindcast.llm.queries import QUERIES, TOKENIZERS
from tests.llm.cases import ROWS, empty, frame

SF = "/root/testdata/sf0.01"
LABELLED = "/root/testdata/sf0.1"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- toxicity


def test_held_out_toxicity(spark):
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet")
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = toxicity.train(docs, labels.filter(~fold))
    scored = docs.join(labels.filter(fold), "doc_id").select("toxic", toxicity.score(docs, F.col("text"), model).alias("s")).collect()
    right = sum((r.s.p_toxic >= toxicity.REJECT) == (r.toxic == 1) for r in scored)
    assert right / len(scored) >= 0.97 and any(r.toxic == 1 for r in scored)
    assert all(0 <= r.s.severity <= 2 for r in scored)


def test_thresholds_are_shared_and_ordered():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    doc, feature = [], []
    for i, g in enumerate(grades):
        for f in rng.integers(100, 140, 6).tolist() + [1, 2][:g]:
            doc.append(i)
            feature.append(f)
    model = toxicity.fit(np.array(doc), np.array(feature, np.uint64), grades, grades > 0)
    assert (np.diff(model.thresholds) > 0).all()
    m = model.margins(np.array(doc), np.array(feature, np.uint64), 600)
    above = model.above(m)
    assert (above[:, 0] >= above[:, 1]).all() and (above.sum(1).round() == grades).mean() > 0.9


def test_toxicity_edge_rows(spark):
    labels = spark.createDataFrame([(6, 1), (None, 1), (4, None), (4, 0), (10, 0), (7, 1), (7, 0)], "doc_id bigint, toxic int")
    for table in (labels, labels.limit(0)):
        model = toxicity.train(frame(spark), table)
        rows = frame(spark).select(toxicity.score(frame(spark), F.col("text"), model).alias("s")).collect()
        assert len(rows) == len(ROWS) and all(r.s.severity is not None for r in rows)
    assert empty(spark).select(toxicity.score(empty(spark), F.col("text"), toxicity.train(empty(spark), labels))).count() == 0


# --- language model


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")] + [""]


def check_scores(rows, training):
    counts = collections.Counter(w for t in training for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        mine = tokens(r.t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine)
        assert r.n_tokens == len(mine) and r.n_known == sum(counts[w] > 0 for w in mine)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_scores_beat_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("text").alias("t"), lbl.held_out(F.col("doc_id")).alias("h"))
    trained = lbl.train(docs.filter("not h"))
    rows = lbl.score(docs, trained).collect()
    check_scores(rows, [r.t for r in rows if not r.h])
    held = [r for r in rows if r.h]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # Every context's probabilities add up to one.
    scorer = lbl.Scorer(lbl.Model(trained.vocabulary.noise).load(trained.parameters))
    every = np.arange(scorer.n)
    for one, two in ((0, 0), (5, 900), (1010, 3)):
        p = np.exp(scorer(every, np.full(scorer.n, one), np.full(scorer.n, two)).astype(float))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_language_model_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(lbl, "HEAD", 5)  # nearly all words take the join
    docs = frame(spark).withColumn("t", F.col("text"))
    rows = lbl.score(docs, lbl.train(docs)).collect()
    assert len(rows) == len(ROWS) and all(r.copies == "own" for r in rows)
    check_scores(rows, [r[1] for r in ROWS])
    nothing = lbl.train(empty(spark))
    rows = lbl.score(docs, nothing).collect()
    assert all(r.n_known == 0 and r.base_score == pytest.approx(r.n_tokens * math.log10(0.1 / 0.1)) for r in rows)
    assert lbl.score(empty(spark).withColumn("t", F.col("text")), nothing).count() == 0


@pytest.mark.parametrize("head", [65_536, 50])
def test_context_tells_rare_words_with_equal_endings_apart(spark, monkeypatch, head):
    monkeypatch.setattr(lbl, "HEAD", head)  # 50: every word looked at below is past the head
    rng = np.random.default_rng(4)
    texts = []
    for turn in range(200):
        words = rng.permutation([f"common{i}" for i in range(1200)] * 2).tolist()  # over 1,000 words are more frequent than the pairs
        for i in range(40):
            words[60 * i] += f" first{i}xx second{i}yy"
        texts.append((turn, " ".join(words)))
    trained = lbl.train(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4))
    right = " ".join(f"common{i} first{i}xx second{i}yy" for i in range(40))
    swapped = " ".join(f"common{i} first{i}xx second{(i + 1) % 40}yy" for i in range(40))
    a, b = sorted(lbl.score(spark.createDataFrame([(0, right), (1, swapped)], "doc_id bigint, text string"), trained).collect())
    assert a.base_score == pytest.approx(b.base_score) and a.score > b.score + 4


def test_a_unit_is_chosen_among_few_and_its_steps_are_normalised():
    rng = np.random.default_rng(3)
    sizes = np.concatenate([np.ones(128, int), np.full(192, 340), np.full(24, 2048)])  # the classes of a full vocabulary
    units = lbl.Units(rng.integers(1, 50, sizes.sum()).astype(float), np.concatenate([[0], np.cumsum(sizes)]))
    below = [np.diff(level.bounds) for level in (units.sections, units.classes, units.shelves, units.units)]
    shelf, kind = units.units.owner, units.shelves.owner[units.units.owner]
    choices = below[0][0] + below[1][units.classes.owner[kind]] + below[2][kind] + below[3][shelf]
    assert choices.max() <= 150 and len(choices) == sizes.sum()  # one class and one unit of it: up to 2,392
    for wide in (0.3, 9.0):  # 9: exponentials that need their greatest taken out
        model = lbl.Model(units)
        model.load(rng.normal(0, wide, len(model.parameters())).astype(np.float32))
        scorer, every = lbl.Scorer(model), np.arange(len(units))
        for one, two in ((0, 0), (700, 70_000)):
            p = np.exp(scorer(every, np.full(len(every), one), np.full(len(every), two)).astype(float))
            assert p.sum() == pytest.approx(1, abs=1e-4)


# --- token counts


def test_counts_equal_the_tokenizer(spark):
    pieces = viterbi.sentencepiece_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    odd = ["", " a", "  a b ", "▁a▁ b", "a\nb\n\n c", " ", "\n", "a" * 50, "<s> </s> <0x41>", "😀😀 x😀", None]
    docs = frame(spark, ROWS + [(100 + i, t, "en", "a", 0) for i, t in enumerate(odd)])
    rows = docs.select("text", viterbi.token_counts(docs, F.col("text"), pieces).alias("c")).collect()
    assert len(rows) == len(ROWS) + len(odd)
    for r in rows:
        assert r.c == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    assert empty(spark).select(viterbi.token_counts(docs, F.col("text"), pieces)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_ties_follow_the_tokenizer(seed):
    rng = np.random.default_rng(seed)
    pieces = {"<unk>": 0.0} | {"".join(rng.choice(list("▁abc"), int(rng.integers(1, 5)))): -float(rng.integers(1, 5)) for _ in range(40)}
    pieces |= {f"<0x{b:02X}>": -9.0 for b in range(256)}
    vocabulary = list(pieces.items())
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = viterbi.Counter(vocabulary)
    for _ in range(200):
        text = "".join(rng.choice(list("abcd é"), int(rng.integers(1, 14))))
        assert counter.text(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


# --- Huffman files


def test_each_distinct_piece_is_looked_up_once():
    class Counting(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        encoder = huffman.Encoder(f.read())
    encoder.cache = Counting(encoder.cache)
    for texts in (["one two\nthree two", "two, one"], ["one four\nfive", "two six two"]):  # all new, then some new
        before = encoder.cache.asked
        ids, sizes = encoder.encode(pa.array(texts), 2)
        whole = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == sum(whole, []) and sizes.tolist() == [len(w) for w in whole]
        pieces = {p for t in texts for p in re.findall(r" ?[a-z]+|,", t)}
        assert encoder.cache.asked - before == len(pieces)


@pytest.mark.parametrize("seed", range(6))
def test_code_round_trip(seed):
    rng = np.random.default_rng(seed)
    size = [1, 2, 5, 300, 3000, 40_000][seed]
    ids = np.minimum(rng.zipf(1.3, 20_000) - 1, size - 1) if size > 1 else np.zeros(1000, int)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=size))
    used = lengths[lengths > 0]
    assert used.max() <= huffman.LIMIT and (2.0 ** -used.astype(float)).sum() <= 1
    code = huffman.Code(lengths)
    for n in (1, 127, 128, 129, len(ids)):
        bits, marks = code.encode(ids[:n])
        assert len(marks) == -(-n // huffman.STRIDE) and (code.decode(bits, marks, n) == ids[:n]).all()


def test_lengths_are_optimal_without_a_binding_limit():
    counts = np.random.default_rng(0).integers(1, 1000, 50)
    import heapq

    heap = [(int(c), 0) for c in counts]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
        total += a + b
        heapq.heappush(heap, (a + b, 0))
    assert (huffman.code_lengths(counts) * counts).sum() == total


def test_files_give_back_all_ids(spark):
    odd = ["it's 12 <|endoftext|> x", "a  b", "tab\tand\x85nel", "line\n\nline", " lead", "trail ", "a\nb c\nd", "…‘x’ y" * 50]
    docs = frame(spark, ROWS + [(100 + i, t, "en", "a", 0) for i, t in enumerate(odd)])
    got = sorted(huffman.roundtrip(docs, f"{TOKENIZERS}/byte_bpe_50k.json").collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    expected = collections.Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    assert huffman.roundtrip(empty(spark), f"{TOKENIZERS}/byte_bpe_50k.json").count() == 0


def test_runs_of_letters_are_encoded_once(monkeypatch):
    """What stands beside a run of letters makes no new piece; a full cache and odd texts change no id."""
    definition = open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8").read()
    encoder, learnt = huffman.Encoder(definition), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda keys: (learnt.extend(keys), learn(keys)))
    words, rng = ["alpha", "beta7", "gamma"], random.Random(5)
    texts = [" ".join(rng.choice(words) + rng.choice([".", ",", "!", "?!", ";", ""]) for _ in range(50)) for _ in range(20)]

    def same(texts):
        ids, sizes = encoder.encode(pa.array(texts, pa.string()), 2)
        whole = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert sizes.tolist() == [len(w) for w in whole] and ids.tolist() == sum(whole, [])

    same(texts)
    assert len(learnt) == len(set(learnt)) <= 15
    monkeypatch.setattr(huffman, "CACHE", 40)
    signs = list("ab,.'sdtré日٣²0 19!?-\n  _\x00\x7f\t") + ["'s", " '", "'ll", "<|endoftext|>"]
    for _ in range(10):
        same(["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, ""])


# --- pseudonyms


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - (9 if d > 4 else 0)
    return total % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    values = [
        "4539578763621486", "4539 5787 6362 1486", "+1 (389) 555-5010", "389-555-5010", "536-90-4399", "666-12-1234", "152.143.123.131",
        "300.1.1.1", "2021-02-28", "2021-02-30", "31/12/1999", "12/31/1999", "01.02.2003", "jane.doe9@mail.example.com", "1234567890123456"]
    rows = [(i, f"A {v}, and {v}. End{i}") for i, v in enumerate(values)] + [(99, None), (100, ""), (101, "no digits"), (102, "4539578763621486")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.private for r in pii.pseudonymise(docs, key="k").collect()}
    bad = {"666-12-1234", "300.1.1.1", "2021-02-30", "1234567890123456"}
    for i, v in enumerate(values):
        first, second = re.fullmatch(rf"A (.*), and (.*)\. End{i}", got[i].text).groups()
        assert first == second and (first == v) == (v in bad) and len(got[i].found) == (0 if v in bad else 2)
        if "@" not in v and "." not in v:
            assert re.sub(r"\d", "0", first) == re.sub(r"\d", "0", v)
    assert luhn(got[0].text.split()[1].strip(",")) and got[102].text == got[0].text.split()[1].strip(",")
    assert re.sub(r"\D", "", got[1].text.split(",")[0]) == got[102].text
    assert got[99].text is None and got[100].text == "" and got[101].text == "no digits"
    # One date in three formats is one day.
    a, b = got[10].text.split()[1].strip(","), got[11].text.split()[1].strip(",")
    assert (a[:2], a[3:5], a[6:]) == (b[3:5], b[:2], b[6:])


def test_pseudonyms_inside_longer_runs(spark):
    card, date = "4539 5787 6362 1486", "2021-02-28"
    texts = [
        card, date, f"card {card} 12/27", f"ref 12 {card}.", "4539578763621486 123", f"{card} {card}", f"12 {card} 123 {card} 9",
        f"at {date}T10:00:00Z", f"{date}Tx", "1234 5678 9012 3456 12",
        f"{card} {date}", f"{card} 12th", f"{card} 12-34x", f"12 {card} 389-555-5010", "389-555-5010", "7 " * 9000 + card]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.private for r in pii.pseudonymise(docs, key="k").collect()}
    c, d = got[0].text, got[1].text
    assert c != card and d != date
    plain = c.replace(" ", "")
    expected = [c, d, f"card {c} 12/27", f"ref 12 {c}.", f"{plain} 123", f"{c} {c}", f"12 {c} 123 {c} 9", f"at {d}T10:00:00Z", texts[8], texts[9],
        f"{c} {d}", f"{c} 12th", f"{c} 12-34x", f"12 {c} {got[14].text}", got[14].text]
    assert got[14].text != texts[14] and got[15].text.startswith("7 7 7")
    assert [got[i].text for i in range(15)] == expected
    assert [len(got[i].found) for i in range(15)] == [1, 1, 1, 1, 1, 2, 2, 1, 0, 0, 2, 1, 1, 2, 1]


def network(key, kind, a, b, m, n):
    """The Feistel network, written again from its definition."""
    for i in range(8):
        def f(value, modulus, i=i):
            return int(hashlib.sha256(f"{key}|{kind}|{i}|{value}".encode()).hexdigest()[:14], 16) % modulus

        a, b = ((a + f(b, m)) % m, b) if i % 2 == 0 else (a, (b + f(a, n)) % n)
    return a, b


def card_of(key, digits):
    free = digits[1:-1]
    half, rest = len(free) // 2, len(free) - len(free) // 2
    a, b = network(key, "card", int(free[:half]), int(free[half:]), 10**half, 10**rest)
    body = digits[0] + str(a).zfill(half) + str(b).zfill(rest)
    return next(body + c for c in "0123456789" if luhn(body + c))


def cards_in(key, run):
    """A run of digit groups with its card numbers replaced, one group after another."""
    parts, out, i = re.findall(r"\d+[ -]?", run), "", 0
    while i < len(parts):
        runs = []
        for n in range(1, min(19, len(parts) - i) + 1):
            digits = re.sub(r"\D", "", "".join(parts[i : i + n]))
            if 13 <= len(digits) <= 19 and luhn(digits):
                runs.append(({16: 0, 15: 1}.get(len(digits), len(digits)), n, digits))
        if runs:
            _, n, digits = min(runs)
            new = iter(card_of(key, digits))
            out += re.sub(r"\d", lambda _: next(new), "".join(parts[i : i + n]))  # noqa: B023
            i += n
        else:
            out += parts[i]
            i += 1
    return out


def test_pseudonyms_equal_an_independent_network(spark):
    rng = np.random.default_rng(3)
    runs = ["4539578763621486", "4539 5787 6362 1486"]
    for groups in (5, 40, 255, 256, 257, 700):  # around the length of a stretch
        runs.append(" ".join("".join(map(str, rng.integers(0, 10, rng.choice([1, 2, 4, 4, 6, 16])))) for _ in range(groups)))
    days = ["2021-02-28", "1900-01-01", "2099-12-31"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(runs + days)], "doc_id int, text string")
    got = {r.doc_id: r.private for r in pii.pseudonymise(docs, key="k").collect()}
    for i, run in enumerate(runs):
        whole = re.fullmatch(pii.PATTERNS["card"].replace("++", "+").replace("*+", "*"), run)
        if whole:  # otherwise a date, phone or SSN splits the run
            assert got[i].text == cards_in("k", run), i
    assert sum(len(got[i].found) for i in range(len(runs))) > 50
    first = datetime.date(1900, 1, 1)
    for i, day in enumerate(days, len(runs)):
        a, b = network("k", "date", *divmod((datetime.date.fromisoformat(day) - first).days, 229), 319, 229)
        assert got[i].text == str(first + datetime.timedelta(days=a * 229 + b))


def test_long_digit_runs_take_time_in_proportion(spark):
    rng = np.random.default_rng(5)
    table = " ".join(str(x) for x in rng.integers(0, 100_000, 200_000))
    docs = spark.createDataFrame([(0, table), (1, "7 " * 200_000)], "doc_id int, text string")
    started = time.monotonic()
    rows = {r.doc_id: r.private for r in pii.pseudonymise(docs, key="k").collect()}
    assert time.monotonic() - started < 120  # quadratic: over an hour
    assert len(rows[0].found) > 1000 and len(rows[0].text) == len(table) and rows[1].text == "7 " * 200_000


def test_the_network_permutes(spark):
    pairs = spark.range(319 * 229).select(
        pii.feistel("k", "date", F.floor(F.col("id") / 229), F.col("id") % 229, 319, 229).alias("p"))
    assert pairs.distinct().count() == 319 * 229
    digits = spark.range(1000).select(pii.permuted_digits("k", "x", F.lpad(F.col("id").cast("string"), 3, "0")).alias("d"))
    assert digits.distinct().count() == 1000 and digits.filter("length(d) <> 3").count() == 0


def test_pseudonym_edge_rows(spark):
    got = pii.pseudonymise(frame(spark), key="k").collect()
    assert len(got) == len(ROWS) and all(r.private.text == r.text and r.n == "own" for r in got)
    assert pii.pseudonymise(empty(spark), key="k").count() == 0


# --- mixing


def test_targets_share_the_excess(spark):
    rows = [(i, "x", "en", s, n) for i, (s, n) in enumerate([("a", 10), ("a", 20), ("b", 1000), ("c", 40), (None, 5), ("d", 0)])]
    got = {r.source: r for r in mixing.targets(frame(spark, rows), "source", "n_chars", (3, 1, 2), 1.5, 2.0).collect()}
    left, weights, sizes = 1.5 * 1075, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}, {"a": 30, "b": 1000, "c": 40, "d": 0, None: 5}
    full: dict = {}
    while True:
        share = {s: left * w / sum(weights[x] for x in weights if x not in full) for s, w in weights.items() if s not in full}
        over = {s: 2.0 * sizes[s] for s in share if share[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
        left -= sum(over.values())
    for s, r in got.items():
        assert r.target == pytest.approx((full | share)[s])


@pytest.mark.parametrize("weight", [None, "w"])
def test_mix_meets_its_targets(spark, weight):
    rng = np.random.default_rng(2)
    rows = [(i, "x", "en", "a" if i % 3 == 0 else f"s{i % 7}", int(rng.integers(1, 900))) for i in range(4000)]
    docs = frame(spark, rows).withColumn("w", 1.0 + F.floor(F.col("doc_id") / 3) % 3)
    mixed = mixing.mix(docs, size="n_chars", weight=weight)
    first, again = ({r.doc_id: r.copies for r in m.collect()} for m in (mixed, mixing.mix(docs.repartition(7), size="n_chars", weight=weight)))
    assert first == again and len(first) == 4000 and set(first.values()) <= {0, 1, 2}
    if weight is None:
        for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_chars")).alias("t"), F.max("target").alias("g")).collect():
            assert abs(r.t - r.g) <= 900
    else:
        rates = {r.w: r.m for r in mixed.filter("source = 'a'").groupBy("w").agg(F.avg("copies").alias("m")).collect()}
        assert rates[1.0] < rates[3.0]


def test_mix_edge_rows(spark):
    docs = frame(spark).withColumn("_size", mixing.word_count(F.col("text")))
    rows = mixing.mix(docs, size="_size").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.copies <= 2 and r.n == "own" for r in rows)
    assert mixing.mix(empty(spark).withColumn("_size", F.lit(0)), size="_size").count() == 0


# --- registry


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))

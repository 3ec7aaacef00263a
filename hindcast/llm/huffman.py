"""Token ids as canonical length-limited Huffman code: encode, write, read back.

1. Every text goes through the given tokenizer once. Its ids wait in the shared folder under a working code, made from a
   first look at `LOOK` documents (it only saves space: it covers every id), while all ids of all documents are counted.
2. The counts (one per id of the vocabulary) give code lengths of at most `LIMIT` bits by package-merge, and the
   lengths alone give the code.
3. Documents go to range partitions in ascending id order and are written block by block in the final code. A block is a run of
   whole documents, decodes without any other block, and keeps the bit offset of every `STRIDE`-th id.
4. Reading decodes all strides of a block in lock step, one table look-up per id.

The blocks are rows of a Parquet table in the shared folder (part, block, ids of documents and their lengths,
checkpoints, bits); the code lengths are a second table beside it.

Runs of letters, digits or signs are encoded once per worker and cached, the distinct ones of about a megabyte of text at
a time: with this tokenizer a space stays with the run behind it and a lone line feed is a piece of its own, so pieces do not
depend on one another. Texts with other white space, double spaces or special tokens go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import bytetext
from hindcast.operators.ordering import running_totals
from hindcast.sources.scratch import materialise, scratch_path

LIMIT = 18
STRIDE = 128
BLOCK_IDS = 1 << 18
END_ID = 2
CACHE = 600_000
LOOK = 256
TEXTS = 128
#: White space other than space and line feed.
OTHER_SPACE = tuple(
    "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))
#: Kinds of bytes. Pieces begin at spaces and line feeds, behind line feeds, and between letters, digits and other signs of
#: ASCII, as the tokenizer's own do. Kind 0 (apostrophes for their contractions, bytes of other characters) cuts nothing.
SPACE, FEED = 4, 5
KINDS = np.full(256, 3, np.uint8)
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KINDS[0x30:0x3A] = 2
KINDS[[0x20, 0x0A]] = SPACE, FEED
KINDS[[0x27, *range(0x80, 0x100)]] = 0
WAITING = (
    "doc_id bigint, h bigint, n bigint, marks array<bigint>, bits binary, ids array<bigint>, counts array<bigint>")
BLOCKS = "part int, block int, doc_ids array<bigint>, lengths array<bigint>, checkpoints array<bigint>, bits binary"


# --- tokenizer ---------------------------------------------------------------------------------------------------------


class Encoder:
    """A tokenizer with a cache of pieces (`KINDS`); ids as little-endian 32-bit integers.

    The texts of a call are cut where their bytes are, and each distinct piece is looked up once. A full
    cache loses what only one call has asked for.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that go through the tokenizer whole.
        self.hard = "|".join([r"^[ \n]", r"[ \n]$", r"[ \n][ \n]", "[" + "".join(f"\\x{{{ord(c):x}}}" for c in OTHER_SPACE) + "]", *special])
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cache: dict[str, int] = {}  # piece i has the ids begin[i] .. begin[i + 1] - 1
        self.ids, self.begin, self.asked = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.splits = len(self.feed) == 1 and self._splits()

    def _splits(self) -> bool:
        """Whether pieces are independent in this tokenizer, tried on a line of every kind of piece."""
        probe = "ab, it's 12 é\nZ9? !x\n(日本 x,'s 3,a'd2 é,a1!é"
        return self._whole(probe).tolist() == self._pieces(pa.array([probe]), 0)[0].tolist()[:-1]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, keys: list[str]) -> None:
        # "\n word\nword": each key becomes one line, so the line feed's id parts the ids of the keys.
        lines = ["\n" + "\n".join(keys[i : i + 1000]) for i in range(0, len(keys), 1000)]
        found = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([*found, np.array(self.feed, "<u4")])
        cuts = np.flatnonzero(ids == self.feed[0])
        lengths = np.diff(cuts) - 1
        begin = self.begin[-1] + np.cumsum(np.append(0, lengths))
        if len(lengths) != len(keys):
            raise ValueError("the tokenizer joins lines")
        self.cache.update(zip(keys, range(len(self.cache), len(self.cache) + len(keys)), strict=True))
        self.ids = np.concatenate([self.ids, ids[ids != self.feed[0]]])
        self.begin = np.concatenate([self.begin, begin[1:]])
        self.asked = np.concatenate([self.asked, np.zeros(len(keys), np.int32)])

    def _sweep(self) -> None:
        """Make room: pieces asked for in one call only since the last sweep go."""
        kept = self.asked > 1
        if kept.sum() > CACHE // 2:
            kept[:] = False
        lengths = np.diff(self.begin)
        self.ids = self.ids[np.repeat(kept, lengths)]
        self.begin = np.append(0, np.cumsum(lengths[kept]))
        self.asked = np.zeros(int(kept.sum()), np.int32)
        self.cache = {k: i for i, k in enumerate(k for k, keep in zip(self.cache, kept.tolist(), strict=True) if keep)}

    def _places(self, keys: list[str]) -> np.ndarray:
        """Where distinct pieces are in the cache."""
        if len(self.cache) + len(keys) > CACHE:
            self._sweep()
        at = np.fromiter(map(self.cache.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.cache), len(self.cache) + len(new))  # where `_learn` puts them
            self._learn([keys[i] for i in new.tolist()])
        self.asked[at] += 1
        return at

    def _pieces(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """`encode` of texts that split. Each text gets a line feed in front; its id becomes the end of the text before."""
        data, offsets = bytetext.string_bytes(pc.binary_join_element_wise("", texts, "\n"))
        kind = KINDS[data]
        cut = kind >= SPACE
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (kind[:-1] != SPACE)
        starts = np.flatnonzero(cut | (np.append(0, kind[:-1]) == FEED))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        feeds, first = kind[starts] == FEED, np.searchsorted(starts, offsets[:-1])
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        feed = words.index("\n")  # in front of the first text
        named = np.arange(len(words)) != feed
        del words[feed]
        at = self._places(words)
        begin, lengths = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
        begin[named], lengths[named] = self.begin.take(at), self.begin.take(at + 1) - self.begin.take(at)
        index = coded.indices.to_numpy()
        sizes = lengths[index] + feeds  # a line feed is one id, put in below
        ends = np.cumsum(sizes)
        out = np.full(int(ends[-1]), self.feed[0], "<u4")
        own = np.flatnonzero(~feeds)
        out[np.repeat(~feeds, sizes)] = self.ids[bytetext.ranges(begin[index[own]], sizes[own])]
        out = np.append(out[1:], np.array([end], "<u4"))
        out[(ends - sizes)[first[1:]] - 1] = end
        return out, np.add.reduceat(sizes, first)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, `end` behind each; number of ids of each)."""
        if texts.null_count:
            texts = texts.fill_null("")
        easy = np.zeros(len(texts), bool)
        if self.splits:
            easy = ~pc.match_substring_regex(texts, self.hard).to_numpy(zero_copy_only=False)
        if easy.all() and len(texts):
            return self._pieces(texts, end)
        whole = [np.append(self._whole(t), np.array([end], "<u4")) for t in texts.filter(pa.array(~easy)).to_pylist()]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~easy] = [len(x) for x in whole]
        if easy.any():
            ids, sizes[easy] = self._pieces(texts.filter(pa.array(easy)), end)
        out, at = np.empty(sizes.sum(), "<u4"), np.cumsum(sizes) - sizes
        out[bytetext.ranges(at[~easy], sizes[~easy])] = np.concatenate([*whole, np.zeros(0, "<u4")])
        if easy.any():
            out[bytetext.ranges(at[easy], sizes[easy])] = ids
        return out, sizes


_encoders: dict[int, Encoder] = {}


def _encoder(definition) -> Encoder:
    """One per worker process and tokenizer."""
    number = zlib.crc32(definition.value.encode())
    if number not in _encoders:
        _encoders[number] = Encoder(definition.value)
    return _encoders[number]


def _encoded(definition, batches, end: int, *more: str) -> Iterator[tuple]:
    """(document ids, the token ids of all with the end ids, their numbers, further columns) of some documents at a time."""
    encoder = _encoder(definition)
    for batch in batches:
        texts = batch.column("text")
        for first, last, _, _ in bytetext.chunks(texts):
            some = batch.slice(first, last - first)
            yield some.column("doc_id"), *encoder.encode(texts.slice(first, last - first), end), *[some.column(c) for c in more]


# --- code --------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        kinds.append(by < len(leaves))
    take = 2 * len(leaves) - 2
    for leaf in reversed(kinds):  # what is taken is a prefix of every row
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """Canonical code of the lengths, and its decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.width = width = max(1, int(lengths.max(initial=1)))
        spans = np.int64(1) << (width - self.lengths[order])
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (width - self.lengths[order])).astype(np.uint64)
        self.symbol = np.zeros(1 << width, np.uint32)
        self.step = np.ones(1 << width, np.int64)
        self.symbol[: spans.sum()] = np.repeat(order, spans)
        self.step[: spans.sum()] = np.repeat(self.lengths[order], spans)

    def _pack(self, ids: np.ndarray, start: np.ndarray, words: int) -> np.ndarray:
        """64-bit words with every id's code at its bit; starts ascend and codes do not overlap."""
        out = np.zeros(words, np.uint64)
        if len(ids):
            code, word = self.codes[ids], start >> 6
            room = 64 - (start & 63) - self.lengths[ids]
            inside = np.where(
                room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[heads]] |= np.bitwise_or.reduceat(inside, heads)
            over = np.flatnonzero(room < 0)  # at most one id runs over into each word
            out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return out

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every STRIDE-th id)."""
        bits, marks = self.encode_each(ids, np.array([len(ids)]))
        return bits[0], marks[0]

    def encode_each(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """The bits and offsets of each of several runs of ids."""
        end = np.cumsum(self.lengths[ids])
        start = end - self.lengths[ids]
        last = np.cumsum(sizes)
        edge = np.concatenate([[0], end])[np.concatenate([[0], last])]  # bits before each run
        words = np.diff(edge) // 64 + 2
        base = np.cumsum(words) - words
        own = start - np.repeat(edge[:-1], sizes)
        raw = self._pack(ids, own + np.repeat(base * 64, sizes), int(words.sum())).astype(">u8").tobytes()
        bits = [raw[8 * b : 8 * (b + w)] for b, w in zip(base.tolist(), words.tolist(), strict=True)]
        firsts = last - sizes
        return bits, [own[a : a + n : STRIDE] for a, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        return self.decode_each([bits], [checkpoints], np.array([n]))

    def decode_each(self, bits: list[bytes], marks: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """The ids of several runs, one behind the other: all strides in lock step, longest first."""
        words = np.frombuffer(b"".join([*bits, bytes(8)]), ">u8").astype(np.uint64)
        base = np.cumsum([0] + [len(b) // 8 for b in bits])[:-1]
        strides = np.array([len(m) for m in marks])
        at = np.concatenate(marks).astype(np.int64) + np.repeat(base * 64, strides)
        left = np.full(len(at), STRIDE)
        full = np.flatnonzero(strides)
        left[np.cumsum(strides)[full] - 1] = sizes[full] - STRIDE * (strides[full] - 1)
        order = np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        out = np.zeros((len(at), STRIDE), np.uint32)
        alive = np.searchsorted(-left, -np.arange(STRIDE), side="left")  # strides longer than j
        for j in range(STRIDE):
            live = at[: alive[j]]
            if not len(live):
                break
            word, off = live >> 6, (live & 63).astype(np.uint64)
            window = (words[word] << off) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - off))
            entry = (window >> np.uint64(64 - self.width)).astype(np.int64)
            out[: len(live), j] = self.symbol[entry]
            live += self.step[entry]
        back = np.empty_like(out)
        back[order] = out
        kept = np.empty(len(at), np.int64)
        kept[order] = left
        return back[np.arange(STRIDE) < kept[:, None]]


# --- jobs --------------------------------------------------------------------------------------------------------------


def _counter(definition, end: int, size: int):
    def count(batches):
        total = np.zeros(size, np.int64)
        for _, ids, _ in _encoded(definition, batches, end):
            total += np.bincount(ids, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return count


def _ints(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _waiting(definition, lengths, end: int):
    """Rows of documents in the working code; each task ends with one row of its id counts (its n is null)."""

    def rows(batches):
        code = Code(lengths.value)
        total = np.zeros(len(lengths.value), np.int64)
        for names, ids, sizes, hashes in _encoded(definition, batches, end, "h"):
            total += np.bincount(ids, minlength=len(total))
            bits, marks = code.encode_each(ids, sizes)
            none = pa.nulls(len(sizes), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [names, hashes, pa.array(sizes), _ints(marks), pa.array(bits, pa.binary()), none, none],
                ["doc_id", "h", "n", "marks", "bits", "ids", "counts"])
        used = np.flatnonzero(total)
        null = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [null, null, null, pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), _ints([used]), _ints([total[used]])],
            ["doc_id", "h", "n", "marks", "bits", "ids", "counts"])

    return rows


def _writer(working, lengths):
    def blocks(batches):
        old, code, part, number = Code(working.value), Code(lengths.value), TaskContext.get().partitionId(), 0
        docs, held, sizes, size = [], [], [], 0

        def block():
            bits, checkpoints = code.encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), _ints([checkpoints]), pa.array([bits], pa.binary())],
                ["part", "block", "doc_ids", "lengths", "checkpoints", "bits"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                n = some.column("n").to_numpy(zero_copy_only=False)
                marks = [m.values.to_numpy(zero_copy_only=False) for m in some.column("marks")]
                ids = old.decode_each(some.column("bits").to_pylist(), marks, n)
                last = np.cumsum(n)
                for name, a, b in zip(some.column("doc_id").to_pylist(), (last - n).tolist(), last.tolist(), strict=True):
                    docs.append(name)
                    held.append(ids[a:b])
                    sizes.append(b - a)
                    size += b - a
                    if size >= BLOCK_IDS:
                        yield block()
                        docs, held, sizes, size, number = [], [], [], 0, number + 1
        if docs:
            yield block()

    return blocks


def _reader(lengths):
    def rows(batches):
        code = Code(lengths.value)
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, docs, sizes, marks, bits = (batch.column(c)[i] for c in range(6))
                sizes = sizes.values.to_numpy(zero_copy_only=False)
                n = int(sizes.sum())
                ids = code.decode(bits.as_py(), marks.values.to_numpy(zero_copy_only=False), n).astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (b - s) : 4 * b]) for s, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([(part.as_py() << 32) + block.as_py()] * len(sizes), pa.int64()), docs.values, pa.array(ends - sizes),
                    pa.array(sizes), pa.array(sums, pa.int64())], ["at", "doc_id", "inside", "n_tokens", "ids_crc32"])

    return rows


def write_ids(docs: DataFrame, tokenizer: str, path: str, *, key: str = "doc_id", text: str = "text", end: int = END_ID) -> None:
    """Encode every text and write blocks and code under `path`. `tokenizer`: its definition file, read on the driver.

    Order: ascending id, null first, then text hash; repeated rows follow one another. Null text: empty. Each document ends with `end`.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    size = max(Encoder(definition.value).tokenizer.get_vocab_size(), end + 1)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    look = np.ones(size, np.int64)
    for row in plain.limit(LOOK).mapInArrow(_counter(definition, end, size), "id bigint, n bigint").collect():
        look[row["id"]] += 64 * row["n"]
    working = spark.sparkContext.broadcast(code_lengths(look))
    waiting = materialise(plain.mapInArrow(_waiting(definition, working, end), WAITING), "waiting-ids")
    counts = np.zeros(size, np.int64)
    tasks = waiting.filter("n is null").select(F.explode(F.arrays_zip("ids", "counts")).alias("c"))
    for row in tasks.groupBy("c.ids").agg(F.sum("c.counts").alias("n")).collect():  # one row per id of the vocabulary
        counts[row["ids"]] = row["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id bigint, length bigint").coalesce(
        1).write.parquet(f"{path}/code")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hash and the row number let a range boundary fall among equal ids and among repeated rows.
    keyed = waiting.filter("n is not null").select("doc_id", "h", "n", "marks", "bits", F.monotonically_increasing_id().alias("r"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("r")]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = ordered.select("doc_id", "n", "marks", "bits").mapInArrow(_writer(working, spark.sparkContext.broadcast(lengths)), BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decode the blocks under `path`: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    stored = {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/code").collect()}  # one row per id of the vocabulary
    lengths = np.zeros(max(stored, default=0) + 1, np.int64)
    for i, n in stored.items():
        lengths[i] = n
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(
        _reader(spark.sparkContext.broadcast(lengths)), "at bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = blocks.select(
        ((F.col("part").cast("long") * (1 << 32)) + F.col("block")).alias("at"),
        F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("size"))
    before = running_totals(sizes, "at", ["size"], inclusive=False).select(F.col("at").alias("_at"), "cum_size")
    return rows.join(before, rows["at"] == before["_at"]).select(
        "doc_id", (F.col("cum_size") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end: int = END_ID) -> DataFrame:
    """Write the ids of `docs` to a fresh folder and return what the files say of each row. Empty table: no rows."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path, key=key, text=text, end=end)
    return read_ids(docs.sparkSession, path)

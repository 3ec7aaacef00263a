"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's word windows.

A shard is a run of whole documents inside one Arrow batch. Words that no benchmark item has cannot lie in a
window, so they only break the indexed text: the index holds the runs of benchmark words, which keeps it small
whatever the training text is. Windows are searched right to left through the wavelet ranks, their places come
from sampled suffix positions, and overlapping places merge into removal spans. Word identity goes by 64-bit
hashes inside the index; every place found is compared byte by byte before it counts.

The benchmark is a stated query set. It goes to the executors in blocks of bounded size (`BLOCK_BYTES` of text),
one pass over the documents per block, so neither the driver nor a broadcast holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm import bytetext
from hindcast.llm.columns import field, pack, packed, unpack
from hindcast.llm.fm_index import FMIndex
from hindcast.sources.scratch import materialise

WINDOW = 10
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 2 << 20
RESULT = "struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>, kept: string>"
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())), ("kept", pa.string()),
])


class Phrases:
    """The windows of a block of items, as symbols of the block's own vocabulary."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids: list[str] = []
        names: dict[str, int] = {}
        vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            data = bytetext.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = bytetext.words(data, np.array([0, len(data)]), bytetext.NOT_ALNUM)
            raw = data.tobytes()
            symbols = [vocabulary.setdefault(raw[a:b], len(vocabulary) + 2) for a, b in zip(starts, ends, strict=True)]
            number = -1
            if item is not None:
                number = names.setdefault(item, len(names))
            for i in range(max(1, len(symbols) - window + 1) if symbols else 0):
                windows.setdefault(tuple(symbols[i : i + window]), set()).add(number)
        self.ids = list(names)
        self.words = list(vocabulary)
        hashes = np.array([bytetext.hash_of(w) for w in self.words], np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.symbols = hashes[by], by + 2
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)
        self.starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        self.groups = []
        for size in sorted({len(w) for w in windows}):
            keys = [w for w in windows if len(w) == size]
            owners = [sorted(windows[w] - {-1}) for w in keys]
            bounds = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
            self.groups.append((np.array(keys, np.int64), np.array([x for o in owners for x in o], np.int64), bounds))
        self.shortest = min((len(w) for w in windows), default=0)


def _symbols(phrases: Phrases, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Benchmark symbol of every word, 1 for a word that no item has."""
    hashes = bytetext.word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(phrases.hashes, hashes), len(phrases.hashes) - 1)
    return np.where(phrases.hashes[at] == hashes, phrases.symbols[at], 1)


def _indexed(symbols: np.ndarray, bounds: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text to index, word number of each of its symbols): runs of benchmark words between single breaks."""
    breaks = bounds[1:-1]
    text = np.insert(symbols, breaks, 1)
    word = np.insert(np.arange(len(symbols)), breaks, -1)
    known = text != 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
    first, length = edge[::2], edge[1::2] - edge[::2]
    long = length >= shortest
    first, length = first[long], length[long]
    take = bytetext.ranges(first, length + 1)  # each run and the break behind it
    text, word = np.append(text, 1), np.append(word, -1)
    return text[take], word[take]


def _exact(phrases: Phrases, data, starts, ends, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Whether the words at these numbers have exactly the bytes of their symbols."""
    mine = phrases.starts[symbols - 2]
    size = phrases.lengths[symbols - 2]
    same = ends[at] - starts[at] == size
    if same.any():
        a = data[bytetext.ranges(starts[at[same]], size[same])]
        b = phrases.bytes[bytetext.ranges(mine[same], size[same])]
        bad = np.add.reduceat(a != b, np.cumsum(size[same]) - size[same]) > 0
        same[np.flatnonzero(same)[bad]] = False
    return same


def _shard(phrases: Phrases, raw: np.ndarray, offsets: np.ndarray) -> list[dict]:
    data = bytetext.LOWER[raw]
    starts, ends, bounds = bytetext.words(data, offsets, bytetext.NOT_ALNUM)
    out = [{"n_words": int(n), "spans": [], "items": [], "kept": None} for n in np.diff(bounds)]
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    if len(starts) and len(phrases.hashes):
        symbols = _symbols(phrases, data, starts, ends)
        text, word = _indexed(symbols, bounds, phrases.shortest)
        if len(text):
            index = FMIndex(text)
            owned: list[np.ndarray] = []
            for patterns, owners, owner_bounds in phrases.groups:
                low, high = index.search(patterns)
                found = np.flatnonzero(high > low)
                if not len(found):
                    continue
                rows = bytetext.ranges(low[found], (high - low)[found])
                which = np.repeat(found, (high - low)[found])
                place = word[index.locate(rows)]
                size = patterns.shape[1]
                covered = place[:, None] + np.arange(size)
                flat, back = np.unique(covered.ravel(), return_inverse=True)
                right = _exact(phrases, data, starts, ends, flat, symbols[flat])[back.reshape(covered.shape)].all(axis=1)
                place, which = place[right], which[right]
                hits.append((place, np.full(len(place), size)))
                n_owners = np.diff(owner_bounds)[which]
                doc = np.searchsorted(bounds, place, side="right") - 1
                owned.append(np.stack([np.repeat(doc, n_owners), owners[bytetext.ranges(owner_bounds[which], n_owners)]]))
            if owned:
                for doc, item in np.unique(np.concatenate(owned, axis=1), axis=1).T:
                    out[doc]["items"].append(phrases.ids[item])
    if hits:
        mark = np.zeros(len(starts) + 1, np.int64)
        for place, size in hits:
            np.add.at(mark, place, 1)
            np.add.at(mark, place + size, -1)
        hit = np.cumsum(mark)[:-1] > 0
        begins = hit.copy()
        begins[1:] &= ~hit[:-1]
        begins[bounds[:-1][bounds[:-1] < len(hit)]] |= hit[bounds[:-1][bounds[:-1] < len(hit)]]
        first = np.flatnonzero(begins)
        stops = hit.copy()
        stops[:-1] &= ~hit[1:] | begins[1:]
        last = np.flatnonzero(stops)
        doc = np.searchsorted(bounds, first, side="right") - 1
        for d, a, b in zip(doc, first, last, strict=True):
            out[d]["spans"].append({"start": int(a - bounds[d]), "end": int(b + 1 - bounds[d])})
    return out


def _annotate(block):
    @F.arrow_udf(RESULT)
    def annotate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for _, _, data, offsets in bytetext.chunks(batch, SHARD_BYTES):
                rows.extend(_shard(block.value, data, offsets))
            yield pa.array(rows, _ARROW)

    return annotate


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, str | None]]]:
    block, size = [], 0
    for item, body in items.select(field(item_id).cast("string"), field(text)).toLocalIterator(prefetchPartitions=False):
        block.append((item, body))
        size += len(body or "") + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, cut: bool = False, result: str = "leak",
) -> DataFrame:
    """Every row of `docs` with `result`: n_words, merged word spans [start, end), items found, text without them.

    Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters. A window is `window`
    consecutive words of an item, or the whole item when it has fewer. `kept` is null unless `cut`.

    Null or empty text: no words, no spans. Null item text: no windows. Null item id: its windows mark words but
    name no item. Repeated items count once, repeated documents are rows of their own. Empty tables give
    empty spans. All columns of `docs` are kept; one named like `result` is replaced.
    """
    spark = docs.sparkSession
    out, passes = pack(docs), 0
    for listed in _blocks(items, item_id, item_text):
        found = _annotate(spark.sparkContext.broadcast(Phrases(listed, window)))(packed(text))
        if passes:  # a further block: its findings merge into the earlier ones
            out = materialise(out, "decontaminate").withColumn("_now", found)
            out = out.select("_doc", _merged(F.col("_leak"), F.col("_now")).alias("_leak"))
        else:
            out = out.withColumn("_leak", found)
        passes += 1
    if not passes:
        out = out.withColumn("_leak", _annotate(spark.sparkContext.broadcast(Phrases([], window)))(packed(text)))
    leak = F.col("_leak")
    if cut:
        leak = leak.withField("kept", _cut(packed(text), leak["spans"]))
    return unpack(out, docs.columns, **{result: leak})


def _merged(before: Column, now: Column) -> Column:
    """Two findings of the same text as one: spans that overlap or touch join."""
    spans = F.array_sort(F.concat(before["spans"], now["spans"]))
    start = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def step(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)  # null while nothing is done
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(
            last["end"] >= span["start"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(span)))

    return F.struct(
        before["n_words"].alias("n_words"), F.aggregate(spans, start, step).alias("spans"),
        F.array_distinct(F.concat(before["items"], now["items"])).alias("items"), before["kept"].alias("kept"))


def _cut(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for body, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if found:
                raw = np.frombuffer(body.encode(), np.uint8)
                starts, ends, _ = bytetext.words(bytetext.LOWER[raw], np.array([0, len(raw)]), bytetext.NOT_ALNUM)
                whole, at, parts = raw.tobytes(), 0, []
                for span in found:
                    parts.append(whole[at : starts[span["start"]]])
                    at = int(ends[span["end"] - 1])
                body = (b"".join(parts) + whole[at:]).decode()
            out.append(body)
        return pa.array(out, pa.string())

    return cut(text, spans)


def removed_words(spans: Column) -> Column:
    """Words inside the merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])

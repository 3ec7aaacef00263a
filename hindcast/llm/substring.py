"""Substring dedup: word windows that already start earlier in the corpus, found by FM-indexes over shards.

1. Each window of `WINDOW` words is given an anchor: the smallest hash among its three-word pieces. Equal windows have equal anchors, and
   neighbours mostly share one, so a text becomes runs (anchor, start, windows).
2. An anchor that occurs once in the corpus cannot belong to a repeat. The other runs become segments (their words), dealt to shards by
   anchor, so equal windows meet in one shard. An anchor with more than `HOT` runs is dealt by whole windows instead: a line that a third
   of all documents have spreads over all shards.
3. A shard builds an FM-index over its distinct segments and streams them through it from the right: backward search on
   the wavelet ranks carries the match, cut back to WINDOW words whenever it is longer. Its length is the matching statistic; an interval at
   full length holds all equal windows, and the earliest of them stays.
4. Each document collects the windows that stay; every other window of a repeated anchor is covered, and covered words go.

Segments are real words, so hashes only decide who meets, never what is equal. Equal segments of an Arrow batch
leave as one row, so copies of a passage do not pile up in a shard. Runs, candidates and results go through the shared folder or a
shuffle; nothing passes through the driver but two totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm import bytetext
from hindcast.llm.columns import field, pack, packed, unpack
from hindcast.llm.fm_index import FMIndex
from hindcast.operators.ordering import running_totals
from hindcast.sources.scratch import materialise

WINDOW = 20
PIECE = 3
HOT = 4096
SHARD_WORDS = 1 << 18
LONGEST = 64  # windows of a segment


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] (shorter at the end)."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _anchors(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first word, windows, whether the anchor stands there more than once) of the runs of windows with one anchor.

    Word numbers run over all texts."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.astype(np.uint64), none, none, none.astype(bool)
    pieces = hashes[: n - PIECE + 1].copy()
    for j in range(1, PIECE):
        pieces = bytetext.mix(pieces * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - PIECE + 1 + j])
    least = _sliding_min(pieces, window - PIECE + 1)[: n - window + 1]
    last = np.repeat(bounds[1:], np.diff(bounds))[: n - window + 1]
    valid = np.arange(n - window + 1) + window <= last
    at = np.flatnonzero(valid)
    if not len(at):
        return none.astype(np.uint64), none, none, none.astype(bool)
    value = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(fresh)
    value, at, count = value[heads], at[heads], np.diff(np.append(heads, len(at)))
    reach = count + window - PIECE
    places = np.add.reduceat(pieces[bytetext.ranges(at, reach)] == np.repeat(value, reach), np.cumsum(reach) - reach, dtype=np.int64)
    return value, at, count, places > 1


# A run travels as one integer: first word, windows (31 bits), and whether its anchor stands in it more than once.
def _start(place: np.ndarray) -> np.ndarray:
    return place >> 32


def _windows(place: np.ndarray) -> np.ndarray:
    return (place & 0xFFFFFFFF) >> 1


def _runs(window: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("n").to_numpy(zero_copy_only=False)
            for first, _, data, offsets in bytetext.chunks(batch.column("text")):
                starts, ends, bounds = bytetext.words(data, offsets)
                anchor, at, count, again = _anchors(bytetext.word_hashes(data, starts, ends), bounds, window)
                doc = np.searchsorted(bounds, at, side="right") - 1
                place = ((at - bounds[doc]) << 32) | (count << 1) | again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(number[first + doc]), pa.array(place)], ["anchor", "n", "place"])

    return runs


def _normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one space apart, and where each starts."""
    lengths = ends - starts + 1
    out = data[np.minimum(bytetext.ranges(starts, lengths), max(len(data) - 1, 0))]
    first = np.cumsum(lengths) - lengths
    out[first[1:] - 1] = 0x20
    if len(out):
        out[-1] = 0x20
    return out, np.append(first, len(out))


def _segments(window: int, shards: int):
    """Segments of the runs listed in `runs`: (shard, n, start, segment), equal segments of a batch once (the first)."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("n").to_numpy(zero_copy_only=False)
            lists = batch.column("runs")
            run_ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            flat = lists.flatten()
            place, anchor, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            start, count = _start(place), _windows(place)
            for first, last, data, offsets in bytetext.chunks(batch.column("text"), 4 * bytetext.CHUNK_BYTES):
                a, b = run_ends[first], run_ends[last]
                doc = np.repeat(np.arange(first, last), np.diff(run_ends[first : last + 1]))
                starts, ends, bounds = bytetext.words(data, offsets)
                hashes = bytetext.word_hashes(data, starts, ends)
                # Hot runs fall apart into single windows; long ones into overlapping pieces.
                size = np.where(hot[a:b], 1, LONGEST)
                pieces = -(-count[a:b] // size)
                index = np.repeat(np.arange(b - a), pieces)
                inside = bytetext.ranges(np.zeros(len(pieces), np.int64), pieces) * size[index]
                begin = start[a:b][index] + inside
                span = np.minimum(size[index], count[a:b][index] - inside) + window - 1
                word = bounds[doc[index] - first] + begin
                route = anchor[a:b][index].view(np.uint64).copy()
                single = hot[a:b][index].astype(bool)
                if single.any():  # the whole window decides
                    mixed = np.zeros(int(single.sum()), np.uint64)
                    for j in range(window):
                        mixed = bytetext.mix(mixed * np.uint64(0xD6E8FEB86659FD93) + hashes[word[single] + j])
                    route[single] = mixed
                text, at = _normal(data, starts, ends)
                body = bytetext.slices(text, at[word], at[word + span] - 1)
                named = number[doc[index]]
                order = np.lexsort((begin, named))
                codes = body.dictionary_encode().indices.to_numpy(zero_copy_only=False)[order]
                keep = np.sort(order[np.unique(codes, return_index=True)[1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((route[keep] % np.uint64(shards)).astype(np.int64)), pa.array(named[keep]), pa.array(begin[keep]),
                     body.take(pa.array(keep)).cast(pa.string())], ["shard", "n", "start", "segment"])

    return segments


def first_windows(segments: pa.Array, n: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, start, windows) of the runs of windows that no equal window precedes in (n, start) order, inside one shard."""
    order = np.lexsort((start, n))
    coded = segments.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)[order]
    own = order[np.sort(np.unique(codes, return_index=True)[1])]  # first of each distinct segment, in order
    n, start, distinct = n[own], start[own], segments.take(pa.array(own))
    data, offsets = bytetext.string_bytes(distinct)
    starts, ends, bounds = bytetext.words(data, offsets)
    symbols = bytetext.slices(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
    lengths = np.diff(bounds)
    # Segments with a break (symbol 1) behind each.
    base = bounds[:-1] + np.arange(len(lengths))
    text = np.ones(len(symbols) + len(lengths), np.int64)
    text[bytetext.ranges(base, lengths)] = symbols
    index = FMIndex(text, depth=window + 1)
    group = np.repeat(np.arange(len(index.groups) - 1), np.diff(index.groups)) if len(index.groups) > 1 else np.zeros(index.size, int)
    # Stream every segment from its end; longest first, so those still running are a prefix.
    by_length = np.argsort(-lengths, kind="stable")
    low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), index.size)
    matched = np.zeros(len(lengths), np.int64)
    found = np.full(len(text), -1)  # for each window, by the text position of its first word: the row group it matched
    running = len(lengths)
    longest = int(lengths.max(initial=0))
    for step in range(1, longest + 1):
        while running and lengths[by_length[running - 1]] < step:
            running -= 1
        live = by_length[:running]
        at = base[live] + lengths[live] - step
        low[live], high[live] = index.extend(text[at], low[live], high[live])
        matched[live] += 1
        over = live[matched[live] > window]
        low[over] = index.groups[group[low[over]]]
        high[over] = index.groups[group[low[over]] + 1]
        matched[over] = window
        full = matched[live] == window
        found[at[full]] = group[low[live[full]]]
    place = np.flatnonzero(found >= 0)
    # Text positions are already in (n, start) order from segment to segment only; rank windows by their own place.
    segment = np.searchsorted(base, place, side="right") - 1
    word = start[segment] + place - base[segment]
    ranked = np.lexsort((word, n[segment]))
    first = np.unique(found[place[ranked]], return_index=True)[1]
    chosen = np.sort(ranked[first])
    place, segment, word = place[chosen], segment[chosen], word[chosen]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])
    heads = np.flatnonzero(fresh)
    return n[segment[heads]], word[heads], np.diff(np.append(heads, len(place)))


def _shard(window: int):
    def shard(table: pa.Table) -> pa.Table:
        got = first_windows(
            table.column("segment").combine_chunks(), table.column("n").to_numpy(), table.column("start").to_numpy(), window)
        return pa.table([pa.array(got[0]), pa.array((got[1] << 32) | (got[2] << 1))], names=["n", "place"])

    return shard


def _covered(window: int):
    @F.arrow_udf("struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, kept: string>")
    def covered(texts: pa.Array, runs: pa.Array, stay: pa.Array) -> pa.Array:
        kind = pa.struct([
            ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])

        def windows(lists: pa.Array, first: int, last: int, bounds: np.ndarray) -> np.ndarray:
            part = lists.slice(first, last - first)
            sizes = pc.fill_null(part.value_lengths(), 0).to_numpy(zero_copy_only=False)
            place = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            return bytetext.ranges(_start(place) + np.repeat(bounds[:-1], sizes), _windows(place))

        out = []
        for first, last, data, offsets in bytetext.chunks(texts):
            starts, ends, bounds = bytetext.words(data, offsets)
            gone = np.zeros(len(starts) + 1, bool)
            gone[windows(runs, first, last, bounds)] = True
            gone[windows(stay, first, last, bounds)] = False
            at = np.flatnonzero(gone)
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            out_word = np.cumsum(cover)[:-1] > 0
            stays = np.flatnonzero(~out_word)
            text, place = _normal(data, starts[stays], ends[stays])
            count = np.searchsorted(stays, bounds)
            whole = text.tobytes()
            begins = out_word.copy()
            begins[1:] &= ~out_word[:-1]
            inner = bounds[1:-1][bounds[1:-1] < len(starts)]
            begins[inner] = out_word[inner]
            heads = np.flatnonzero(begins)
            tails = np.concatenate([heads[1:], [len(starts)]])
            total = np.concatenate([[0], np.cumsum(out_word)])
            span_end = heads + (total[tails] - total[heads])
            owner = np.searchsorted(bounds, heads, side="right") - 1
            spans: list[list[dict]] = [[] for _ in range(last - first)]
            for d, a, b in zip(owner.tolist(), heads.tolist(), span_end.tolist(), strict=True):
                spans[d].append({"start": a - int(bounds[d]), "end": b - int(bounds[d])})
            for d in range(last - first):
                a, b = place[count[d]], place[count[d + 1]]
                out.append({"n_words": int(bounds[d + 1] - bounds[d]), "spans": spans[d], "kept": whole[a : max(a, b - 1)].decode()})
        return pa.array(out, kind)

    return covered


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """The packed documents with a number `n` in document order, and whether numbers are unique.

    Unique ids are the numbers themselves. Otherwise documents are distinct (id, text) pairs in order of id (null first) and text
    hash; repeated rows share their number.
    """
    ids = docs.agg(
        F.count("*").alias("rows"), F.count_distinct(field(key)).alias("distinct")).first()
    given = pack(docs)
    if ids["rows"] == ids["distinct"]:
        return given.select("_doc", packed(key).cast("long").alias("n")), True
    hashed = given.select("_doc", packed(key).alias("_i"), F.xxhash64(F.coalesce(packed(text), F.lit(""))).alias("_h"))
    keys = materialise(
        hashed.select(F.col("_i").alias("_k"), F.col("_h").alias("_kh")).distinct().withColumn("one", F.lit(1)), "numbers")
    ranks = materialise(running_totals(keys, "_k", ["one"], tie="_kh").select("_k", "_kh", F.col("cum_one").alias("n")), "numbers")
    return hashed.join(ranks, F.col("_i").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_kh"))).select("_doc", "n"), False


def dedup_substrings(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, result: str = "repeat",
) -> DataFrame:
    """Every row of `docs` with `result`: n_words, spans [start, end) of words that go, kept (the other words, one space apart).

    Words are runs of characters other than space and \\x09-\\x0D, unchanged. A word goes when a window of `window` words covers it whose
    word sequence also starts earlier: in a document with a smaller id, or earlier in the same one. All windows are judged on
    the input. Null or empty text: no words. Ids that repeat or are null: see `numbered`; repeated rows are one document and
    get its result each. Empty table: no rows. Columns n, runs and stay are added on the way and must not be in `docs`.
    """
    rows, unique = numbered(docs, key, text)
    plain = rows.select("n", packed(text).alias("text"))
    if not unique:
        plain = plain.groupBy("n").agg(F.first("text").alias("text"))
    runs = materialise(plain.mapInArrow(_runs(window), "anchor bigint, n bigint, place bigint"), "runs")
    weight = F.when(F.col("place") % 2 == 1, 2).otherwise(1)  # a window can repeat inside such a run
    often = runs.groupBy("anchor").agg(F.sum(weight).alias("_times")).filter("_times > 1").withColumnRenamed("anchor", "_a")
    found = runs.join(often, F.col("anchor") == F.col("_a")).select(
        "n", F.struct("place", "anchor", (F.col("_times") > HOT).alias("hot")).alias("run"))
    candidates = materialise(found.groupBy("n").agg(F.collect_set("run").alias("runs")), "candidates")
    span = lambda r: F.shiftright(r["place"].bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    words = candidates.agg(F.sum(F.aggregate(
        "runs", F.lit(0).cast("long"),
        lambda t, r: t + F.when(r["hot"], span(r) * window).otherwise(span(r) + window - 1)))).first()[0] or 0
    shards = 1 + int(words) // SHARD_WORDS
    ready = plain.join(candidates, "n").select("n", "text", "runs")
    segments = ready.mapInArrow(_segments(window, shards), "shard bigint, n bigint, start bigint, segment string")
    stay = segments.groupBy("shard").applyInArrow(_shard(window), "n bigint, place bigint")
    stay = stay.groupBy("n").agg(F.collect_list("place").alias("stay"))
    listed = candidates.select("n", F.transform("runs", lambda r: r["place"]).alias("runs"))
    # The Python step comes last: it does not keep the partitioning that the joins share.
    judged = plain.join(listed, "n", "left").join(stay, "n", "left").join(rows, "n").select(
        "_doc", _covered(window)(F.col("text"), F.col("runs"), F.col("stay")).alias("_judged"))
    return unpack(judged, docs.columns, **{result: F.col("_judged")})

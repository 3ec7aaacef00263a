"""Execution traces: final attempts, tool usage, behaviour, repeated calls, digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.blocks import ranges_of
from hindcast.operators.latest import last_line_wins
from hindcast.operators.uncertainty import percentile_linear
from hindcast.sources.scratch import materialise, remove, scratch_path

# Fixed values of a digest.
DIGEST_CHARS = 6_000
DIGEST_MARK = "\n[... trace truncated]"
LINE_CHARS = 160
OVERLAP = 0.5
HEAD_WORDS = 1 << 17
CHUNKS = 16  # chunks of all sets, of LEAST_CHUNK to MOST_CHUNK sets: two of them are in a task
LEAST_CHUNK = 4_096
MOST_CHUNK = 32_768
MATCHES = 1 << 20  # matches of a set that are held at once, and BATCH sets beside it
BATCH = 1 << 12


def final_attempt(events: DataFrame, predictions: DataFrame, key: str, seq: str) -> DataFrame:
    """Events of each item's last prediction only, by trace id."""
    winners = last_line_wins(predictions, [key], seq).select("trace_id")
    return events.join(winners, "trace_id", "left_semi")


def tool_usage(calls: DataFrame, tool: str, item: str, is_error: Column) -> DataFrame:
    """(tool, calls, errors, items): collapsed per (tool, item) first, so the distinct count is a count."""
    per = calls.groupBy(tool, item).agg(F.count(F.lit(1)).alias("_c"), F.count_if(is_error).alias("_e"))
    return per.groupBy(tool).agg(F.sum("_c").alias("calls"), F.sum("_e").alias("errors"), F.count(F.lit(1)).alias("items"))


def run_behaviour(steps: DataFrame, run: str, trace: str) -> DataFrame:
    """Per run: step and tool-call distribution, skill loading, forced ends, tokens.

    steps: one row per trace event with is_tool, is_skill, is_invalid, forced, tokens.
    """
    per = steps.groupBy(run, trace).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if("is_tool").alias("tools"), F.bool_or("is_skill").alias("skill"),
        F.bool_or("is_invalid").alias("invalid"), F.max("forced").alias("forced"), F.sum("tokens").alias("tokens"))
    return per.groupBy(run).agg(
        F.count(F.lit(1)).alias("items"), F.avg("steps").alias("steps_mean"),
        percentile_linear(F.col("steps").cast("double"), 95).alias("steps_p95"), F.avg("tools").alias("tools_mean"),
        F.max("tools").alias("tools_max"), F.avg(F.col("skill").cast("double")).alias("skill_load_rate"),
        F.count_if("invalid").alias("with_validation_errors"), F.count("forced").alias("forced"),
        F.avg("tokens").alias("tokens_mean"))


def stop_reasons(predictions: DataFrame, run: str) -> DataFrame:
    reason = F.coalesce("stop_reason", "error", F.lit("?"))
    return predictions.groupBy(run, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def repeat_calls(calls: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Calls that repeat an earlier one exactly: all but the first of each (item, tool, arguments).

    First calls come from an aggregate, and the rest from a join AQE can split, so a call made by
    a third of all rows is not one window.
    """
    first = calls.groupBy(*keys).agg(F.min(seq).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return calls.join(first.drop("_n"), keys).filter(F.col(seq) > F.col("_first")).drop("_first")


def frequent_codes(rows: DataFrame, words: str) -> tuple[int, np.ndarray]:
    """(seed, codes of the HEAD_WORDS most frequent words, rarest first). A word's code are 62 bits of its hash with the seed, and the seed is
    one with which no two words of the table have the same code. Words of one count are head or not together.
    """
    counts = materialise(rows.select(F.explode(words).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_df")), "word-counts")
    seed = 0
    while True:
        found = counts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(word_code(F.col("_w"), seed)).alias("codes")).first()
        if found["n"] == found["codes"]:
            break
        seed += 1
    taken, least = 0, None
    for row in counts.filter("_df > 1").groupBy("_df").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_df")).limit(HEAD_WORDS).collect():
        taken += row["_n"]
        if taken > HEAD_WORDS:
            break
        least = row["_df"]
    head = [] if least is None else counts.filter(F.col("_df") >= least).select("_df", word_code(F.col("_w"), seed).alias("c")).collect()
    return seed, np.array([c for _, c in sorted((r["_df"], r["c"]) for r in head)], np.int64)


def word_code(word: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), word), 2)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A row's share of `values`, as bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _encoded(head):
    """Lists of codes as `_rare`, codes outside the head, and `_head`, numbers of the others by falling rarity as steps from one to the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = head.value
        by_code = np.argsort(codes)
        ordered = codes[by_code]
        for batch in batches:
            lists = batch.column("_codes")
            sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(ordered, flat), max(len(ordered) - 1, 0))
            known = ordered[at] == flat if len(ordered) else np.zeros(len(flat), bool)
            rare, of = flat[~known], owner[~known]
            rare = rare[np.lexsort((rare, of))]
            ranks, whose = by_code[at[known]] if len(ordered) else at[known], owner[known]
            ranks = ranks[np.lexsort((ranks, whose))]
            first = np.concatenate([[True], np.diff(whose) != 0]) if len(whose) else np.zeros(0, bool)
            steps = np.where(first, ranks, np.diff(ranks, prepend=0)).astype(np.int32)
            n = [np.bincount(x, minlength=len(sizes)) for x in (of, whose)]
            rest = [batch.column(c) for c in batch.schema.names if c != "_codes"]
            names = [c for c in batch.schema.names if c != "_codes"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(sizes.astype(np.int32)), _binary(rare, n[0]), _binary(steps, n[1])], [*names, "_size", "_rare", "_head"])

    return run


class _Sets:
    """Word sets by size, and the postings of the words by which a larger set finds them, by word and set."""

    def __init__(self, rows: pa.Table, first: np.ndarray, order: np.ndarray, rare: np.ndarray, head_words: int, overlap: float):
        self.first, self.order, self.id = first, order, rows["_id"].to_numpy()
        self.size = rows["_size"].to_numpy().astype(np.int64)
        flat = lambda c, t: np.frombuffer(b"".join(rows[c].to_pylist()), t)
        n_rare, n_head = (pc.binary_length(rows[c]).to_numpy().astype(np.int64) // w for c, w in (("_rare", 8), ("_head", 4)))
        total = np.concatenate([[0], np.cumsum(flat("_head", np.int32), dtype=np.int64)])
        before = total[np.cumsum(n_head) - n_head]
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.words = np.empty(int(self.size.sum()), np.int32)
        self.words[ranges_of(self.start, n_rare)] = head_words + np.searchsorted(rare, flat("_rare", np.int64))
        self.words[ranges_of(self.start + n_rare, n_head)] = total[1:] - np.repeat(before, n_head)
        self.order_of_words(overlap)

    def order_of_words(self, overlap: float) -> None:
        # Two sets that overlap enough share so many words that one is among the first `kept` of the smaller.
        kept = self.size - np.ceil(2 * self.size * overlap / (1 + overlap) - 1e-9).astype(np.int64) + 1
        where = ranges_of(self.start, kept)
        owner = np.repeat(np.arange(len(self.size)), kept)
        key = self.words[where].astype(np.int64) * len(self.size) + owner
        order = np.argsort(key)
        self.key, self.set = key[order], owner[order].astype(np.int32)
        self.place = (where - np.repeat(self.start, kept) + 1)[order].astype(np.int32)


def _meet(asked: _Sets, held: _Sets, words: int, overlap: float, asked_near: np.ndarray, held_near: np.ndarray) -> None:
    """Each set of `asked` against those of `held` that come before it by size; of two that overlap enough the later one is marked."""
    n, mark = len(held.size), np.zeros(words, np.int8)
    share = overlap / (1 + overlap)
    for q in range(len(asked.size)):
        mine, size, first = asked.words[asked.start[q] : asked.end[q]], asked.size[q], asked.first[q]
        smaller = np.searchsorted(held.order, asked.order[q])
        least = np.searchsorted(held.size, np.ceil(size * overlap - 1e-9))
        if least >= smaller:
            continue
        at = np.arange(1, size - int(np.ceil(size * overlap - 1e-9)) + 2)
        # A set whose first shared word has place `at` shares at most it and what follows it: larger sets would need more.
        ends = np.minimum(np.searchsorted(held.size, (size - at + 1) / share - size + 1e-6, side="right"), smaller)
        word = mine[: len(at)].astype(np.int64) * n
        low, high = np.searchsorted(held.key, word + least), np.searchsorted(held.key, word + np.maximum(ends, least))
        some = np.flatnonzero(low < high)
        at, low, high = at[some], low[some], high[some]
        mark[mine] = 1
        for a, b in _portions(high - low):
            begin, until = (low, high) if a is None else (low[a:b], high[a:b])
            places = at if a is None else at[a:b]
            for step in range(0, int((until - begin).max(initial=0)), MATCHES):  # one word's sets alone may be more
                count = np.clip(until - begin - step, 0, MATCHES)
                where = ranges_of(begin + step, count)
                sets = held.set[where]
                other = held.size[sets]
                needed = np.ceil((size + other) * share - 1e-9)
                fit = 1 + np.minimum(size - np.repeat(places, count), other - held.place[where]) >= needed
                sets = np.unique(sets[fit])
                earlier = held.first[sets] < first
                later = sets[(held.first[sets] > first) & ~held_near[sets]]
                for batch in _batches(later, BATCH):
                    held_near[batch[_alike(held, batch, mark, size, overlap)]] = True
                if not asked_near[q]:
                    for batch in _batches(sets[earlier], 16):
                        if _alike(held, batch, mark, size, overlap).any():
                            asked_near[q] = True
                            break
        mark[mine] = 0


def _portions(sizes: np.ndarray) -> list[tuple]:
    """(from, to) of consecutive sizes, MATCHES or one size at a time; (None, None): all at once."""
    ends = np.cumsum(sizes)
    if not len(ends) or ends[-1] <= MATCHES:
        return [(None, None)] if len(ends) else []
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(MATCHES, ends[-1], MATCHES)), len(ends)])
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _batches(sets: np.ndarray, first: int) -> Iterator[np.ndarray]:
    """From `first` sets at a time to BATCH."""
    at = 0
    while at < len(sets):
        yield sets[at : at + first]
        at, first = at + first, min(4 * first, BATCH)


def _alike(held: _Sets, sets: np.ndarray, mark: np.ndarray, size: int, overlap: float) -> np.ndarray:
    other = held.size[sets]
    hits = mark[held.words[ranges_of(held.start[sets], other)]]
    shared = np.add.reduceat(hits, np.cumsum(other) - other, dtype=np.int64)
    return shared / (size + other - shared) >= overlap


def _cell(head_words: int, overlap: float):
    """One cell: the sets of one chunk of a group, or of two, against each other."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_size", "ascending"), ("_id", "ascending")])
        first = pc.rank(rows["_first"], tiebreaker="min").to_numpy()
        rare = np.unique(np.frombuffer(b"".join(rows["_rare"].to_pylist()), np.int64))
        low, high, chunk = (rows[c].to_numpy() for c in ("_lo", "_hi", "_chunk"))
        parts = [chunk == low, chunk == high] if low[0] != high[0] else [chunk == low]
        sets = [_Sets(rows.filter(pa.array(p)), first[p], np.flatnonzero(p), rare, head_words, overlap) for p in parts if p.any()]
        near = [np.zeros(len(s.size), bool) for s in sets]
        if len(sets) == len(parts):
            for k in range(len(sets)):
                other = len(sets) - 1 - k
                _meet(sets[k], sets[other], head_words + len(rare), overlap, near[k], near[other])
        return pa.table({"_id": pa.array(np.concatenate([s.id[k] for s, k in zip(sets, near, strict=True)]), pa.int64())})

    return run


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`materialise`, with the folder: for tables that go before the job ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def near_repeats(rows: DataFrame, group: str, seq: str, words: str, overlap: float = OVERLAP) -> DataFrame:
    """(group, seq): rows whose word set overlaps some earlier row's of the group by >= `overlap`.

    Equal sets first become one row (its first occurrence): their copies are near repeats as they
    are. Distinct sets that overlap enough must share one of their rarest words (the prefix rule
    of set-similarity joins). The sets of a group are dealt to chunks, and two chunks meet in a cell, where candidates are found by
    the postings of the prefixes, and where the shared word stands in both orders bounds what can still be shared. Words are numbers there,
    and neither pairs nor sets beside pairs are written or sent: a set is sent as often as its group has chunks. No row is dropped unproven.
    """
    spark = rows.sparkSession
    listed, path = _written(rows.select(group, seq, F.col(words).alias("_words")), "word-sets")
    listed = listed.filter(F.size("_words") > 0)  # not before: the filter would split every text once more
    seed, codes = frequent_codes(listed, "_words")
    head = spark.sparkContext.broadcast(codes)
    coded = listed.select(group, seq, F.transform("_words", lambda w: word_code(w, seed)).alias("_codes"))
    schema = T.StructType([*listed.select(group, seq).schema.fields, T.StructField("_size", T.IntegerType()),
                           T.StructField("_rare", T.BinaryType()), T.StructField("_head", T.BinaryType())])
    text = F.concat(F.col("_rare"), F.encode(F.col("_size").cast("string"), "utf-8"), F.col("_head"))
    base, coded_path = _written(coded.mapInArrow(_encoded(head), schema).withColumn("_h", F.unhex(F.md5(text))), "coded-sets")
    remove(spark, path)
    distinct, distinct_path = _written(
        base.groupBy(group, "_h").agg(F.min(seq).alias("_first"), *[F.first(c).alias(c) for c in ("_size", "_rare", "_head")]).withColumn(
            "_id", F.monotonically_increasing_id()),
        "distinct-sets")
    # What is left of each table once the sets stand in their prefix order under a number: keys only.
    base = materialise(base.select(group, seq, "_h"), "set-keys")
    remove(spark, coded_path)
    sets = materialise(distinct.select(group, "_id", "_first", "_size", "_rare", "_head"), "prefixes")
    named = materialise(distinct.select(group, "_h", "_first", "_id"), "set-names")
    remove(spark, distinct_path)
    most = max(LEAST_CHUNK, min(MOST_CHUNK, sets.count() // CHUNKS))
    large = sets.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).filter("_parts > 1")  # few, whatever the groups
    parts = F.coalesce("_parts", F.lit(1))
    dealt = sets.filter(F.col("_first").isNotNull() & F.col(group).isNotNull()).join(F.broadcast(large), group, "left").withColumn(
        "_chunk", F.pmod(F.xxhash64("_id"), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    cells = dealt.withColumn("_other", other).select(
        group, F.least("_chunk", "_other").alias("_lo"), F.greatest("_chunk", "_other").alias("_hi"), "_chunk", "_id", "_first", "_size", "_rare", "_head")
    near = cells.groupBy(group, "_lo", "_hi").applyInArrow(_cell(len(codes), overlap), "_id long").distinct().withColumn("_near", F.lit(True))
    known = named.join(near, "_id", "left")
    marked = base.join(known, [group, "_h"])
    return marked.filter((F.col(seq) > F.col("_first")) | F.col("_near")).select(group, seq)


def trace_digest(events: DataFrame, trace: str, step: str, line: Column, limit: int = DIGEST_CHARS) -> DataFrame:
    """(trace, events, digest): an ordered short rendering of each trace, cut at `limit` characters.

    Only as many leading events as could fit are gathered, ranked in a window Spark prunes
    before the shuffle, so a huge trace gathers a bounded list. The true length decides the truncation mark.
    """
    rendered = events.select(trace, step, line.alias("_l"))
    totals = rendered.groupBy(trace).agg(
        F.count(F.lit(1)).alias("events"), (F.sum(F.length("_l")) + F.count(F.lit(1)) - 1).alias("_chars"))
    most = limit + 1  # every line takes at least its newline
    ranked = Window.partitionBy(trace).orderBy(step)
    head = rendered.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= most)
    text = head.groupBy(trace).agg(F.array_sort(F.collect_list(F.struct("_r", "_l"))).alias("_e")).select(
        trace, F.array_join(F.transform("_e", lambda e: e["_l"]), "\n").alias("_t"))
    joined = totals.join(text, trace)
    cut = F.when(F.col("_chars") > limit, F.concat(F.left("_t", F.lit(limit)), F.lit(DIGEST_MARK))).otherwise(F.col("_t"))
    return joined.select(trace, "events", cut.alias("digest"))


def output_limit_rate(calls: DataFrame, run: str, tokens_out: Column, limit: int) -> DataFrame:
    hit = tokens_out >= limit
    return calls.groupBy(run).agg(F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("rate"))

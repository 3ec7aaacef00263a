"""Prefix trie of conversations by ROLLUP over positional turn columns.

A turn becomes an id (128 bits of SHA-256 of its role and text) and its number of words. A conversation becomes rows of WIDTH turn
columns: turns 1..8, 9..16 and so on. Each row carries the key of the node in which its block starts: a sum over the turns
before of 104 hash bits of (position, turn id), which names a prefix and can be summed in any order. One

    GROUP BY block, key, ROLLUP(t1, ..., t8)

then aggregates all prefixes of all blocks together; grouping_id() tells the depth. Blocks do not wait for each other, so a long
conversation costs rows, not rounds.

Sums over subtrees need every node once. A node is owned by its smallest member, and whoever owns a node owns all its deeper nodes,
so a conversation owns a tail of its own path. What a subtree holds is the owner's tail from the node on, plus the whole tails of
the other members: a running sum over each conversation's nodes, and a second ROLLUP over the conversations that own
any, with their columns cut where their own nodes begin. Copies own nothing and take no part in it.

Conversations are dealt by their base, so ordering, rebuilding and cutting into blocks take one shuffle. Lists of members that end in a
node are made in ranges of ids; where a node has several ranges, their pieces are hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.columns import field
from hindcast.llm.mixing import word_count
from hindcast.operators.ordering import bucket_count, with_buckets
from hindcast.sources.scratch import materialise

WIDTH = 8
HEADS = 3  # h is below 4
PIECE = 512  # ids of a piece of a long list
BIG = "decimal(38,0)"
NOBODY = hashlib.sha256(b"").hexdigest()
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that name (role, text)."""
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(named, 256), 1, 32))


def mark(position: Column, turn: Column) -> Column:
    """104 bits of a turn at its position; null for no turn. Their sum over a prefix names the prefix."""
    digest = F.sha2(F.concat(position.cast("string"), F.lit(":"), F.hex(turn)), 256)
    high, low = (F.conv(F.substring(digest, at, 13), 16, 10).cast("decimal(16,0)") for at in (1, 14))
    return (high.cast("decimal(20,0)") * F.lit(1 << 52).cast("decimal(17,0)") + low).cast(BIG)


def rebuilt(conversations: DataFrame, *, conv: str, turn: str, role: str, text: str, every: int, heads: int) -> DataFrame:
    """(base, conv_id, length, j, id, words): rebuilt turns at j = 1..length, and one row at j = 0 for each conversation."""
    who, what = (F.coalesce(field(c), F.lit("")) for c in (role, text))
    rows = conversations.filter(field(conv).isNotNull()).select(
        field(conv).cast("long").alias("conv_id"), field(turn).alias("_turn"), turn_id(who, what).alias("id"), word_count(what).alias("words"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).repartition("base")
    own = Window.partitionBy("base", "conv_id")
    rows = rows.withColumn("_pos", F.row_number().over(own.orderBy(F.col("_turn").asc_nulls_first(), "id"))).withColumn("_n", F.count(F.lit(1)).over(own))
    opening = [
        F.max(F.when((F.col("conv_id") == F.col("base")) & (F.col("_pos") == i), F.struct("id", "words"))).over(Window.partitionBy("base")).alias(f"_h{i}")
        for i in range(1, heads)]
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    rows = rows.select("*", *opening).withColumn("_h", h)
    kept = F.slice(F.array_compact(F.array(*[F.col(f"_h{i}") for i in range(1, heads)])), F.lit(1), F.col("_h"))
    rows = rows.withColumn("_head", kept)
    size = F.size("_head")

    def element(j: Column, turn_: Column, words: Column) -> Column:
        return F.struct(j.cast("int").alias("j"), turn_.alias("id"), words.alias("words"))

    taken = F.transform("_head", lambda x, i: element(i + 1, x["id"], x["words"]))
    first = F.concat(F.array(element(F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("long"))), taken)
    itself = F.when(F.col("_pos") > F.col("_h"), F.array(element(size + F.col("_pos") - F.col("_h"), F.col("id"), F.col("words")))).otherwise(F.array())
    turns = F.when(F.col("_pos") == 1, F.concat(first, itself)).otherwise(itself)
    return rows.select(
        "base", "conv_id", (size + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).cast("int").alias("length"), F.explode(turns).alias("_x"),
    ).select("base", "conv_id", "length", "_x.*")


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv_id, length, block, key, marks, t1..t8): turns side by side; `key` names all turns before the block, `marks` adds the block's."""
    block = F.floor(F.greatest(F.col("j") - 1, F.lit(0)) / WIDTH).cast("int")
    placed = turns.withColumn("block", block).withColumn("_at", F.col("j") - F.col("block") * WIDTH)
    wide = placed.groupBy("base", "conv_id", "length", "block").agg(
        *[F.max(F.when(F.col("_at") == i + 1, F.struct("id", "words"))).alias(t) for i, t in enumerate(TURNS)],
        F.coalesce(F.sum(mark(F.col("j"), F.col("id"))), F.lit(0)).cast(BIG).alias("marks"))
    before = Window.partitionBy("base", "conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return wide.select(
        "conv_id", "length", "block", F.coalesce(F.sum("marks").over(before), F.lit(0)).cast(BIG).alias("key"), "marks", *TURNS)


def rollup(blocks: DataFrame, aggregates: str) -> DataFrame:
    """One row per node: depth, prefix (names the node with its depth), parent (the parent's prefix), words of its last turn, aggregates."""
    columns = ", ".join(TURNS)
    found = blocks.sparkSession.sql(
        f"SELECT block, key, {columns}, grouping_id() AS _g, {aggregates} FROM {{blocks}} GROUP BY block, key, ROLLUP({columns})", blocks=blocks)
    # The last `WIDTH - level` columns are rolled up: as many bits of the id are set.
    level = F.lit(WIDTH) - F.bit_count("_g")
    last = F.get(F.array(*[F.col(t) for t in TURNS]), F.col("_level") - 1)
    found = found.withColumn("_level", level.cast("int")).withColumn("_last", F.when(F.col("_level") > 0, last)).filter(
        "_last is not null or (_level = 0 and block = 0)")
    marks = [
        F.when(F.col("_level") >= i + 1, mark(F.col("block") * WIDTH + i + 1, F.col(t)["id"])).otherwise(F.lit(0).cast(BIG))
        for i, t in enumerate(TURNS)]
    prefix = F.col("key")
    for m in marks:
        prefix = (prefix + m).cast(BIG)
    found = found.withColumn("depth", F.col("block") * WIDTH + F.col("_level")).withColumn("prefix", prefix)
    parent = F.when(F.col("depth") > 0, (F.col("prefix") - mark(F.col("depth"), F.col("_last.id"))).cast(BIG))
    return found.withColumn("parent", parent).withColumn("words", F.coalesce("_last.words", F.lit(0))).drop(
        "block", "key", "_g", "_level", "_last", *TURNS)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come in order."""
    node = digest = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.decimal128(38, 0)), pa.array([digest.hexdigest()])], ["depth", "prefix", "ends_sha256"])

    for batch in batches:
        for depth, prefix, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "prefix", "ids")), strict=True):
            if (depth, prefix) != node:
                if node is not None:
                    yield done()
                node, digest = (depth, prefix), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if node is not None:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, prefix, ends_sha256): SHA-256 of the ascending, comma-joined ids of `ends` (depth, prefix, conv_id) in each node."""
    ends = materialise(ends, "trie-ends")
    ranges = with_buckets(ends, "conv_id", buckets=bucket_count(ends)).groupBy("depth", "prefix", "_bucket").agg(
        F.sort_array(F.collect_list("conv_id")).alias("_ids"))  # ids are distinct: a range holds about ordering.ROWS_PER_BUCKET of them
    ranges = materialise(ranges.withColumn("_ranges", F.count(F.lit(1)).over(Window.partitionBy("depth", "prefix"))), "trie-ranges")

    def joined(ids: Column) -> Column:
        return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")

    short = ranges.filter("_ranges = 1").select("depth", "prefix", F.sha2(joined(F.col("_ids")), 256).alias("ends_sha256"))
    starts = F.sequence(F.lit(1), F.size("_ids"), F.lit(PIECE))
    pieces = ranges.filter("_ranges > 1").select("depth", "prefix", "_bucket", "_ids", F.explode(starts).alias("_from")).select(
        "depth", "prefix", "_bucket", "_from", joined(F.slice("_ids", F.col("_from"), F.lit(PIECE))).alias("ids"))
    ordered = pieces.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "_bucket", "_from").select("depth", "prefix", "ids")
    return short.unionByName(ordered.mapInArrow(_streamed, f"depth int, prefix {BIG}, ends_sha256 string"))


def prefix_trie(
    conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 20,
    heads: int = HEADS + 1,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt from the first h turns of conversation c - c % every and its own turns after its first h, where
    h = crc32(decimal c) % heads. Turns go by `turn`, null first; equal turn numbers by turn id, so repeated rows are turns of their own. Null
    role or text: empty. Rows with a null conversation id belong to no conversation and take no part. Empty table: no rows, not
    even a root. Texts may have any length; only their digests are shuffled. Other columns play no part, whatever their names.
    A conversation is ordered in one task (by a sort that can spill).
    """
    turns = rebuilt(conversations, conv=conv, turn=turn, role=role, text=text, every=every, heads=heads)
    blocks = materialise(blocks_of(turns), "trie-blocks")
    nodes = rollup(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id, max(length) AS _longest")
    nodes = nodes.withColumn("_saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("_leaf", (F.col("_longest") == F.col("depth")).cast("long"))
    owner = Window.partitionBy("conv_id")
    tail = owner.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = materialise(nodes.select(
        "conv_id", "depth", "prefix", "parent", "n_convs",
        *[F.sum(c).over(tail).alias(f"{c}_tail") for c in ("_saved", "_leaf")],
        *[F.sum(c).over(owner).alias(f"{c}_all") for c in ("_saved", "_leaf")], F.min("depth").over(owner).alias("_first")), "trie-nodes")
    heads_ = nodes.filter("depth = _first and depth > 0")

    # Whole tails of members that own nodes further down, for the nodes above these.
    tails = heads_.filter("_saved_all > 0 or _leaf_all > 0").select(F.col("conv_id").alias("_c"), "_first", "_saved_all", "_leaf_all")
    above = blocks.join(tails, blocks["conv_id"] == tails["_c"]).filter(F.col("block") * WIDTH < F.col("_first"))
    cut = [F.when(F.col("block") * WIDTH + i + 1 < F.col("_first"), F.col(t)).alias(t) for i, t in enumerate(TURNS)]
    hung = rollup(above.select("block", "key", *cut, "_saved_all", "_leaf_all"), "sum(_saved_all) AS _saved_hung, sum(_leaf_all) AS _leaf_hung")

    zero = F.lit(0).cast("long")
    children = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("prefix"))
    added = children.select("depth", "prefix", F.lit(1).cast("long").alias("n_children"), zero.alias("_saved_hung"), zero.alias("_leaf_hung")).unionByName(
        hung.select("depth", "prefix", zero.alias("n_children"), "_saved_hung", "_leaf_hung"))
    added = added.groupBy("depth", "prefix").agg(*[F.sum(c).alias(c) for c in ("n_children", "_saved_hung", "_leaf_hung")])
    # A node's parent has the same owner, but for the first node that a conversation owns.
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("conv_id").alias("_above"))
    parents = heads_.select("depth", "prefix", "parent").join(over, ["depth", "parent"]).select("depth", "prefix", "_above")
    ends = blocks.filter(F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / WIDTH) == F.col("block")).select(
        F.col("length").alias("depth"), (F.col("key") + F.col("marks")).cast(BIG).alias("prefix"), "conv_id")
    full = nodes.join(added, ["depth", "prefix"], "left").join(parents, ["depth", "prefix"], "left").join(end_digests(ends), ["depth", "prefix"], "left")
    return full.select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == 0, F.lit(None)).otherwise(F.coalesce("_above", "conv_id")).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), (F.col("_leaf_tail") + F.coalesce("_leaf_hung", zero)).alias("n_leaves"),
        (F.col("_saved_tail") + F.coalesce("_saved_hung", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"))

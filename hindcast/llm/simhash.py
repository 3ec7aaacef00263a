"""SimHash fingerprints with built-in functions only, and the permuted block tables that find near ones.

Every word shingle of a text votes with the 64 bits of its XXH64 (seed 42): for a bit that is set, against it otherwise,
with the shingle's weight. The votes of bits k and k + 32 share one 64-bit sum, so a text needs 32 sums; they stay inside
one hash aggregate over the exploded shingle positions, and only one row per text is shuffled. A lane holds 2^31: more than
the weights of a text of the largest size a row can have.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
LANES = (1 << 32) | 1
BLOCKS = (11, 11, 11, 11, 10, 10)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The runs of characters other than space and \\x09-\\x0D; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def by_length(shingle: Column) -> Column:
    """Longer shingles say more: a quarter of the code points, 1 to 16."""
    return F.least(F.lit(16), F.greatest(F.lit(1), F.length(shingle) / 4)).cast("long")


def fingerprints(df: DataFrame, keys: list[str], text: str, *, shingle: int = 3, weight=None) -> DataFrame:
    """One row per value of `keys` (which must determine the text): keys, copies, terms, fingerprint (a 64-bit integer).

    A bit is 1 when over half of the weight votes for it. Fewer words than `shingle`: the whole sequence is the one shingle.
    No words (also null): terms 0, fingerprint 0. Rows with equal keys are counted in `copies`; their equal votes
    change nothing.
    """
    listed = df.select(*keys, words(F.col(text)).alias("_w"))
    last = F.greatest(F.size("_w") - shingle, F.lit(0))
    spread = listed.select(*keys, "_w", F.explode_outer(F.sequence(F.lit(0), last)).alias("_i"))
    term = F.concat_ws(" ", *[F.get(F.col("_w"), F.col("_i") + j) for j in range(shingle)])
    some = F.size("_w") > 0
    power = F.lit(1).cast("long") if weight is None else weight(term)
    voted = spread.select(
        *keys, F.xxhash64(term).alias("_h"), F.when(some, power).otherwise(F.lit(0)).cast("long").alias("_p"),
        (F.col("_i") == 0).cast("long").alias("_one"), some.cast("long").alias("_t"))
    sums = [
        F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(LANES)) * F.col("_p")).alias(f"_v{k}") for k in range(32)
    ]
    counted = voted.groupBy(*keys).agg(F.sum("_one").alias("copies"), F.sum("_t").alias("_terms"), F.sum("_p").alias("_all"), *sums)
    bits = F.lit(0).cast("long")
    for k in range(32):
        for lane in range(2):
            votes = F.shiftrightunsigned(f"_v{k}", 32) if lane else F.col(f"_v{k}").bitwiseAND(F.lit(0xFFFFFFFF))
            value = 1 << (k + 32 * lane)
            value -= (value >> 63) << 64
            bits = bits.bitwiseOR(F.when(votes * 2 > F.col("_all"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return counted.select(*keys, "copies", (F.col("_terms") / F.col("copies")).cast("long").alias("terms"), bits.alias("fingerprint"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def _table_masks(radius: int) -> list[int]:
    """The bits each table keeps in front: all choices of blocks that `radius` differing bits can leave untouched."""
    at, blocks = 0, []
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    masks = [sum(c) for c in combinations(blocks, len(BLOCKS) - radius)]
    return [m - ((m >> 63) << 64) for m in masks]


def near_counts(fingerprints: DataFrame, queries: DataFrame, *, radius: int = 3) -> DataFrame:
    """(fingerprint, near): for each distinct fingerprint, the sum of `weight` of the queries within `radius` bits.

    `queries`: (fingerprint, weight). Table t is the fingerprints permuted so that its chosen blocks stand in front; equal
    fronts meet, and a pair counts in the first table in which its fronts are equal. The queries of a front stay packed
    in one row, so no row per pair arises: output follows the fingerprints. Queries that share a front are distinct values
    near one another or chance meetings in 31 bits or more, which bounds the pack whatever the number of copies. A popular
    front on the other side is split by the adaptive skew join.
    """
    masks = _table_masks(radius)
    literal = F.array(*[F.lit(m) for m in masks])

    def tables(df: DataFrame, *more: str) -> DataFrame:
        return df.select("fingerprint", *more, F.posexplode(literal).alias("_table", "_mask")).select(
            "fingerprint", *more, "_table", F.col("fingerprint").bitwiseAND(F.col("_mask")).alias("_front"))

    asked = queries.groupBy("fingerprint").agg(F.sum("weight").alias("weight"))
    packs = tables(asked, "weight").groupBy("_table", "_front").agg(
        F.collect_list(F.struct(F.col("fingerprint").alias("q"), F.col("weight").alias("w"))).alias("_pack"))
    met = tables(fingerprints.select("fingerprint").distinct()).join(packs, ["_table", "_front"])

    def add(total: Column, query: Column) -> Column:
        differ = F.col("fingerprint").bitwiseXOR(query["q"])
        earlier = F.exists(F.slice(literal, F.lit(1), F.col("_table")), lambda m: differ.bitwiseAND(m) == 0)
        return total + F.when((F.bit_count(differ) <= radius) & ~earlier, query["w"]).otherwise(F.lit(0))

    return met.select("fingerprint", F.aggregate("_pack", F.lit(0).cast("long"), add).alias("_n")).groupBy("fingerprint").agg(
        F.sum("_n").alias("near"))

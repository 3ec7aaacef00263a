"""One registered query per operator, with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import decontaminate as leaks
from hindcast.llm import cover_tree, gray_index, huffman, lbl, mixing, pii, prefix_trie, simhash, substring, toxicity, viterbi, whitening
from hindcast.operators.ordering import running_totals
from hindcast.sources.scratch import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def register(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, source_size, [3.0, 1.0, 2.0][(i % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS lev
  FROM w WINDOW f AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(lim, weight * max(lev) OVER ()) AS target FROM l),
e AS (
  SELECT d.*, t.source_size, t.target,
    least(2.0::DOUBLE, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END) AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p FROM e),
r AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rnk,
    target - sum(whole * size) OVER (PARTITION BY source) AS missing FROM p),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk NULLS LAST, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS cum FROM r)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rnk IS NOT NULL AND cum <= missing THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


@register("op9_mix_sources", MIX_SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


LEAK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAK_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '{LEAK_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '{LEAK_WORD}') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM di),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
hw AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


@register("op10_decontaminate", LEAK_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = leaks.removed_words(F.col("leak.spans"))
    return found.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("leak.items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@register("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gray_index.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@register("op1_simhash_fingerprints")
def op1_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are one per distinct (doc_id, text), in order of doc_id (null smallest), then text hash; repeated rows give
    repeated result rows. `near_queries`: documents with an id divisible by 50 whose fingerprint lies within 3 bits."""
    # An id that may be null as two plain columns: every join and aggregate below then shares one partitioning.
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = materialise(
        docs.groupBy("id", "no_id", "h").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows")).select(
            "*", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.lit(1).alias("one")),
        "simhash-keys")
    total = keys.count()
    ranked = materialise(running_totals(keys, "doc_id", ["one"], tie="h").select("id", "no_id", "h", "n", "cum_one"), "simhash-ranks")
    after = F.when(F.col("cum_one") == 1, F.lit(total)).otherwise(F.col("cum_one") - 1)  # next in descending order
    needs = ranked.select(
        F.col("id").alias("p_id"), F.col("no_id").alias("p_no_id"), F.col("h").alias("p_h"),
        F.floor(F.col("n") / 2).cast("int").alias("need"), after.alias("at"))
    order = ranked.join(needs, ranked["cum_one"] == needs["at"]).drop("at", "cum_one")
    own = docs.join(order, ["id", "no_id", "h"])
    heads = own.groupBy(F.col("p_id").alias("id"), F.col("p_no_id").alias("no_id"), F.col("p_h").alias("h")).agg(
        F.first(F.left("text", F.col("need"))).alias("head"))
    half = (F.col("n") - F.floor(F.col("n") / 2)).cast("int")
    pairs = own.select("id", "no_id", "h", "n", "text").join(heads, ["id", "no_id", "h"]).select(
        "id", "no_id", "h", "n", "text", F.concat(F.left("text", half), F.col("head")).alias("edited"))
    both = pairs.select(
        "id", "no_id", "h", "n", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("text").alias("body")),
            F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("x")).select(
        "id", "no_id", "h", "n", "edited_sha256", "x.side", "x.body")
    prints = simhash.fingerprints(both, ["id", "no_id", "h", "n", "edited_sha256", "side"], "body", weight=simhash.by_length)
    wide = materialise(
        prints.groupBy("id", "no_id", "h", "n", "edited_sha256").agg(
            F.max("copies").alias("copies"), F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fp"),
            F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited_fp")),
        "simhash-prints")
    following = wide.select("id", "no_id", "h", F.col("fp").alias("next_fp")).join(
        order.select("id", "no_id", "h", "p_id", "p_no_id", "p_h"), ["id", "no_id", "h"]).select(
        F.col("p_id").alias("id"), F.col("p_no_id").alias("no_id"), F.col("p_h").alias("h"), "next_fp")
    near = simhash.near_counts(
        wide.select(F.col("fp").alias("fingerprint")),
        wide.filter("not no_id and id % 50 = 0").select(F.col("fp").alias("fingerprint"), F.col("copies").alias("weight")))
    full = wide.join(following, ["id", "no_id", "h"]).join(near, wide["fp"] == near["fingerprint"], "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return full.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", simhash.hexadecimal(F.col("fp")).alias("fingerprint"),
        simhash.hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.coalesce("near", F.lit(0)).alias("near_queries"))


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("s", toxicity.score(docs, F.col("text"), model))
    return scored.select("doc_id", "s.severity", "s.p_toxic", "s.grade", (F.col("s.p_toxic") >= toxicity.REJECT).alias("rejected"))


@register("op8_token_ids")
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return huffman.roundtrip(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


REPEAT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM i),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS x FROM r WHERE nth > 1),
a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS x FROM d),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY x) AS kept, count(*) AS n FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.x = g.x GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@register("op2_substring_dedup", REPEAT_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("repeat.n_words").alias("n_words"),
        F.aggregate("repeat.spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]).alias("n_removed"),
        F.sha2("repeat.kept", 256).alias("kept_sha256"))


@register("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", lbl.held_out(F.col("doc_id")).alias("held_out"))
    trained = lbl.train(docs.filter(~F.col("held_out")))
    return lbl.score(docs, trained).withColumn("train_tokens", F.lit(trained.vocabulary.total).cast("long"))


#: The pseudonym key is a parameter of the operator; a real run takes it from its own secret store.
PSEUDONYM_KEY = "test tables only"


@register("op3_pii_pseudonyms")
def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, key=PSEUDONYM_KEY)

    def count(kind: str):
        return F.size(F.filter("private.found", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", F.size("private.found").cast("long").alias("n_found"), *counts, F.col("private.text").alias("text"))


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = viterbi.sentencepiece_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    return docs.select("doc_id", viterbi.token_counts(docs, F.col("text"), pieces).alias("n_tokens"))


@register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    long = rows.select("vec_id", F.col("white.deviation").alias("deviation"), F.posexplode("white.whitened").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"))


CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""
TRIE_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM r GROUP BY conv_id),
h AS (SELECT *, (xor({CRC}, 4294967295::BIGINT) % 4)::INT AS h FROM l),
b AS (
  SELECT h.conv_id, list_concat(coalesce(base.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN l base ON base.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS length, d AS depth, turns[1:d] AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM b)),
n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^ 	-]+')) END AS saved
  FROM p GROUP BY depth, path),
c AS (SELECT a.depth, a.path, count(*) AS n FROM n a JOIN n b ON b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path GROUP BY a.depth, a.path),
m AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN c USING (depth, path)),
u AS (
  SELECT m.depth AS at, unnest(range(0, m.depth + 1)) AS depth, m.path AS whole, m.saved, (m.n_children = 0)::INT AS leaf FROM m),
s AS (SELECT depth, whole[1:depth] AS path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, path) LEFT JOIN m o ON m.depth > 0 AND o.depth = m.depth - 1 AND o.path = m.path[1:m.depth - 1]
"""


@register("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


NEAREST_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.x, d.x)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id OR q.x <> d.x WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op13_exact_top_k", NEAREST_SQL)
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cover_tree.top_k(vectors.filter("vec_id % 50 = 0"), vectors)

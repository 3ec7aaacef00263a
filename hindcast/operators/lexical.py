"""Time-aware lexical retrieval: postings, as-of statistics, BM25 and TF-IDF queries of the block-max index.

Collection statistics (N, average length, document frequency) are computed per query over
documents created strictly before it, so nothing later shapes a ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import blocks
from hindcast.operators.ordering import counts_before, running_totals
from hindcast.sources.scratch import materialise

# Fixed values of the scoring formula.
K1 = 1.2
B = 0.75
HOUR = 3_600_000_000
DOCS_PER_TASK = 512


def dealt(docs: DataFrame, key: str) -> DataFrame:
    """`docs` by key, about DOCS_PER_TASK to a partition: their `postings` are counted where they are, without a shuffle of terms."""
    return docs.repartition(docs.count() // DOCS_PER_TASK + 1, key)


def each_term(rows: DataFrame, columns: list, tokens: Column) -> DataFrame:
    """(columns, term): a row per token. An inner explode would have the engine make the tokens once more, in a filter on their number that it
    moves to the scan, below joins and shuffles.
    """
    return rows.select(*columns, F.posexplode_outer(tokens).alias("_at", "term")).filter("_at IS NOT NULL").drop("_at")


def postings(docs: DataFrame, key: str, created: str, tokens: Column) -> DataFrame:
    """(term, key, tf, doc_len, created): one row per document and distinct term.

    The length is its own column before the explode, so the token array is not copied into
    every exploded row; repeats are combined map-side (a document's tokens are in one task), and not sent anywhere if
    `docs` are dealt by `key`.
    """
    staged = docs.select(key, F.col(created).alias("created"), tokens.alias("_t"))
    rows = each_term(staged.withColumn("doc_len", F.size("_t").cast("long")), [key, "created", "doc_len"], F.col("_t"))
    return rows.groupBy("term", key, "doc_len", "created").agg(F.count(F.lit(1)).alias("tf")).select(
        "term", key, "tf", "doc_len", "created")


def document_lengths(docs: DataFrame, key: str, created: str, tokens: Column) -> DataFrame:
    return docs.select(key, F.col(created).alias("created"), F.size(tokens).cast("long").alias("doc_len"))


def query_terms(queries: DataFrame, q: str, as_of: str, tokens: Column) -> DataFrame:
    """(q, as_of, term): each query's distinct terms."""
    return each_term(queries, [q, F.col(as_of).alias("as_of")], F.array_distinct(tokens))


def asof_stats(terms: DataFrame, index: DataFrame, lengths: DataFrame) -> DataFrame:
    """(q, as_of, term, n_docs, avgdl, df) over documents strictly before each query.

    df counts are first summed per (term, hour), so what meets the queries is calendar-sized per
    term even when a term is in a third of all documents; only a query's own hour is looked at
    moment by moment.
    """
    collection = counts_before(
        terms, "as_of", lengths, "created", {"n_docs": F.count(F.lit(1)), "sum_len": F.sum("doc_len")})
    asked = terms.select("term", "as_of").distinct().withColumn("_h", F.floor(F.col("as_of") / HOUR))
    wanted = index.select("term", "created").join(terms.select("term").distinct(), "term", "left_semi")
    hourly = wanted.groupBy("term", F.floor(F.col("created") / HOUR).alias("_h")).agg(
        F.count(F.lit(1)).alias("_n"))
    # Requested hours ride in the same per-term timeline, once per (term, hour).
    hours = asked.select("term", "_h").distinct()
    marks = hourly.withColumn("_ask", F.lit(0)).unionByName(
        hours.select("term", "_h", F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_ask")))
    before = Window.partitionBy("term").orderBy("_h").rangeBetween(Window.unboundedPreceding, -1)
    earlier = marks.withColumn("_df", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_ask = 1")
    # Inside the hour requests ride in the timeline of moments, so nothing pairs them with postings.
    moments = wanted.groupBy("term", F.col("created").alias("_at")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_ask", F.lit(0))
    inside = moments.unionByName(
        asked.select("term", F.col("as_of").alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_ask")))
    strictly = Window.partitionBy("term", "_h").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    own_hour = inside.withColumn("_h", F.floor(F.col("_at") / HOUR)).withColumn(
        "_own", F.sum("_n").over(strictly)).filter("_ask = 1").select("term", F.col("_at").alias("as_of"), "_own")
    df = asked.join(earlier.select("term", "_h", "_df"), ["term", "_h"]).join(
        own_hour, ["term", "as_of"], "left").select(
        "term", "as_of", (F.col("_df") + F.coalesce("_own", F.lit(0))).alias("df"))
    return _with_collection(terms.join(df, ["term", "as_of"]), collection)


def _with_collection(terms: DataFrame, collection: DataFrame) -> DataFrame:
    avgdl = F.col("sum_len") / F.col("n_docs")
    return terms.join(collection, "as_of").filter("df > 0").withColumn(
        "avgdl", F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))).drop("sum_len")


def index_stats(terms: DataFrame, index: blocks.Index) -> DataFrame:
    """`asof_stats` from the blocks of an index."""
    collection = counts_before(
        terms, "as_of", index.lengths(), "created", {"n_docs": F.count(F.lit(1)), "sum_len": F.sum("doc_len")})
    return _with_collection(terms.join(index.document_frequency(terms), ["term", "as_of"]), collection)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_part(k1: float = K1, b: float = B) -> Column:
    """One term's contribution, over a row holding tf, doc_len, avgdl and idf."""
    norm = k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl"))
    return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)


def pair_scores(pairs: DataFrame, weighted: DataFrame, index: DataFrame, q: str, key: str, part: Column) -> DataFrame:
    """(q, key, score) of given (q, key) pairs; a pair sharing no term scores 0."""
    rows = pairs.select(q, key).join(weighted, q).join(index, ["term", key])
    scored = rows.filter("created < as_of").groupBy(q, key).agg(F.sum(part).alias("score"))
    return pairs.select(q, key).join(scored, [q, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def bm25_queries(stats: DataFrame) -> DataFrame:
    """(q, as_of, terms, weights, mean) for `blocks.search`: one row per query, from its as-of statistics."""
    rows = stats.select("q", "as_of", "avgdl", F.struct("term", idf(F.col("n_docs"), F.col("df")).alias("w")).alias("t"))
    return rows.groupBy("q", "as_of").agg(F.collect_list("t").alias("t"), F.first("avgdl").alias("mean")).select(
        "q", "as_of", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"), "mean")


def bm25_topk(
    queries: DataFrame, index: blocks.Index, key: str, k: int, tokens: Column, exclude: DataFrame | None = None
) -> DataFrame:
    """(q, key, score, rank): exact as-of BM25 top k of queries (q, as_of, ...), without the (q, key) pairs of `exclude`."""
    terms = materialise(query_terms(queries, "q", "as_of", tokens), "terms")
    stats = index_stats(terms, index)
    return blocks.search(index, bm25_queries(stats), key, k, blocks.Bm25(K1, B), exclude=exclude)


def fit_idf(term_rows: DataFrame, key: str, min_df: int = 2) -> DataFrame:
    """(term, df, n_fit, idf) over (key, term, ...) rows, one per document and distinct term."""
    n = term_rows.agg(F.count_distinct(key)).scalar()
    fitted = term_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df).withColumn("n_fit", n)
    return fitted.withColumn("idf", F.log((1 + F.col("n_fit")) / (1 + F.col("df"))) + 1)


def numbered(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((term, idf, _i), the written terms): terms numbered from 0, part by part, so no task sees the whole vocabulary."""
    part = F.pmod(F.xxhash64("term"), F.lit(256))
    fitted = materialise(
        terms.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("term")) - 1), "fit")
    sizes = fitted.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # 256 rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    place = fitted.join(F.broadcast(offsets), "_part").select("term", "idf", (F.col("_rank") + F.col("_offset")).cast("int").alias("_i"))
    return place, fitted


def tfidf_weights(index: DataFrame, key: str, fitted: DataFrame) -> DataFrame:
    """(term, key, created, w): L2-normalised sublinear TF-IDF of documents, idf from `fitted`; unseen terms drop out."""
    rows = index.join(fitted, "term").select("term", key, "created", ((1 + F.log("tf")) * F.col("idf")).alias("_w"))
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return rows.join(norms, key).select("term", key, "created", (F.col("_w") / F.col("_n")).alias("w"))


def tfidf_neighbours(docs: DataFrame, train: DataFrame, key: str, tokens: Column, k: int = 5, two_rounds: bool = True) -> DataFrame:
    """(q, key, score, rank): for each document of `train` (key) the nearest earlier documents by cosine, never itself, score > 0.

    L2-normalised sublinear TF-IDF; document frequencies are learnt on the training rows only, and terms they hold once drop out.
    """
    index = blocks.build_index(docs, key, "created", tokens)
    own = each_term(docs.join(train.select(key).distinct(), key, "left_semi"), [key, "created"], tokens)
    counted = materialise(own.groupBy(key, "created", "term").agg(F.count(F.lit(1)).alias("tf")), "tfidf-queries")
    fitted = materialise(numbered(fit_idf(counted, key))[0], "tfidf-idf")
    weighted = counted.join(fitted, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    lists = weighted.groupBy(key, "created").agg(
        F.sort_array(F.collect_list(F.struct("_i", "tf"))).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    queries = lists.select(
        F.col(key).alias("q"), F.col("created").alias("as_of"), F.col("t._i").alias("terms"), F.col("t.tf").alias("weights"), "norm",
        F.lit(1.0).alias("mean"))
    return blocks.search(index, queries, key, k, blocks.Cosine(), idf=fitted, two_rounds=two_rounds)


def tune_threshold(best: DataFrame) -> DataFrame:
    """One row (threshold, f1): the similarity cut that maximises link F1; 1.01 when none is better.

    best(gold, found, sim) has one row per training item. Swept over all distinct similarities with running totals, the
    highest wins ties.
    """
    right = F.coalesce(F.col("found") == F.col("gold"), F.lit(False))
    total = best.agg(F.count("gold")).scalar()
    per_sim = materialise(
        best.groupBy("sim").agg(F.count_if(right).alias("n_tp"), F.count_if(F.col("found").isNotNull() & ~right).alias("n_fp")), "sweep")
    swept = running_totals(per_sim, "sim", ["n_tp", "n_fp"], descending=True).select(
        "sim", F.col("cum_n_tp").alias("tp"), F.col("cum_n_fp").alias("fp"))
    denominator = F.col("tp") + F.col("fp") + total
    f1 = F.when(denominator > 0, 2.0 * F.col("tp") / denominator).otherwise(0.0)
    picked = swept.withColumn("f1", f1).agg(F.max_by(F.struct("sim", "f1"), F.struct("f1", "sim")).alias("p"))
    return picked.select(
        F.coalesce("p.sim", F.lit(1.01)).alias("threshold"), F.coalesce("p.f1", F.lit(0.0)).alias("f1"))

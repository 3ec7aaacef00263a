"""Section G: time-aware retrieval. The flagship is `recall_at_k`."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import text as tx
from hindcast.functions.numeric import micros, r6
from hindcast.operators import asof, blocks, dense, fusion, lexical, uncertainty
from hindcast.operators.sampling import time_window
from hindcast.plans import fixtures as fx
from hindcast.plans import history as hist
from hindcast.plans.oracle import poisson_one, tokens, u
from hindcast.plans.registry import query
from hindcast.plans.textual import SNIPPET_SQL
from hindcast.sources.scratch import materialise
from hindcast.sources.tables import read_table

KS = (1, 5, 10, 20)
TOP = 20
LATEST = 253_370_764_800_000_000  # 9999-01-01, later than every document


def corpus(spark, sf, by_number=False):
    d = fx.documents(spark, sf)
    if by_number:
        d = lexical.dealt(d, "number")
    return d.select(
        "number", micros(F.col("created_at")).alias("created"), "title", "body",
        tx.tokenize(tx.document_text(F.col("title"), F.col("body"))).alias("tokens"))


def index_tables(spark, sf):
    """(postings, lengths), written once: every step below scans them."""
    posts = materialise(lexical.postings(corpus(spark, sf, by_number=True), "number", "created", F.col("tokens")), "postings")
    counted = posts.groupBy("number").agg(F.first("doc_len").alias("doc_len"))
    # Documents without a single token still count as documents.
    every = fx.documents(spark, sf).select("number", micros(F.col("created_at")).alias("created"))
    lengths = every.join(counted, "number", "left").withColumn("doc_len", F.coalesce("doc_len", F.lit(0)))
    return posts, lengths


def duplicate_texts(spark, sf):
    """(q, as_of, text, original): documents with an earlier exact copy, asked as of their creation."""
    d = fx.documents(spark, sf).join(fx.duplicates(spark, sf), "number")
    return d.select(
        F.col("number").alias("q"), micros(F.col("created_at")).alias("as_of"),
        tx.issue_text(F.col("title"), F.col("body")).alias("text"), "original")


def benchmark_texts(spark, sf):
    """Benchmark passages as queries over the whole corpus; ids are negative."""
    b = read_table(spark, sf, "benchmark")
    return b.select(
        (-1 - F.col("item_id")).alias("q"), F.lit(LATEST).cast("long").alias("as_of"), "text",
        F.lit(None).cast("long").alias("original"))


def all_queries(spark, sf):
    return duplicate_texts(spark, sf).unionByName(benchmark_texts(spark, sf))


def weighted_terms(spark, sf, queries, posts, lengths):
    terms = lexical.query_terms(queries, "q", "as_of", tx.tokenize(F.col("text")))
    stats = lexical.asof_stats(materialise(terms, "terms"), posts, lengths)
    return materialise(stats.withColumn("idf", lexical.idf(F.col("n_docs"), F.col("df"))), "weights")


def bm25_ranking(spark, sf, queries, k, exclude=None):
    index = blocks.build_index(corpus(spark, sf), "number", "created", F.col("tokens"))
    return lexical.bm25_topk(queries, index, "number", k, tx.tokenize(F.col("text")), exclude)


DOCS_SQL = f"""docs AS (SELECT number, epoch_us(created_at) AS created,
  {tokens("title || chr(10) || title || chr(10) || body")} AS toks FROM issue),
post AS (SELECT term, number, count(*) AS tf, any_value(doc_len) AS doc_len, any_value(created) AS created
  FROM (SELECT number, created, len(toks) AS doc_len, unnest(toks) AS term FROM docs) GROUP BY term, number)"""
QUERY_SQL = f"""qs AS (SELECT i.number AS q, epoch_us(created_at) AS as_of, title || chr(10) || chr(10) || body AS text, original
  FROM issue i JOIN dup USING (number)
  UNION ALL SELECT -1 - item_id, {LATEST}, text, NULL FROM benchmark),
qt AS (SELECT q, as_of, unnest(list_distinct({tokens('text')})) AS term FROM qs),
coll AS (SELECT as_of, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM (SELECT DISTINCT as_of FROM qs) JOIN docs
  ON created < as_of GROUP BY as_of),
st AS (SELECT q, as_of, term, n_docs, avgdl, count(*) AS df FROM qt JOIN post USING (term) JOIN coll USING (as_of)
  WHERE created < as_of GROUP BY ALL),
sc AS (SELECT q, number, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))), 9) AS score
  FROM st JOIN post USING (term) WHERE created < as_of GROUP BY q, number),
top AS (SELECT * FROM (SELECT q, number, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, number) AS rank
  FROM sc) WHERE rank <= {TOP})"""
SQL = f"WITH {DOCS_SQL}, {QUERY_SQL} "


@query("postings", "issue", sql=f"""WITH {DOCS_SQL}
SELECT number, doc_len, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS top_tf, min(term) AS first_term
FROM post GROUP BY ALL""")
def postings(spark, sf):
    posts = lexical.postings(corpus(spark, sf, by_number=True), "number", "created", F.col("tokens"))
    return posts.groupBy("number", "doc_len").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("total"), F.max("tf").alias("top_tf"),
        F.min("term").alias("first_term"))


@query("asof_stats", "issue", "dup", sql=SQL + "SELECT q, term, n_docs, round(avgdl, 6) AS avgdl, df FROM st")
def asof_stats(spark, sf):
    posts, lengths = index_tables(spark, sf)
    terms = materialise(lexical.query_terms(all_queries(spark, sf), "q", "as_of", tx.tokenize(F.col("text"))), "terms")
    return lexical.asof_stats(terms, posts, lengths).select("q", "term", "n_docs", r6(F.col("avgdl")).alias("avgdl"), "df")


@query("bm25_asof", "issue", "dup", sql=SQL + """
SELECT qs.q, qs.original AS number, round(coalesce(score, 0), 6) AS score FROM qs
LEFT JOIN sc ON sc.q = qs.q AND sc.number = qs.original WHERE qs.original IS NOT NULL""")
def bm25_asof(spark, sf):
    """Exact as-of score of each query against its own original: only those pairs are scored."""
    queries = duplicate_texts(spark, sf)
    posts, lengths = index_tables(spark, sf)
    weighted = weighted_terms(spark, sf, queries, posts, lengths)
    pairs = queries.select("q", F.col("original").alias("number"))
    out = lexical.pair_scores(pairs, weighted, posts, "q", "number", lexical.bm25_part())
    return out.withColumn("score", r6(F.col("score")))


@query("bm25_topk", "issue", "dup", sql=SQL + "SELECT q, number, round(score, 6) AS score, rank FROM top")
def bm25_topk(spark, sf):
    top = bm25_ranking(spark, sf, all_queries(spark, sf), TOP)
    return top.select("q", "number", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


EXCLUDED_SQL = SQL.rstrip() + f""", ex AS (SELECT q, number, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, number) AS rank
  FROM sc JOIN qs USING (q) WHERE qs.q >= 0 AND number <> original)
SELECT * FROM ex WHERE rank <= {TOP}"""


@query("bm25_excluding", "issue", "dup", sql=EXCLUDED_SQL)
def bm25_excluding(spark, sf):
    """Hard negatives: what each duplicate finds when its known original must not be among the answers."""
    queries = duplicate_texts(spark, sf)
    known = queries.select("q", F.col("original").alias("number"))
    top = bm25_ranking(spark, sf, queries, TOP, exclude=known)
    return top.select("q", "number", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def vectors(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("number"), F.col("vec_id").alias("created"), "embedding")


@query("dense_topk", sql="""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS number, round(list_cosine_similarity(a.e, b.e), 9) AS score
  FROM v a JOIN v b ON b.vec_id < a.vec_id)
SELECT q, number, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, number) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(spark, sf):
    v = vectors(spark, sf)
    queries = v.select(F.col("number").alias("q"), F.col("created").alias("as_of"), "embedding")
    top = dense.dense_topk(queries, v, "number", 10)
    return top.select("q", "number", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("l2_normalise", sql="""
SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / n)), 6) AS total,
  round(embedding[1]::DOUBLE / n, 6) AS head FROM (
  SELECT *, greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 1e-12) AS n FROM embeddings)""")
def l2_normalise(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", dense.l2_normalise(F.col("embedding")).alias("v"))
    return e.select(
        "vec_id", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.get("v", F.lit(0))).alias("head"))


@query("rrf", sql="""
WITH r AS (SELECT l_orderkey AS q, l_linenumber::BIGINT AS number,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey, l_shipdate) AS a,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber, l_suppkey, l_shipdate) AS b FROM lineitem),
f AS (SELECT q, number, round(sum(x), 12) AS score FROM (
  SELECT q, number, 1.0::DOUBLE / (60 + a) AS x FROM r WHERE a <= 3 UNION ALL
  SELECT q, number, 0.5::DOUBLE / (60 + b) FROM r WHERE b <= 3) GROUP BY q, number)
SELECT q, number, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, number) AS rank FROM f""")
def rrf(spark, sf):
    line = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("q"), F.col("l_linenumber").cast("long").alias("number"), "l_extendedprice",
        "l_quantity", "l_partkey", "l_suppkey", "l_shipdate")

    def ranking(by):
        from pyspark.sql import Window

        w = Window.partitionBy("q").orderBy(F.desc(by), "l_partkey", "number", "l_suppkey", "l_shipdate")
        return line.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")

    out = fusion.rrf([ranking("l_extendedprice"), ranking("l_quantity")], "q", "number", [1.0, 0.5])
    return out.select("q", "number", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_ranking(spark, sf, queries, k):
    """Documents that have a stored vector, by cosine; a query without one finds nothing here."""
    stored = vectors(spark, sf).select("number", "embedding")
    created = fx.documents(spark, sf).select("number", micros(F.col("created_at")).alias("created"))
    docs = stored.join(created, "number")
    asked = queries.select("q", "as_of").join(stored.withColumnRenamed("number", "q"), "q")
    return dense.dense_topk(asked, docs, "number", k)


ARMS_SQL = SQL.rstrip() + f""",
lex AS (SELECT * FROM (SELECT q, number, row_number() OVER (PARTITION BY q ORDER BY score DESC, number) AS rank FROM sc WHERE q >= 0)
  WHERE rank <= {fusion.DEPTH}),
v AS (SELECT vec_id AS number, embedding::DOUBLE[] AS e FROM embeddings),
sem AS (SELECT * FROM (SELECT q, number, row_number() OVER (PARTITION BY q ORDER BY score DESC, number) AS rank FROM (
    SELECT qs.q, v.number, round(list_cosine_similarity(a.e, v.e), 9) AS score FROM qs JOIN v a ON a.number = qs.q JOIN v ON v.number < qs.q
    WHERE v.number IN (SELECT number FROM issue))) WHERE rank <= {fusion.DEPTH}),
hyb AS (SELECT q, number, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, number) AS rank FROM (
  SELECT q, number, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM sem) GROUP BY q, number))"""


@query("hybrid_search", "issue", "dup", sql=ARMS_SQL + f"""
SELECT hyb.q, hyb.number, round(hyb.score, 9) AS score, hyb.rank, lex.rank AS bm25_rank, sem.rank AS dense_rank FROM hyb
LEFT JOIN lex USING (q, number) LEFT JOIN sem USING (q, number) WHERE hyb.rank <= {TOP}""")
def hybrid_search(spark, sf):
    queries = duplicate_texts(spark, sf)
    lex = materialise(bm25_ranking(spark, sf, queries, fusion.DEPTH), "lexical")
    sem = materialise(dense_ranking(spark, sf, queries, fusion.DEPTH), "semantic")
    out = fusion.hybrid(lex, sem, "q", "number", TOP)
    return out.select("q", "number", F.round("score", 9).alias("score"), *[F.col(c).cast("long").alias(c) for c in ("rank", "bm25_rank", "dense_rank")])


@query("embed_backfill", sql=f"""
SELECT doc_id AS number, 256 AS dims, len({tokens('text')}) > 0 AS encoded FROM documents
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def embed_backfill(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("number"), "text")
    stored = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("number"))
    out = dense.embed_backfill(d, stored, "number", dense.hashed_encoder())
    unit = F.abs(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x) - 1) < 1e-9
    return out.select("number", F.size("embedding").alias("dims"), unit.alias("encoded"))


@query("embedding_coverage", sql="""
SELECT count(*) AS missing, min(doc_id) AS first_missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def embedding_coverage(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("number"))
    stored = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("number"))
    return dense.missing_vectors(d, stored, "number").agg(
        F.count(F.lit(1)).alias("missing"), F.min("number").alias("first_missing"))


def doc_split():
    return time_window(F.col("created_at"), "2024-01-01", "2024-01-25", "2024-02-05", "2124-12-31")


SPLIT_SQL = """CASE WHEN created_at < TIMESTAMP '2024-01-25' THEN 'train' WHEN created_at < TIMESTAMP '2024-02-05' THEN 'dev'
  ELSE 'test' END"""


def allowed_queries(spark, sf):
    """Known duplicates from the train and dev windows; the test window is never asked."""
    d = fx.documents(spark, sf).withColumn("split", doc_split()).filter(F.col("split").isin("train", "dev"))
    return d.join(fx.duplicates(spark, sf), "number")


@query("duplicate_queries", "issue", "dup", sql=f"""
SELECT number, {SPLIT_SQL} AS split, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, original,
  md5(title || chr(10) || chr(10) || body) AS text_hash FROM issue JOIN dup USING (number) WHERE {SPLIT_SQL} <> 'test'""")
def duplicate_queries(spark, sf):
    return allowed_queries(spark, sf).select(
        "number", "split", F.date_format("created_at", hist.STAMP).alias("created_at"), "original",
        F.md5(tx.issue_text(F.col("title"), F.col("body"))).alias("text_hash"))


def provable_corpus(spark, sf):
    return asof.build_corpus(hist.document_issues(spark, sf)).select("number", micros(F.col("created_at")).alias("created"))


@query("reachable", "dup", sql="SELECT number AS q, original, original % 9 <> 0 AS reachable FROM dup")
def reachable(spark, sf):
    queries = duplicate_texts(spark, sf).drop("text")
    return fusion.reachable(queries, provable_corpus(spark, sf), "q", "number").select("q", "original", "reachable")


def query_ranks(spark, sf, ranked=None):
    """(q, original, reachable, rank) of every duplicate query."""
    queries = duplicate_texts(spark, sf)
    ranked = bm25_ranking(spark, sf, queries, TOP) if ranked is None else ranked
    asked = fusion.reachable(queries.drop("text"), provable_corpus(spark, sf), "q", "number")
    return fusion.first_rank(asked, ranked, "q", "number")


RANKS_SQL = SQL.rstrip() + """, ranks AS (SELECT qs.q, qs.original, original % 9 <> 0 AS reachable, rank
  FROM qs LEFT JOIN top ON top.q = qs.q AND top.number = qs.original WHERE qs.q >= 0) """


@query("recall_at_k", "issue", "dup", sql=RANKS_SQL + "SELECT scope, queries, recall_1, recall_5, recall_10, recall_20 FROM ("
       + " UNION ALL ".join(f"""SELECT '{s}' AS scope, count(*) AS queries,
  {', '.join(f"round(avg((coalesce(rank, 99) <= {k})::INT), 6) AS recall_{k}" for k in KS)} FROM ranks WHERE {c}"""
                            for s, c in (("all", "true"), ("reachable", "reachable"))) + ")")
def recall_at_k(spark, sf):
    return scoped(query_ranks(spark, sf)).groupBy("scope").agg(
        F.count(F.lit(1)).alias("queries"), *[r6(fusion.recall("rank", k)).alias(f"recall_{k}") for k in KS])


def scoped(ranks):
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("reachable"), "reachable")))
    return ranks.withColumn("scope", F.explode(scopes))


@query("mrr", "issue", "dup", sql=RANKS_SQL + " UNION ALL ".join(
    f"SELECT '{s}' AS scope, count(*) AS queries, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM ranks WHERE {c}"
    for s, c in (("all", "true"), ("reachable", "reachable"))))
def mrr(spark, sf):
    return scoped(query_ranks(spark, sf)).groupBy("scope").agg(
        F.count(F.lit(1)).alias("queries"), r6(fusion.mean_reciprocal_rank("rank")).alias("mrr"))


def rank_stats(rank="rank", prefix=""):
    hits = {f"{prefix}hit_{k}": F.coalesce(F.col(rank) <= k, F.lit(False)) for k in KS}
    return {**hits, f"{prefix}rr": F.coalesce(1.0 / F.col(rank), F.lit(0.0))}


def rank_metrics(prefix=""):
    names = [f"hit_{k}" for k in KS] + ["rr"]
    return {n: F.when(F.col("n") > 0, F.col(f"{prefix}{n}") / F.col("n")) for n in names}


def three_rankings(spark, sf):
    queries = duplicate_texts(spark, sf)
    lex = materialise(bm25_ranking(spark, sf, queries, fusion.DEPTH), "lexical")
    sem = materialise(dense_ranking(spark, sf, queries, fusion.DEPTH), "semantic")
    return {"bm25": lex, "dense": sem, "hybrid": fusion.rrf([lex, sem], "q", "number")}


SYSTEMS = (("bm25", "lex"), ("dense", "sem"), ("hybrid", "hyb"))
RANKED_SQL = ARMS_SQL + ", rk AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS mode, qs.q, qs.original % 9 <> 0 AS reachable, t.rank FROM qs LEFT JOIN {table} t ON t.q = qs.q AND t.number = qs.original WHERE qs.q >= 0"
    for name, table in SYSTEMS) + "), dr AS (SELECT r, q, CASE WHEN r = 0 THEN 1 ELSE " + poisson_one(u("'0'", "r", "q")) + """ END::DOUBLE AS w
  FROM (SELECT DISTINCT q FROM rk), range(0, 1001) t(r))"""
RANK_STATS_SQL = ", ".join(
    [f"{{'metric': 'hit_{k}', 'v': sum(w * coalesce(rank <= {k}, false)::INT) / nullif(sum(w), 0)}}" for k in KS]
    + ["{'metric': 'rr', 'v': sum(w * coalesce(1.0::DOUBLE / rank, 0)) / nullif(sum(w), 0)}"])


@query("retrieval_report", "issue", "dup", sql=RANKED_SQL + f""",
s AS (SELECT *, 'all' AS scope FROM rk UNION ALL SELECT *, 'reachable' FROM rk WHERE reachable),
mx AS (SELECT mode, scope, r, unnest([{RANK_STATS_SQL}]) AS x FROM s JOIN dr USING (q) GROUP BY mode, scope, r),
m AS (SELECT mode, scope, r, x.metric AS metric, x.v AS v FROM mx)
SELECT mode, scope, metric, round(max(v) FILTER (WHERE r = 0), 6) AS point, round(quantile_cont(v, 0.025) FILTER (WHERE r > 0), 6) AS low,
  round(quantile_cont(v, 0.975) FILTER (WHERE r > 0), 6) AS high, count(v) FILTER (WHERE r > 0) AS valid_resamples FROM m GROUP BY mode, scope, metric""")
def retrieval_report(spark, sf):
    rows = None
    for name, ranked in three_rankings(spark, sf).items():
        part = scoped(query_ranks(spark, sf, ranked)).withColumn("mode", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    out = uncertainty.bootstrap_ci(
        materialise(rows, "ranks"), "q", {"n": F.lit(1), **rank_stats()}, rank_metrics(), by=["mode", "scope"])
    return out.select("mode", "scope", "metric", *[r6(F.col(c)).alias(c) for c in ("point", "low", "high")], "valid_resamples")


PAIRS = (("bm25", "dense"), ("bm25", "hybrid"), ("dense", "hybrid"))


@query("retriever_deltas", "issue", "dup", sql=RANKED_SQL + f""",
mx AS (SELECT mode, r, unnest([{RANK_STATS_SQL}]) AS x FROM rk JOIN dr USING (q) WHERE reachable GROUP BY mode, r),
m AS (SELECT mode, r, x.metric AS metric, x.v AS v FROM mx),
p AS (SELECT a.mode AS system_a, b.mode AS system_b, r, metric, a.v AS a, b.v AS b, b.v - a.v AS d FROM m a JOIN m b USING (r, metric)
  WHERE (a.mode, b.mode) IN (('bm25', 'dense'), ('bm25', 'hybrid'), ('dense', 'hybrid')))
SELECT system_a, system_b, metric, round(max(a) FILTER (WHERE r = 0), 6) AS a, round(max(b) FILTER (WHERE r = 0), 6) AS b,
  round(max(d) FILTER (WHERE r = 0), 6) AS delta, round(quantile_cont(d, 0.025) FILTER (WHERE r > 0), 6) AS low,
  round(quantile_cont(d, 0.975) FILTER (WHERE r > 0), 6) AS high, round(avg((d > 0)::INT) FILTER (WHERE r > 0), 6) AS share_b_better,
  count(d) FILTER (WHERE r > 0) AS valid_resamples,
  coalesce(quantile_cont(d, 0.025) FILTER (WHERE r > 0) > 0 OR quantile_cont(d, 0.975) FILTER (WHERE r > 0) < 0, false) AS significant
FROM p GROUP BY system_a, system_b, metric""")
def retriever_deltas(spark, sf):
    """Every later retriever minus every earlier one, on the same reachable queries."""
    asked = {
        name: query_ranks(spark, sf, ranked).filter("reachable").select("q", "rank") for name, ranked in three_rankings(spark, sf).items()}
    wide = materialise(fusion.paired_ranks(asked, "q"), "paired-ranks")
    out = None
    for a, b in PAIRS:
        part = uncertainty.paired_bootstrap(
            wide, "q", {"n": F.lit(1), **rank_stats(a, "a_"), **rank_stats(b, "b_")}, rank_metrics("a_"), rank_metrics("b_"))
        part = part.select(
            F.lit(a).alias("system_a"), F.lit(b).alias("system_b"), "metric",
            *[r6(F.col(c)).alias(c) for c in ("a", "b", "delta", "low", "high", "share_b_better")], "valid_resamples", "significant")
        out = part if out is None else out.unionByName(part)
    return out


@query("similar_with_context", "issue", "dup", "label_event", "state_event", sql=SQL.rstrip() + f""",
hits AS (SELECT * FROM top WHERE rank <= 5 AND q >= 0),
rq AS (SELECT DISTINCT h.number AS issue, qs.as_of FROM hits h JOIN qs USING (q)),
lab AS (SELECT issue, as_of, string_agg(label, ',' ORDER BY label) AS labels FROM (
  SELECT r.issue, r.as_of, e.label, max_by(e.added, (e.at_, e.seq)) AS added FROM rq r
  JOIN label_event e ON e.issue = r.issue AND epoch_us(e.at_) < r.as_of GROUP BY ALL) WHERE added GROUP BY ALL),
st2 AS (SELECT r.issue, r.as_of, max_by(e.kind, (e.at_, e.seq)) AS kind FROM rq r
  JOIN state_event e ON e.issue = r.issue AND epoch_us(e.at_) < r.as_of GROUP BY ALL)
SELECT h.q, h.number, h.rank, round(h.score, 4) AS score, i.title, CASE WHEN kind = 'closed' THEN 'closed' ELSE 'open' END AS state,
  coalesce(labels, '') AS labels, {SNIPPET_SQL.format('i.body')} AS snippet
FROM hits h JOIN qs USING (q) JOIN issue i ON i.number = h.number
LEFT JOIN lab ON lab.issue = h.number AND lab.as_of = qs.as_of
LEFT JOIN st2 ON st2.issue = h.number AND st2.as_of = qs.as_of""")
def similar_with_context(spark, sf):
    queries = duplicate_texts(spark, sf)
    top = bm25_ranking(spark, sf, queries, 5)
    when = fx.documents(spark, sf).select(F.col("number").alias("q"), F.col("created_at").alias("as_of"))
    hits = materialise(top.join(when, "q"), "hits").withColumnRenamed("number", "issue")
    labels = asof.replay_labels(hits, fx.label_events(spark, sf), "issue")
    state = asof.replay_state(hits, fx.state_events(spark, sf), "issue")
    docs = fx.documents(spark, sf).select(F.col("number").alias("issue"), "title", "body")
    full = hits.join(docs, "issue").join(labels, ["issue", "as_of"]).join(state, ["issue", "as_of"])
    return full.select(
        "q", F.col("issue").alias("number"), F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"),
        "title", "state", F.array_join("labels", ",").alias("labels"), tx.snippet(F.col("body")).alias("snippet"))


TFIDF_SQL = f"""docs AS (SELECT number, epoch_us(created_at) AS created, {tokens("title || chr(10) || chr(10) || body")} AS toks FROM issue),
post AS (SELECT term, number, count(*) AS tf, any_value(created) AS created
  FROM (SELECT number, created, unnest(toks) AS term FROM docs) GROUP BY term, number),
fit AS (SELECT term, count(*) AS df FROM post WHERE number IN (SELECT doc_id FROM labels) GROUP BY term HAVING count(*) >= 2),
nf AS (SELECT count(DISTINCT number) AS n FROM post WHERE number IN (SELECT doc_id FROM labels)),
raw AS (SELECT term, number, created, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM post JOIN fit USING (term), nf),
vec AS (SELECT term, number, created, w / sqrt(sum(w * w) OVER (PARTITION BY number)) AS w FROM raw),
sims AS (SELECT a.number AS q, b.number, round(sum(a.w * b.w), 9) AS score FROM vec a JOIN vec b USING (term)
  WHERE b.created < a.created AND a.number IN (SELECT doc_id FROM labels) GROUP BY ALL),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, number) AS rank FROM sims) WHERE rank <= 5)"""


def neighbours(spark, sf, k):
    """Training rows are the labelled documents; every document is a possible neighbour."""
    docs = fx.documents(spark, sf).select(
        "number", micros(F.col("created_at")).alias("created"), tx.issue_text(F.col("title"), F.col("body")).alias("text"))
    train = read_table(spark, sf, "labels").select(F.col("doc_id").alias("number"))
    return lexical.tfidf_neighbours(docs, train, "number", tx.tokenize(F.col("text")), k)


@query("tfidf_neighbours", "issue", sql=f"WITH {TFIDF_SQL} SELECT q, number, round(score, 6) AS score, rank FROM nn")
def tfidf_neighbours(spark, sf):
    return neighbours(spark, sf, 5).select(
        "q", "number", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("tune_threshold", "issue", "dup", sql=f"""WITH {TFIDF_SQL},
best AS (SELECT l.doc_id, d.original AS gold, nn.number AS found, coalesce(nn.score, 0.0) AS sim FROM labels l
  LEFT JOIN dup d ON d.number = l.doc_id LEFT JOIN nn ON nn.q = l.doc_id AND rank = 1),
s AS (SELECT sim, count(*) FILTER (WHERE found = gold) AS tp,
  count(*) FILTER (WHERE found IS NOT NULL AND found IS DISTINCT FROM gold) AS fp FROM best GROUP BY sim),
c AS (SELECT sim, sum(tp) OVER (ORDER BY sim DESC) AS tp, sum(fp) OVER (ORDER BY sim DESC) AS fp FROM s)
SELECT round(sim, 6) AS threshold, round(2.0 * tp / (tp + fp + (SELECT count(gold) FROM best)), 6) AS f1
FROM c ORDER BY 2.0 * tp / (tp + fp + (SELECT count(gold) FROM best)) DESC, sim DESC LIMIT 1""")
def tune_threshold(spark, sf):
    nearest = neighbours(spark, sf, 1).select(F.col("q").alias("number"), F.col("number").alias("found"), F.col("score").alias("sim"))
    gold = fx.duplicates(spark, sf).withColumnRenamed("original", "gold")
    train = read_table(spark, sf, "labels").select(F.col("doc_id").alias("number"))
    best = train.join(gold, "number", "left").join(nearest, "number", "left").withColumn(
        "sim", F.coalesce("sim", F.lit(0.0)))
    out = lexical.tune_threshold(materialise(best, "best"))
    return out.select(r6(F.col("threshold")).alias("threshold"), r6(F.col("f1")).alias("f1"))

"""The driver's tables seen as issues, event logs, predictions, traces and spend.

Every builder is a projection (plus, where said, one join) of a given table, so queries over
them grow with the data. `oracle.py` states the same relations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.numeric import uniform
from hindcast.sources.tables import read_table

LANGS = ("en", "fr", "de", "es")
RUNS = ("a", "b", "c")
EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"

# Split windows (half-open train and dev, closed test).
TRAIN_END = "1999-01-01"
DEV_END = "2000-06-01"
TEST_END = "2001-06-30"


def hours_after(hours: str) -> Column:
    return F.expr(f"{EPOCH} + make_dt_interval(0, CAST({hours} AS INT), 0, 0)")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """issue: number, created_at, title, body, lang, source."""
    d = read_table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("number"),
        hours_after("doc_id").alias("created_at"),
        F.left("text", F.lit(80)).alias("title"),
        F.col("text").alias("body"),
        "lang",
        "source",
    )


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """number, original: the smallest id with equal text, where that is smaller than its own.

    Texts are compared by hash so the shuffle carries 16 bytes per row; a group of copies is
    one aggregate row joined back, never a list.
    """
    d = read_table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    firsts = d.groupBy("h").agg(F.min("doc_id").alias("original"))
    return d.join(firsts, "h").filter("original < doc_id").select(
        F.col("doc_id").alias("number"), "original"
    )


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def ev_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues whose history is the events table: one per user, all fields derived from the key."""
    ids = raw_events(spark, sf).groupBy("user_id").agg(
        F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events")
    )
    created = hours_after("user_id * 2")
    return ids.select(
        F.col("user_id").alias("issue"),
        created.alias("created_at"),
        F.concat(F.lit("title now "), F.col("user_id")).alias("title"),
        F.concat(F.lit("body now "), F.col("user_id")).alias("body"),
        F.when(F.col("user_id") % 4 != 0, F.col("last_ts")).alias("last_edited_at"),
        (F.col("user_id") % 7).alias("author"),
        (F.col("user_id") % 10 == 0).alias("author_is_bot"),
        F.when(F.col("user_id") % 3 == 0, F.lit("MEMBER")).otherwise(F.lit("NONE")).alias("author_association"),
        "n_events",
    )


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Body revisions: error events; the event of id divisible by 5 stands at creation time."""
    e = raw_events(spark, sf).filter("event_type = 'error'")
    created = hours_after("user_id * 2")
    near = F.expr(f"{EPOCH} + make_dt_interval(0, CAST(user_id * 2 AS INT), 0, event_id % 80)")
    return e.select(
        F.col("user_id").alias("issue"),
        F.when(F.col("event_id") % 5 == 0, near).otherwise(F.greatest("ts", created)).alias("at"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("revision "), F.col("event_id")).alias("body"),
    )


def label_events(spark: SparkSession, sf: str) -> DataFrame:
    """issue, label, at, seq, added, actor (null = deleted account), is_bot, author."""
    return raw_events(spark, sf).select(
        F.col("user_id").alias("issue"),
        F.col("event_type").alias("label"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 3 != 0).alias("added"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 7).alias("actor"),
        (F.col("event_id") % 11 == 0).alias("is_bot"),
        (F.col("user_id") % 7).alias("author"),
    )


def state_events(spark: SparkSession, sf: str) -> DataFrame:
    e = raw_events(spark, sf).filter(F.col("event_type").isin("signup", "purchase"))
    closed = F.col("event_type") == "signup"
    return e.select(
        F.col("user_id").alias("issue"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.when(closed, "closed").otherwise("reopened").alias("kind"),
        F.when(
            closed, F.when(F.col("event_id") % 2 == 0, "COMPLETED").otherwise("NOT_PLANNED")
        ).alias("state_reason"),
    )


def event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def renames(spark: SparkSession, sf: str) -> DataFrame:
    e = raw_events(spark, sf).filter("event_type = 'view'")
    return e.select(
        F.col("user_id").alias("issue"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("title "), event_k()).alias("previous"),
        F.concat(F.lit("title "), event_k() + 1).alias("current"),
    )


def duplicate_marks(spark: SparkSession, sf: str) -> DataFrame:
    e = raw_events(spark, sf).filter("event_type = 'click'")
    return e.select(
        F.col("user_id").alias("issue"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 20 != 0, F.col("event_id") % 8).alias("canonical"),
        (F.col("event_id") % 4 == 0).alias("unmarked"),
    )


def asof_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every user at three moments."""
    days = F.array(*[F.expr(f"TIMESTAMP_NTZ'2024-01-{d} 00:00:00'") for d in ("08", "15", "22")])
    users = raw_events(spark, sf).select(F.col("user_id").alias("issue")).distinct()
    return users.select("issue", F.explode(days).alias("as_of"))


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """issue, at, seq, association, is_bot, body: conversation turns."""
    c = read_table(spark, sf, "conversations")
    n = F.floor(uniform("n", F.col("conv_id"), F.col("turn")) * 100)
    marked = uniform(F.col("conv_id"), F.col("turn")) < 0.2
    prefix = F.when(marked, F.concat(F.lit("Duplicate of #"), n, F.lit("\n"))).otherwise(F.lit(""))
    return c.select(
        F.col("conv_id").alias("issue"),
        F.expr(f"{EPOCH} + make_dt_interval(0, CAST(conv_id AS INT), CAST(turn AS INT), 0)").alias("at"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "NONE").when(F.col("role") == "system", "OWNER")
        .otherwise("MEMBER").alias("association"),
        ((F.col("conv_id") + F.col("turn")) % 11 == 0).alias("is_bot"),
        F.concat(prefix, F.col("text")).alias("body"),
    )


def linked_prs(spark: SparkSession, sf: str) -> DataFrame:
    """issue, number, title, merged, base_ref, via: one row per order."""
    o = read_table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("issue"),
        F.col("o_orderkey").alias("number"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("fix-"), "o_custkey", F.lit(": patch")))
        .otherwise(F.lit("patch")).alias("title"),
        (F.col("o_orderstatus") == "F").alias("merged"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "main")
        .otherwise("release").alias("base_ref"),
        F.when(F.col("o_orderkey") % 4 == 0, "closing_reference").otherwise("cross_reference").alias("via"),
    )


def pr_files(spark: SparkSession, sf: str) -> DataFrame:
    """number, path: one changed file per order line."""
    line = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = read_table(spark, sf, "part").select("p_partkey", "p_type")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("number"),
        F.concat(F.lower("p_type"), F.lit("/mod"), "l_partkey", F.lit("/f"), "l_linenumber").alias("path"),
    )


# (component, prefix, role) in match order, and the ignored prefixes.
FILE_RULES = (
    ("core-standard", "standard/mod1", "primary"),
    ("standard", "standard/", "primary"),
    ("economy", "economy/", "primary"),
    ("medium", "medium/", "primary"),
    ("tests", "small/", "supporting"),
    ("docs", "promo/", "supporting"),
)
FILE_IGNORED = ("large/",)

PAGE_RULES = (
    ("english-first", "en/1", "primary"),
    ("english", "en/", "primary"),
    ("german", "de/", "primary"),
    ("french-nine", "fr/9", "supporting"),
    ("french", "fr/", "primary"),
)
PAGE_IGNORED = ("es/",)
OWNER_RULES = (
    ("*", "everyone"),
    ("/en/", "team-en"),
    ("/en/1*", "team-one"),
    ("**/*.html", "team-html"),
    ("/de/*", "team-de"),
    ("/fr/", ""),
)


def split_issues(spark: SparkSession, sf: str) -> DataFrame:
    """number, created_at, duplicate, needs_info, component, exclusion_reason: orders."""
    o = read_table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("number"),
        F.col("o_orderdate").alias("created_at"),
        (key % 37 == 0).alias("duplicate"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).alias("needs_info"),
        (F.col("o_orderstatus") != "P").alias("component"),
        F.when(key % 101 == 0, "bot_author").when(key % 103 == 0, "creation_text_unrecoverable")
        .alias("exclusion_reason"),
    )


# --- gold and predictions ------------------------------------------------------------------


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Reference answers: labels joined with documents, duplicates from equal texts."""
    lab = read_table(spark, sf, "labels")
    doc = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    dup = duplicates(spark, sf)
    joined = lab.join(doc, "doc_id").join(dup, F.col("doc_id") == F.col("number"), "left")
    q = F.concat(F.lit("q"), "quality")
    t = F.concat(F.lit("t"), "toxic")
    return joined.select(
        "doc_id",
        F.array("lang", q, t).alias("labels"),
        F.map_from_arrays(
            F.array("lang", q, t), F.array(F.lit("type"), F.lit("area"), F.lit("family"))
        ).alias("label_groups"),
        (F.col("doc_id") % 10 != 0).alias("human_triaged"),
        F.col("original").alias("duplicate_of"),
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("component"),
        (F.col("toxic") == 1).alias("needs_info"),
        (1.0 + F.col("doc_id") % 4).alias("weight"),
        "lang",
        "quality",
        "toxic",
        "source",
    )


def predictions(spark: SparkSession, sf: str, run: str) -> DataFrame:
    """Run `run`'s answers for every labelled document (the reference answers, disturbed)."""
    g = gold(spark, sf)
    doc = F.col("doc_id")
    wrong_q = F.concat(F.lit("q"), 1 - F.col("quality"))
    kept = F.filter("labels", lambda x: uniform(run, doc, x) >= 0.2)
    extra = F.when(uniform(run, doc, "extra") < 0.1, F.array(wrong_q)).otherwise(
        F.array().cast("array<string>")
    )
    labels = F.concat(kept, extra)
    component = F.when(uniform(run, doc, "comp") < 0.3, F.lit("elsewhere")).otherwise(F.col("source"))
    candidates = F.array(component, F.lit("elsewhere"), F.col("source"))
    dup = (
        F.when(uniform(run, doc, "dup") < 0.2, F.lit(None).cast("long"))
        .when(uniform(run, doc, "dup") < 0.3, F.lit(0).cast("long"))
        .otherwise(F.col("duplicate_of"))
    )
    return g.select(
        "doc_id",
        F.lit(run).alias("run_id"),
        labels.alias("labels"),
        F.transform(labels, lambda x: uniform(run, doc, "conf", x)).alias("confidences"),
        F.when(uniform(run, doc, "nocomp") >= 0.05, component).alias("component"),
        uniform(run, doc, "cc").alias("component_confidence"),
        F.array_distinct(candidates).alias("component_candidates"),
        dup.alias("duplicate_of"),
        F.array(F.lit(0).cast("long"), doc % 5).alias("duplicate_candidates"),
        (F.col("needs_info") != (uniform(run, doc, "ni") < 0.15)).alias("needs_info"),
        uniform(run, doc).alias("confidence"),
        F.when(uniform(run, doc, "err") < 0.05, F.lit("timeout")).alias("error"),
        F.round(uniform(run, doc, "cost") * 0.01, 6).alias("cost_usd"),
        F.floor(uniform(run, doc, "lat") * 1000).alias("latency_ms"),
    )


def rubric_scores(spark: SparkSession, sf: str, rater: str) -> DataFrame:
    """item, criterion, score in 1..4: one row per labelled document and criterion."""
    lab = read_table(spark, sf, "labels").select("doc_id")
    names = F.array(F.lit("correctness"), F.lit("actionability"), F.lit("tone"))
    noise = F.floor(uniform(rater, F.col("item"), F.col("criterion")) * 3) - 1
    base = F.floor(uniform("truth", F.col("item"), F.col("criterion")) * 4) + 1
    return lab.select(F.col("doc_id").alias("item"), F.explode(names).alias("criterion")).select(
        "item", "criterion", F.greatest(F.lit(1), F.least(F.lit(4), base + noise)).cast("long").alias("score")
    )

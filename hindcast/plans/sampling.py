"""Section D: splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.numeric import r6, uniform
from hindcast.operators import sampling as sm
from hindcast.plans import fixtures as fx
from hindcast.plans.oracle import u
from hindcast.plans.registry import query
from hindcast.sources.tables import read_table

SIZES = {"dev": 100, "test": 50}
MINIMUMS = {
    "dev": {"duplicate": 15, "needs_info": 20, "component": 60},
    "test": {"duplicate": 8, "needs_info": 10, "component": 30},
}
SEED = "seven"


def window():
    return sm.time_window(F.col("created_at"), "1995-01-01", fx.TRAIN_END, fx.DEV_END, fx.TEST_END)


WINDOW_SQL = """CASE WHEN created_at::DATE >= DATE '1995-01-01' AND created_at < TIMESTAMP '1999-01-01' THEN 'train'
  WHEN created_at >= TIMESTAMP '1999-01-01' AND created_at < TIMESTAMP '2000-06-01' THEN 'dev'
  WHEN created_at >= TIMESTAMP '2000-06-01' AND created_at::DATE <= DATE '2001-06-30' THEN 'test' ELSE 'out' END"""
STRATUM_SQL = "'duplicate=' || duplicate::INT || '|needs_info=' || needs_info::INT || '|component=' || component::INT"


def sample_sql(name: str) -> str:
    """The sampling rounds as one chain of CTEs; {name}_chosen(number) is the result."""
    n, mins = SIZES[name], MINIMUMS[name]
    out = [f"""{name}_pool AS (SELECT number, duplicate, needs_info, component, {STRATUM_SQL} AS stratum,
  md5('{SEED}-{name}|' || number) AS d FROM split_issue WHERE {WINDOW_SQL} = '{name}' AND exclusion_reason IS NULL)"""]
    prev = None
    for i, flag in enumerate([*mins, None]):
        cur = f"{name}_c{i}"
        have = f"(SELECT count(*) FILTER (WHERE {flag}) FROM {prev})" if prev and flag else "0"
        total = f"(SELECT count(*) FROM {prev})" if prev else "0"
        need = f"least({mins[flag]} - {have}, {n} - {total})" if flag else f"{n} - {total}"
        free = f"number NOT IN (SELECT number FROM {prev})" if prev else "true"
        cond = flag or "true"
        took = f"""SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (ORDER BY d) AS rk FROM {name}_pool
  WHERE {free} AND {cond}) WHERE rk <= {need}"""
        out.append(f"{cur} AS ({f'SELECT * FROM {prev} UNION ALL ' if prev else ''}{took})")
        prev = cur
    out.append(f"{name}_chosen AS (SELECT number FROM {prev})")
    out.append(f"""{name}_w AS (SELECT number, p.stratum, pool::DOUBLE / taken AS weight FROM
  (SELECT number, stratum FROM {name}_pool WHERE number IN (SELECT number FROM {name}_chosen)) p
  JOIN (SELECT stratum, count(*) AS pool FROM {name}_pool GROUP BY 1) USING (stratum)
  JOIN (SELECT stratum, count(*) AS taken FROM {name}_pool WHERE number IN (SELECT number FROM {name}_chosen) GROUP BY 1)
  USING (stratum))""")
    return ",\n".join(out)


ASSIGN_SQL = f"""{sample_sql('dev')},
{sample_sql('test')},
assigned AS (SELECT s.number,
  CASE WHEN exclusion_reason IS NOT NULL THEN 'excluded' WHEN win = 'train' THEN 'train'
    WHEN coalesce(d.weight, t.weight) IS NOT NULL THEN win ELSE win || '_reserve' END AS split,
  {STRATUM_SQL} AS stratum, coalesce(d.weight, t.weight) AS weight, exclusion_reason,
  duplicate, needs_info, component
  FROM (SELECT *, {WINDOW_SQL} AS win FROM split_issue) s
  LEFT JOIN dev_w d USING (number) LEFT JOIN test_w t USING (number)
  WHERE exclusion_reason IS NOT NULL OR win <> 'out')"""


def pool_of(spark, sf, name):
    issues = fx.split_issues(spark, sf).withColumn("stratum", sm.stratum())
    return issues.filter((window() == name) & F.col("exclusion_reason").isNull())


def assigned(spark, sf):
    return sm.assign_splits(fx.split_issues(spark, sf), "number", window(), SIZES, MINIMUMS, SEED)


@query("time_window", "split_issue", sql=f"SELECT number, {WINDOW_SQL} AS win FROM split_issue")
def time_window(spark, sf):
    return fx.split_issues(spark, sf).select("number", window().alias("win"))


@query("stratum", "split_issue", sql=f"SELECT number, {STRATUM_SQL} AS stratum FROM split_issue")
def stratum(spark, sf):
    return fx.split_issues(spark, sf).select("number", sm.stratum().alias("stratum"))


@query("stratified_sample", "split_issue", sql=f"WITH {sample_sql('dev')} SELECT number FROM dev_chosen")
def stratified_sample(spark, sf):
    return sm.stratified_sample(pool_of(spark, sf, "dev"), "number", SIZES["dev"], MINIMUMS["dev"], f"{SEED}-dev")


@query("poststrat_weights", "split_issue", sql=f"""WITH {sample_sql('dev')}
SELECT number, stratum, round(weight, 6) AS weight FROM dev_w""")
def poststrat_weights(spark, sf):
    pool = pool_of(spark, sf, "dev")
    chosen = sm.stratified_sample(pool, "number", SIZES["dev"], MINIMUMS["dev"], f"{SEED}-dev")
    return sm.poststrat_weights(pool, chosen, "number").withColumn("weight", r6(F.col("weight")))


@query("assign_splits", "split_issue", sql=f"""WITH {ASSIGN_SQL}
SELECT number, split, stratum, round(weight, 6) AS weight, exclusion_reason FROM assigned""")
def assign_splits(spark, sf):
    return assigned(spark, sf).withColumn("weight", r6(F.col("weight")))


@query("hash_half_split", sql="""
SELECT doc_id, CASE WHEN ('0x' || substr(sha256('"doc#' || doc_id || '"'), 1, 8))::BIGINT % 2 = 0
  THEN 'judge-dev' ELSE 'judge-test' END AS half FROM documents""")
def hash_half_split(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return d.select("doc_id", sm.hash_half(F.concat(F.lit("doc#"), "doc_id")).alias("half"))


@query("hash_subset", sql="""
SELECT * FROM (SELECT 'demo/repo#' || doc_id AS ref, doc_id AS number FROM documents
ORDER BY sha256('"demo/repo#' || doc_id || '"') LIMIT 40) ORDER BY number""")
def hash_subset(spark, sf):
    d = read_table(spark, sf, "documents").select(
        F.concat(F.lit("demo/repo#"), "doc_id").alias("ref"), F.col("doc_id").alias("number"))
    return sm.hash_subset(d, "ref", 40).orderBy("number")


@query("hash_folds", sql="""
SELECT doc_id, CAST(('0x' || substr(sha256('"doc#' || doc_id || '"'), 57, 8))::BIGINT % 2 AS INT) AS fold2,
  CAST(('0x' || substr(sha256('"doc#' || doc_id || '"'), 57, 8))::BIGINT % 4 AS INT) AS fold4 FROM documents""")
def hash_folds(spark, sf):
    ref = F.concat(F.lit("doc#"), "doc_id")
    d = read_table(spark, sf, "documents").select("doc_id")
    return d.select("doc_id", sm.fold_of(ref, 2).alias("fold2"), sm.fold_of(ref, 4).alias("fold4"))


ITEM_RUNS = ("a", "b", "c")


@query("one_item_per_key", sql=f"""
WITH r AS (SELECT doc_id, run, CASE WHEN {u("run", "'text'", 'doc_id')} < 0.7 THEN run || ' says ' || quality ELSE '' END AS comment
  FROM labels, (VALUES ('a'), ('b'), ('c')) t(run) WHERE {u("run", "'has'", 'doc_id')} < 0.9),
k AS (SELECT doc_id FROM r GROUP BY doc_id HAVING count(DISTINCT run) = 3)
SELECT doc_id || ':' || system AS item_id, doc_id, system, comment FROM (
  SELECT doc_id, min_by(run, md5('zero|' || doc_id || '|' || run)) AS system,
    min_by(comment, md5('zero|' || doc_id || '|' || run)) AS comment
  FROM r WHERE comment <> '' AND doc_id IN (SELECT doc_id FROM k) GROUP BY doc_id)""")
def one_item_per_key(spark, sf):
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    runs = {}
    for run in ITEM_RUNS:
        text = F.when(uniform(run, "text", F.col("doc_id")) < 0.7, F.concat(F.lit(f"{run} says "), "quality")).otherwise("")
        runs[run] = lab.filter(uniform(run, "has", F.col("doc_id")) < 0.9).withColumn("text", text)
    return sm.one_item_per_key(runs, "doc_id", F.col("text"), "zero")


@query("explicit_subset", sql="""
SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')""")
def explicit_subset(spark, sf):
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    french = read_table(spark, sf, "documents").filter("lang = 'fr'").select("doc_id")
    wanted = french.join(lab, "doc_id", "left_semi")
    return sm.explicit_subset(lab, wanted, "doc_id")

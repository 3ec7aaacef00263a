"""Section M, third part: spend."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.numeric import micros
from hindcast.operators import spend as sp
from hindcast.plans.registry import query
from hindcast.sources.tables import read_table

TOTAL_CAP = 1_000_000_000.0


def calls(spark, sf):
    line = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    part = read_table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("model"))
    tokens = (F.col("l_quantity") * 1000).cast("long")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "model", tokens.alias("tokens_in"), (F.col("l_linenumber") * 100).alias("tokens_out"),
        F.floor(tokens * F.col("l_discount")).alias("cached_tokens_in"))


def prices(spark, sf):
    """One price row per brand; brands divisible by three have no cached rate."""
    n = F.length("model") + F.substring_index("model", "#", -1).cast("int")
    models = read_table(spark, sf, "part").select(F.col("p_brand").alias("model")).distinct()
    return models.select(
        "model", (n * 0.1).alias("input_per_mtok"), (n * 0.4).alias("output_per_mtok"),
        F.when(n % 3 != 0, n * 0.02).alias("cached_per_mtok"))


CALLS_SQL = """n AS (SELECT DISTINCT p_brand AS model, length(p_brand) + split_part(p_brand, '#', 2)::INT AS n FROM part),
pr AS (SELECT model, n * 0.1::DOUBLE AS pin, n * 0.4::DOUBLE AS pout, CASE WHEN n % 3 <> 0 THEN n * 0.02::DOUBLE END AS pc FROM n),
ca AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS model, CAST(l_quantity * 1000 AS BIGINT) AS tin, l_linenumber * 100 AS tout,
  CAST(floor(CAST(l_quantity * 1000 AS BIGINT) * l_discount) AS BIGINT) AS tc FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("call_cost", sql=f"""WITH {CALLS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, round(((tin - tc) * pin + tc * coalesce(pc, pin) + tout * pout) / 1000000.0, 6) AS cost
FROM ca JOIN pr USING (model)""")
def call_cost(spark, sf):
    rows = sp.priced(calls(spark, sf), prices(spark, sf), "model")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(sp.call_cost(), 6).alias("cost"))


@query("worst_case_cost", sql=f"""WITH {CALLS_SQL}
SELECT model, count(*) AS calls, round(max((tin * pin + 4000 * pout) / 1000000.0), 6) AS worst FROM ca JOIN pr USING (model) GROUP BY model""")
def worst_case_cost(spark, sf):
    rows = sp.priced(calls(spark, sf), prices(spark, sf), "model")
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.max(sp.worst_case_cost(F.col("tokens_in"), F.lit(4000))), 6).alias("worst"))


@query("spend_ledger", sql="""
SELECT o_custkey AS run, round(sum(o_totalprice), 2) AS spent, count(*) AS calls FROM orders GROUP BY ROLLUP (o_custkey)""")
def spend_ledger(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), "o_totalprice")
    return sp.spend_ledger(o, "run", "o_totalprice").withColumn("spent", F.round("spent", 2))


@query("budget_breach", sql=f"""
WITH l AS (SELECT o_custkey AS run, o_orderdate AS d, o_orderkey AS seq, o_totalprice AS c, abs(c_acctbal) * 100 AS cap
  FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT *, sum(c) OVER (PARTITION BY run ORDER BY d, seq) AS running, sum(c) OVER (ORDER BY d, seq) AS total FROM l)
SELECT 'run' AS scope, run, min_by(seq, (d, seq)) AS seq, round(min_by(running, (d, seq)), 2) AS running FROM r WHERE running > cap GROUP BY run
UNION ALL SELECT 'total', NULL, seq, running FROM (SELECT seq, round(total, 2) AS running FROM r WHERE total > {TOTAL_CAP} ORDER BY d, seq LIMIT 1)""")
def budget_breach(spark, sf):
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), (F.abs("c_acctbal") * 100).alias("cap"))
    ledger = o.select(
        F.col("o_custkey").alias("run"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("cost")).join(c, "run")
    runs = sp.run_breaches(ledger, "run", "at", "seq", "cost", "cap").select(F.lit("run").alias("scope"), "run", "seq", "running")
    total = sp.total_breach(ledger.withColumn("us", micros(F.col("at"))), "us", "seq", "cost", TOTAL_CAP)
    total = total.select(F.lit("total").alias("scope"), F.lit(None).cast("long").alias("run"), "seq", "running")
    return runs.unionByName(total).withColumn("running", F.round("running", 2))


@query("cache_savings", sql="""
SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_id % 4 = 0) AS cache_hits,
  round(coalesce(sum(value) FILTER (WHERE event_id % 4 = 0), 0), 4) AS saved, round(coalesce(sum(value) FILTER (WHERE event_id % 4 <> 0), 0), 4) AS spent
FROM events GROUP BY user_id""")
def cache_savings(spark, sf):
    out = sp.cache_savings(read_table(spark, sf, "events"), ["user_id"], F.col("event_id") % 4 == 0, F.col("value"))
    return out.withColumn("saved", F.round("saved", 4)).withColumn("spent", F.round("spent", 4))

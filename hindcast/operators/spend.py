"""Prices, costs, ledgers and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.numeric import micros
from hindcast.operators.ordering import running_totals

PER_MILLION = 1_000_000.0


def priced(calls: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Calls with their price row. A model with no price fails the job: money is never guessed.

    The price list has one row per model and is broadcast.
    """
    joined = calls.join(prices.withColumn("_known", F.lit(True)), model, "left")
    known = F.when(F.col("_known"), True).otherwise(
        F.raise_error(F.concat(F.lit("no price for model "), F.coalesce(F.col(model), F.lit("?")))).cast("boolean"))
    return joined.filter(known).drop("_known")


def call_cost() -> Column:
    """Over tokens_in, cached_tokens_in, tokens_out and the price columns. Cached tokens are part
    of tokens_in; without a cached rate they cost the input rate."""
    cached = F.least("cached_tokens_in", "tokens_in")
    rate = F.coalesce("cached_per_mtok", "input_per_mtok")
    fresh = (F.col("tokens_in") - cached) * F.col("input_per_mtok")
    return (fresh + cached * rate + F.col("tokens_out") * F.col("output_per_mtok")) / PER_MILLION


def worst_case_cost(prompt: Column, max_tokens: Column) -> Column:
    """Ceiling before a call: the whole output budget and no cache discount."""
    return (prompt * F.col("input_per_mtok") + max_tokens * F.col("output_per_mtok")) / PER_MILLION


def spend_ledger(ledger: DataFrame, run: str, cost: str) -> DataFrame:
    """(run, spent, calls): per run, and all time as the null run."""
    return ledger.rollup(run).agg(F.sum(cost).alias("spent"), F.count(F.lit(1)).alias("calls"))


def run_breaches(ledger: DataFrame, run: str, at: str, seq: str, cost: str, cap: str) -> DataFrame:
    """(run, seq, running): the first row at which a run's spend passes its own cap.

    Days are summed first; a run's running total over days finds the day that crosses, and only
    that day's rows are then added up one by one, by bucketed running totals: a run with most of a day's rows is no hot window.
    """
    day = F.col(at).cast("date")
    daily = ledger.groupBy(run, day.alias("_day")).agg(F.sum(cost).alias("_s"), F.max(cap).alias("_cap"))
    upto = Window.partitionBy(run).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    crossing = daily.withColumn("_c", F.sum("_s").over(upto)).filter(F.col("_c") > F.col("_cap")).groupBy(run).agg(
        F.min_by(F.struct("_day", (F.col("_c") - F.col("_s")).alias("_base"), "_cap"), "_day").alias("_x")).select(run, "_x.*")
    rows = ledger.select(run, at, seq, F.col(cost).alias("_cost"), day.alias("_day")).join(crossing, [run, "_day"])
    placed = rows.select(run, seq, "_cost", "_base", "_cap", micros(F.col(at)).alias("_us"))
    passed = running_totals(placed, "_us", ["_cost"], tie=seq, by=[run]).withColumn("running", F.col("_base") + F.col("cum__cost")).filter(
        F.col("running") > F.col("_cap"))
    return passed.groupBy(run).agg(F.min_by(F.struct(seq, "running"), F.struct("_us", seq)).alias("_f")).select(run, "_f.*")


def total_breach(ledger: DataFrame, at_micros: str, seq: str, cost: str, cap: float) -> DataFrame:
    """(seq, running) of the first row at which all-time spend passes the cap; no global window."""
    run = running_totals(ledger.select(at_micros, seq, cost), at_micros, [cost], tie=seq)
    return run.filter(F.col(f"cum_{cost}") > cap).orderBy(at_micros, seq).limit(1).select(
        seq, F.col(f"cum_{cost}").alias("running"))


def cache_savings(calls: DataFrame, by: Sequence[str], hit: Column, cost: Column) -> DataFrame:
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("cache_hits"),
        F.sum(F.when(hit, cost).otherwise(0.0)).alias("saved"), F.sum(F.when(hit, 0.0).otherwise(cost)).alias("spent"))

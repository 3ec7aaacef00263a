"""Calibration of confidences: reliability bins, ECE, Brier, risk-coverage, slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import uncertainty
from hindcast.operators.ordering import running_totals

BINS = 10
LETTER = r"^[\W_]*([A-Za-z])[\W_]*$"  # fixed value: a token that is one option letter


def width_bin(conf: Column, bins: int = BINS) -> Column:
    """min(int(conf * bins), bins - 1): the top edge belongs to the last bin."""
    return F.least(F.floor(conf * bins).cast("int"), F.lit(bins - 1))


def _bin_stats(conf: str, correct: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.avg(conf).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy")]


def reliability_width(rows: DataFrame, conf: str, correct: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    out = rows.groupBy(*by, width_bin(F.col(conf), bins).alias("bin")).agg(*_bin_stats(conf, correct))
    return out.withColumn("lo", F.col("bin") / bins).withColumn("hi", (F.col("bin") + 1) / bins)


def reliability_mass(
    rows: DataFrame, conf: str, correct: str, key: str, bins: int = BINS, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-mass bins in (confidence, key) order, of each group of `by`; bin b starts at round-half-even(b * n / bins).

    Positions come from a bucketed running count, so neither the sort nor a large group of
    equal confidences lands in one task.
    """
    by = list(by)
    one = rows.select(*by, conf, correct, key).withColumn("_one", F.lit(1).cast("long"))
    placed = running_totals(one, conf, ["_one"], tie=key, inclusive=False, by=by)
    if by:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).withColumnsRenamed({c: f"_b_{c}" for c in by})
        placed = placed.join(sizes, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by])
    else:
        placed = placed.withColumn("_rows", rows.agg(F.count(F.lit(1))).scalar())
    placed = placed.withColumn("_size", F.col("_rows") / F.lit(float(bins)))
    edge = lambda b: F.bround(b * F.col("_size"))
    guess = F.floor(F.col("cum__one") / F.col("_size"))
    nudged = (
        F.when(F.col("cum__one") < edge(guess), guess - 1).when(F.col("cum__one") >= edge(guess + 1), guess + 1).otherwise(guess))
    return placed.groupBy(*by, nudged.cast("int").alias("bin")).agg(
        *_bin_stats(conf, correct), F.min(conf).alias("lo"), F.max(conf).alias("hi"))


def ece(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share-weighted gap between accuracy and mean confidence, over any bins."""
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")))
    return bins.groupBy(*by).agg((gap / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier(conf: Column, correct: Column) -> Column:
    return F.avg(F.pow(conf - correct.cast("double"), F.lit(2.0)))


def risk_coverage(rows: DataFrame, conf: str, correct: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, coverage, accuracy) for every distinct confidence of a group; equal ones stay together."""
    by = list(by)
    per_value = rows.groupBy(*by, conf).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("long")).alias("hits"))
    run = running_totals(per_value, conf, ["n", "hits"], descending=True, by=by)
    if by:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")).withColumnsRenamed({c: f"_b_{c}" for c in by})
        run = run.join(sizes, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by])
    else:
        run = run.withColumn("_total", rows.agg(F.count(F.lit(1))).scalar())
    return run.select(
        *by, F.col(conf).alias("threshold"), (F.col("cum_n") / F.col("_total")).alias("coverage"),
        (F.col("cum_hits") / F.col("cum_n")).alias("accuracy"), (F.col("n") / F.col("_total")).alias("step"))


def aurc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under risk (1 - accuracy) over coverage, step interpolation."""
    return points.groupBy(*by).agg(F.sum(F.col("step") * (1 - F.col("accuracy"))).alias("aurc"))


def calibration_summary(
    rows: DataFrame, key: str, conf: str, correct: str, by: Sequence[str], costs: DataFrame | None = None, resamples: int | None = None,
) -> DataFrame:
    """(by..., metric, point, low, high, valid_resamples): n, accuracy, mean confidence, both ECEs, Brier, AURC, cost per issue.

    Accuracy, mean confidence, width ECE and Brier have resampled intervals; what needs a ranking (mass ECE, AURC), the
    count and the cost are points. `costs`: (a column of `by`, cost) with one row per issue, averaged.
    """
    by = list(by)
    sums, metrics = calibration_sums(F.col(conf), F.col(correct))
    draws = {} if resamples is None else {"resamples": resamples}
    held = uncertainty.bootstrap_ci(rows, key, sums, metrics, by=by, **draws).drop("weighted")
    count = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("point")).withColumn("metric", F.lit("n"))
    mass = ece(reliability_mass(rows, conf, correct, key, by=by), by).select(*by, F.col("ece").alias("point"), F.lit("ece_mass").alias("metric"))
    area = aurc(risk_coverage(rows, conf, correct, by), by).select(*by, F.col("aurc").alias("point"), F.lit("aurc").alias("metric"))
    points = count.unionByName(mass).unionByName(area)
    if costs is not None:
        shared = [c for c in by if c in costs.columns]
        mean = costs.groupBy(*shared).agg(F.avg("cost").alias("point"))
        points = points.unionByName(rows.select(*by).distinct().join(mean, shared).withColumn("metric", F.lit("cost_per_issue")))
    none = F.lit(None).cast("double")
    return held.unionByName(points.select(
        *by, "metric", "point", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("valid_resamples")))


def best_type(labels: Column, confidences: Column, types: Sequence[str]) -> Column:
    """{answer, conf}: the most confident type label (the first one listed wins ties)."""
    pairs = F.transform(F.arrays_zip(labels.alias("l"), confidences.alias("c")), lambda p, i: F.struct(
        p["c"].alias("conf"), (-i).alias("first"), p["l"].alias("answer")))
    return F.array_max(F.filter(pairs, lambda p: p["answer"].isin(*types)))


def decision_outcomes(gold: DataFrame, predictions: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """(run_id, key, question, answer, confidence, correct); a missing answer is wrong at 0."""
    held = F.filter(F.col("g_labels"), lambda x: x.isin(*types))
    g = gold.select(key, F.col("labels").alias("g_labels"), F.col("component").alias("g_comp"))
    best = best_type(F.col("labels"), F.col("confidences"), types)
    rows = predictions.select(
        key, "run_id", best.alias("_t"), "component", "component_confidence").join(g, key)
    asked = F.array(
        F.struct(F.lit("type").alias("question"), F.when(F.size(held) == 1, held[0]).alias("reference"),
                 F.col("_t.answer").alias("answer"), F.coalesce("_t.conf", F.lit(0.0)).alias("confidence")),
        F.struct(F.lit("component").alias("question"), F.col("g_comp").alias("reference"), F.col("component").alias("answer"),
                 F.when(F.col("component").isNotNull(), F.coalesce("component_confidence", F.lit(0.0))).otherwise(0.0).alias("confidence")))
    out = rows.select("run_id", key, F.explode(asked).alias("x")).select("run_id", key, "x.*").filter("reference IS NOT NULL")
    return out.withColumn("correct", F.coalesce(F.col("answer") == F.col("reference"), F.lit(False))).drop("reference")


def calibration_sums(conf: Column, correct: Column, bins: int = BINS) -> tuple[dict[str, Column], dict[str, Column]]:
    """(item sums, metrics): accuracy, mean confidence, Brier and width ECE as additive statistics.

    share * |accuracy - confidence| of a bin is |hits - summed confidence| / n, so a resample's
    ECE needs one signed sum per bin.
    """
    hit = correct.cast("double")
    sums = {"n": F.lit(1), "hit": hit, "conf": conf, "sq": F.pow(conf - hit, F.lit(2.0))}
    for b in range(bins):
        sums[f"gap_{b}"] = F.when(width_bin(conf, bins) == b, hit - conf).otherwise(0.0)
    total = sum((F.abs(F.col(f"gap_{b}")) for b in range(1, bins)), F.abs(F.col("gap_0")))
    metrics = {
        "accuracy": F.col("hit") / F.col("n"), "mean_confidence": F.col("conf") / F.col("n"),
        "brier": F.col("sq") / F.col("n"), "ece": total / F.col("n")}
    return sums, metrics


def calibration_slices(rows: DataFrame, slices: Mapping[str, Column], conf: str, correct: str) -> DataFrame:
    """(slice, n, accuracy, mean_confidence, ece); a slice nobody is in has n = 0 and nulls."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()]))
    member = rows.withColumn("slice", F.explode(names))
    bins = reliability_width(member, conf, correct, ["slice"])
    gaps = ece(bins, ["slice"]).select("slice", "ece")
    stats = member.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(conf).alias("mean_confidence"))
    # The declared slice names, a literal list.
    declared = rows.sparkSession.createDataFrame([(n,) for n in slices], "slice string")
    return declared.join(stats.join(gaps, "slice"), "slice", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def letter_distribution(tokens: DataFrame, item: str, n_options: int) -> DataFrame:
    """(item, option, p): probability per option letter, variants pooled, other tokens dropped."""
    letter = F.upper(F.regexp_extract("token", LETTER, 1))
    pooled = tokens.select(item, (F.ascii(letter) - F.lit(ord("A"))).alias("option"), "logprob", letter.alias("_l")).filter(
        (F.col("_l") != "") & (F.col("option") < n_options)).groupBy(item, "option").agg(F.sum(F.exp("logprob")).alias("mass"))
    # At most n_options rows per item after pooling.
    whole = Window.partitionBy(item)
    return pooled.filter("mass > 0").select(item, "option", (F.col("mass") / F.sum("mass").over(whole)).alias("p"))

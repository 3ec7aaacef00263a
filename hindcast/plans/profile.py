"""Section E: dataset statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.numeric import r6
from hindcast.operators import profile as pf
from hindcast.operators.silver import label_source, taxonomy_labels
from hindcast.plans import fixtures as fx
from hindcast.plans import silver as sv
from hindcast.plans.registry import query
from hindcast.plans.sampling import ASSIGN_SQL, assigned
from hindcast.sources.tables import read_table


def flagged(spark, sf):
    flags = fx.split_issues(spark, sf).select("number", "duplicate", "needs_info", "component")
    return assigned(spark, sf).join(flags, "number")


def _rates_sql() -> str:
    parts = []
    for f in ("duplicate", "needs_info", "component"):
        parts.append(f"""SELECT 'pool' AS scope, '{f}' AS flag, round(avg({f}::INT), 6) AS rate, NULL::DOUBLE AS weighted
  FROM assigned WHERE split IN ('dev', 'test', 'dev_reserve', 'test_reserve')""")
        for s in ("dev", "test"):
            parts.append(f"""SELECT '{s}', '{f}', round(avg({f}::INT), 6), round(sum(weight * {f}::INT) / sum(weight), 6)
  FROM assigned WHERE split = '{s}'""")
    return f"WITH {ASSIGN_SQL} " + "\nUNION ALL ".join(parts)


@query("positive_rates", "split_issue", sql=_rates_sql())
def positive_rates(spark, sf):
    out = pf.positive_rates(flagged(spark, sf))
    return out.withColumn("rate", r6(F.col("rate"))).withColumn("weighted", r6(F.col("weighted")))


@query("split_sizes", "split_issue", sql=f"""WITH {ASSIGN_SQL}
SELECT 'split' AS kind, split AS name, count(*) AS n FROM assigned GROUP BY 2
UNION ALL SELECT 'excluded', exclusion_reason, count(*) FROM assigned WHERE exclusion_reason IS NOT NULL GROUP BY 2""")
def split_sizes(spark, sf):
    return pf.split_sizes(assigned(spark, sf))


@query("label_source_counts", "label_event", sql=f"""WITH {sv.SOURCES}
SELECT source, count(*) AS n FROM src GROUP BY source""")
def label_source_counts(spark, sf):
    rows = label_source(sv.current_labels(spark, sf), fx.label_events(spark, sf))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("top_labels", "issue", sql="""
WITH l AS (SELECT lang AS label, CASE WHEN lang IN ('en', 'fr') THEN 'type' ELSE 'area' END AS grp FROM issue
  UNION ALL SELECT 'topic-' || (number % 5), 'family' FROM issue),
c AS (SELECT grp, label, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, label) AS rank FROM c)
SELECT grp, label, n, rank FROM r WHERE rank <= 12""")
def top_labels(spark, sf):
    rows = taxonomy_labels(sv.doc_labels(spark, sf), "number", "labels", sv.TYPES, sv.AREAS, sv.PREFIXES)
    return pf.top_labels(rows, "grp", "label").withColumn("rank", F.col("rank").cast("long"))


@query("component_by_split", sql="""
SELECT coalesce(CASE WHEN doc_id % 7 <> 0 THEN source END, '(none)') AS component,
  count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr,
  count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es
FROM documents GROUP BY 1""")
def component_by_split(spark, sf):
    d = read_table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("component"), "lang")
    return pf.component_by_split(d, "component", "lang", fx.LANGS)


@query("triage_rate", "gold", sql="""
SELECT lang AS split, round(avg(human_triaged::INT), 6) AS rate, count(*) AS n FROM gold GROUP BY 1""")
def triage_rate(spark, sf):
    g = fx.gold(spark, sf).withColumnRenamed("lang", "split")
    return pf.rate_by(g, "split", F.col("human_triaged"), "rate").withColumn("rate", r6(F.col("rate")))


@query("component_ties", "linked_pr", "pr_file", sql=f"""WITH {sv.VOTES}
SELECT count(*) FILTER (WHERE component IS NULL) AS ties, count(*) AS voted FROM vote""")
def component_ties(spark, sf):
    n = sv.fixes(spark, sf).groupBy("issue").agg(F.count(F.lit(1)).alias("n_fix_prs"))
    return pf.component_ties(sv.votes(spark, sf), n)


@query("edit_counts", "ev_issue", "rename", sql="""
SELECT count(last_edited_at) AS body_edited, count(*) AS issues,
  (SELECT count(DISTINCT issue) FROM rename) AS renamed FROM ev_issue""")
def edit_counts(spark, sf):
    return pf.edit_counts(fx.ev_issues(spark, sf), fx.renames(spark, sf))


@query("label_profile", "issue", sql="""
WITH l AS (SELECT number, title, unnest([lang, source, 'topic-' || (number % 5), 'status-new']) AS label FROM issue),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY number) AS k FROM l)
SELECT label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM issue), 6) AS share,
  string_agg(title, ' / ' ORDER BY number) FILTER (WHERE k <= 3) AS examples FROM r GROUP BY label""")
def label_profile(spark, sf):
    out = pf.label_profile(sv.doc_labels(spark, sf), "number", "title", "labels")
    return out.withColumn("share", r6(F.col("share"))).withColumn("examples", F.array_join("examples", " / "))


@query("component_shares", "gold", sql="""
SELECT component, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(component) FROM gold), 6) AS share FROM gold
WHERE component IS NOT NULL GROUP BY component""")
def component_shares(spark, sf):
    return pf.component_shares(fx.gold(spark, sf)).withColumn("share", r6(F.col("share")))

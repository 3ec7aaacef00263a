"""API JSON to typed records: one `from_json` with a fixed schema, then projections.

Timeline nodes are dispatched on `__typename`. A null actor is a deleted account: no login,
not a bot. Two entry points: `timeline_facts` for a table of single nodes (what a stream or a
flattened crawl holds, no per-issue collection), `parse_issues` for whole nested issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.sources.schemas import (
    ACTOR, CROSS_REFERENCE_NODE, LABEL_NODES, LINKED_PR, MARK_NODES, RENAME_NODE, STATE_NODES,
)

API_ACTOR = "STRUCT<login: STRING, __typename: STRING>"
API_PR = (
    "STRUCT<__typename: STRING, number: LONG, title: STRING, merged: BOOLEAN, "
    "mergedAt: TIMESTAMP_NTZ, baseRefName: STRING>"
)
API_NODE = (
    f"STRUCT<__typename: STRING, createdAt: TIMESTAMP_NTZ, actor: {API_ACTOR}, "
    "label: STRUCT<name: STRING>, stateReason: STRING, duplicateOf: STRUCT<number: LONG>, "
    "canonical: STRUCT<__typename: STRING, number: LONG, createdAt: TIMESTAMP_NTZ>, "
    f"previousTitle: STRING, currentTitle: STRING, source: {API_PR}>"
)
API_ISSUE = (
    "STRUCT<number: LONG, url: STRING, title: STRING, body: STRING, createdAt: TIMESTAMP_NTZ, "
    f"closedAt: TIMESTAMP_NTZ, state: STRING, stateReason: STRING, author: {API_ACTOR}, "
    "authorAssociation: STRING, lastEditedAt: TIMESTAMP_NTZ, "
    "duplicateOf: STRUCT<number: LONG, createdAt: TIMESTAMP_NTZ>, "
    "labels: STRUCT<nodes: ARRAY<STRUCT<name: STRING>>>, "
    f"originalBody: STRUCT<nodes: ARRAY<STRUCT<editedAt: TIMESTAMP_NTZ, diff: STRING, editor: {API_ACTOR}>>>, "
    f"comments: STRUCT<totalCount: LONG, nodes: ARRAY<STRUCT<createdAt: TIMESTAMP_NTZ, author: {API_ACTOR}, "
    "authorAssociation: STRING, body: STRING>>>, "
    f"closedByPullRequestsReferences: STRUCT<nodes: ARRAY<{API_PR}>>, "
    f"timelineItems: STRUCT<totalCount: LONG, nodes: ARRAY<{API_NODE}>>>"
)
READ_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]['Z']"}


def actor(node: Column) -> Column:
    """{login, is_bot}; a missing node is a deleted account."""
    return F.struct(
        node["login"].alias("login"),
        F.coalesce(node["__typename"] == "Bot", F.lit(False)).alias("is_bot"),
    )


def linked_pr(node: Column, via: str) -> Column:
    return F.struct(
        node["number"].alias("number"),
        F.coalesce(node["title"], F.lit("")).alias("title"),
        F.coalesce(node["merged"], F.lit(False)).alias("merged"),
        node["mergedAt"].alias("merged_at"),
        node["baseRefName"].alias("base_ref"),
        F.lit(via).alias("via"),
    ).cast(LINKED_PR)


def timeline_facts(nodes: DataFrame, key: str, seq: str, json: str) -> DataFrame:
    """One typed row per known timeline node of a (key, seq, json) table; others are dropped."""
    parsed = nodes.select(key, seq, F.from_json(json, API_NODE, READ_OPTIONS).alias("n"))
    kind = F.col("n.__typename")
    known = (*LABEL_NODES, *STATE_NODES, *MARK_NODES, RENAME_NODE, CROSS_REFERENCE_NODE)
    who = actor(F.col("n.actor"))
    is_issue = F.col("n.canonical.__typename") == "Issue"
    fact = (
        F.when(kind.isin(*LABEL_NODES), "label")
        .when(kind.isin(*STATE_NODES), "state")
        .when(kind.isin(*MARK_NODES), "duplicate_mark")
        .when(kind == RENAME_NODE, "rename")
        .when(F.col("n.source.__typename") == "PullRequest", "linked_pr")
    )
    return (
        parsed.filter(kind.isin(*known))
        .select(
            key, seq, fact.alias("fact"), F.col("n.createdAt").alias("at"),
            F.when(fact == "label", F.coalesce("n.label.name", F.lit(""))).alias("label"),
            F.when(fact == "label", kind == LABEL_NODES[0]).alias("added"),
            F.when(fact == "state", F.when(kind == STATE_NODES[0], "closed").otherwise("reopened")).alias("state"),
            F.when(fact == "state", F.col("n.stateReason")).alias("state_reason"),
            F.when(is_issue, F.col("n.canonical.number")).alias("canonical"),
            F.when(fact == "duplicate_mark", kind == MARK_NODES[1]).alias("unmarked"),
            F.col("n.previousTitle").alias("previous"),
            F.col("n.currentTitle").alias("current"),
            F.when(fact == "linked_pr", F.col("n.source.number")).alias("pr_number"),
            who["login"].alias("login"),
            who["is_bot"].alias("is_bot"),
        )
        .filter("fact IS NOT NULL")
    )


def parse_issues(nodes: DataFrame, repo: str, json: str, collected_at: str) -> DataFrame:
    """Whole nested issue documents -> the raw issue record.

    Work per row is bounded by that row's own JSON (the API caps a page), so arrays stay nested.
    """
    i = nodes.select(F.from_json(json, API_ISSUE, READ_OPTIONS).alias("i"), F.col(collected_at).alias("collected_at"))

    def items(path: str) -> Column:
        return F.filter(F.coalesce(F.col(path), F.array()), lambda n: n.isNotNull())

    timeline = F.filter(
        F.coalesce(F.col("i.timelineItems.nodes"), F.from_json(F.lit("[]"), f"ARRAY<{API_NODE}>")),
        lambda n: n.isNotNull(),
    )

    def pick(*kinds: str) -> Column:
        return F.filter(timeline, lambda n: n["__typename"].isin(*kinds))

    labels = F.transform(pick(*LABEL_NODES), lambda n: F.struct(
        n["createdAt"].alias("at"), F.coalesce(n["label"]["name"], F.lit("")).alias("label"),
        (n["__typename"] == LABEL_NODES[0]).alias("added"), actor(n["actor"]).alias("actor")))
    states = F.transform(pick(*STATE_NODES), lambda n: F.struct(
        n["createdAt"].alias("at"),
        F.when(n["__typename"] == STATE_NODES[0], "closed").otherwise("reopened").alias("kind"),
        n["stateReason"].alias("state_reason"), n["duplicateOf"]["number"].alias("duplicate_of")))

    def mark(n: Column) -> Column:
        is_issue = n["canonical"]["__typename"] == "Issue"
        return F.struct(
            n["createdAt"].alias("at"), F.when(is_issue, n["canonical"]["number"]).alias("canonical"),
            F.when(is_issue, n["canonical"]["createdAt"]).alias("canonical_created_at"),
            (n["__typename"] == MARK_NODES[1]).alias("unmarked"), actor(n["actor"]).alias("actor"))

    renames = F.transform(pick(RENAME_NODE), lambda n: F.struct(
        n["createdAt"].alias("at"), n["previousTitle"].alias("previous"), n["currentTitle"].alias("current")))
    closing = F.transform(items("i.closedByPullRequestsReferences.nodes"), lambda n: linked_pr(n, "closing_reference"))
    cross = F.transform(
        F.filter(pick(CROSS_REFERENCE_NODE), lambda n: n["source"]["__typename"] == "PullRequest"),
        lambda n: linked_pr(n["source"], "cross_reference"))
    numbered = F.map_from_entries(F.transform(
        F.array_distinct(F.transform(F.concat(closing, cross), lambda p: p["number"])),
        lambda k: F.struct(k, F.filter(F.concat(closing, cross), lambda p: p["number"] == k)[0])))
    original = F.when(
        F.col("i.lastEditedAt").isNotNull() & (F.size("i.originalBody.nodes") > 0),
        F.struct(
            F.col("i.originalBody.nodes")[0]["editedAt"].alias("at"),
            F.coalesce(F.col("i.originalBody.nodes")[0]["diff"], F.lit("")).alias("body"),
            actor(F.col("i.originalBody.nodes")[0]["editor"]).alias("editor")))
    comments = F.transform(items("i.comments.nodes"), lambda c: F.struct(
        c["createdAt"].alias("at"), actor(c["author"]).alias("author"),
        F.coalesce(c["authorAssociation"], F.lit("NONE")).alias("author_association"),
        F.coalesce(c["body"], F.lit("")).alias("body")))

    def text(path: str, default: str = "") -> Column:
        return F.coalesce(F.col(path), F.lit(default))

    return i.select(
        F.lit(repo).alias("repo"), F.col("i.number").alias("number"), text("i.url").alias("url"),
        text("i.title").alias("title"), text("i.body").alias("body"), F.col("i.createdAt").alias("created_at"),
        F.col("i.closedAt").alias("closed_at"), text("i.state").alias("state"),
        F.col("i.stateReason").alias("state_reason"), actor(F.col("i.author")).cast(ACTOR).alias("author"),
        text("i.authorAssociation", "NONE").alias("author_association"),
        F.col("i.lastEditedAt").alias("last_edited_at"), original.alias("original_body"),
        F.transform(items("i.labels.nodes"), lambda n: n["name"]).alias("labels_current"),
        F.when(F.col("i.duplicateOf").isNotNull(), F.struct(
            F.col("i.duplicateOf.number").alias("number"),
            F.col("i.duplicateOf.createdAt").alias("created_at"))).alias("duplicate_of"),
        labels.alias("label_events"), states.alias("state_events"),
        F.transform(pick(*MARK_NODES), mark).alias("duplicate_marks"), renames.alias("title_renames"),
        comments.alias("comments"), F.coalesce("i.comments.totalCount", F.lit(0)).alias("comments_total"),
        F.coalesce("i.timelineItems.totalCount", F.lit(0)).alias("timeline_total"),
        F.array_sort(F.map_values(numbered), lambda a, b: (a["number"] - b["number"]).cast("int")).alias("linked_prs"),
        "collected_at",
    )


def truncation_audit(parents: DataFrame, children: DataFrame, key: str, reported: str, cap: int) -> DataFrame:
    """How many parents hold fewer children than they report, and how many report over the cap."""
    held = children.groupBy(key).agg(F.count(F.lit(1)).alias("_held"))
    joined = parents.join(held, key, "left")
    return joined.agg(
        F.count_if(F.col(reported) > F.coalesce("_held", F.lit(0))).alias("truncated"),
        F.count_if(F.col(reported) > cap).alias("over_cap"),
        F.count(F.lit(1)).alias("rows"),
    )

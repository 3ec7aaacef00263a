"""The record types as explicit DDL schemas. Nothing is inferred from data."""

from __future__ import annotations

ACTOR = "STRUCT<login: STRING, is_bot: BOOLEAN>"
LABEL_EVENT = f"STRUCT<at: TIMESTAMP_NTZ, label: STRING, added: BOOLEAN, actor: {ACTOR}>"
STATE_EVENT = "STRUCT<at: TIMESTAMP_NTZ, kind: STRING, state_reason: STRING, duplicate_of: LONG>"
DUPLICATE_MARK = (
    "STRUCT<at: TIMESTAMP_NTZ, canonical: LONG, canonical_created_at: TIMESTAMP_NTZ, "
    f"unmarked: BOOLEAN, actor: {ACTOR}>"
)
TITLE_RENAME = "STRUCT<at: TIMESTAMP_NTZ, previous: STRING, current: STRING>"
COMMENT = f"STRUCT<at: TIMESTAMP_NTZ, author: {ACTOR}, author_association: STRING, body: STRING>"
BODY_REVISION = f"STRUCT<at: TIMESTAMP_NTZ, body: STRING, editor: {ACTOR}>"
LINKED_PR = (
    "STRUCT<number: LONG, title: STRING, merged: BOOLEAN, merged_at: TIMESTAMP_NTZ, "
    "base_ref: STRING, via: STRING>"
)

RAW_ISSUE = (
    "repo STRING, number LONG, url STRING, title STRING, body STRING, created_at TIMESTAMP_NTZ, "
    f"closed_at TIMESTAMP_NTZ, state STRING, state_reason STRING, author {ACTOR}, "
    f"author_association STRING, last_edited_at TIMESTAMP_NTZ, original_body {BODY_REVISION}, "
    "labels_current ARRAY<STRING>, duplicate_of STRUCT<number: LONG, created_at: TIMESTAMP_NTZ>, "
    f"label_events ARRAY<{LABEL_EVENT}>, state_events ARRAY<{STATE_EVENT}>, "
    f"duplicate_marks ARRAY<{DUPLICATE_MARK}>, title_renames ARRAY<{TITLE_RENAME}>, "
    f"comments ARRAY<{COMMENT}>, comments_total LONG, timeline_total LONG, "
    f"linked_prs ARRAY<{LINKED_PR}>, collected_at TIMESTAMP_NTZ"
)
PR_FILES = "repo STRING, number LONG, files ARRAY<STRING>, files_total LONG"

# The leakage contract: a snapshot has these columns and no others.
SNAPSHOT_COLUMNS = (
    "issue_ref", "repo", "number", "title", "body", "author_association", "created_at",
)
SPLIT_COLUMNS = ("number", "split", "stratum", "weight", "exclusion_reason")

PREDICTION = (
    "run_id STRING, issue_ref STRING, labels ARRAY<STRING>, label_confidence MAP<STRING, DOUBLE>, "
    "rejected_labels ARRAY<STRING>, component STRING, component_confidence DOUBLE, "
    "component_candidates ARRAY<STRING>, suggested_owners ARRAY<STRING>, duplicate_of LONG, "
    "duplicate_confidence DOUBLE, duplicate_candidates ARRAY<LONG>, needs_info BOOLEAN, "
    "needs_info_confidence DOUBLE, missing_info ARRAY<STRING>, triage_comment STRING, "
    "decided_by MAP<STRING, STRING>, trace_id STRING, cost_usd DOUBLE, latency_ms LONG, "
    "tokens_in LONG, tokens_out LONG, steps LONG, tool_calls LONG, stop_reason STRING, error STRING"
)
LEDGER = "run_id STRING, at TIMESTAMP_NTZ, model STRING, cost_usd DOUBLE, calls LONG"

# The timeline node types of the issue API, and what each becomes.
LABEL_NODES = ("LabeledEvent", "UnlabeledEvent")
STATE_NODES = ("ClosedEvent", "ReopenedEvent")
MARK_NODES = ("MarkedAsDuplicateEvent", "UnmarkedAsDuplicateEvent")
RENAME_NODE = "RenamedTitleEvent"
CROSS_REFERENCE_NODE = "CrossReferencedEvent"

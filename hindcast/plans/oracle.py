"""The fixture relations as SQL, assembled into WITH clauses by name."""

from __future__ import annotations

from hindcast.functions.numeric import POISSON_ONE
from collections.abc import Sequence


def u(*parts: str) -> str:
    """The seeded uniform: parts are SQL expressions (quote literals yourself)."""
    text = " || '|' || ".join(p if p.startswith("'") else f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE)"


def poisson_one(u_sql: str) -> str:
    """The Poisson(1) draw at a uniform: how many of its cumulative probabilities the uniform has passed."""
    edges = ", ".join(f"{p!r}::DOUBLE" for p in POISSON_ONE)
    return f"len(list_filter([{edges}], lambda e: e <= {u_sql}))"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0::DOUBLE END)"


STOP = (
    "a an and are as at be but by for from has have i if in into is it its of on or so that "
    "the their then there these this to was were will with you your we our can could should "
    "would do does did been being when which what who how"
)
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP.split()) + "]"


def tokens(text: str) -> str:
    found = f"regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')"
    return (
        f"list_filter(list_transform({found}, lambda x: lower(x)), "
        f"lambda x: length(x) > 1 AND NOT list_contains({STOP_LIST}, x))"
    )


def prediction_sql(run: str) -> str:
    r = f"'{run}'"
    return f"""
SELECT doc_id, {r} AS run_id,
  list_filter(labels, lambda x: {u(r, 'doc_id', 'x')} >= 0.2)
    || CASE WHEN {u(r, 'doc_id', "'extra'")} < 0.1 THEN ['q' || (1 - quality)] ELSE [] END AS labels,
  CASE WHEN {u(r, 'doc_id', "'nocomp'")} >= 0.05 THEN
    CASE WHEN {u(r, 'doc_id', "'comp'")} < 0.3 THEN 'elsewhere' ELSE source END END AS component,
  {u(r, 'doc_id', "'cc'")} AS component_confidence,
  CASE WHEN {u(r, 'doc_id', "'comp'")} < 0.3 THEN ['elsewhere', source] ELSE [source, 'elsewhere'] END
    AS component_candidates,
  CASE WHEN {u(r, 'doc_id', "'dup'")} < 0.2 THEN NULL WHEN {u(r, 'doc_id', "'dup'")} < 0.3 THEN 0
    ELSE duplicate_of END::BIGINT AS duplicate_of,
  [0::BIGINT, doc_id % 5] AS duplicate_candidates,
  needs_info <> ({u(r, 'doc_id', "'ni'")} < 0.15) AS needs_info,
  {u(r, 'doc_id')} AS confidence,
  CASE WHEN {u(r, 'doc_id', "'err'")} < 0.05 THEN 'timeout' END AS error,
  round({u(r, 'doc_id', "'cost'")} * 0.01, 6) AS cost_usd,
  floor({u(r, 'doc_id', "'lat'")} * 1000)::BIGINT AS latency_ms
FROM gold"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "issue": ((), """
SELECT doc_id AS number, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at,
  left(text, 80) AS title, text AS body, lang, source FROM documents"""),
    "dup": ((), """
SELECT doc_id AS number, original FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS original FROM documents)
WHERE original < doc_id"""),
    "ev_issue": ((), """
SELECT user_id AS issue, TIMESTAMP '2024-01-01' + to_hours(user_id * 2) AS created_at,
  'title now ' || user_id AS title, 'body now ' || user_id AS body,
  CASE WHEN user_id % 4 <> 0 THEN max(ts) END AS last_edited_at, user_id % 7 AS author,
  user_id % 10 = 0 AS author_is_bot,
  CASE WHEN user_id % 3 = 0 THEN 'MEMBER' ELSE 'NONE' END AS author_association,
  count(*) AS n_events FROM events GROUP BY user_id"""),
    "revision": ((), """
SELECT user_id AS issue, CASE WHEN event_id % 5 = 0
    THEN TIMESTAMP '2024-01-01' + to_hours(user_id * 2) + to_seconds(event_id % 80)
    ELSE greatest(ts, TIMESTAMP '2024-01-01' + to_hours(user_id * 2)) END AS at_,
  event_id AS seq, 'revision ' || event_id AS body FROM events WHERE event_type = 'error'"""),
    "label_event": ((), """
SELECT user_id AS issue, event_type AS label, ts AS at_, event_id AS seq, event_id % 3 <> 0 AS added,
  CASE WHEN event_id % 13 <> 0 THEN event_id % 7 END AS actor, event_id % 11 = 0 AS is_bot,
  user_id % 7 AS author FROM events"""),
    "state_event": ((), """
SELECT user_id AS issue, ts AS at_, event_id AS seq,
  CASE WHEN event_type = 'signup' THEN 'closed' ELSE 'reopened' END AS kind,
  CASE WHEN event_type = 'signup' THEN
    CASE WHEN event_id % 2 = 0 THEN 'COMPLETED' ELSE 'NOT_PLANNED' END END AS state_reason
FROM events WHERE event_type IN ('signup', 'purchase')"""),
    "rename": ((), """
SELECT user_id AS issue, ts AS at_, event_id AS seq,
  'title ' || CAST(json_extract(props, '$.k') AS BIGINT) AS previous,
  'title ' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1) AS current
FROM events WHERE event_type = 'view'"""),
    "mark": ((), """
SELECT user_id AS issue, ts AS at_, event_id AS seq,
  CASE WHEN event_id % 20 <> 0 THEN event_id % 8 END AS canonical, event_id % 4 = 0 AS unmarked
FROM events WHERE event_type = 'click'"""),
    "request": ((), """
SELECT issue, as_of FROM (SELECT DISTINCT user_id AS issue FROM events),
  (VALUES (TIMESTAMP '2024-01-08'), (TIMESTAMP '2024-01-15'), (TIMESTAMP '2024-01-22')) t(as_of)"""),
    "comment": ((), f"""
SELECT conv_id AS issue, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS at_,
  turn AS seq, CASE role WHEN 'user' THEN 'NONE' WHEN 'system' THEN 'OWNER' ELSE 'MEMBER' END AS association,
  (conv_id + turn) % 11 = 0 AS is_bot,
  CASE WHEN {u('conv_id', 'turn')} < 0.2 THEN 'Duplicate of #'
    || CAST(floor({u("'n'", 'conv_id', 'turn')} * 100) AS BIGINT) || chr(10) ELSE '' END || text AS body
FROM conversations"""),
    "linked_pr": ((), """
SELECT o_custkey AS issue, o_orderkey AS number,
  CASE WHEN o_orderkey % 3 = 0 THEN 'fix-' || o_custkey || ': patch' ELSE 'patch' END AS title,
  o_orderstatus = 'F' AS merged,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'main' ELSE 'release' END AS base_ref,
  CASE WHEN o_orderkey % 4 = 0 THEN 'closing_reference' ELSE 'cross_reference' END AS via FROM orders"""),
    "pr_file": ((), """
SELECT l_orderkey AS number, lower(p_type) || '/mod' || l_partkey || '/f' || l_linenumber AS path
FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "split_issue": ((), """
SELECT o_orderkey AS number, o_orderdate AS created_at, o_orderkey % 37 = 0 AS duplicate,
  o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS needs_info, o_orderstatus <> 'P' AS component,
  CASE WHEN o_orderkey % 101 = 0 THEN 'bot_author'
    WHEN o_orderkey % 103 = 0 THEN 'creation_text_unrecoverable' END AS exclusion_reason FROM orders"""),
    "gold": (("dup",), """
SELECT l.doc_id, [d.lang, 'q' || l.quality, 't' || l.toxic] AS labels, l.doc_id % 10 <> 0 AS human_triaged,
  dup.original AS duplicate_of, CASE WHEN l.doc_id % 7 <> 0 THEN d.source END AS component,
  l.toxic = 1 AS needs_info, (1.0 + l.doc_id % 4)::DOUBLE AS weight, d.lang, l.quality, l.toxic, d.source
FROM labels l JOIN documents d USING (doc_id) LEFT JOIN dup ON dup.number = l.doc_id"""),
    "pred_a": (("gold",), prediction_sql("a")),
    "pred_b": (("gold",), prediction_sql("b")),
    "pred_c": (("gold",), prediction_sql("c")),
}
for _rater in ("human", "judge", "terse"):
    CTES[f"score_{_rater}"] = ((), f"""
SELECT doc_id AS item, criterion, greatest(1, least(4,
    floor({u("'truth'", 'doc_id', 'criterion')} * 4)::BIGINT + 1
    + floor({u(f"'{_rater}'", 'doc_id', 'criterion')} * 3)::BIGINT - 1))::BIGINT AS score
FROM labels, (VALUES ('correctness'), ('actionability'), ('tone')) t(criterion)""")


def _needed(names: Sequence[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(CTES[name][0], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_ctes(names: Sequence[str], body: str) -> str:
    """Prefix the body with the named relations and those they build on."""
    head = [f"{n} AS ({CTES[n][1].strip()})" for n in _needed(names, [])]
    body = body.strip()
    if not head:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(head) + ",\n" + body[5:]
    return "WITH " + ",\n".join(head) + "\n" + body

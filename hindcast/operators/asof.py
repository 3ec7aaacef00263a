"""Point-in-time reconstruction from event logs. Every comparison is strict: before `as_of`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.numeric import micros
from hindcast.sources.schemas import SNAPSHOT_COLUMNS

CREATION_TOLERANCE_S = 60  # fixed value: clock skew allowed between an issue and its first revision


def last_before(
    requests: DataFrame,
    events: DataFrame,
    key: str,
    payload: Sequence[str],
    *,
    sub: Sequence[str] = (),
    as_of: str = "as_of",
    at: str = "at",
    seq: str = "seq",
) -> DataFrame:
    """The last event before each request's moment, per `sub` (e.g. label) within the key.

    Looked up in three steps: the last event day before the request's day, the last minute before its minute inside that
    day, the last moment before its own inside that minute; the finest one found holds. In each step events are first compressed to
    one row per unit by a partial aggregate, the requested units ride in the same timeline, and a window carries the
    value forward. No step pairs requests with events: rows are events, or requested units once per `sub`, which is
    what comes out.
    """
    subs = list(sub)
    order = F.struct(F.col(at), F.col(seq))

    def units(moment: Column) -> list[Column]:
        exact = micros(moment)
        return [F.unix_date(moment.cast("date")).cast("long"), F.floor(exact / 60_000_000), exact]

    names = ["_day", "_minute", "_exact"]
    asked = requests.select(key, as_of).distinct().select("*", *[u.alias(n) for n, u in zip(names, units(F.col(as_of)), strict=True)])
    seen = events.select(
        key, *subs, F.struct(*payload).alias("_v"), order.alias("_o"), *[u.alias(n) for n, u in zip(names, units(F.col(at)), strict=True)])
    found = None
    for level, unit in enumerate(names):
        inside = [key, *names[max(0, level - 1) : level]]  # a minute lies in one day, a moment in one minute
        happened = seen.groupBy(*inside, *subs, unit).agg(F.max_by("_v", "_o").alias("_v"))
        wanted = asked.select(*inside, unit).distinct().join(seen.select(*inside, *subs).distinct(), inside)
        marks = happened.withColumn("_asked", F.lit(False)).unionByName(
            wanted.select(*inside, *subs, unit, F.lit(None).cast(happened.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_asked")))
        earlier = Window.partitionBy(*inside, *subs).orderBy(unit).rangeBetween(Window.unboundedPreceding, -1)
        carried = marks.withColumn("_last", F.last("_v", ignorenulls=True).over(earlier)).filter("_asked AND _last IS NOT NULL")
        part = asked.join(carried.select(*inside, *subs, unit, "_last"), [*inside, unit]).select(
            key, as_of, *subs, "_last", F.lit(level).alias("_level"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(key, as_of, *subs).agg(F.max_by("_last", "_level").alias("_v")).select(key, as_of, *subs, "_v.*")


def title_at_creation(issues: DataFrame, renames: DataFrame, key: str) -> DataFrame:
    """The title before the first rename, or the current one."""
    first = renames.groupBy(key).agg(F.min_by("previous", F.struct("at", "seq")).alias("_first"))
    return issues.join(first, key, "left").withColumn("creation_title", F.coalesce("_first", "title")).drop("_first")


def body_at_creation(issues: DataFrame) -> DataFrame:
    """Adds (creation_body, reject_reason) from body, last_edited_at, original_at/original_body."""
    gap = F.abs(micros(F.col("original_at")) - micros(F.col("created_at")))
    reason = (
        F.when(F.col("last_edited_at").isNull(), F.lit(None).cast("string"))
        .when(F.col("original_at").isNull(), "no_revision_history")
        .when(gap > CREATION_TOLERANCE_S * 1_000_000, "oldest_revision_not_creation")
    )
    body = F.when(F.col("last_edited_at").isNull(), F.col("body")).when(reason.isNull(), F.col("original_body"))
    return issues.withColumn("reject_reason", reason).withColumn("creation_body", body)


def exclusion_reason(author_is_bot: Column, reject_reason: Column) -> Column:
    return F.when(author_is_bot, "bot_author").when(reject_reason.isNotNull(), "creation_text_unrecoverable")


def to_snapshot(issues: DataFrame, repo: str) -> DataFrame:
    """The allow-listed snapshot columns only, for rows whose creation text is provable."""
    return issues.filter("reject_reason IS NULL").select(
        F.concat(F.lit(f"{repo}#"), F.col("number").cast("string")).alias("issue_ref"),
        F.lit(repo).alias("repo"),
        "number",
        F.col("creation_title").alias("title"),
        F.col("creation_body").alias("body"),
        "author_association",
        "created_at",
    ).select(*SNAPSHOT_COLUMNS)


def build_corpus(issues: DataFrame) -> DataFrame:
    """Rows with provable text; automated authors stay, they are real history."""
    reason = exclusion_reason(F.col("author_is_bot"), F.col("reject_reason"))
    return issues.filter(F.col("reject_reason").isNull()).withColumn("exclusion_reason", reason)


def replay_labels(requests: DataFrame, label_events: DataFrame, key: str) -> DataFrame:
    """(key, as_of, labels): sorted labels whose last event before the moment added them."""
    last = last_before(requests, label_events, key, ["added"], sub=["label"])
    held = last.filter("added").groupBy(key, "as_of").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    asked = requests.select(key, "as_of").distinct()
    empty = F.array().cast("array<string>")
    return asked.join(held, [key, "as_of"], "left").withColumn("labels", F.coalesce("labels", empty))


def replay_state(requests: DataFrame, state_events: DataFrame, key: str) -> DataFrame:
    """(key, as_of, state, state_reason): open unless the last state event closed it."""
    last = last_before(requests, state_events, key, ["kind", "state_reason"])
    closed = F.col("kind") == "closed"
    return requests.select(key, "as_of").distinct().join(last, [key, "as_of"], "left").select(
        key, "as_of",
        F.when(closed, "closed").otherwise("open").alias("state"),
        F.when(closed, F.col("state_reason")).alias("state_reason"),
    )


def replay_title(requests: DataFrame, renames: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(key, as_of, title): the last rename before the moment, else the creation title."""
    last = last_before(requests, renames, key, ["current"])
    asked = requests.select(key, "as_of").distinct()
    base = asked.join(issues.select(key, "creation_title"), key)
    return base.join(last, [key, "as_of"], "left").select(
        key, "as_of", F.coalesce("current", "creation_title").alias("title")
    )


def view_as_of(
    requests: DataFrame, issues: DataFrame, label_events: DataFrame, state_events: DataFrame,
    renames: DataFrame, key: str,
) -> DataFrame:
    """Each requested issue as seen at its moment; issues created at or after it are refused.

    `issues` carries created_at, creation_title, creation_body, reject_reason.
    """
    visible = requests.select(key, "as_of").distinct().join(
        issues.select(key, "created_at", "creation_title", "creation_body", "reject_reason"), key
    ).filter("created_at < as_of AND reject_reason IS NULL")
    on = [key, "as_of"]
    return (
        visible.join(replay_title(visible, renames, issues, key), on)
        .join(replay_labels(visible, label_events, key), on)
        .join(replay_state(visible, state_events, key), on)
        .select(key, "as_of", "created_at", "title", F.col("creation_body").alias("body"), "labels", "state", "state_reason")
    )


def get_as_of(requests: DataFrame, corpus: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keyed lookup. 'Created later' and 'never existed' give the same answer on purpose."""
    found = requests.join(corpus.select(key, "created_at", *columns), key, "left")
    available = F.coalesce(F.col("created_at") < F.col("as_of"), F.lit(False))
    return found.select(
        *requests.columns, available.alias("available"), *[F.when(available, F.col(c)).alias(c) for c in columns]
    )


def created_before(history: DataFrame, moments: Sequence[Column]) -> DataFrame:
    """History rows repeated for each listed moment they precede (no join: moments are a literal)."""
    asked = F.filter(F.array(*moments), lambda m: F.col("created_at") < m)
    return history.withColumn("as_of", F.explode(asked))


# --- leak audit of what a system was shown -------------------------------------------------

# The shape of pasted rows and of truncated tool output.
BLOCK = r"(?s)<similar_issues>(.*?)</similar_issues>"
PASTED_ROW = r"(?m)^- #(\d+) \[(?:open|closed); labels: ([^\]]*)\]"
CUT_OUTPUT = r'^\{"number": (\d+)'
ISSUE_TOOLS = ("search_similar_issues", "get_issue")
TOOL_OUTPUT = (
    "STRUCT<number: LONG, labels: ARRAY<STRING>, "
    "results: ARRAY<STRUCT<number: LONG, labels: ARRAY<STRING>>>, _corrupt_record: STRING>"
)


def extract_shown(trace: DataFrame, ref: str) -> DataFrame:
    """(ref, number, labels): past items in prompts (pasted blocks) and in tool results.

    `trace` has event, name, is_error, content. Labels are null where the trace cut them off.
    """
    blocks = trace.filter("event = 'llm'").select(
        ref, F.explode(F.regexp_extract_all("content", F.lit(BLOCK), F.lit(1))).alias("block"))
    rows = blocks.select(ref, F.explode(F.regexp_extract_all("block", F.lit(PASTED_ROW), F.lit(0))).alias("row"))
    names = F.filter(
        F.transform(F.split(F.regexp_extract("row", PASTED_ROW, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    is_none = (F.size(names) == 1) & (names[0] == "none")
    pasted = rows.select(
        ref,
        F.regexp_extract("row", PASTED_ROW, 1).cast("long").alias("number"),
        F.when(is_none, F.array().cast("array<string>")).otherwise(F.array_sort(names)).alias("labels"),
    )
    calls = trace.filter(
        (F.col("event") == "tool") & F.col("name").isin(*ISSUE_TOOLS) & ~F.coalesce("is_error", F.lit(False)))
    parsed = calls.select(
        ref, "name", "content", F.from_json("content", TOOL_OUTPUT, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    whole = parsed.filter("j._corrupt_record IS NULL AND j IS NOT NULL")
    single = F.struct(F.col("j.number").alias("number"), F.col("j.labels").alias("labels"))
    items = F.when(F.col("name") == ISSUE_TOOLS[0], F.col("j.results")).otherwise(F.array(single))
    returned = whole.select(ref, F.explode(items).alias("i")).select(
        ref, F.col("i.number").alias("number"), F.array_sort("i.labels").alias("labels"))
    cut = parsed.filter("j._corrupt_record IS NOT NULL").select(
        ref, F.regexp_extract("content", CUT_OUTPUT, 1).alias("n")).filter("n <> ''").select(
        ref, F.col("n").cast("long").alias("number"), F.lit(None).cast("array<string>").alias("labels"))
    return pasted.unionByName(returned).unionByName(cut)


def context_audit(
    shown: DataFrame, issues: DataFrame, corpus: DataFrame, label_events: DataFrame, key: str
) -> DataFrame:
    """One row of leak counts for everything a run was shown.

    shown(ref, number, labels), issues(ref, own, as_of), corpus(key, created_at).
    """
    seen = shown.join(issues, "ref").withColumnRenamed("labels", "shown_labels")
    looked = seen.join(corpus.select(F.col(key).alias("number"), "created_at"), "number", "left")
    visible = F.coalesce(F.col("created_at") < F.col("as_of"), F.lit(False))
    itself = F.col("number") == F.col("own")
    to_check = looked.filter(visible & ~itself & F.col("shown_labels").isNotNull()).select(
        F.col("number").alias(key), "as_of")
    allowed = replay_labels(to_check, label_events, key).withColumnRenamed(key, "number")
    checked = looked.join(allowed, ["number", "as_of"], "left")
    wrong = visible & ~itself & F.col("shown_labels").isNotNull() & (F.col("shown_labels") != F.col("labels"))
    return checked.agg(
        F.count_distinct("ref").alias("issues"),
        F.count(F.lit(1)).alias("shown"),
        F.count_if(itself).alias("itself"),
        F.count_if(~itself & ~visible).alias("not_visible"),
        F.count_if(wrong).alias("wrong_labels"),
        F.count_if(visible & ~itself & F.col("shown_labels").isNull()).alias("labels_unchecked"),
    )

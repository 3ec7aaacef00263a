"""Text functions for retrieval, slicing and path rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these patterns, words and limits.
TOKEN_PATTERN = r"[A-Za-z_][A-Za-z0-9_]+|\d{2,}"
STOPWORDS = (
    "a an and are as at be but by for from has have i if in into is it its of on or so that "
    "the their then there these this to was were will with you your we our can could should "
    "would do does did been being when which what who how"
).split()
WORD_PATTERN = r"[a-z0-9_]+"
SNIPPET_CHARS = 300
SNIPPET_MARK = " …[truncated]"
DOC_TOKENS = 1000
QUERY_TOKENS = 400
SHORT_BODY = 300
FENCED_SHARE = 0.5
FOREIGN_SHARE = 0.1


def tokenize(text: Column, max_tokens: int | None = None) -> Column:
    """Lower-cased identifier-shaped tokens, longer than one character, without stop words."""
    # The pattern leaves out single characters, so no second pass has to.
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    tokens = F.filter(F.transform(found, F.lower), lambda t: ~t.isin(STOPWORDS))
    return tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)


def document_text(title: Column, body: Column) -> Column:
    """What a document is indexed by: the title counts twice."""
    return F.concat_ws("\n", title, title, body)


def issue_text(title: Column, body: Column, max_chars: int | None = None) -> Column:
    text = F.concat(title, F.lit("\n\n"), body)
    return text if max_chars is None else F.left(text, F.lit(max_chars))


def snippet(text: Column, limit: int = SNIPPET_CHARS, mark: str = SNIPPET_MARK) -> Column:
    """Whitespace collapsed, ends trimmed, cut with a marker when longer than the limit."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit(mark))).otherwise(flat)


def fenced_share(body: Column) -> Column:
    """Share of lines that lie inside ``` fences; the fence lines themselves do not count."""
    lines = F.split(body, "\r\n|\n|\r")
    # A trailing newline ends the last line, it does not open another one.
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("inside"))

    def step(state: Column, line: Column) -> Column:
        fence = F.startswith(F.trim(line), F.lit("```"))
        counted = F.when(~fence & state["open"], 1).otherwise(0)
        return F.struct((state["open"] != fence).alias("open"), (state["inside"] + counted).alias("inside"))

    inside = F.aggregate(lines, start, step)["inside"]
    return F.when(F.size(lines) > 0, inside / F.size(lines)).otherwise(F.lit(0.0))


def non_ascii_share(text: Column) -> Column:
    """Non-ASCII share of the letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    foreign = F.length(F.regexp_replace(text, r"[^\p{L}]|[A-Za-z]", ""))
    return F.when(letters > 0, foreign / letters).otherwise(F.lit(0.0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two arrays; two empty sets overlap 0."""
    union = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))


def issue_number(ref: Column) -> Column:
    return F.substring_index(ref, "#", -1).cast("long")


def url_path(url: Column) -> Column:
    return F.regexp_replace(url, r"^[a-z]+://[^/]+/?", "")


def _segment_regex(segment: str) -> str:
    """One path segment of an ownership pattern: stars and question marks stay inside it, a double star does not."""
    def atom(found: re.Match) -> str:
        run = found.group()
        if run == "?":
            return "[^/]"
        return re.escape(run) if run[0] != "*" else ".*" if len(run) > 1 else "[^/]*"

    return re.sub(r"[*]+|[?]|[^*?]+", atom, segment)


def owner_pattern_regex(pattern: str) -> str:
    """A gitignore-style ownership pattern as a regex over paths without a leading slash.

    Built segment by segment on the driver, over the (small) rule table only; matching is `rlike` in the job. A pattern of
    one segment matches at any depth unless it starts with a slash. A closing slash asks for something below; a
    closing `/*` for direct children; otherwise the path itself or anything below matches.
    """
    *parents, name = [s for s in pattern.strip().split("/") if s] or ["**"]
    out = "^" if parents or pattern.strip().startswith("/") else "^(?:.*/)?"
    for segment in parents:
        out += "(?:.*/)?" if segment == "**" else _segment_regex(segment) + "/"
    if name == "**":
        return out + ".*$"
    if pattern.strip().endswith("/"):
        return out + _segment_regex(name) + "/.*$"
    return out + _segment_regex(name) + ("$" if parents and name == "*" else "(?:/.*)?$")


SLICES = {
    "all": lambda title, body: F.lit(True),
    "short": lambda title, body: F.length(F.trim(body)) < SHORT_BODY,
    "mostly_fenced": lambda title, body: fenced_share(body) > FENCED_SHARE,
    "non_english": lambda title, body: non_ascii_share(F.concat(title, body)) > FOREIGN_SHARE,
}

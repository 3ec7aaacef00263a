"""Lookups over a file table: owners by pattern, literal search by line."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.text import owner_pattern_regex

# Characters of a line that a report shows.
SNIPPET = 200


def owners_of(paths: DataFrame, path: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds (owners, pattern) of the last matching rule; a rule with no owners means nobody.

    Rules are one repository's ownership file: they become a CASE over constant regexes, tried
    from the last rule back, with no join and the regexes compiled once.
    """
    clean = F.ltrim(F.trim(F.col(path)), F.lit("/"))
    case = None
    for pattern, owners in reversed(rules):
        hit = F.struct(F.lit(owners).alias("owners"), F.lit(pattern).alias("pattern"))
        match = clean.rlike(owner_pattern_regex(pattern))
        case = F.when(match, hit) if case is None else case.when(match, hit)
    none = F.lit(None).cast("struct<owners: string, pattern: string>")
    out = paths.withColumn("_o", none if case is None else case)
    return out.select(*paths.columns, F.coalesce("_o.owners", F.lit("")).alias("owners"), "_o.pattern")


def glob_regex(glob: str) -> str:
    """A shell-style glob over the whole path, where * also crosses slashes."""
    wild = {"*": ".*", "?": "."}
    return "^(?s:" + "".join(wild.get(ch) or re.escape(ch) for ch in glob) + ")$"


def file_lines_matching(
    files: DataFrame, path: str, text: str, needle: str, *, glob: str | None = None, max_results: int = 20,
    hits_per_file: int | None = None,
) -> DataFrame:
    """(path, number, snippet, truncated): lines holding the needle, case-insensitively.

    Files of any size in path order, those with a NUL left out; `hits_per_file` shows the first hits of each only. Each file is one row, so its hits are
    found by array functions before anything is exploded, and the path-ordered limit is a
    distributed top-n.
    """
    kept = files.filter(
        (F.instr(text, "\0") == 0)
        & F.contains(F.lower(text), F.lit(needle.lower()))
    )
    if glob is not None:
        kept = kept.filter(F.col(path).rlike(glob_regex(glob)))
    lines = F.transform(
        F.split(text, "\r\n|\n|\r"), lambda x, i: F.struct((i + 1).cast("long").alias("number"), x.alias("line")))
    hits = F.filter(lines, lambda x: F.contains(F.lower(x["line"]), F.lit(needle.lower())))
    if hits_per_file is not None:
        hits = F.slice(hits, 1, hits_per_file)
    rows = kept.select(path, F.explode(hits).alias("h")).select(
        path, "h.number", F.left(F.trim("h.line"), F.lit(SNIPPET)).alias("snippet"))
    top = rows.orderBy(path, "number").limit(max_results + 1)
    found = top.agg(F.count(F.lit(1))).scalar()
    return top.withColumn("truncated", found > max_results).orderBy(path, "number").limit(max_results)

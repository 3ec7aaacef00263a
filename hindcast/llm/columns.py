"""Carrying the caller's columns through an operator, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC = "_doc"


def field(name: str) -> Column:
    return F.col(f"`{name}`")


def pack(df: DataFrame) -> DataFrame:
    """All columns as one struct `_doc`: none can clash with an operator's own."""
    return df.select(F.struct(*[field(c) for c in df.columns]).alias(DOC))


def packed(name: str) -> Column:
    """A column of the packed frame."""
    return F.col(DOC)[name]


def unpack(df: DataFrame, names: list[str], **added: Column) -> DataFrame:
    """The packed columns and the added ones; an added column replaces one of its name."""
    new = {k.lower() for k in added}
    return df.select(
        *[packed(c).alias(c) for c in names if c.lower() not in new], *[v.alias(k) for k, v in added.items()])

"""Content hashes that agree across machines and engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(text: Column) -> Column:
    """A string as its canonical JSON literal, quotes and escapes included."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    # {"v":"..."} without the five leading characters and the closing brace.
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def stable_hash(text: Column) -> Column:
    """SHA-256 (hex) of the canonical JSON form of a string."""
    return F.sha2(json_string(text), 256)


def hash_bucket(digest: Column, buckets: int) -> Column:
    """digest mod buckets for a hex digest, exact for the full 256-bit number.

    The digest is folded 7 hex digits at a time (28 bits), so no step overflows a long.
    """
    remainder = F.lit(0).cast("long")
    step = 16**7
    for start in range(1, 65, 7):
        width = min(7, 65 - start)
        chunk = F.conv(F.substring(digest, start, width), 16, 10).cast("long")
        remainder = (remainder * (step if width == 7 else 16**width) + chunk) % buckets
    return remainder.cast("int")

"""The part of the documents that a model doesn't learn from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod ``mod`` is ``rest``; true for a null id, which is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(True))

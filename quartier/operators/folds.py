"""Deterministic folds from a content hash of the row key or of a group key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions.text import hash_number


def with_fold(
    df: DataFrame, key: str, k: int = 5, seed: int = 0, group: str | None = None, out: str = "fold"
) -> DataFrame:
    """Add a fold in 0..k-1. With ``group`` all rows of a group share a fold.

    The fold depends on the key alone: no shuffle, and the same on every run and retry.
    """
    source = F.col(group or key).cast("string")
    return df.withColumn(out, (hash_number(F.concat(F.lit(f"{seed}:"), source)) % k).cast("int"))

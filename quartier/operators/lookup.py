"""Lookup joins against a unique-key table, safe for hot keys and for large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartier.session import scratch_path

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1_000


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame | None:
    """``df`` as a local relation if it is proven small, else None.

    Partitions are read a few at a time until ``rows + 1`` rows have come, so neither the driver nor a task ever
    holds more, whatever the size of ``df``. For tables that are not needed if they are too large: see ``stored``.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    found = df.select("*", row_bytes(df).alias("_bytes")).limit(rows + 1).collect()
    if len(found) > rows or sum(r["_bytes"] for r in found) > BROADCAST_BYTES:
        return None
    return df.sparkSession.createDataFrame([tuple(r)[:-1] for r in found], df.schema)


def row_bytes(df: DataFrame) -> Column:
    """A measure of each row's size: 8 bytes a value, and the length of texts."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    lengths = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in texts]
    return sum(lengths, F.lit(8 * len(df.columns)).cast("long"))


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, bool, str]:
    """``df`` computed once into the shared folder: the stored copy, whether it is small enough to send, its path.

    Rows and bytes are counted while they are written.
    """
    path, seen = scratch_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")).write.parquet(path)
    small = seen.get["rows"] <= BROADCAST_ROWS and (seen.get["bytes"] or 0) <= BROADCAST_BYTES
    return df.sparkSession.read.schema(df.schema).parquet(path), small, path


def lookup(df: DataFrame, dim: DataFrame, on: list[str], size: int | None = None) -> DataFrame:
    """Left join to ``dim``, whose key ``on`` is unique; NULL keys find nothing.

    A proven-small ``dim`` is broadcast. The proof is its stored copy, or ``size``: the row count of a ``dim`` of
    numbers or bounded text that the caller has counted. Beyond that, keys holding more than one thousandth of the
    rows (so at most a thousand keys) are joined by broadcast and the rest by shuffle, all from the stored copy.
    """
    if size is None:
        dim, small, _ = stored(dim)
    else:
        small = size <= BROADCAST_ROWS
    if small:
        return df.join(F.broadcast(dim), on, "left")
    present = _all_present(on)
    known, missing = df.where(present), df.where(~present)
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in dim.schema if f.name not in on]
    unmatched = missing.select(*on, *[c for c in df.columns if c not in on], *extra)
    hot = hot_keys(known, on)
    if hot.isEmpty():  # a local relation
        return known.join(dim, on, "left").unionByName(unmatched)
    hot_dim = dim.join(F.broadcast(hot), on, "left_semi")
    hot_rows = known.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_dim), on, "left")
    cold_rows = known.join(F.broadcast(hot), on, "left_anti").join(dim, on, "left")
    return hot_rows.unionByName(cold_rows).unionByName(unmatched)


def hot_keys(df: DataFrame, on: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than ``1/share`` of the rows: fewer than ``share`` of them by counting."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * share > F.col("_all"))
    local = bounded(hot.select(*on), share)
    if local is None:
        raise ValueError("hot keys exceed the byte bound of a broadcast")
    return local


def _all_present(on: list[str]) -> Column:
    present = F.lit(True)
    for name in on:
        present = present & F.col(name).isNotNull()
    return present

"""Ranks by distributed prefix sums over distinct values: no global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartier.functions.exprs import correlation
from quartier.operators.lookup import bounded, lookup, stored
from quartier.operators.quantiles import EXACT_ROWS, bucket_count, bucket_of, cut_points, literal_cuts


def values_below(
    counts: DataFrame, by: list[str], value: str, weight: str, out: str, exact_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ``out``: the total ``weight`` of smaller values in the group.

    ``counts`` holds each (by..., value) once. Beyond ``exact_rows`` rows, values are split into
    balanced buckets, bucket totals are summed up (few rows) and each bucket is ranked by itself.
    """
    limit = EXACT_ROWS if exact_rows is None else exact_rows
    rows = counts.count() if rows is None else rows
    if rows <= limit:
        w = Window.partitionBy(*by).orderBy(value)
        return counts.withColumn(out, F.sum(weight).over(w) - F.col(weight))
    buckets = bucket_count(rows, limit)
    cuts = literal_cuts(cut_points(counts, value, buckets))
    placed = counts.withColumn("_b", bucket_of(F.col(value), cuts, buckets))
    group = Window.partitionBy(*by).orderBy("_b")  # at most ``buckets`` rows per group
    offsets = (
        placed.groupBy(*by, "_b")
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_offset", F.sum("_w").over(group) - F.col("_w"))
        .drop("_w")
    )
    inside = Window.partitionBy(*by, "_b").orderBy(value)
    joined = placed.join(offsets, [*by, "_b"])
    total = F.col("_offset") + F.sum(weight).over(inside) - F.col(weight)
    return joined.withColumn(out, total).drop("_b", "_offset")


def average_ranks(
    pairs: DataFrame, by: list[str], value: str, weight: str, out: str, exact_rows: int | None = None
) -> tuple[DataFrame, int]:
    """(by..., value, out) with 1-based average ranks from weighted (counted) rows, and its row count.

    Counts and ranks are stored: cuts, offsets and windows read the one, hot and cold keys of a lookup the other.
    """
    counts, _, _ = stored(pairs.groupBy(*by, value).agg(F.sum(weight).alias("_w")), "counts")
    rows = counts.count()
    ranked = values_below(counts, by, value, "_w", "_below", exact_rows, rows)
    ranked = ranked.select(*by, value, (F.col("_below") + (F.col("_w") + 1) / 2).alias(out))
    return stored(ranked, "ranks")[0], rows


def spearman(
    df: DataFrame, cols: list[str], target: str, out: str = "spearman", exact_rows: int | None = None
) -> DataFrame:
    """(feature, out): rank correlation with ``target`` on pairwise complete rows, average ranks.

    Up to ``exact_rows`` counted rows each column is ranked by a window over that many rows at
    most; beyond, by prefix sums over counted pairs.
    """
    limit = EXACT_ROWS if exact_rows is None else exact_rows
    long = df.select(
        F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols]
    ).unpivot(["_y"], cols, "feature", "_x")
    if df.count() <= limit:
        ranked = long.dropna().select("feature", _window_rank("_x").alias("_rx"), _window_rank("_y").alias("_ry"))
        return ranked.groupBy("feature").agg(correlation(F.col("_rx"), F.col("_ry")).alias(out))
    pairs = long.dropna().groupBy("feature", "_x", "_y").agg(F.count("*").alias("_w")).persist()
    try:
        rows = _rank_correlation(pairs, len(cols), exact_rows).collect()  # one row per column
    finally:
        pairs.unpersist()
    return df.sparkSession.createDataFrame(rows, f"feature string, {out} double")


def _window_rank(value: str) -> Column:
    below = F.rank().over(Window.partitionBy("feature").orderBy(value))
    ties = F.count("*").over(Window.partitionBy("feature", value))
    return below + (ties - 1) / 2


def _rank_correlation(pairs: DataFrame, features: int, exact_rows: int | None) -> DataFrame:
    x_ranks, x_rows = average_ranks(pairs, ["feature"], "_x", "_w", "_rx", exact_rows)
    y_ranks, y_rows = average_ranks(pairs, ["feature"], "_y", "_w", "_ry", exact_rows)
    ranked = lookup(pairs, x_ranks, ["feature", "_x"], size=x_rows)
    ranked = lookup(ranked, y_ranks, ["feature", "_y"], size=y_rows)
    sizes = bounded(pairs.groupBy("feature").agg(F.sum("_w").alias("_n")), features)
    centred = ranked.join(F.broadcast(sizes), "feature").withColumns(
        {
            "_dx": F.col("_rx") - (F.col("_n") + 1) / 2,
            "_dy": F.col("_ry") - (F.col("_n") + 1) / 2,
        }
    )
    w, dx, dy = F.col("_w"), F.col("_dx"), F.col("_dy")
    rho = F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)))
    return centred.groupBy("feature").agg(rho.alias("rho"))

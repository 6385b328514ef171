"""Exact quantiles (linear interpolation) that never gather a hot group in one task.

Up to ``EXACT_ROWS`` counted rows Spark's own ``percentile`` is used: its state is bounded by
that count. Beyond, ranks are located in three scans that shuffle only counts:

The group and value of each row are stored once; what is read afterwards is that copy.

1. a mergeable sketch proposes cut points, which split the values into balanced buckets;
2. rows are counted per (group, bucket), which tells the bucket every wanted rank falls in;
3. only the values of those few buckets are counted one by one to read the ranks off.

The cut points steer balance alone; the result is exact whatever they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartier.operators.lookup import bounded, stored
from quartier.session import checkpointed

EXACT_ROWS = 1_000_000
MIN_BUCKETS, MAX_BUCKETS = 256, 16_384


def _value(value: str | Column) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def value_count(df: DataFrame, value: str | Column) -> int:
    return df.select(F.count(_value(value))).first()[0]


def quantiles(
    df: DataFrame,
    value: str | Column,
    probs: list[float],
    by: list[str] = (),
    out: str = "q",
    aggs: list[Column] = (),
    exact_rows: int | None = None,
    accuracy: int | None = None,
    counted: int | None = None,
) -> DataFrame:
    """One row per group: the group, ``aggs`` and ``out`` (array of quantiles, NULL if no value).

    Rows with a missing group key are dropped, missing values are skipped. With ``accuracy``
    the answer is the approximate ``percentile_approx`` in a single pass. ``counted``, a known
    upper bound of the value count, saves counting.
    """
    by = list(by)
    df = df.dropna(subset=by) if by else df
    limit = EXACT_ROWS if exact_rows is None else exact_rows
    levels = F.array(*[F.lit(float(p)) for p in probs])
    if accuracy is not None:
        q = F.percentile_approx(_value(value), levels, accuracy)
        return df.groupBy(*by).agg(q.alias(out), *aggs)
    counted = value_count(df, value) if counted is None else counted
    if counted <= limit:
        return df.groupBy(*by).agg(F.percentile(_value(value), levels).alias(out), *aggs)
    found = _by_rank(df.select(*by, _value(value).alias("_v")), probs, by, out, counted, limit)
    groups = df.groupBy(*by).agg(*(list(aggs) or [F.count("*").alias("_rows")])).drop("_rows")
    if not by:
        return groups.crossJoin(F.broadcast(found))  # one row
    return groups.join(found, by, "left")


def median(df: DataFrame, value: str | Column, by: list[str] = (), out: str = "median",
           aggs: list[Column] = (), **kw) -> DataFrame:
    """Grouped or global exact median."""
    q = quantiles(df, value, [0.5], by, "_q", aggs, **kw)
    return q.withColumn(out, F.get("_q", F.lit(0))).drop("_q")


def scalar_quantiles(df: DataFrame, value: str | Column, probs: list[float], **kw) -> list[float | None]:
    """Quantiles of one column as driver-side numbers (as many as ``probs``)."""
    row = quantiles(df, value, probs, **kw).first()
    q = row["q"] if row else None
    return list(q) if q is not None else [None] * len(probs)


def cut_points(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """One row: sketch-based cut points splitting ``value`` into about ``buckets`` parts."""
    levels = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    return df.agg(F.expr(f"percentile_approx(`{value}`, array({levels}), {4 * buckets})").alias("_cuts"))


def literal_cuts(cuts: DataFrame) -> Column:
    """The one row of ``cut_points`` as a literal: a column of it would be copied into every row."""
    (found,) = cuts.first()
    if found is None:
        return F.lit(None).cast("array<double>")
    return F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")  # folded into one constant


def bucket_of(value: Column, cuts: Column, buckets: int) -> Column:
    """Index of the cut interval ``value`` falls in: the number of cuts below it (binary search)."""
    steps = [1 << k for k in range(int(math.log2(buckets)) - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at),
    )


def bucket_count(rows: int, per_bucket: int) -> int:
    wanted = max(1, 4 * rows // max(per_bucket, 1))
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << math.ceil(math.log2(wanted))))


def _by_rank(df: DataFrame, probs: list[float], by: list[str], out: str, counted: int, limit: int):
    df, _, _ = stored(df.where(F.col("_v").isNotNull()), "values")  # read three times
    buckets = bucket_count(counted, limit)
    cuts = literal_cuts(cut_points(df, "_v", buckets))
    placed = df.select(*by, "_v", bucket_of(F.col("_v"), cuts, buckets).alias("_b"))
    group = Window.partitionBy(*by)  # at most ``buckets`` rows per group from here on
    totals = placed.groupBy(*by, "_b").agg(F.count("*").alias("_n")).withColumns(
        {
            "_all": F.sum("_n").over(group),
            "_upto": F.sum("_n").over(group.orderBy("_b")),
        }
    )
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    at = F.col("_w.p") * (F.col("_all") - 1)
    ranked = totals.select("*", F.explode(wanted).alias("_w")).withColumn("_at", at)
    ranks = F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))
    before = F.col("_upto") - F.col("_n")
    targets = (
        ranked.select(*by, "_b", "_upto", "_n", F.col("_w.i").alias("_i"), "_at", F.explode(ranks).alias("_r"))
        .where((F.col("_r") >= before) & (F.col("_r") < F.col("_upto")))
        .select(*by, "_b", before.alias("_before"), "_i", "_at", "_r")
    )
    targets = checkpointed(targets)
    needed = targets.select(*by, "_b", "_before").distinct()
    small = bounded(needed)
    needed = F.broadcast(small) if small is not None else needed
    inside = Window.partitionBy(*by, "_b").orderBy("_v")
    values = (
        placed.join(needed, [*by, "_b"])
        .groupBy(*by, "_b", "_before", "_v")
        .agg(F.count("*").alias("_n"))
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    )
    hit = (F.col("_r") >= F.col("_end") - F.col("_n")) & (F.col("_r") < F.col("_end"))
    read = values.join(targets.drop("_before"), [*by, "_b"]).where(hit)
    frac = F.first("_at") - F.floor(F.first("_at"))
    low, high = F.min("_v"), F.max("_v")
    each = read.groupBy(*by, "_i").agg((low + frac * (high - low)).alias("_q"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_q")))  # as many as ``probs``
    return each.groupBy(*by).agg(F.transform(ordered, lambda s: s["_q"]).alias(out))

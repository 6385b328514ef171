"""Exact split search: every cut between two neighbouring values, without bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartier.operators.lookup import bounded, stored
from quartier.operators.quantiles import EXACT_ROWS, bucket_count, bucket_of, cut_points
from quartier.session import checkpointed


def exact_splits(
    df: DataFrame, cols: list[str], y: str, min_rows: int = 1, by: list[str] = (), exact_rows: int | None = None
) -> DataFrame:
    """The binary split that most reduces the squared error of ``y``, for each of ``cols`` and each group of ``by``.

    (by..., feature, threshold, n_left, n_right, gain): rows up to ``threshold`` (the middle of two neighbouring values)
    go left. Rows that lack the column or ``y`` (null or NaN) are left out for that column; the lowest cut wins ties; a
    column with no cut that leaves ``min_rows`` on both sides gives no row.

    Rows are counted and summed by value first, so a value of any frequency is one row. Up to ``exact_rows`` values a
    window sums them up; beyond, values are dealt to balanced ranges, each range carries the totals of those below, and
    the best cut of each range meets the others in one aggregation.
    """
    by = list(by)
    target = F.col(y).cast("double")
    long = (
        df.select(*by, target.alias("_y"), *[F.col(c).cast("double").alias(f"_x_{c}") for c in cols])
        .select(*by, "_y", F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"_x_{c}").alias("x")) for c in cols
        ])).alias("_p"))
        .select(*by, "_y", "_p.feature", F.col("_p.x").alias("_x"))
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    )
    group = [*by, "feature"]
    counts, _, _ = stored(long.groupBy(*group, "_x").agg(F.count("*").alias("_n"), F.sum("_y").alias("_s")), "splits")
    limit = EXACT_ROWS if exact_rows is None else exact_rows
    values = counts.count()
    if values <= limit:
        placed, parts = counts.withColumns({"_n0": F.lit(0), "_s0": F.lit(0.0)}), group
        totals = Window.partitionBy(*group)
        placed = placed.withColumns({"_all_n": F.sum("_n").over(totals), "_all_s": F.sum("_s").over(totals),
                                     "_after": F.lit(None).cast("double")})
    else:
        buckets = bucket_count(values, limit)
        cuts = bounded(cut_points(counts, "_x", buckets), 1)
        dealt = counts.crossJoin(F.broadcast(cuts)).withColumn(
            "_b", bucket_of(F.col("_x"), F.col("_cuts"), buckets)
        ).drop("_cuts")
        ranges = Window.partitionBy(*group)  # at most ``buckets`` rows
        upto = ranges.orderBy("_b")
        carried = (
            dealt.groupBy(*group, "_b").agg(F.sum("_n").alias("_rn"), F.sum("_s").alias("_rs"), F.min("_x").alias("_first"))
            .select(
                *group, "_b",
                (F.sum("_rn").over(upto) - F.col("_rn")).alias("_n0"),
                F.coalesce(F.sum("_rs").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_s0"),
                F.sum("_rn").over(ranges).alias("_all_n"), F.sum("_rs").over(ranges).alias("_all_s"),
                F.lead("_first").over(upto).alias("_after"),
            )
        )
        parts = [*group, "_b"]
        # Equal groups meet by join; ``by`` may hold nulls.
        dealt, carried = dealt.alias("d"), carried.alias("c")
        same = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"c.`{c}`")) for c in parts]
        joined = dealt.join(carried, same)
        placed = joined.select("d.*", *[f"c.{c}" for c in ("_n0", "_s0", "_all_n", "_all_s", "_after")])
    inside = Window.partitionBy(*parts).orderBy("_x")
    cut = placed.select(
        *group, "_x", "_all_n", "_all_s",
        (F.col("_n0") + F.sum("_n").over(inside)).alias("n_left"),
        (F.col("_s0") + F.sum("_s").over(inside)).alias("_left"),
        F.coalesce(F.lead("_x").over(inside), F.col("_after")).alias("_next"),
    ).withColumn("n_right", F.col("_all_n") - F.col("n_left"))
    apart = F.col("_left") / F.col("n_left") - (F.col("_all_s") - F.col("_left")) / F.col("n_right")
    gain = apart * apart * F.col("n_left") * F.col("n_right") / F.col("_all_n")
    enough = F.col("_next").isNotNull() & (F.col("n_left") >= min_rows) & (F.col("n_right") >= min_rows)
    best = F.struct(
        F.col("gain"), (-F.col("_x")).alias("down"), (F.col("_x") + (F.col("_next") - F.col("_x")) / 2).alias("threshold"),
        F.col("n_left"), F.col("n_right"),
    )
    scored = cut.where(enough).withColumn("gain", gain).groupBy(*group).agg(F.max(best).alias("_best"))
    return scored.select(*group, "_best.threshold", "_best.n_left", "_best.n_right", "_best.gain")


def exact_zones(df: DataFrame, cols: list[str], y: str, depth: int, min_rows: int, out: str = "zone",
                exact_rows: int | None = None) -> DataFrame:
    """``df`` with the leaf of a regression tree on unbinned values, grown a level at a time for all nodes together.

    ``out`` is the node's number (1 the root, 2n and 2n+1 the halves of n); NULL where one of ``cols`` or ``y`` is
    missing or NaN. A level is one search for all nodes and a join of at most 2^depth rows, so ``depth`` is limited
    to 15. Ties: the higher gain, then the earlier column.
    """
    if not 0 <= depth <= 15:
        raise ValueError("depth must be from 0 to 15")
    known = F.lit(True)
    for c in [*cols, y]:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    placed = checkpointed(df.withColumn(out, F.when(known, F.lit(1))))  # each level reads it again
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    for level in range(depth):
        at = placed.where(F.col(out) >= 1 << level)
        found = exact_splits(at, cols, y, min_rows, [out], exact_rows).where("gain > 0")
        choice = found.groupBy(out).agg(F.max(F.struct("gain", (-order).alias("o"), "feature", "threshold")).alias("_best"))
        splits = bounded(choice.select(out, F.col("_best.feature").alias("_f"), F.col("_best.threshold").alias("_t")), 1 << level)
        rows = splits.collect()  # at most 2^level
        if not rows:
            break
        x = F.coalesce(*[F.when(F.col("_f") == c, F.col(c).cast("double")) for c in cols])
        child = F.col(out) * 2 + F.when(x <= F.col("_t"), 0).otherwise(1)
        moved = placed.join(F.broadcast(splits), out, "left")
        placed = moved.withColumn(out, F.when(F.col("_f").isNull(), F.col(out)).otherwise(child)).drop("_f", "_t").select(*df.columns, out)
    return placed

"""Shuffled columns without a global sort, and the importance that they measure."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartier.functions.text import hash_number
from quartier.session import checkpointed

SLICE_ROWS = 100_000
MAX_BITS = 16


def hashed_positions(df: DataFrame, key: str, seed: int, out: str, rows: int, slice_rows: int | None = None) -> DataFrame:
    """Add ``out``: 1 to ``rows``, the place of each row in the order of a hash of ``seed`` and ``key``, then of ``key``.

    The hash's first bits cut the rows into even slices; counts by slice give offsets, a window inside gives the rest.
    """
    wanted = -(-rows // (slice_rows or SLICE_ROWS))
    bits = min(MAX_BITS, max(wanted - 1, 0).bit_length())
    order = hash_number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    placed = df.withColumn("_h", order).withColumn("_b", F.shiftright("_h", 32 - bits).cast("int"))
    upto = Window.partitionBy().orderBy("_b")  # at most 2^MAX_BITS slices
    offsets = placed.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", (F.sum("_n").over(upto) - F.col("_n")).alias("_o"))
    joined = placed.join(F.broadcast(offsets), "_b")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return joined.withColumn(out, F.col("_o") + inside).select(*df.columns, out)


def permuted(
    df: DataFrame, key: str, cols: list[str], seed: int = 0, suffix: str = "_perm", slice_rows: int | None = None, rows: int | None = None,
) -> DataFrame:
    """``df`` with ``<col><suffix>``: the values of ``cols`` of another row, each row giving to exactly one.

    The row at place p of one hashed order receives from the row at place p of another. ``key`` tells rows apart (rows
    that repeat a key are permuted all the same, in no fixed order). All of ``cols`` come from one row and one join.
    ``rows`` is the number of rows, if known.
    """
    rows = df.count() if rows is None else rows
    taking = hashed_positions(df, key, 2 * seed, "_place", rows, slice_rows)
    given = df.select(key, *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    giving = hashed_positions(given, key, 2 * seed + 1, "_place", rows, slice_rows).select("_place", *[f"{c}{suffix}" for c in cols])
    return taking.join(giving, "_place").select(*df.columns, *[f"{c}{suffix}" for c in cols])


def permutation_importance(
    model: Transformer, df: DataFrame, cols: list[str], label: str, key: str, prediction: str = "prediction",
    repeats: int = 5, seed: int = 0,
) -> DataFrame:
    """(feature, n, r2, r2_drop, r2_drop_std, mse_rise): how much worse ``model`` predicts with a column shuffled.

    Drops are means over ``repeats`` shuffles; ``r2_drop_std`` is their population spread. Rows without a label or
    without a prediction of their own are left out. Losses are compared row by row, so a column that the model doesn't
    use, or one with a single value, scores exactly 0. One join and one aggregation a repeat serve all columns; the
    model is applied ``len(cols) + 1`` times to each row within its task.
    """
    rows = checkpointed(df.dropna(subset=[label]))
    kept, number = rows.columns, rows.count()
    measured = None
    for i in range(repeats):
        work = permuted(rows, key, cols, seed + i, "_perm", rows=number).withColumn("_own", F.struct(*[F.col(c) for c in kept]))
        carried = [*[f"{c}_perm" for c in cols], "_own"]
        work = model.transform(work).select(*kept, *carried, F.col(prediction).alias("_p"))
        carried.append("_p")
        for j, c in enumerate(cols):
            swapped = work.withColumn(c, F.col(f"{c}_perm"))
            scored = model.transform(swapped)
            work = scored.select(
                *[F.col(f"_own.`{k}`").alias(k) for k in kept], *carried, F.col(prediction).alias(f"_p{j}")
            )
            carried.append(f"_p{j}")
        y = F.col(label).cast("double")
        before = F.pow(y - F.col("_p"), F.lit(2.0))
        rises = [F.sum(F.pow(y - F.col(f"_p{j}"), F.lit(2.0)) - before).alias(f"_d{j}") for j in range(len(cols))]
        sums = work.where(F.col("_p").isNotNull()).agg(
            F.count("*").alias("n"), F.sum(before).alias("_sse"), (F.var_pop(y) * F.count("*")).alias("_sst"), *rises
        )
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_d{j}").alias("rise")) for j, c in enumerate(cols)]))
        line = sums.select("n", "_sse", "_sst", each.alias("_e")).select("n", "_sse", "_sst", "_e.feature", "_e.rise")
        measured = line if measured is None else measured.unionByName(line)
    drop = F.try_divide(F.col("rise"), F.col("_sst"))
    return measured.groupBy("feature").agg(
        F.max("n").alias("n"), F.avg(1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"),
        F.avg(drop).alias("r2_drop"), F.stddev_pop(drop).alias("r2_drop_std"),
        F.avg(F.try_divide(F.col("rise"), F.col("n"))).alias("mse_rise"),
    )

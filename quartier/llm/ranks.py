"""Positions and running sums inside groups of any size: a range sort, counts by partition, offsets joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quartier.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lost executors can't change it, and its size is known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _runs(group: pa.ChunkedArray) -> np.ndarray:
    """The first row of each run of equal groups."""
    if len(group) < 2:
        return np.zeros(len(group), np.int64)
    change = pc.not_equal(group.slice(1), group.slice(0, len(group) - 1))
    return np.concatenate(([0], 1 + np.flatnonzero(np.asarray(change))))


def ranked(df: DataFrame, group: str, order: list[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 0 in its group by ``order``, nulls first) and ``total`` (rows of the group).

    With ``weight`` (a long column, never null) also ``before``, the sum over earlier rows of the group, and ``whole``,
    that over all of it. ``group`` is never null. Groups may have any size: no group meets in one task, rows are
    shuffled once, by range, and those that agree in ``order`` may take any order (it should tell them apart).
    """
    if weight is None:
        return ranked(df.withColumn("_one", F.lit(1).cast("long")), group, order, "_one").drop("_one", "before", "whole")
    keys = [group, *order]
    lined = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    longs = [T.StructField(c, T.LongType()) for c in ("_k", "_w")]
    schema = T.StructType([*lined.schema.fields, *longs])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k, w = None, 0, 0  # group of the last row; rows and weight of it so far
        for batch in batches:
            if not batch.num_rows:
                continue
            column, weights = batch.column(group), np.asarray(batch.column(weight)).astype(np.int64)
            first = _runs(column)
            sizes = np.diff(np.append(first, batch.num_rows))
            place = np.arange(batch.num_rows) - np.repeat(first, sizes)
            sums = np.cumsum(weights) - weights
            sums -= np.repeat(sums[first], sizes)
            if column[0].as_py() == last:
                place[: sizes[0]] += k
                sums[: sizes[0]] += w
            last, k, w = column[-1].as_py(), int(place[-1]) + 1, int(sums[-1] + weights[-1])
            columns = [*batch.columns, pa.array(place, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = stored(lined.mapInArrow(number, schema), "lined")
    parts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.sum(weight).alias("_s"))
    so_far = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)  # a row for each partition that the group reaches
    offsets = parts.select(
        group, "_part", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(so_far), F.lit(0)).alias("_w0"),
        F.sum("_n").over(whole).alias("total"), F.sum("_s").over(whole).alias("whole"),
    )
    joined = rows.join(stored(offsets, "offsets"), [group, "_part"])
    return joined.select(
        *df.columns, (F.col("_k") + F.col("_n0")).alias("rank"), "total", (F.col("_w") + F.col("_w0")).alias("before"), "whole"
    )

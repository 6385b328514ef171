"""Sums of one large numpy array over all tasks: partial arrays meet chunk by chunk, the whole only where it is used."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 13
_SCHEMA = "chunk int, part binary"


def _emit(chunk: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()])], names=["chunk", "part"])


def summed(df: DataFrame, add: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], size: int, dtype=np.float64) -> np.ndarray:
    """The sum of what ``add`` puts into a zeroed array of ``size`` in each task, on the driver.

    ``size`` must be fixed by the model, not by the data. Tasks are as many as there are cores, so what is shuffled is
    ``size`` for each core; chunks without a value aren't sent.
    """
    kind = np.dtype(dtype).str

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        add(batches, total)
        for a in range(0, size, CHUNK):
            part = total[a : a + CHUNK]
            if part.any():
                yield _emit(a // CHUNK, part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, kind)
                total[chunk] = total[chunk] + part if chunk in total else part
        for chunk, part in total.items():
            yield _emit(chunk, part)

    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    merged = df.coalesce(cores).mapInArrow(partial, _SCHEMA).repartition("chunk").mapInArrow(merge, _SCHEMA)
    out = np.zeros(size, kind)
    for r in merged.toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.part, kind)
    return out

"""Exact removal of repeated passages, with a count-min sketch as prefilter.

A window is ``WINDOW`` consecutive words. Each window is counted through its anchor, the smallest hash among the
half-length grams in it: equal windows have equal anchors, so an anchor's count is never below its windows' counts,
and an anchor occurs about 13 times less often than words do. Partition sketches of the anchors (saturating cells)
are merged cell by cell; what is left of the merged sketch are bits "seen twice or more", of a bounded size, which
are sent to all tasks. A second pass emits only windows whose anchor the sketch calls repeated, and groups those
exactly by 96 hash bits. The sketch errs only by letting single windows through: none that repeats is lost.

Hot windows: an occurrence whose task has seen the same window in a smaller document is settled there and then. Only
the occurrences in the smallest document of each task are grouped over all tasks, so a group has no more rows than
there are tasks, however common its window is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartier.llm.text import Block, blocks, gram_hashes, id_text, mix, utf8

WINDOW = 50
ROWS = 3  # hash rows of the sketch
CELLS_PER_ANCHOR = 1.5
CHARS_PER_ANCHOR = 75
MAX_CELLS = 48 << 20  # per row; beyond it the sketch only lets more single windows through
CHUNK = 1 << 16
HELD = 1 << 19  # occurrences that a task holds to settle them against each other
_SALTS = [0x1F0A, 0x2B71, 0x3C95]


def anchors_of(words: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """For each window start (texts ignored), the smallest gram hash in the window; and the gram size."""
    size = max(1, window // 2)
    low = gram_hashes(words, size)
    span, have = window - size + 1, 1  # grams in a window; reach of ``low`` so far
    while have < span and len(low):
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    return low, size


def window_starts(block: Block, window: int) -> np.ndarray:
    """Whether a window of one text starts at each word."""
    last = np.repeat(block.first[:-1] + block.n_words - window, block.n_words)
    return np.arange(len(block.starts)) <= last


def cells(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((mix(anchors, _SALTS[row]) >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def sketch_width(docs: DataFrame, max_cells: int = MAX_CELLS) -> int:
    """Cells per row, from the number of characters in all texts."""
    chars = docs.select(F.sum(F.length("text"))).first()[0] or 0
    wanted = int(chars / CHARS_PER_ANCHOR * CELLS_PER_ANCHOR)
    return min(max_cells, max(CHUNK, -(-wanted // CHUNK) * CHUNK))


def repeated_bits(docs: DataFrame, window: int, width: int) -> list[np.ndarray]:
    """The merged sketch as one bit per cell: counted in two or more documents."""
    spark = docs.sparkSession

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((ROWS, width), np.uint8)
        for batch in batches:
            for _, _, texts in blocks(batch):
                block = Block(utf8(texts))
                low, _ = anchors_of(block.word_hashes(), window)
                at = np.flatnonzero(window_starts(block, window)[: len(low)])
                low, doc = low[at], block.doc[at]
                new = np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])) if len(at) else np.empty(0, bool)
                low, doc = low[new], doc[new]
                order = np.lexsort((low, doc))
                low, doc = low[order], doc[order]
                if len(low):
                    low = low[np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))]  # once a document
                for row in range(ROWS):
                    at, n = np.unique(cells(low, row, width), return_counts=True)
                    count[row, at] = np.minimum(2, count[row, at] + n)
        packed = count[:, 0::4] | count[:, 1::4] << 2 | count[:, 2::4] << 4 | count[:, 3::4] << 6
        step = CHUNK // 4
        for row in range(ROWS):
            starts = [a for a in range(0, width // 4, step) if packed[row, a : a + step].any()]
            for a in starts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int32()), pa.array([a // step], pa.int32()), pa.array([packed[row, a : a + step].tobytes()])],
                    names=["row", "chunk", "cells"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row, chunk, raw in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(raw, np.uint8)
                have = total.get((row, chunk))
                if have is None:
                    total[row, chunk] = part.copy()
                    continue
                out = np.zeros_like(have)
                for s in (0, 2, 4, 6):
                    out |= np.minimum(2, (have >> s & 3) + (part >> s & 3)) << s
                total[row, chunk] = out
        for (row, chunk), have in total.items():
            twice = np.stack([have >> s & 2 for s in (0, 2, 4, 6)], axis=1).ravel() > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([row], pa.int32()), pa.array([chunk], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()])],
                names=["row", "chunk", "cells"],
            )

    schema = "row int, chunk int, cells binary"
    few = docs.coalesce(max(1, spark.sparkContext.defaultParallelism))  # one sketch for each core, not for each split
    merged = few.mapInArrow(sketch, schema).repartition("row", "chunk").mapInArrow(merge, schema)
    bits = [np.zeros(width // 8, np.uint8) for _ in range(ROWS)]
    for r in merged.toLocalIterator():
        bits[r.row][r.chunk * (CHUNK // 8) : (r.chunk + 1) * (CHUNK // 8)] = np.frombuffer(r.cells, np.uint8)
    return bits


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of runs; ``same`` says whether a position goes on with the run before it."""
    first = np.flatnonzero(~same)
    return first, np.diff(np.append(first, len(same)))


def settle(h1, h2, doc, tag, start) -> pa.RecordBatch:
    """Of one task's occurrences, in order of text: those that are settled, as runs, and those to be judged."""
    order = np.argsort(h1, kind="stable")
    g1, g2, d = h1[order], h2[order], doc[order]
    group = np.append(True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))
    least = np.minimum.reduceat(d, np.flatnonzero(group))
    later = d > least[np.cumsum(group) - 1]
    gone = np.zeros(len(order), bool)
    gone[order[later]] = True
    at = np.flatnonzero(gone)
    goes_on = (doc[at][1:] == doc[at][:-1]) & (tag[at][1:] == tag[at][:-1]) & (start[at][1:] == start[at][:-1] + 1)
    first, size = _runs(np.append(False, goes_on)) if len(at) else (at, at)
    settled = at[first]
    open_ = order[~later]
    goes_on = (h1[open_][1:] == h1[open_][:-1]) & (doc[open_][1:] == doc[open_][:-1]) & (tag[open_][1:] == tag[open_][:-1])
    goes_on &= (h2[open_][1:] == h2[open_][:-1]) & (start[open_][1:] == start[open_][:-1] + 1)  # one word again and again
    first, more = _runs(np.append(False, goes_on)) if len(open_) else (open_, open_)
    rows = np.concatenate((settled, open_[first]))
    sure = np.arange(len(rows)) < len(settled)
    spread = mix(doc[settled].view(np.uint64) ^ start[settled].astype(np.uint64) << np.uint64(40)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(sure), pa.array(np.concatenate((spread, h1[rows[len(settled) :]]))), pa.array(h2[rows]),
            pa.array(doc[rows]), pa.array(tag[rows]), pa.array(start[rows]), pa.array(np.concatenate((size, more)).astype(np.int32)),
        ],
        names=["sure", "h1", "h2", "doc_id", "tag", "start", "n"],
    )


def candidate_windows(docs: DataFrame, window: int, width: int, bits: list[np.ndarray]) -> DataFrame:
    """Windows whose anchor may be repeated: (sure, h1, h2, doc_id, tag, start, n), ``n`` starts from ``start`` on.

    ``sure`` rows are known to repeat an earlier document; the key of such a row only spreads it.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(bits)  # ROWS * MAX_CELLS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = shipped.value, [], 0
        for batch in batches:
            ids = np.array(batch.column("doc_id").fill_null(0))
            known = np.array(batch.column("doc_id").is_valid())
            tags = np.array(batch.column("tag"))
            for a, b, texts in blocks(batch):
                block = Block(utf8(texts))
                words = block.word_hashes()
                low, _ = anchors_of(words, window)
                at = np.flatnonzero(window_starts(block, window)[: len(low)] & known[a:b][block.doc[: len(low)]])
                low = low[at]
                unique, back = np.unique(low, return_inverse=True)
                often = np.ones(len(unique), bool)
                for row in range(ROWS):
                    cell = cells(unique, row, width)
                    often &= (seen[row][cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                at = at[often[back]]
                if len(at):
                    h1 = gram_hashes(words, window, 1)[at].view(np.int64)
                    h2 = (gram_hashes(words, window, 2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    doc = block.doc[at]
                    held.append((h1, h2, ids[a:b][doc], tags[a:b][doc], (at - block.first[doc]).astype(np.int32)))
                    size += len(at)
                if size >= HELD:
                    yield settle(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield settle(*map(np.concatenate, zip(*held)))

    return docs.mapInArrow(run, "sure boolean, h1 long, h2 int, doc_id long, tag int, start int, n int")


def dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True, max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``texts``) kept text for each document.

    A word goes if a window over it also starts in a document with a smaller doc_id, judged on the input. Null text
    has no words; texts below ``window`` words lose nothing; rows with a null doc_id lose nothing and take nothing
    from others; rows that repeat a doc_id are judged each by its own text, and none is smaller than the other. An
    empty table gives no rows; other columns are not read.
    """
    base = id_text(docs, F.hash("text").alias("tag"))
    width = sketch_width(base, max_cells)
    found = candidate_windows(base, window, width, repeated_bits(base, window, width))
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2", "sure"))
    hits = found.withColumn("first", least).where("sure OR doc_id > first")
    hits = hits.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("starts"))  # at most its words
    joined = base.join(hits, ["doc_id", "tag"], "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts")):
                words = text.encode().split() if text else []
                gone = 0
                if starts.is_valid:
                    at, n = (np.asarray(starts.values.field(k)) for k in (0, 1))
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n - 1 + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                kept = b" ".join(words)
                rows.append((len(words) + gone, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.string()), *([pa.array(columns[3], pa.string())] if texts else []),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else ""))

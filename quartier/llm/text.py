"""Whole texts as numpy blocks: word bounds and hashes for many documents at once, inside a task.

A block is the UTF-8 of several texts with a line break around each, so that one pass over the bytes
finds the words of all. Words are maximal runs without ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))

_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 2**64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        _POWERS[base] = have = out
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finish that spreads every input bit over all output bits."""
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """The words of some texts: byte bounds, owner and the first word of each text."""

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        raw = b"\n" + b"\n".join(texts) + b"\n"
        self.raw = raw
        self.buf = np.frombuffer(raw, np.uint8)
        space = SPACE[self.buf]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_start = 1 + np.concatenate(([0], np.cumsum(lengths + 1)))
        self.first = np.searchsorted(self.starts, self.doc_start)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, by differences of one running sum over the block."""
        n = len(self.buf)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUE[self.buf] * powers(_ODD, n), out=total[1:])
        back = powers(_ODD_INVERSE, n)
        return mix((total[self.ends] - total[self.starts]) * back[self.starts])

    def words(self) -> list[bytes]:
        return self.raw.split()


def gram_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes (runs may cross texts)."""
    n = len(words)
    if n < size:
        return np.empty(0, np.uint64)
    base = (_ODD + 2 * salt * 0x632BE59BD9B4E019) % 2**64
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((mix(words, salt) if salt else words) * powers(base, n), out=total[1:])
    back = powers(pow(base, -1, 2**64), n - size + 1)
    return mix((total[size:] - total[:-size]) * back)


def utf8(texts: list) -> list[bytes]:
    """Null counts as empty; lone surrogates cannot come from a Spark string."""
    return [t.encode() if t else b"" for t in texts]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list]]:
    """Row ranges whose texts hold about ``limit`` bytes, with the texts; a longer text has a range of its own."""
    texts = batch.column(column)
    sizes = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64) + 1
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i, texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts), texts.slice(start).to_pylist()


def id_text(docs, *more):
    """The two columns that operators read, under fixed names; other columns never clash."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)

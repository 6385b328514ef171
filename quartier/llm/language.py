"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams by language are summed over all tasks (the matrix has a fixed number of buckets),
turned into log probabilities and sent to every task; texts are scored in blocks by sparse sums of matrix rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.llm.sums import summed
from quartier.llm.text import blocks

BUCKET_BITS = 16
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 512  # the matrix holds a column for each
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: hashed bucket and owner of every n-gram within one line of one text."""
    lowered = [t.lower() if t else "" for t in texts]
    chars = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    wide = chars.astype(np.uint64) + np.uint64(1)
    line = np.cumsum(chars == 10)
    code = np.zeros(len(chars), np.uint64)
    for size in range(1, max(GRAMS) + 1):
        n = len(chars) - size + 1
        if n <= 0:
            return
        code = code[:n] * _BASE + wide[size - 1 :]
        if size in GRAMS:
            inside = (line[:n] == line[size - 1 :]) & (chars[:n] != 10)
            hashed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * size)
            yield (hashed[inside] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owner[:n][inside]


def languages(docs: DataFrame, learn: Column) -> list[str]:
    found = docs.where(learn & F.col("lang").isNotNull()).select("lang").distinct().limit(MAX_LANGUAGES + 1).toArrow()
    names = sorted(found.column(0).to_pylist())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return names


def fit(docs: DataFrame, learn: Column) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (buckets by languages) with the log priors as a last row."""
    names = languages(docs, learn)
    number = {name: k for k, name in enumerate(names)}
    buckets, n = 1 << BUCKET_BITS, len(names)
    if not n:
        return names, np.zeros((buckets + 1, 0))
    rows = docs.where(learn & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), "lang")

    def add(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        counts = total.reshape(buckets + 1, n)
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            counts[buckets] += np.bincount(langs, minlength=n)
            for a, b, texts in blocks(batch):
                for bucket, owner in gram_buckets(texts):
                    counts[:buckets] += np.bincount(bucket * n + langs[a:b][owner], minlength=buckets * n).reshape(buckets, n)

    counts = summed(rows, add, (buckets + 1) * n, np.int64).reshape(buckets + 1, n)
    grams = counts[:buckets] + SMOOTHING
    return names, np.vstack((np.log(grams / grams.sum(0)), np.log((counts[buckets] + SMOOTHING) / (counts[buckets] + SMOOTHING).sum())))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, ``more`` columns, lang_pred and score (probability of that language) for every row.

    A null text, or one without letters, is ``und`` with score 0, as is every text if no language was learned. Equal
    scores go to the language that sorts first. Rows with repeated or null ids keep a row each; an empty table gives
    none; other columns are not read.
    """
    names, table = model
    shipped = docs.sparkSession.sparkContext.broadcast(table)  # 2**16 rows, MAX_LANGUAGES columns at most
    more = more or {}
    kept_names = ["doc_id", *more]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in more.items()], F.col("text").cast("string").alias("text"))
    limit = max(1 << 14, (1 << 21) * 4 // max(4, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shipped.value
        for batch in batches:
            for a, b, texts in blocks(batch, limit=limit):
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if names:
                    total = np.tile(logs[-1], (len(texts), 1))
                    for bucket, owner in gram_buckets(texts):
                        if len(bucket):
                            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                            total[owner[first]] += np.add.reduceat(logs[bucket], first)
                    total -= total.max(1, keepdims=True)
                    shares = np.exp(total) / np.exp(total).sum(1, keepdims=True)
                    for k, (text, j) in enumerate(zip(texts, shares.argmax(1).tolist())):
                        if text and any(map(str.isalpha, text)):
                            best[k], score[k] = names[j], shares[k, j]
                kept = [batch.column(c).slice(a, b - a) for c in kept_names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(best), pa.array(score)], names=[*kept_names, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept_names) + ", lang_pred string, score double"
    return base.mapInArrow(run, schema)

"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network.

Every word bucket has a sparse random index vector. A word's vector is the sum of the index vectors of its neighbours
over all documents, gathered by all tasks into one matrix of fixed size. A document's features are the means of its
words' vectors and of its words' shape vectors (case, digits, punctuation, length, and whether the word was seen
before in the document). A two-layer network is fitted on a bounded sample of labelled documents, and its logit is
divided by the temperature that fits a part kept aside best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.llm.sums import summed
from quartier.llm.text import SPACE, Block, blocks, mix, utf8

BUCKET_BITS = 15
SIZE = 64
SPARSE = 4  # nonzero components of an index vector
REACH = 2
SHAPES = 64
HIDDEN = 32
MAX_LABELLED = 20_000  # labelled documents that the network is fitted on, those with the smallest hash of their id
THRESHOLD = 0.7
_RANDOM_STATE = 7


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero components, by bucket."""
    rng = np.random.default_rng(_RANDOM_STATE)
    at = rng.random((1 << BUCKET_BITS, SIZE)).argpartition(SPARSE, axis=1)[:, :SPARSE]
    return at.astype(np.int64), rng.choice([-1.0, 1.0], (1 << BUCKET_BITS, SPARSE))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_buckets(block: Block) -> np.ndarray:
    return bucket_of(block.word_hashes())


def context_sums(docs: DataFrame) -> np.ndarray:
    """Sums of neighbours' index vectors by word bucket over all texts, and how often each bucket occurs."""
    n = 1 << BUCKET_BITS

    def add(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        at, sign = index_vectors()  # made in the task: arrays that were shipped take numpy's slow path in add.at
        sums, seen = total[: n * SIZE], total[n * SIZE :]
        for batch in batches:
            for _, _, texts in blocks(batch):
                block = Block(utf8(texts))
                bucket = word_buckets(block)
                seen += np.bincount(bucket, minlength=n)
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(block.doc[step:] == block.doc[:-step])
                    left, right = bucket[near], bucket[near + step]
                    for a, b in ((left, right), (right, left)):
                        np.add.at(sums, (a[:, None] * SIZE + at[b]).ravel(), sign[b].ravel())

    return summed(docs.select(F.col("text").cast("string").alias("text")), add, n * (SIZE + 1))


def word_vectors(total: np.ndarray) -> np.ndarray:
    """Unit context vector plus index vector of each bucket, frequent buckets weighing less."""
    n = 1 << BUCKET_BITS
    context, seen = total[: n * SIZE].reshape(n, SIZE), total[n * SIZE :]
    at, sign = index_vectors()
    own = np.zeros((n, SIZE))
    np.put_along_axis(own, at, sign / np.sqrt(SPARSE), axis=1)
    context = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    share = seen / max(1.0, seen.sum())
    return ((context + own) * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


# What a byte tells of a word's shape: upper case, lower case or above ASCII, digit, punctuation; blanks tell nothing.
_KIND = np.array([0 if SPACE[b] else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b > 127 else 4 if 48 <= b <= 57 else 8 for b in range(256)], np.uint8)


def shapes(block: Block, hashes: np.ndarray) -> np.ndarray:
    """A small number for each word: which kinds of bytes it has, whether it is long, whether its text had it before."""
    if not len(block.starts):
        return np.empty(0, np.int64)
    code = np.bitwise_or.reduceat(_KIND[block.buf], block.starts).astype(np.int64)
    code |= (block.ends - block.starts > 8).astype(np.int64) << 4
    key = mix(hashes ^ block.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(code), np.int64)
    again[order[1:][key[order[1:]] == key[order[:-1]]]] = 1
    return code | again << 5


def pooled(texts: list, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean word vector, shares of shapes, log length. Texts without words have zeros."""
    block = Block(utf8(texts))
    out = np.zeros((len(texts), SIZE + SHAPES + 1), np.float32)
    full = np.flatnonzero(block.n_words)
    if len(full):
        n = block.n_words[full][:, None]
        hashes, first = block.word_hashes(), block.first[full]
        bucket = bucket_of(hashes)
        for k, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(bucket)])):
            total = np.zeros(SIZE)
            for s in range(a, b, 1 << 12):  # long texts in parts
                part = vectors[bucket[s : min(b, s + (1 << 12))]]
                total += np.ones(len(part), np.float32) @ part
            out[full[k], :SIZE] = total
        out[full, :SIZE] /= n
        counts = np.bincount(block.doc * SHAPES + shapes(block, hashes), minlength=len(texts) * SHAPES).reshape(-1, SHAPES)
        out[full, SIZE : SIZE + SHAPES] = counts[full] / n
        out[:, -1] = np.log1p(block.n_words) / 10
    return out


def labelled_features(docs: DataFrame, labels: DataFrame, learn: Column, vectors, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample; at most ``most`` rows come to the driver."""
    known = labels.where(learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.join(F.broadcast(known), "doc_id")  # bounded by ``most``
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch):
                rows = pa.array(list(pooled(texts, shipped.value)), pa.list_(pa.float32()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), rows], names=["doc_id", "quality", "x"])

    rows = base.mapInArrow(run, "doc_id long, quality int, x array<float>")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), "x").alias("r")).select("doc_id", "r.*")
    table = rows.toArrow().sort_by("doc_id")
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(-1, SIZE + SHAPES + 1)
    return x, table.column("quality").to_numpy().astype(np.float64)


def train(x: np.ndarray, y: np.ndarray, steps: int = 600) -> dict:
    """A tanh layer and a logistic output fitted by Adam, the best of its steps on the rows kept aside, calibrated."""
    if len(np.unique(y)) < 2:
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        width = SIZE + SHAPES + 1
        return {"mean": np.zeros(width), "scale": np.ones(width), "w1": np.zeros((width, 1)), "b1": np.zeros(1), "w2": np.zeros(1), "b2": np.log(p / (1 - p)), "t": 1.0}
    rng = np.random.default_rng(_RANDOM_STATE)
    aside = rng.random(len(y)) < 0.2
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    fit, keep = np.flatnonzero(~aside), np.flatnonzero(aside)
    share = np.clip(y[fit].mean(), 1e-3, 1 - 1e-3)
    weights = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.log(share / (1 - share))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    best, least = [np.copy(w) for w in weights], np.inf

    def logit(rows, w):
        return np.tanh(z[rows] @ w[0] + w[1]) @ w[2] + w[3]

    def loss(rows, w, t=1.0):
        s = logit(rows, w) / t
        return float(np.mean(np.logaddexp(0, s) - y[rows] * s)) if len(rows) else 0.0

    for step in range(1, steps + 1):
        rows = rng.choice(fit, min(512, len(fit)), replace=False)
        hidden = np.tanh(z[rows] @ weights[0] + weights[1])
        gap = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -40, 40))) - y[rows]) / len(rows)
        back = np.outer(gap, weights[2]) * (1 - hidden**2)
        grads = [z[rows].T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ gap + 1e-4 * weights[2], gap.sum()]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if step % 50 == 0 and (now := loss(keep if len(keep) else fit, weights)) < least:
            best, least = [np.copy(w) for w in weights], now
    rows = keep if len(np.unique(y[keep])) == 2 else fit
    t = min(np.geomspace(0.5, 5, 40), key=lambda t: loss(rows, best, t))
    return {"mean": mean, "scale": scale, "w1": best[0], "b1": best[1], "w2": best[2], "b2": best[3], "t": float(t)}


def probability(x: np.ndarray, net: dict) -> np.ndarray:
    z = np.clip((x - net["mean"]) / net["scale"], -8, 8)
    s = (np.tanh(z @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]) / net["t"]
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MAX_LABELLED) -> tuple[np.ndarray, dict]:
    """Word vectors from all texts, and the network from at most ``most`` labelled rows for which ``learn`` holds."""
    vectors = word_vectors(context_sums(docs))
    return vectors, train(*labelled_features(docs, labels, learn, vectors, most))


def score(docs: DataFrame, model: tuple[np.ndarray, dict], more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, ``more`` columns, score (probability of label 1) and predicted (1 from THRESHOLD on) for every row.

    Null and empty texts are scored from zero features. Repeated and null ids keep a row each; an empty table gives
    none; other columns are not read. Without labels of both kinds every score is the labels' mean, or a half.
    """
    more = more or {}
    names = ["doc_id", *more]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in more.items()], F.col("text").cast("string").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shipped.value
        for batch in batches:
            for a, b, texts in blocks(batch):
                p = probability(pooled(texts, vectors), net)
                kept = [batch.column(c).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    return base.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", score double, predicted int")


def accepted(docs: DataFrame, model: tuple[np.ndarray, dict]) -> DataFrame:
    """The rows and columns of ``docs`` that are predicted to be of quality; rows are judged one by one."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shipped.value
        for batch in batches:
            for a, b, texts in blocks(batch):
                keep = probability(pooled(texts, vectors), net) >= THRESHOLD
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (alternating between the sign code and the rotation that fits it) turns vectors
into 64-bit codes. Each shard of the vectors keeps its codes in one index for each 8-bit substring. By the pigeonhole
principle a code within Hamming radius r of the query's has a substring within r/8 of the query's, so probing those
buckets in every index retrieves every code within the radius; each is then ranked by the inner product of the original
vectors. The radius is calibrated on the sample, so that it holds nearly all true neighbours there; neighbours in the
whole table are nearer than in the sample, and a query that gets too few candidates takes the whole shard.

All vectors are indexed, each in one shard. Queries go to every shard in blocks, and the best of all shards meet in a
top-k for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartier.session import checkpointed

BITS = 64
SUBSTRINGS = 8
WIDTH = BITS // SUBSTRINGS
SAMPLE = 8_192  # vectors that rotation and radius are learned from
PROBES = 256  # sampled queries that the radius is calibrated with
COVER = 0.98  # share of their true neighbours that the radius must hold
SHARD = 16_384  # vectors a shard
QUERY_BLOCK = 8_192  # queries that meet a shard at once
DENSE = 0.05  # share of candidates from which a block of products is cheaper than one by one
_DISTANCE = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint16)[:, None] ^ np.arange(1 << WIDTH, dtype=np.uint16))


def usable(vector: Column, size: Column | None = None) -> Column:
    """Whether a vector takes part: not null, not empty, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Coder:
    """Mean, rotation and radius, learned from sampled vectors."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        x = sample - self.mean
        width = x.shape[1]
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        # beyond the vectors' own directions further bits are random combinations of them
        basis = np.zeros((width, BITS))
        have = min(len(axes), BITS)
        basis[:, :have] = axes[:have].T
        if have < BITS:
            basis[:, have:] = axes.T @ rng.normal(size=(len(axes), BITS - have)) / np.sqrt(len(axes))
        v = x @ basis
        turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(25):
            signs = np.where(v @ turn > 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(signs.T @ v)
            turn = (a @ b).T
        self.turn = basis @ turn
        codes = self.codes(sample)
        probes = rng.permutation(len(sample))[:PROBES]
        products = sample[probes] @ sample.T
        products[np.arange(len(probes)), probes] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            self.radius = BITS
            return
        true = np.argpartition(-products, k - 1, axis=1)[:, :k]
        distance = np.bitwise_count(codes[probes][:, None] ^ codes[true])
        self.radius = int(np.quantile(distance, COVER, method="higher"))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.turn > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class MultiIndex:
    """The codes of a shard, sorted once for each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view(np.uint8).reshape(-1, SUBSTRINGS)
        self.order = [np.argsort(self.parts[:, s], kind="stable") for s in range(SUBSTRINGS)]
        self.first = [np.searchsorted(self.parts[o, s], np.arange((1 << WIDTH) + 1)) for s, o in enumerate(self.order)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within ``radius`` of a code, each once: by the first substring that finds it."""
        near = radius // SUBSTRINGS
        own = np.array([code], np.uint64).view(np.uint8)
        found = []
        for s in range(SUBSTRINGS):
            buckets = np.flatnonzero(_DISTANCE[own[s]] <= near)
            a, n = self.first[s][buckets], self.first[s][buckets + 1] - self.first[s][buckets]
            at = self.order[s][np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
            at = at[np.bitwise_count(self.codes[at] ^ code) <= radius]
            for earlier in range(s):
                at = at[_DISTANCE[own[earlier], self.parts[at, earlier]] > near]
            found.append(at)
        return np.concatenate(found)


def nearest(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, index: MultiIndex, askers, queries, codes, radius: int, k: int):
    """For each query the best k of the shard: (query's row, vector's id and row, product) arrays."""
    out = []
    for q in range(len(queries)):
        at = index.within(codes[q], radius)
        at = at[rows[at] != askers[q]]
        if len(at) < k:
            at = np.flatnonzero(rows != askers[q])
        scores = vectors[at] @ queries[q] if len(at) < DENSE * len(ids) else (vectors @ queries[q])[at]
        if len(at) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= least
            at, scores = at[keep], scores[keep]
        best = np.lexsort((rows[at], ids[at], -scores))[:k]
        out.append((np.full(len(best), askers[q]), ids[at[best]], rows[at[best]], scores[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0)]


def search(table: DataFrame, queries: Column, k: int = 20, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for every row for which ``queries`` holds.

    Nearest by inner product in double precision, ties to the smaller vec_id; the query's own row is no candidate.
    Rows with a null id take no part, nor do vectors that are null, empty, zero or hold a null or non-finite component.
    Vectors of each length are searched apart, as they have no product with others. Rows that repeat an id are rows of
    their own, as queries and as candidates. With fewer than ``k`` candidates all are returned. An empty table gives no
    rows; other columns are not read.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    found = None
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"))
    for r in widths.where("asked > 0").orderBy("width").collect():  # a search for each length
        mine = _search(rows.where(F.size("v") == r.width), r.width, r.n, r.asked, k, shard, block)
        found = mine if found is None else found.unionByName(mine)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def _search(rows: DataFrame, width: int, n: int, asked: int, k: int, shard: int, block: int) -> DataFrame:
    """``search`` over ``n`` vectors of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    schema = "asker long, vec_id long, row long, score double"
    shards, blocks_ = max(1, -(-n // shard)), max(1, -(-asked // block))
    shipped = spark.sparkContext.broadcast(Coder(np.array(sample), k))  # of fixed size

    # every vector is in one shard and meets every block of queries there
    side = F.explode(F.sequence(F.lit(0), F.lit(blocks_ - 1)))
    data = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), side.alias("block"), "vec_id", "row", "v")
    side = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asks = rows.where("asks").select(side.alias("shard"), F.pmod(F.hash("row"), F.lit(blocks_)).alias("block"), F.col("row").alias("asker"), "v")

    def meet(left, right):
        coder = shipped.value
        ids, places, vectors = left.column("vec_id").to_numpy(), left.column("row").to_numpy(), _matrix(left.column("v"), width)
        askers, queries = right.column("asker").to_numpy(), _matrix(right.column("v"), width)
        index = MultiIndex(coder.codes(vectors)) if len(ids) else None
        some = len(ids) and len(askers)
        found = nearest(ids, places, vectors, index, askers, queries, coder.codes(queries), coder.radius, k) if some else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(found, kinds)], names=["asker", "vec_id", "row", "score"])

    near = asks.groupBy("shard", "block").cogroup(data.groupBy("shard", "block")).applyInArrow(lambda q, d: meet(d, q), schema)
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("row")
    named = rows.where("asks").select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"))
    return best.join(named, "asker").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    chunks = [c.flatten().to_numpy() for c in column.chunks]
    return np.concatenate(chunks).reshape(-1, width) if chunks else np.empty((0, width))

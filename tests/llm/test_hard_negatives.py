import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartier.llm.hard_negatives import Shard, mine

ROWS = "vec_id long, embedding array<float>, label int, rank string, row int, key string, square string"


def ints(vector, scale=256):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def plain(rows, divisor, k=5, n=10):
    """By the definition, on Python integers; ids must be distinct where ties need them."""
    good = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, ints(v), label))
    place = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, label) in enumerate(good):
        if i is None or i % divisor:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), place(j), lab == label) for b, (j, w, lab) in enumerate(good) if b != a and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2])[:k]:
            inside = sorted(x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:n]
            out += [(i, None if j[0] else j[1], r, None if x[1][0] else x[1][1], -s, -x[0]) for r, x in enumerate(inside, 1)]
    return sorted(out, key=str)


def found(spark, rows, divisor, **kw):
    table = spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in rows], ROWS).repartition(5)
    return sorted([tuple(r) for r in mine(table, F.col("vec_id") % divisor == 0, **kw).collect()], key=str)


def clustered(rng, n, d, spread):
    centres = rng.normal(size=(6, d))
    return (centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, d))) * rng.uniform(0.1, 2.0, (n, 1))


@pytest.mark.parametrize("shard", [7, 8192])
def test_mining_equals_definition(spark, shard):
    rng = np.random.default_rng(shard)
    vectors = clustered(rng, 260, 12, 0.4).astype(np.float32)
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(40)]  # one vector, many times
    rows += [(2000 + i, v, 1) for i, v in enumerate([None, [None] * 12, [math.nan] * 12, [math.inf] + [1.0] * 11])]
    rows += [(2010, [0.0] * 12, 1), (2020, [0.0] * 12, 2), (2021, [0.0] * 12, 1), (2030, [1.0] * 12, None), (None, [0.5] * 12, 2)]
    rows += [(3000 + 10 * i, [1.0, 0.5 * i], i % 2) for i in range(6)] + [(4000, [], 1), (4001, [], 1), (4002, [], 2)]
    want = plain(rows, 10)
    assert found(spark, rows, 10, shard=shard) == want and len(want) > 500


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (0, [0.9, 0.1], 1), (5, [0.5, 0.5], 2), (5, [0.5, 0.5], 2), (7, [0.4, 0.3], 2)]
    assert found(spark, rows, 10) == plain(rows, 10)


def test_integers_beyond_double_precision(spark):
    big = 2.0**17
    rows = [(i, [big + i * 0.0625, -big, big * (i % 3)], i % 2) for i in range(30)] + [(90, [3e38, 0.0, 0.0], 1)]
    want = plain([r for r in rows if r[0] != 90], 10)
    assert found(spark, rows, 10) == want and want


def test_empty_tables_and_no_anchors(spark):
    assert found(spark, [(0, [1.0], 1)], 10) == [] and found(spark, [(1, [1.0], 1), (2, [1.0], 2)], 10) == []
    table = spark.createDataFrame([], ROWS)
    assert mine(table, F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mine(table, F.lit(True)).count() == 0


@pytest.mark.parametrize("spread, most", [(0.05, 0.3), (3.0, 1.0)])
def test_coordinates_lose_no_vector_and_prune(spread, most):
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * clustered(rng, 3000, 32, spread)).astype(np.int64)
    vectors[10:20] = 0
    square = (vectors**2).sum(1)
    n = np.arange(len(vectors))
    shard = Shard(vectors, square, n % 5, n, np.zeros(len(n), bool), n)
    shares = []
    for a in range(0, 3000, 97):
        scores = vectors @ vectors[a]
        for low, high in ((np.sort(scores)[-50], 2**62), (-5, 5), (0.3 * scores.max(), 0.9 * scores.max())):
            kept = shard.candidates(vectors[a], math.sqrt(square[a]), low, high)
            assert np.isin(np.flatnonzero((scores >= low) & (scores <= high)), kept).all() and len(set(kept.tolist())) == len(kept)
            if high == 2**62 and square[a]:
                same_length = Shard(vectors[20:] * 1000 // np.maximum(1, np.sqrt(square[20:]).astype(int))[:, None], np.full(len(n) - 20, 10**6), n[20:], n[20:], np.zeros(len(n) - 20, bool), n[20:])
                shares.append(len(same_length.candidates(vectors[a], math.sqrt(square[a]), 950 * math.sqrt(square[a]), 2**62)) / len(n))
    assert np.mean(shares) <= most

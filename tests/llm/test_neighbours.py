import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartier.llm.neighbours import Coder, MultiIndex, search
from quartier.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<float>, score int, rank string"


def exact(ids, vectors, query_ids, k):
    out = {}
    for q in query_ids:
        mine = vectors[list(ids).index(q)]
        found = sorted((-float(np.dot(vectors[j], mine)), int(i)) for j, i in enumerate(ids) if i != q)[:k]
        out[int(q)] = [i for _, i in found]
    return out


@pytest.mark.parametrize("radius", [0, 3, 9, 26])
def test_index_finds_every_code_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    codes[1000:2000] = codes[:1000] ^ (np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64))
    codes[2000:2500] = codes[0]
    index = MultiIndex(codes)
    for q in (0, 5, 3000):
        found = index.within(codes[q], radius)
        assert sorted(found.tolist()) == np.flatnonzero(np.bitwise_count(codes ^ codes[q]) <= radius).tolist()


def test_odd_vectors_and_few_candidates(spark):
    good = [(i, [math.cos(i), math.sin(i), 0.5]) for i in range(0, 9)] + [(20, [1.0, 0.0, 0.5]), (40, [1.0, 0.0, 0.5])]
    bad = [(60, None), (80, []), (100, [0.0, 0.0, 0.0]), (120, [1.0, None, 0.0]), (140, [float("nan"), 1.0, 1.0]), (160, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (180, [1.0, 2.0])]
    rows = spark.createDataFrame([(*r, 1, "x") for r in good + bad + good[:2]], ROWS).repartition(3)
    usable = good + good[:2]  # repeated rows are rows of their own
    want = []
    for a, (q, mine) in enumerate(usable):
        if q % 20 == 0:
            own = np.array(mine, np.float32).astype(float)
            scored = sorted((-float(np.dot(np.array(v, np.float32).astype(float), own)), i) for b, (i, v) in enumerate(usable) if b != a)
            want += [(q, rank, i) for rank, (_, i) in enumerate(scored[:20], 1)]
    got = search(rows, F.col("vec_id") % 20 == 0, k=20, shard=3, block=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)
    assert search(rows.limit(0), F.lit(True)).count() == 0 and search(rows, F.lit(False)).count() == 0


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=3 if i % 3 else 7).tolist()) for i in range(60)]
    rows = spark.createDataFrame([(*r, 1, "x") for r in vectors], ROWS).repartition(3)
    got = {}
    for r in search(rows, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in (0, 20, 40):
        same = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if len(v) == len(vectors[q][1])]
        ids, table = np.array([i for i, _ in same]), np.array([v for _, v in same])
        assert got[q] == exact(ids, table, [q], 5)[q]


def test_query_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    rows = QUERIES["op7_neighbours"](spark, sf_dir).collect()
    want = exact(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - vectors[list(ids).index(r.query_id)] @ vectors[list(ids).index(r.vec_id)]) < 1e-12
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_recall_on_a_larger_table_with_small_radius():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(50, 64))
    vectors = centres[rng.integers(0, 50, 6000)] + rng.normal(size=(6000, 64)) * 0.15
    coder = Coder(vectors[:3000], 20)
    codes, hits = coder.codes(vectors), []
    index = MultiIndex(codes)
    for q in range(0, 6000, 200):
        products = vectors @ vectors[q]
        true = set(np.argsort(-products)[:20].tolist())
        hits.append(len(true & set(index.within(codes[q], coder.radius).tolist())) / 20)
    assert np.mean(hits) >= 0.9

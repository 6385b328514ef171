import zlib

import numpy as np
from conftest_llm import ODD
from pyspark.sql import functions as F

from quartier.llm.quality import SIZE, accepted, context_sums, fit, index_vectors, pooled, probability, score, train, word_buckets
from quartier.llm.queries import QUERIES
from quartier.llm.text import Block, utf8


def auc(y, s):
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_context_sums_equal_definition(make_docs):
    rows = ODD + [(40, "a b c a d"), (41, "b a")]
    got = context_sums(make_docs(rows))
    at, sign = index_vectors()
    n = len(at)
    want = np.zeros((n, SIZE))
    seen = np.zeros(n)
    for _, t in rows:
        b = word_buckets(Block(utf8([t])))
        for i, x in enumerate(b):
            seen[x] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(b):
                    np.add.at(want[x], at[b[j]], sign[b[j]])
    assert np.allclose(got[: n * SIZE].reshape(n, SIZE), want) and np.allclose(got[n * SIZE :], seen)


def test_odd_rows_and_tables_without_labels(spark, make_docs):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, 1, 0), (None, 1, 0), (5, None, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    docs = make_docs(ODD)
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        got = score(docs, fit(docs, known, F.lit(True))).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    model = fit(make_docs([]), labels, F.lit(True))
    assert score(make_docs([]), model).count() == 0
    assert accepted(docs, model).columns == docs.columns


def test_network_learns_and_pools_repeat(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, SIZE + 65))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    assert auc(y, probability(x, train(x, y))) > 0.85
    vectors = rng.normal(size=(1 << 15, SIZE)).astype(np.float32)
    both = pooled(["a b c", None, "A b c a"], vectors)
    assert np.allclose(both[0], pooled(["a b c"], vectors)[0]) and not both[1].any()


def test_query_held_out_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op5_quality"](spark, sf_dir).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_held_out_accuracy_on_a_larger_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in QUERIES["op5_quality"](spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    y, s = np.array([labels[r.doc_id] for r in held]), np.array([r.score for r in held])
    print("auc", auc(y, s), "kept", (s[y == 1] >= 0.7).mean(), "rejected", (s[y == 0] < 0.7).mean())
    assert auc(y, s) > 0.9
    assert (s[y == 1] >= 0.7).mean() > 0.95 and (s[y == 0] < 0.7).mean() > 0.7


def test_index_vectors_have_four_components():
    at, sign = index_vectors()
    assert at.shape == sign.shape == (1 << 15, 4)
    assert all(len(set(row)) == 4 for row in at[:100].tolist())

import math
import zlib
from collections import Counter

import numpy as np
from conftest_llm import ODD
from pyspark.sql import functions as F

from quartier.llm import language
from quartier.llm.language import fit, gram_buckets, predict
from quartier.llm.queries import QUERIES


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS lang_pred").repartition(3)


TRAIN = [(1, "the cat and the dog", "en"), (2, "le chat et le chien\nété", "fr"), (3, "the end", "en"), (4, None, "fr"), (5, "xyz", None)]


def brute(rows, train):
    grams = lambda t: [b for bs, _ in gram_buckets([t]) for b in bs.tolist()]
    names = sorted({x for *_, x in train if x})
    counts = {n: Counter() for n in names}
    docs = Counter(x for *_, x in train if x)
    for _, t, x in train:
        if x:
            counts[x].update(grams(t))
    size = 1 << language.BUCKET_BITS
    out = []
    for i, t in rows:
        if not t or not any(map(str.isalpha, t)):
            out.append((str(i), "und", 0.0))
            continue
        logs = []
        for n in names:
            total = sum(counts[n].values()) + 0.5 * size
            logs.append(math.log((docs[n] + 0.5) / (sum(docs.values()) + 0.5 * len(names))) + sum(math.log((counts[n][g] + 0.5) / total) for g in grams(t)))
        k = int(np.argmax(logs))
        out.append((str(i), names[k], 1 / sum(math.exp(x - logs[k]) for x in logs)))
    return sorted(out)


def test_equals_brute_force_and_odd_rows(spark, make_docs):
    model = fit(labelled(spark, TRAIN), F.lit(True))
    rows = ODD + [(30, "the dog"), (31, "chien été"), (32, "123 !?"), (33, "Ω")]
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in predict(make_docs(rows), model).collect())
    want = brute(rows, TRAIN)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert predict(make_docs([]), model).count() == 0


def test_nothing_learned(spark, make_docs):
    model = fit(labelled(spark, TRAIN), F.lit(False))
    assert {(r.lang_pred, r.score) for r in predict(make_docs(ODD), model).collect()} == {("und", 0.0)}


def test_query_held_out_accuracy(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op6_language"](spark, sf_dir).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)

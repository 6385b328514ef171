"""The pipeline equals its stages' brute-force versions, each judged on its own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quartier.llm import quality, secret_scan  # noqa: E402
from quartier.llm.decontaminate import plain  # noqa: E402
from quartier.llm.folds import held_out  # noqa: E402
from test_secret_scan import brute as secret_brute  # noqa: E402
from test_simhash import brute as simhash_brute  # noqa: E402


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == columns for s in seen[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in seen]

    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(4, 2))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert set(rows[1]) == good

    groups = simhash_brute([(i, r.text) for i, r in rows[1].items()])
    assert {str(i) for i in rows[2]} == {c for _, _, c in groups}

    items = [(" " + plain([r.text])[0].decode() + " ").split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i, r in rows[2].items():
        line = " " + " ".join(plain([r.text])[0].decode().split()) + " "
        if any(" " + " ".join(t) + " " in line for t in items):
            assert i not in rows[3]
    gone = set(rows[2]) - set(rows[3])
    assert len(gone) < 0.2 * len(rows[2])

    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert not secret_brute(r.text) and r.n_chars == len(r.text)
        if not any(secret_scan.Scanner(secret_scan.RULES).spans([rows[3][i].text])[0]):
            assert r.text == rows[3][i].text

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: r.ids for i, r in rows[5].items()} == {i: library.encode(r.text, add_special_tokens=False).ids for i, r in rows[4].items()}

    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == seen[-1].columns
    assert whole.select(F.sum(F.xxhash64("doc_id", "ids", "decoded") % 1000)).first() == seen[-1].select(F.sum(F.xxhash64("doc_id", "ids", "decoded") % 1000)).first()


def test_stages_stand_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0

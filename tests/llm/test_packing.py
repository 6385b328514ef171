import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD
from tokenizers import Tokenizer

from quartier.llm.bpe import load
from quartier.llm.packing import WordEncoder, cutting_plan, first_fit, intervals, knapsack, pack, relaxed
from quartier.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def check(rows, want, limit):
    """``rows``: (doc_id, start, length, ids or None, doc_tokens, sequence_id, offset); ``want``: ids of each document."""
    docs, sequences = {}, {}
    for doc, start, length, ids, n, sequence, offset in rows:
        assert length > 0
        docs.setdefault((doc, n), []).append((start, length, ids))
        sequences.setdefault(sequence, []).append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == limit or (at < limit and at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r[2] for r in rows) == sum(map(len, want))
    tails = [s for s in sequences.values() if sum(x[1] for x in s) < limit]
    assert sum(x[1] for s in tails for x in s) == sum(map(len, want)) % limit
    return docs


@pytest.mark.parametrize("text", [
    "", " \t\n", "Plain words, here's 12 of them!", "a\x1cb !\x1c! \x1f", "É é ﬁ İstanbul ΣΑΣ  x y　z\u0085w", "x ́y <|endoftext|> z<|startoftext|>",
    "中文 と かな ไทย 🙂🙂  ", "w" * 5000, "don't DON'T we'll '' 's", "a​b﻿c⁠",
])
def test_words_give_the_ids_of_the_library(library, text):
    encoder = WordEncoder(load(PATH))
    for texts in ([text], ["again " + text, None, text], [text + " x"]):
        assert [list(map(int, i)) for i in encoder.encode(texts)] == [library(t) for t in texts]


def test_words_are_forgotten_and_learned_again(library, monkeypatch):
    monkeypatch.setattr("quartier.llm.packing.KNOWN_WORDS", 3)
    encoder = WordEncoder(load(PATH))
    texts = ["one two three four", "four five", "", "one six seven eight nine"]
    for _ in range(2):
        for t in texts:
            assert list(encoder.encode([t])[0]) == library(t)
    assert len(encoder.words.keys) <= 5


@pytest.mark.parametrize("seed", range(5))
def test_knapsack_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(2, 9, 4))
    values = rng.normal(0.4, 0.4, len(sizes))
    best = max(sum(v * t for v, t in zip(values, times)) for times in itertools.product(range(10), repeat=len(sizes)) if sum(s * t for s, t in zip(sizes, times)) <= 17)
    value, times = knapsack(values, sizes, 17)
    assert value == pytest.approx(max(best, 0)) and times @ sizes <= 17 and times @ values == pytest.approx(value)


def test_columns_reach_the_linear_optimum():
    # Sizes 3, 5, 7 into 15: full patterns 5x3, 3x5, 1x3 + 1x5 + 1x7; a demand they meet without waste.
    patterns, use = relaxed(np.array([3, 5, 7]), np.array([5 * 40 + 9, 3 * 20 + 9, 9.0]), 15, gap=0.0)
    assert use.sum() == pytest.approx(40 + 20 + 9, abs=0.5)
    assert np.allclose(patterns @ use, [209, 69, 9])


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_exactly_the_demand(seed):
    rng = np.random.default_rng(seed)
    demand = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 257), 120, replace=False), rng.integers(1, 5000, 120))}
    plan = cutting_plan(demand, 256)
    held = {s: sum(t * p.get(s, 0) for t, p in plan) for s in demand}
    assert held == demand and all(sum(s * k for s, k in p.items()) <= 256 for _, p in plan)
    least = sum(s * n for s, n in demand.items()) / 256
    assert sum(t for t, _ in plan) <= 1.02 * least + 5 or max(demand) * 2 > 256  # large sizes can't be paired at will
    places = {(s, seq, slot) for s, lo, hi, first, copies, slot0 in intervals(plan) for r in range(lo, min(hi, lo + 50)) for seq, slot in [(first + (r - lo) // copies, slot0 + (r - lo) % copies)]}
    assert len({(seq, slot) for _, seq, slot in places}) == len(places)
    assert cutting_plan({}, 256) == [] and first_fit(np.array([4]), np.array([3]), 9)[0].tolist() == [2]


@pytest.mark.parametrize("limit", [8, 64, 4096])
def test_pieces_cover_texts_and_fill_sequences(spark, make_docs, library, limit):
    rng = np.random.default_rng(limit)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = ODD + [(100 + i, " ".join(rng.choice(words, int(rng.integers(0, 200))))) for i in range(150)] + [(700 + i, "same") for i in range(200)]
    want = sorted([*library(t), 2] for _, t in rows)
    pieces = [tuple(r) for r in pack(make_docs(rows), PATH, 2, limit).collect()]
    docs = check(pieces, want, limit)
    ids = {i: sorted([*library(t), 2] for j, t in rows if j == i) for i, _ in rows}
    for (doc, n), parts in docs.items():
        if len(ids[doc]) == 1:  # ids that repeat can't be told apart here
            at, got = 0, []
            for start, length, raw in sorted(parts):
                assert start == at and len(raw) == 4 * length
                at, got = at + length, got + np.frombuffer(raw, "<u4").tolist()
            assert got == ids[doc][0] and n == len(got)


def test_empty_table(spark, make_docs):
    empty = pack(make_docs(ODD).limit(0), PATH, 2)
    assert empty.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and empty.count() == 0


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = {i: [*library(t), 2] for i, t in texts.items()}
    rows = [tuple(r) for r in QUERIES["op12_packing"](spark, sf_dir).collect()]
    check(rows, list(ids.values()), 4096)
    for doc, start, length, crc, n, _, _ in rows:
        assert n == len(ids[doc]) and crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from quartier.llm import language_model as lm
from quartier.llm.queries import QUERIES
from quartier.llm.text import LOWER


def words(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


def brute(rows, learn):
    count = Counter(w for (i, t), k in zip(rows, learn) if k for w in words(t))
    n, v = sum(count.values()), len(count)
    return [
        (str(i), len(words(t)), sum(count[w] > 0 for w in words(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)))
        for i, t in rows
    ]


def same(got, want):
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    want = sorted(want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9)


@pytest.mark.parametrize("share", [lm.HOT_SHARE, 1 / 20])
def test_base_equals_brute_force(make_docs, monkeypatch, share):
    monkeypatch.setattr(lm, "HOT_SHARE", share)
    rows = ODD + [(60 + k, f"the cat w{k} sat on The mat w{k % 3}") for k in range(40)]
    learned = [(F.col("doc_id") < 75, lambda i: i is not None and i < 75), (F.lit(False), lambda i: False), (F.lit(True), lambda i: True)]
    for learn, rule in learned:
        got = lm.score(make_docs(rows), learn).collect()
        same(got, brute(rows, [rule(i) for i, _ in rows]))
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(make_docs([]), F.lit(True)).count() == 0


def test_model_is_a_distribution(make_docs):
    """After any history the classes, and within them all known words and one unknown a class, add up to one."""
    rows = [(k, f"a b c{k % 7} a b") for k in range(50)]
    docs = make_docs(rows)
    counts = lm.count_tokens(docs, F.lit(True))
    classes = lm.Classes(counts)
    weights = lm.fit(docs, F.lit(True), classes)
    h, spelled, owner = lm.tokens([t for _, t in rows])
    shares = lm.class_shares(weights, classes.bias, lm.features(h, owner))
    assert np.allclose(shares.sum(1), 1, atol=1e-5)
    unique, first, c = np.unique(h, return_index=True, return_counts=True)
    of = classes.of(unique, spelled[first])
    inside = np.bincount(of, (c + 1) / classes.mass[of], lm.CLASSES)
    inside[lm.OWN :] += 1 / classes.mass[lm.OWN :]
    assert np.allclose(inside[classes.mass > 0], 1)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op2_lm_score"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    same(got, brute([(r.doc_id, r.text) for r in docs], [zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in docs]))


def test_model_beats_counts_on_held_out_text(spark):
    held = [r for r in QUERIES["op2_lm_score"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("gain a token", gain)
    assert gain > 0


def learned(make_docs, monkeypatch, rows):
    monkeypatch.setattr(lm, "LEAF_TOKENS", 1)
    docs = make_docs(rows)
    counts = lm.count_tokens(docs, F.lit(True))
    classes = lm.Classes(counts)
    paths = lm.Paths(counts, classes)
    return counts, classes, paths, *lm.fit_both(docs, F.lit(True), classes, paths)


def test_history_reaches_the_word_within_its_class(make_docs, monkeypatch):
    """Two words of one class, each after a word of its own, had the same share after any history before."""
    filler = [f"w{k}" for k in range(600)]
    pair = next((a, b) for a in filler for b in filler if a < b and lm.shared_class(lm.tokens([a])[1][:1]) == lm.shared_class(lm.tokens([b])[1][:1]))
    common = [f"c{k}" for k in range(lm.OWN)] * 25  # these have the classes of their own
    rows = [(k, " ".join([*filler[k % 60 :: 60], *common, *(f"left {pair[0]} right {pair[1]}".split() * 20)])) for k in range(120)]
    _, classes, paths, _, inner = learned(make_docs, monkeypatch, rows)
    assert paths.levels >= 1

    def share(before, word):
        h, spelled, owner = lm.tokens([f"{before} {word}"])
        leaf = lm.leaf_of(h[1:2], classes.of(h, spelled)[1:2], paths.levels)
        return lm.path_shares(inner, paths, lm.history(h, owner)[:, 1:2], leaf)[0]

    a, b = pair
    assert share("left", a) > 2 * share("right", a) and share("right", b) > 2 * share("left", b)


def test_score_equals_a_plain_walk(make_docs, monkeypatch):
    """Class and path are distributions, words of a leaf share by count + 1, and the score is their product."""
    rows = [(k, " ".join(f"w{(k * j) % 97} the" for j in range(9))) for k in range(80)]
    counts, classes, paths, weights, inner = learned(make_docs, monkeypatch, rows)
    h, spelled, owner = lm.tokens([t for _, t in rows])
    codes, target = lm.history(h, owner), classes.of(h, spelled)
    unique, first, c = np.unique(h, return_index=True, return_counts=True)
    shared = target[first] >= lm.OWN
    leaf = lm.leaf_of(unique[shared], target[first][shared], paths.levels)
    assert paths.levels >= 1 and np.allclose(np.bincount(leaf, c[shared] + 1, len(paths.mass)) + 1, paths.mass)
    monkeypatch.setattr(lm, "fit_both", lambda *_: (weights, inner))
    got = {r.doc_id: r.score for r in lm.score(make_docs(rows), F.lit(True)).collect()}
    tops = lm.class_shares(weights, classes.bias, lm.class_rows(codes))
    count = dict(zip(unique.tolist(), c.tolist()))
    for k in (0, 3, 79):
        want = 0.0
        for i in np.flatnonzero(owner == k):
            p = tops[i, target[i]] * (count[int(h[i])] + 1)
            if target[i] < lm.OWN:
                want += math.log10(p / classes.mass[target[i]])
                continue
            at = lm.leaf_of(h[i : i + 1], target[i : i + 1], paths.levels)
            for place, branch in zip(*(x[0] for x in paths.places(at))):
                rows_here = paths.rows(codes[:, i : i + 1], np.array([[place]]))[:, 0, 0]
                s = np.exp(paths.bias[place] + inner[rows_here].sum(0))
                p *= s[branch] / s.sum()
            want += math.log10(p / paths.mass[at[0]])
        assert got[k] == pytest.approx(want, rel=1e-4)


def test_steps_on_repeated_rows_stay_bounded():
    """Steps on rows that repeat stay bounded, and rows not used keep their weights."""
    state = lm._fresh(np.zeros((4, 8), np.float32))
    gap = np.tile(np.array([-1, 1, 0, 0, 0, 0, 0, 0], np.float32), (400, 1))
    lm._adagrad(*state, np.zeros((1, 400), np.int64), gap)
    assert 0 < state[0][0, 0] < 2.01 * lm.RATE and not state[0][1:].any() and not state[2].any()

import hashlib
import random

import numpy as np
import pytest
from conftest_llm import ODD
from oracle import compare, connect

from quartier.llm.queries import ORACLE, QUERIES
from quartier.llm.substring_dedup import anchors_of, dedup
from quartier.llm.text import Block, gram_hashes


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(got):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())


@pytest.mark.parametrize("cells", [1 << 16, 48 << 20])
def test_equals_brute_force(make_docs, cells):
    rng = random.Random(3)
    passage = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (5, 6, 9, 14)]
    rows = [(i, "  ".join(rng.choice([*passage, *"abcdefgh"]) for _ in range(rng.randrange(25)))) for i in range(120)]
    rows += [(i, passage[3] + "\n" + passage[2]) for i in range(200, 260)] + ODD
    for window in (6, 7):
        assert rows_of(dedup(make_docs(rows), window, max_cells=cells)) == brute(rows, window)


def test_empty_table_and_kept_text(make_docs):
    assert dedup(make_docs([])).count() == 0
    got = {r.doc_id: r.kept for r in dedup(make_docs([(1, "a b c d"), (2, "x a b c d y"), (3, "x  a")]), 3).collect()}
    assert got == {1: "a b c d", 2: "x y", 3: "x a"}


def test_anchor_belongs_to_its_window():
    words = Block([b"a b c d e f g h i j k l m n o p q r s t a b c d e f g h"]).word_hashes()
    low, size = anchors_of(words, 8)
    grams = gram_hashes(words, size)
    assert low.tolist() == [grams[i : i + 8 - size + 1].min() for i in range(len(words) - 7)]
    assert len(np.unique(gram_hashes(words, 8))) == len(words) - 7 - 1


def test_query_equals_sql(spark, sf_dir):
    assert compare(QUERIES["op8_substring_dedup"](spark, sf_dir), ORACLE["op8_substring_dedup"], connect(sf_dir)) is None

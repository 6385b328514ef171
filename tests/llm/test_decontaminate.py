import random
import tracemalloc

import numpy as np
import pytest
from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from quartier.llm.decontaminate import contaminated, plain, tile, without_contaminated
from quartier.llm.queries import QUERIES
from quartier.llm.text import mix


def plain_tiles(text, item, least):
    """Greedy tiling by definition: the longest unmarked common run first, ties to the smallest item and text start."""
    used_t, used_i, out = set(), set(), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(text)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in used_t and j + n not in used_i:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        used_t |= set(range(best[0], best[0] + best[2]))
        used_i |= set(range(best[1], best[1] + best[2]))


def hashed(words):
    return mix(np.array([hash(w) & (2**63 - 1) for w in words], np.uint64))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=24), st.integers(2, 4))
def test_tiles_equal_definition(text, item, least):
    assert tile(hashed(text), hashed(item), least) == plain_tiles(text, item, least)


@pytest.mark.parametrize("letters", ["ab", "abcde"])
def test_tiles_of_copied_passages_equal_definition(letters):
    rng = random.Random(7)
    for _ in range(150):
        item = [rng.choice(letters) for _ in range(rng.randrange(5, 60))]
        text = [rng.choice(letters) for _ in range(rng.randrange(0, 20))]
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(item))
            text += item[k : k + rng.randrange(3, 40)] + [rng.choice(letters)] * rng.randrange(0, 3)
        assert tile(hashed(text), hashed(item), 5) == plain_tiles(text, item, 5)


@pytest.mark.parametrize("phrase", [["so"], ["so", "on"], ["and", "so", "on"]])
def test_a_million_repeated_words_need_little_memory(phrase):
    text, item = np.tile(hashed(phrase), 1_000_000 // len(phrase)), np.tile(hashed(phrase), 402 // len(phrase))
    other = np.concatenate([item[:150], hashed(["x"]), item[:100], hashed(["y"]), item[:7]])
    tracemalloc.start()
    tiles, more = tile(text, item), tile(text, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(0, 0, len(item))] and sum(t[2] for t in more) == len(other) - 2
    assert peak < 400_000_000


def brute(docs, items):
    out = []
    for d, text in docs:
        for i, item in items:
            a, b = (x[0].split() for x in (plain([text]), plain([item])))
            if len(b) >= 5 and sum(t[2] for t in plain_tiles(a, b, 5)) >= 0.8 * len(b) - 1e-9:
                out.append((str(d), str(i)))
    return sorted(out)


def test_reordered_passages_odd_rows_and_blocks(spark, make_docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.randrange(10, 24)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "too short item"), (0, items[0][1]), (None, items[1][1]), (53, "long " * 9), (54, "é É ß x y")]
    docs = []
    for k, (_, text) in enumerate(items[:12]):
        w = text.split()
        half = len(w) // 2
        docs.append((100 + k, " ".join([word(), *w[half:], word(), *w[:half], word()]).upper()))  # both halves, swapped
        docs.append((200 + k, " ".join(w[: int(len(w) * 0.7)])))
        docs.append((300 + k, "x " + ", ".join(w) + "! " + " ".join(word() for _ in range(30))))
    docs += [(400, " ".join(word() for _ in range(200))), (401, "É, é; ß (X) Y")] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS coverage")
    want = brute(docs, items)
    assert {str(100 + k) for k in range(12)} <= {d for d, _ in want} and "400" not in {d for d, _ in want}
    for chars in (60, 8_000_000):
        got = contaminated(make_docs(docs), bench, block_chars=chars).collect()
        assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == want
    kept = without_contaminated(make_docs(docs), bench)
    assert kept.columns == make_docs(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if str(d) not in {w for w, _ in want})
    assert contaminated(make_docs([]), bench).count() == 0 and contaminated(make_docs(docs), bench.limit(0)).count() == 0
    assert without_contaminated(make_docs(docs), bench.limit(0)).count() == len(docs)


def test_query_finds_whole_passages(spark, sf_dir):
    docs = [(r.doc_id, plain([r.text])[0].split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, plain([r.text])[0].split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.coverage for r in QUERIES["op10_decontamination"](spark, sf_dir).collect()}
    for d, w in docs:
        line = b" " + b" ".join(w) + b" "
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, v in items:
            if b" " + b" ".join(v) + b" " in line:
                assert got[d, i] == 1
            elif (d, i) in got:
                assert sum(tuple(v[k : k + 5]) in grams for k in range(len(v) - 4)) >= len(v) * 0.8 / 5


def test_short_items_and_scripts_without_blanks(spark, make_docs):
    docs = make_docs([
        (1, "we saw The blue whale, the blue whale today"), (2, "the blue fish"), (3, "他说今天天气很好我们去公园散步吧然后回家"),
        (4, "whale"), (5, "the blue"),
    ])
    items = spark.createDataFrame([(10, "the blue whale"), (11, "今天天气很好我们去公园散步"), (12, "Whale!"), (13, "the blue whale")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.tiles[0].doc_start) for r in contaminated(docs, items).collect()}
    assert got == {(1, 10): (1.0, 1, 2), (1, 12): (1.0, 1, 4), (1, 13): (1.0, 1, 2), (3, 11): (1.0, 1, 2), (4, 12): (1.0, 1, 0)}

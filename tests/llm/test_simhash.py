import random

import numpy as np
import pytest
import xxhash
from conftest_llm import ODD

from quartier.llm import simhash
from quartier.llm.components import components
from quartier.llm.queries import QUERIES
from quartier.llm.simhash import Union, grow, half, link_shard, near_duplicates, one_of_each, place


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def brute(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    union = Union(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                union.join(a, b)
    roots = [union.root(k) for k in range(len(rows))]
    least = {}
    for r, (i, _) in zip(roots, prints):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((str(i), f"{p:016x}", str(least.get(r))) for r, (i, p) in zip(roots, prints))


def near_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(120)]
        for k in range(rng.randrange(1, 7)):
            copy = list(base)
            if k:
                copy[rng.randrange(120)] = word()
            rows.append((100 * g + k, (" " if k % 2 else "\n").join(copy)))
    return rows


def test_equals_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 4)
    monkeypatch.setattr(simhash, "LEAF", 3)
    rows = near_rows() + ODD
    got = near_duplicates(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute(rows)
    assert near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("crowd", [False, True])
def test_trees_lose_no_link(crowd):
    rng = np.random.default_rng(1)
    n = 3000
    prints = rng.integers(0, 2**64, n, dtype=np.uint64)
    if crowd:  # one tight crowd around a centre
        flips = rng.integers(0, 64, (n, 4)).astype(np.uint64)
        prints = prints[0] ^ np.bitwise_or.reduce(np.uint64(1) << flips, axis=1)
    else:
        flips = rng.integers(0, 64, (n // 2, 3)).astype(np.uint64)
        prints[: n // 2] = prints[n // 2 :] ^ np.bitwise_xor.reduce(np.uint64(1) << flips, axis=1)
    prints = np.unique(prints)
    got, want = Union(len(prints)), Union(len(prints))
    for side in (0, 1):
        for _, at in place(grow(half(prints[::3], side), 4, 1), half(prints, side), 1):
            link_shard(prints, side, got, at)
    for i, j in np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints) <= 3, 1)).tolist():
        want.join(i, j)
    assert [got.root(i) for i in range(len(prints))] == [want.root(i) for i in range(len(prints))]


def shared_half(n, seed=3):
    """Distinct fingerprints with the same lower half; every second one is a neighbour of the one before."""
    rng = np.random.default_rng(seed)
    upper = rng.integers(0, 2**32, n // 2, dtype=np.uint64)
    near = upper ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 32, (n // 2, 3)).astype(np.uint64), axis=1)
    return np.unique(np.concatenate([upper, near]) << np.uint64(32) | np.uint64(77))


def test_fingerprints_that_share_a_half_are_spread(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 1_000)
    prints = shared_half(50_000)
    rng = np.random.default_rng(4)
    trees = simhash._trees(rng.permutation(prints)[: simhash.SAMPLE], len(prints))
    shards = [at for _, at in place(trees[0], half(prints, 0), 1, prints)]
    assert len(shards) > 8 and max(map(len, shards)) < 0.25 * len(prints)
    together = np.concatenate([prints[at] for at in shards])
    assert set(together.tolist()) == set(prints.tolist())


def test_links_of_a_shared_half_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 40)
    prints = shared_half(3_000)
    want = Union(len(prints))
    for i, j in np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints) <= 3, 1)).tolist():
        want.join(i, j)
    got, place_of = Union(len(prints)), {int(p): i for i, p in enumerate(prints.view(np.int64))}
    table = spark.createDataFrame([(p,) for p in place_of], "fp long")
    for r in simhash.links(table, len(prints)).collect():
        got.join(place_of[r.u], place_of[r.v])
    assert [got.root(i) for i in range(len(prints))] == [want.root(i) for i in range(len(prints))]


def test_components_of_chain_hub_and_ring(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(999, i) for i in range(1000, 1400)] + [(1001, 5), (1399, 4)]
    ring = [(-1, -2), (-2, -3), (-3, -1), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + hub + ring, "u long, v long")).collect()}
    want = {i: 100 for i in range(101, 161)} | {i: 4 for i in [5, *range(999, 1400)]} | {-1: -3, -2: -3}
    assert got == want


def test_one_of_each_keeps_columns_and_one_row_a_component(make_docs):
    rows = near_rows() + ODD + [(None, "no id here at all"), (None, "nor any here"), (None, "no id here at all")]
    rows += [(900, "the same id and text twice"), (900, "the same id and text twice"), (900, "the same id, another text")]
    docs = make_docs(rows)
    got = one_of_each(docs)
    assert got.columns == docs.columns
    want, seen = [], set()
    for i, p, c in brute(rows):  # one row a component, told apart by its smallest fingerprint where it has no id
        if i == c and (i, p) not in seen and (i != "None" or all(q != p for _, q in seen)):
            seen.add((i, p))
            want.append(i)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(want)


def test_one_of_each_stands_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 5, 6), (2, "x y z w v", 7, 8)], "doc_id int, text string, _id int, _fp_ int")
    got = sorted(tuple(r) for r in one_of_each(docs).collect())
    assert got == [(1, "a b c d", 5, 6), (2, "x y z w v", 7, 8)]


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op4_simhash"](spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute(rows)

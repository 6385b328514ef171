import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quartier.llm import merkle, ranks
from quartier.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, total int, g string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = (row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1])
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def halves(nodes):
    while len(nodes) > 1:
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0]


def proof_of(nodes, i):
    out = []
    while len(nodes) > 1:
        out += nodes[i ^ 1 : (i ^ 1) + 1]
        nodes, i = [sha(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)], i // 2
    return out


def plain(rows, hit):
    """Every column by its definition; the altered roots from whole trees grown anew."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    leaves = {v: [x[2] for x in sorted(by[v], key=lambda x: x[:3])] for v in langs}
    subroots = [halves(leaves[v]) for v in langs]
    root, out = halves(subroots), []
    for k, v in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[v], key=lambda x: x[:3])):
            changed = list(leaves[v])
            changed[i] = leaf_of(r, 1) if hit(r[0]) else leaf
            folded = halves([*subroots[:k], halves(changed), *subroots[k + 1 :]])
            out.append((r[0], i, leaf, subroots[k], root, "".join(proof_of(leaves[v], i) + proof_of(subroots, k)), folded))
    return sorted(out, key=str)


def rows_for(n, langs):
    rows = [(i * 3 % 101 if i % 11 else None, None if i % 7 == 0 else f"text {i} é" * (i % 3), langs[i * i % len(langs)], "s" if i % 2 else None, i if i % 5 else None) for i in range(n)]
    return rows + rows[: n // 4]


@pytest.mark.parametrize("n, langs, block", [(1, ["en"], 2), (9, ["en"], 2), (70, ["en", None, "", "é", "de"], 4), (90, ["x", "x", "y"], 8), (60, [str(i) for i in range(25)], 4)])
def test_manifest_equals_definition(spark, n, langs, block):
    rows = rows_for(n, langs)
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], COLUMNS).repartition(3)
    got = merkle.manifest(docs, F.col("doc_id") % 2 == 0, {"n_chars": F.col("n_chars") + 1}, block)
    want = plain(rows, lambda i: i is not None and i % 2 == 0)
    assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_odd_rows_and_empty_table(spark, make_docs):
    from conftest_llm import ODD

    docs = make_docs(ODD)
    got = merkle.manifest(docs).collect()
    assert len(got) == len(ODD) and all(r.folded_root == r.root for r in got) and len({r.root for r in got}) == 1
    empty = merkle.manifest(docs.limit(0))
    assert empty.columns == merkle.manifest(docs).columns and empty.count() == 0


def test_versions_share_what_they_do_not_copy():
    leaves = [sha(str(i)) for i in range(13)]
    tree = merkle.grow(leaves)
    before = [list(level) for level in tree]
    copies = merkle.climb(sha("new"), merkle.steps(tree, 5))
    assert tree == before and len(copies) == len(tree)
    assert copies[-1] == halves([*leaves[:5], sha("new"), *leaves[6:]])


def test_ranks_with_one_hot_group(spark):
    rows = [("hot" if i % 3 else str(i % 7), i * 37 % 500, i, i % 4) for i in range(500)] + [("hot", 1, 1000 + i, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v long, id long, w long").repartition(9)
    got = {r.id: (r.rank, r.total, r.before, r.whole) for r in ranks.ranked(df, "g", ["v", "id"], "w").collect()}
    for g in {r[0] for r in rows}:
        mine, before = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 0
        for k, r in enumerate(mine):
            assert got[r[2]] == (k, len(mine), before, sum(x[3] for x in mine))
            before += r[3]


def test_query_marks_the_altered_documents(spark, sf_dir):
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").collect()}
    rows = QUERIES["op11_merkle"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or docs[r.doc_id] is None) for r in rows)

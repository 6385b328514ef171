"""Merkle manifest of a table: a hash tree a group and one over the groups, with persistent versions.

Leaves are hashed by column expressions and ordered by a range sort. Aligned blocks of ``BLOCK`` leaves are grown into
subtrees, a task each; their tops are the leaves of the next stage, grown alike until a group has one node. A change
of a leaf makes a version of the tree by path copying: inside its block only the ancestors are copied, all other nodes
are shared, and the version goes on along the path of its block through the upper stages.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.llm.ranks import ranked, stored

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
BLOCK = 4096  # a power of two
LEFT, RIGHT = "<", ">"  # the side of a sibling in a path; an empty step has none

_PATHS = "g string, pos long, total long, path array<string>, top string"
_ROWS = "doc_id long, position long, leaf string, subroot string, root string, proof string, folded_root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def grow(leaves: list[str], levels: int | None = None) -> list[list[str]]:
    """All levels of a tree from its leaves up: ``levels`` steps, or until one node is left."""
    tree = [leaves]
    while len(tree) <= levels if levels is not None else len(tree[-1]) > 1:
        below = tree[-1]
        tree.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return tree


def steps(tree: list[list[str]], i: int) -> list[str]:
    """The path of leaf ``i`` to the top: at each level its sibling with its side, or nothing."""
    out = []
    for level in tree[:-1]:
        other = i ^ 1
        out.append((LEFT if other < i else RIGHT) + level[other] if other < len(level) else "")
        i >>= 1
    return out


def climb(node: str, path: list[str]) -> list[str]:
    """The copies of a changed node's ancestors along its path, the topmost last; siblings are shared, not copied."""
    copies = [node]
    for step in path:
        sibling = step[1:]
        copies.append(digest(sibling, copies[-1]) if step[:1] == LEFT else digest(copies[-1], sibling))
    return copies


def siblings(tree: list[list[str]], above: str) -> list[str]:
    """For each leaf its siblings up to the top, end to end, followed by ``above``."""
    tails = [above]
    for level in reversed(tree[:-1]):
        tails = [(level[i ^ 1] if i ^ 1 < len(level) else "") + tails[i >> 1] for i in range(len(level))]
    return tails


def height(total: int, block: int) -> int | None:
    """Levels of a block's subtree: all of them if the group has more blocks, else as many as it takes."""
    return block.bit_length() - 1 if total > block else None


def _paths(nodes: DataFrame, block: int) -> DataFrame:
    """(g, pos, total, path, top) of the nodes (g, pos, total, node): the way to the top of each group's tree.

    ``total`` counts the nodes of a group. Stages of blocks until no group has more nodes than a block.
    """

    def stage(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total = table.column("total")[0].as_py()
        tree = grow(table.column("node").to_pylist(), height(total, block))
        n = table.num_rows
        ways = pa.array([steps(tree, i) for i in range(n)], pa.list_(pa.string()))
        return pa.table([table.column("g"), table.column("pos"), table.column("total"), ways, pa.array([tree[-1][0]] * n)], names=["g", "pos", "total", "path", "top"])

    at = (F.col("pos") / block).cast("long")
    ways = stored(nodes.groupBy("g", at.alias("block")).applyInArrow(stage, _PATHS), "paths")
    if (ways.agg(F.max("total")).first()[0] or 0) <= block:
        return ways
    heads = ways.where(F.col("pos") % block == 0)
    parents = heads.select("g", at.alias("pos"), F.ceil(F.col("total") / block).alias("total"), F.col("top").alias("node"))
    upper = _paths(parents, block).select("g", F.col("pos").alias("block"), F.col("path").alias("more"), F.col("top").alias("end"))
    joined = ways.drop("top").withColumn("block", at).join(upper, ["g", "block"])
    return joined.select("g", "pos", "total", F.concat("path", "more").alias("path"), F.col("end").alias("top"))


def manifest(docs: DataFrame, changed: Column | None = None, change: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, position, leaf, subroot, root, proof, folded_root of every row.

    Leaves (``FIELDS``) of a ``lang`` ascend by doc_id, null first; rows of equal doc_id by leaf. ``position`` counts
    from 0 in the ``lang``. ``proof`` holds the siblings from the leaf to the root, end to end. ``folded_root`` is the root
    of the tree's version in which this row alone has the values ``change`` where ``changed`` holds, else the root.

    Null is a value of its own in each field and for ``lang``; a null doc_id is never changed through a null condition.
    Empty texts are fields of no bytes, texts of any length are hashed whole by the JVM. Repeated rows are leaves
    each; a lone leaf is its subroot, a lone subroot the root. An empty table gives no rows. Other columns aren't read.
    """
    changes = change or {}
    altered = F.when(F.lit(False) if changed is None else changed, leaf([changes.get(c, F.col(c)) for c in FIELDS]))
    nodes = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf([F.col(c) for c in FIELDS]).alias("leaf"), altered.alias("altered"), F.monotonically_increasing_id().alias("row"),
    )
    lined = ranked(stored(nodes, "leaves"), "g", ["doc_id", "leaf", "row"])
    lined = stored(lined.withColumn("block", (F.col("rank") / block).cast("long")), "lined-leaves")

    def tops(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        total = table.column("total")[0].as_py()
        tree = grow(table.column("leaf").to_pylist(), height(total, block))
        return pa.table({
            "g": table.column("g")[:1], "pos": table.column("block")[:1], "total": pa.array([-(-total // block)], pa.int64()), "node": pa.array([tree[-1][0]]),
        })

    narrow = lined.select("g", "block", "rank", "total", "leaf")
    shape = "g string, pos long, total long, node string"
    ways = stored(_paths(narrow.groupBy("g", "block").applyInArrow(tops, shape), block), "block-paths")
    subroots = ways.where("pos = 0").select(F.lit("").alias("all"), F.col("g").alias("lang"), F.col("top").alias("node"))
    over = ranked(subroots, "all", ["lang"]).select(F.col("all").alias("g"), F.col("rank").alias("pos"), "total", "node", "lang")
    over = stored(over, "subroots")
    roots = _paths(over.drop("lang"), block).select("pos", F.col("path").alias("more"), F.col("top").alias("root"))
    roots = over.join(roots, "pos").select(F.col("lang").alias("g"), "more", "root")
    whole = ways.join(roots, "g").select("g", F.col("pos").alias("block"), F.concat("path", "more").alias("path"), F.col("top").alias("subroot"), "root")

    def versions(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("rank")
        total, n = left.column("total")[0].as_py(), left.num_rows
        path, subroot, root = (right.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        tree = grow(left.column("leaf").to_pylist(), height(total, block))
        proofs = siblings(tree, "".join(s[1:] for s in path))
        folded = [root] * n
        for i, node in enumerate(left.column("altered").to_pylist()):
            if node is not None:
                inside = climb(node, steps(tree, i))
                folded[i] = climb(inside[-1], path)[-1]
        fixed = [pa.array([x] * n, pa.string()) for x in (subroot, root)]
        return pa.table(
            [left.column("doc_id"), left.column("rank"), left.column("leaf"), *fixed, pa.array(proofs), pa.array(folded)],
            names=["doc_id", "position", "leaf", "subroot", "root", "proof", "folded_root"],
        )

    mine = lined.select("g", "block", "rank", "total", "doc_id", "leaf", "altered")
    return mine.groupBy("g", "block").cogroup(whole.groupBy("g", "block")).applyInArrow(versions, _ROWS)

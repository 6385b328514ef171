"""SimHash near-duplicates through vantage-point trees.

Fingerprints are cut in two halves: a pair within 3 bits differs by at most 1 bit in one half. One vantage-point
tree a half partitions the distinct fingerprints by Hamming distance of that half to sampled vantage points. By the
triangle inequality a partner of a fingerprint at distance d from the point lies within d-1 .. d+1, so only those on
the inner rim of a ball can have a partner outside; they alone are handed to both branches. Leaves of the top tree
are shards; a heavy one whose halves are too much alike forks into a tree for each quarter of the other half. In a shard
the tree is grown on until its leaves are small or can't be cut, and leaves are compared in full. A leaf returns a star
for each linked set, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartier.llm.components import components
from quartier.llm.text import LOWER, blocks, id_text
from quartier.session import checkpointed

WORDS = 3
BITS = 3
SEED = 42
SAMPLE = 8_192  # fingerprints at least that the top tree is grown from, or LEAF_SAMPLE a leaf
LEAF_SAMPLE = 32
SHARD = 4_096  # fingerprints a shard should hold
MAX_LEAVES = 1 << 15
HEAVY = 8  # shards of more than so many times SHARD are cut further
EXTRA = 16  # levels at most for that
LEAF = 96
_HALF = np.uint64(0xFFFFFFFF)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """Bit k is 1 if it is set in over half of the hashes of the word shingles; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = len(words)
    if n <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        digest = xxhash.xxh64_intdigest
        starts = [0, *ends[: n - size].tolist()]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]
    codes = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for a in range(0, len(codes), 1 << 16):
        counts += np.unpackbits(codes[a : a + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.bitwise_or.reduce(_BIT[2 * counts > len(codes)], initial=np.uint64(0)))


def _signed(prints: list[int]) -> pa.Array:
    return pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())


def _prints(batch: pa.RecordBatch) -> list[int]:
    return [fingerprint(t.encode()) if t else 0 for _, _, part in blocks(batch) for t in part]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _signed(_prints(batch))], names=["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """All rows and columns of ``docs`` and their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _signed(_prints(batch))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def half(prints: np.ndarray, side: int) -> np.ndarray:
    return (prints >> np.uint64(32 * side)) & _HALF


def choose(points: np.ndarray, reach: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius, of a few tried, that leave the fewest comparisons; None if no cut helps."""
    best, least = None, 0.95 * len(points) ** 2
    for k in np.linspace(0, len(points) - 1, 6).astype(int):
        count = np.bincount(np.bitwise_count(points ^ points[k]), minlength=66)
        inner = np.cumsum(count)
        for radius in range(int(np.searchsorted(inner, len(points) * 0.2)), 65):
            inside = int(inner[radius])
            if inside > 0.85 * len(points):
                break
            rim = inside - int(inner[radius - reach] if radius >= reach else 0)
            cost = inside**2 + (len(points) - inside + rim) ** 2
            if cost < least:
                best, least = (points[k], radius), cost
    return best


def _quarters(side: int) -> tuple[int, int]:
    """The two quarters of the other half."""
    return 2 * (1 - side), 2 * (1 - side) + 1


def quarter(prints: np.ndarray, k: int) -> np.ndarray:
    return (prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)


def grow(
    points: np.ndarray, depth: int, reach: int, prints: np.ndarray | None = None, side: int = 0, heavy: float = np.inf
) -> tuple | None:
    """A tree of (vantage point, radius, inner, outer); None is a leaf.

    Below ``depth`` only leaves of more than ``heavy`` points are cut on. Where such ones are too much alike to be cut
    and ``prints`` has the fingerprints they are halves of, a fork (None, quarter, tree, quarter, tree) hands all of them
    to a tree of each quarter of the other half: a pair within BITS differs by at most BITS // 2 in one of them.
    """
    if len(points) < 16 or (depth <= 0 and len(points) <= heavy) or depth <= -EXTRA:
        return None
    cut = choose(points, reach)
    if cut is None:
        if prints is None or len(points) <= heavy:
            return None
        a, b = _quarters(side)
        return None, a, grow(quarter(prints, a), depth, reach, heavy=heavy), b, grow(quarter(prints, b), depth, reach, heavy=heavy)
    distance = np.bitwise_count(points ^ cut[0])
    sides = distance <= cut[1], distance > cut[1] - reach
    return (*cut, *[grow(points[s], depth - 1, reach, None if prints is None else prints[s], side, heavy) for s in sides])


def place(
    tree: tuple | None, points: np.ndarray, reach: int, prints: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """Leaf number and the positions of the points that go there; rim points go to both sides."""
    stack, leaf = [(tree, points, np.arange(len(points)))], 0
    while stack:
        node, keys, at = stack.pop()
        if node is None:
            yield leaf, at
            leaf += 1
            continue
        if node[0] is None:
            stack += [(node[2], quarter(prints, node[1]), at), (node[4], quarter(prints, node[3]), at)]
            continue
        point, radius, inner, outer = node
        distance = np.bitwise_count(keys[at] ^ point)
        stack += [(outer, keys, at[distance > radius - reach]), (inner, keys, at[distance <= radius])]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def link_shard(prints: np.ndarray, side: int, union: Union, at: np.ndarray | None = None) -> None:
    """Join all fingerprints of a shard that are within BITS of each other, and within BITS // 2 in this half."""
    reach = BITS // 2
    stack = [(np.arange(len(prints)) if at is None else at, half(prints, side), True)]
    while stack:
        at, keys, by_half = stack.pop()
        if len(at) <= LEAF:
            near = np.bitwise_count(prints[at][:, None] ^ prints[at]) <= BITS
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))):
                union.join(int(at[i]), int(at[j]))
            continue
        cut = choose(keys[at], reach)
        if cut is None and by_half:
            stack += [(at, quarter(prints, k), False) for k in _quarters(side)]  # halves that are all alike
            continue
        if cut is None:
            _flood(prints, at, union)
            continue
        distance = np.bitwise_count(keys[at] ^ cut[0])
        stack += [(at[distance <= cut[1]], keys, by_half), (at[distance > cut[1] - reach], keys, by_half)]


def _flood(prints: np.ndarray, at: np.ndarray, union: Union) -> None:
    """A crowd that no ball can cut: reached members leave the crowd at once, so close ones are not compared again."""
    rest = at
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = np.bitwise_count(prints[rest] ^ prints[one]) <= BITS
            for k in rest[near].tolist():
                union.join(one, k)
                front.append(k)
            rest = rest[~near]


def _sample(classes: DataFrame, count: int) -> np.ndarray:
    want = max(SAMPLE, int(LEAF_SAMPLE * min(MAX_LEAVES, count / SHARD)))
    return classes.orderBy(F.xxhash64("fp")).limit(want).select("fp").toArrow().column(0).to_numpy().view(np.uint64)


def _trees(sample: np.ndarray, count: int) -> list[tuple | None]:
    """The top tree of each half."""
    depth = int(np.ceil(np.log2(max(1.0, min(MAX_LEAVES, count / SHARD)))))
    heavy = HEAVY * SHARD * len(sample) / max(1, count)
    return [grow(half(sample, side), depth, BITS // 2, sample, side, heavy) for side in (0, 1)]


def links(classes: DataFrame, count: int) -> DataFrame:
    """(u, v) stars of distinct fingerprints ``fp`` that link within a shard.

    The sample grows with the number of shards, to at most MAX_LEAVES * LEAF_SAMPLE fingerprints. Shards that the sample
    shows to be heavy, say since their fingerprints share a half, are cut by the other half before anything is shuffled.
    """
    spark = classes.sparkSession
    shipped = spark.sparkContext.broadcast(_trees(_sample(classes, count), count))  # fewer nodes than sampled points

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(batch.column("fp")).view(np.uint64)
            for side, tree in enumerate(shipped.value):
                leaves = list(place(tree, half(prints, side), BITS // 2, prints))
                shard = np.concatenate([np.full(len(at), 2 * leaf + side, np.int64) for leaf, at in leaves])
                fp = prints[np.concatenate([at for _, at in leaves])].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp)], names=["shard", "fp"])

    def link(key, table):
        prints = np.sort(table.column("fp").to_numpy()).view(np.uint64)
        union = Union(len(prints))
        link_shard(prints, key[0].as_py() & 1, union)
        root = np.array([union.root(i) for i in range(len(prints))], np.int64)
        at = np.flatnonzero(root != np.arange(len(prints)))
        return pa.table({"u": pa.array(prints[at].view(np.int64)), "v": pa.array(prints[root[at]].view(np.int64))})

    dealt = classes.select("fp").mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(link, "u long, v long")


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, component, component_id) of each distinct fingerprint; components are named by a fingerprint in them."""
    known = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = components(links(known, known.count())).withColumnRenamed("node", "fp")
    linked = checkpointed(known.join(parts, "fp"))  # only fingerprints with a link to another
    roots = linked.select(F.col("component").alias("fp")).distinct().join(known, "fp").withColumn("component", F.col("fp"))
    linked = linked.unionByName(roots)
    least = checkpointed(linked.groupBy("component").agg(F.min("first").alias("component_id")))
    linked = linked.join(least, "component").select("fp", "component", "component_id")
    alone = known.join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("first").alias("component_id"))
    return checkpointed(linked.unionByName(alone))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable, for every row.

    Texts that are null, empty or blank have fingerprint zero and link like any other. Rows that repeat a doc_id keep
    a row each. Rows with a null doc_id link too; a component of null ids alone has a null component_id. An empty
    table gives no rows; other columns are not read.
    """
    prints = checkpointed(fingerprints(docs))
    out = prints.join(_classes(prints), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``, of each near-duplicate component only the document with the smallest doc_id.

    Exact repeats of that row's id and fingerprint go too. A component without any doc_id keeps one row. Which rows stay
    is settled from ids and fingerprints alone; texts go through one shuffle, that of the join with the ids that stay.
    """
    prints = checkpointed(fingerprints(docs))
    stays = prints.join(_classes(prints), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = stays.groupBy("component").agg(F.min("fp").alias("fp"), F.min("component_id").alias("doc_id"))
    repeated = prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id", F.lit(True).alias("repeated"))
    key, fp = (_fresh(name, docs.columns) for name in ("_id", "_fp"))
    same_id = stays["doc_id"].eqNullSafe(repeated["doc_id"])
    stays = checkpointed(stays.join(repeated, same_id, "left").select(stays["doc_id"].alias(key), stays["fp"].alias(fp), "repeated"))
    own = F.col("doc_id").cast("long")
    kept = docs.join(stays.where("repeated IS NULL").select(key), own == F.col(key), "left_semi")
    unsure = stays.where("repeated").select(key, fp)
    if unsure.isEmpty():
        return kept
    # Rows that share an id, or have none, are told apart by their fingerprints, and only they are fingerprinted again.
    marked = with_fingerprint(docs.join(unsure.select(key).distinct(), own.eqNullSafe(F.col(key)), "left_semi"), fp)
    told = unsure.withColumnRenamed(fp, fp + "_").withColumnRenamed(key, key + "_")
    found = marked.join(told, (F.col(fp) == F.col(fp + "_")) & own.eqNullSafe(F.col(key + "_")), "left_semi")
    return kept.unionByName(found.dropDuplicates(["doc_id", fp]).select(*[f"`{c}`" for c in docs.columns]))


def _fresh(name: str, taken: list[str]) -> str:
    while any(c.lower().startswith(name) for c in taken):
        name += "_"
    return name

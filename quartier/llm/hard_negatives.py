"""Hard negatives by coordinate pruning over length buckets, on integer inner products.

Vectors are ranked by label and length and cut into shards, a task each, whose vectors have about one length. A shard
keeps sorted lists of coordinates of its unit vectors. A range of scores and the lengths give a range of angles to the
anchor; with the anchor's own angles to its focus coordinates (its largest) it bounds the coordinates of every vector
that qualifies. The feasible stretches of the lists are intersected, and what is left is verified by exact products.

Anchors reach the shards by shuffle and pass by as a stream. A bounded sample of the vectors gives every search a
true lower bound beforehand; it decides what is looked at, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartier.llm.ranks import ranked, stored

SCALE = 256
SHARD, SHARD_CELLS = 8192, 1 << 21  # vectors and integers of a shard, at most
SAMPLE, SAMPLE_CELLS = 2048, 1 << 22
BLOCK = 128  # anchors verified together
FOCUS = 4
DENSE = 0.1  # share of a shard above which candidates are verified by one product for the block
EXACT = 2.0**53  # products below it are exact in double precision
SALT = 32
LOWEST = -(2**63)

_PROBE = "key string, kind int, row long, vec_id long, label long, square long, vec array<int>, lows array<long>, highs array<long>"
_HIT = "anchor long, k int, vec_id long, row long, score long"


class Shard:
    """Vectors of one dimension with sorted coordinate lists, made for a coordinate when it is first a focus."""

    def __init__(self, vectors: np.ndarray, square: np.ndarray, labels: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, rows: np.ndarray):
        self.whole, self.vectors = vectors.astype(np.int64), vectors.astype(np.float64)
        self.labels, self.ids, self.unnamed, self.rows = labels, ids, unnamed, rows
        self.lengths = np.sqrt(square.astype(np.float64))
        self.units = self.vectors / np.maximum(self.lengths, 1)[:, None]
        self.zero = np.flatnonzero(self.lengths == 0)
        some = self.lengths[self.lengths > 0]
        self.shortest, self.longest = (some.min(), some.max()) if len(some) else (0.0, 0.0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.units[:, f], kind="stable")
            self.lists[f] = order, self.units[order, f]
        return self.lists[f]

    def angles(self, length: float, low: float, high: float) -> tuple[float, float] | None:
        """The least and greatest angle to an anchor of that length at which a score can be in the range."""
        if not self.longest:
            return None
        least = low / (length * (self.longest if low > 0 else self.shortest))
        most = high / (length * (self.shortest if high > 0 else self.longest))
        if least > 1 + 1e-9 or most < -1 - 1e-9:
            return None
        return float(np.arccos(min(max(most, -1.0), 1.0))), float(np.arccos(min(max(least, -1.0), 1.0)))

    def candidates(self, anchor: np.ndarray, length: float, low: float, high: float) -> np.ndarray:
        """Places of all vectors whose score can be in the range, and few others."""
        if length == 0:
            return np.arange(len(self.rows)) if low <= 0 <= high else np.empty(0, np.int64)
        none = self.zero if low <= 0 <= high else np.empty(0, np.int64)
        span = self.angles(length, low, high)
        if span is None:
            return none
        near, far = span
        unit = anchor / length
        focus = np.argpartition(-np.abs(unit), min(FOCUS, len(unit)) - 1)[:FOCUS] if len(unit) else []
        stretches = []
        for f in focus:
            own = float(np.arccos(np.clip(unit[f], -1, 1)))
            closest = max(0.0, near - own, own - far)
            widest = own + far if own + far <= np.pi else 2 * np.pi - own - near if own + near >= np.pi else np.pi
            bottom, top = np.cos(widest) - 1e-9, np.cos(closest) + 1e-9
            order, values = self.sorted_list(int(f))
            a, b = np.searchsorted(values, bottom), np.searchsorted(values, top, "right")
            stretches.append((b - a, int(f), a, b, bottom, top))
        if not stretches:
            return np.arange(len(self.rows))
        stretches.sort()
        _, f, a, b, _, _ = stretches[0]
        found = self.sorted_list(f)[0][a:b]
        for size, f, _, _, bottom, top in stretches[1:]:
            if size < len(self.rows):
                mine = self.units[found, f]
                found = found[(mine >= bottom) & (mine <= top)]
        return np.union1d(found, none) if len(none) else found

    def products(self, anchors: np.ndarray, length: float, places: np.ndarray | None = None) -> np.ndarray:
        """Exact scores of anchors (rows) with the vectors at ``places``, or with all."""
        exact = max(length, 1.0) * max(self.longest, 1.0) < EXACT
        mine = self.vectors if exact else self.whole
        mine = mine if places is None else mine[places]
        return (anchors.astype(mine.dtype) @ mine.T).astype(np.int64)

    def first(self, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Of ``places`` with their scores the first ``k``: higher scores, then smaller ids, named rows before others."""
        if len(places) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            places, scores = places[scores >= kth], scores[scores >= kth]
        order = np.lexsort((self.rows[places], self.ids[places], self.unnamed[places], -scores))[:k]
        return places[order]


def _matrix(vec, n: int) -> np.ndarray:
    return np.asarray(vec.flatten()).reshape(n, -1)


def _ints(column, empty: int = 0) -> np.ndarray:
    return np.asarray(column.fill_null(empty)).astype(np.int64)


def _search(same: bool, k: int):
    """The task: shards and the anchors sent to them, in; the ``k`` first vectors of each anchor and range, out.

    ``same`` asks for vectors of the anchor's label other than itself, else for those of other labels.
    """

    def shard_of(parts: list[pa.RecordBatch]) -> Shard:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ids = t.column("vec_id")
        return Shard(_matrix(t.column("vec"), t.num_rows), _ints(t.column("square")), _ints(t.column("label")), _ints(ids), np.asarray(ids.is_null()), _ints(t.column("row")))

    def answer(shard: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchors = _matrix(batch.column("vec"), batch.num_rows)
        rows, labels = _ints(batch.column("row")), _ints(batch.column("label"))
        lengths = np.sqrt(_ints(batch.column("square")).astype(np.float64))
        lows, highs = batch.column("lows").to_pylist(), batch.column("highs").to_pylist()
        out: list[tuple] = []
        for a in range(0, len(rows), BLOCK):
            block = range(a, min(a + BLOCK, len(rows)))
            places = {i: shard.candidates(anchors[i], lengths[i], min(lows[i]), max(highs[i])) for i in block if lows[i]}
            wide = [i for i, p in places.items() if len(p) > DENSE * len(shard.rows)]
            dense = dict(zip(wide, shard.products(anchors[wide], lengths[wide].max()))) if wide else {}
            for i, at in places.items():
                fits = (shard.labels[at] == labels[i]) & (shard.rows[at] != rows[i]) if same else shard.labels[at] != labels[i]
                at = at[fits]
                if not len(at):
                    continue
                scores = dense[i][at] if i in dense else shard.products(anchors[i : i + 1], lengths[i], at)[0]
                for j, (low, high) in enumerate(zip(lows[i], highs[i])):
                    inside = (scores >= low) & (scores <= high)
                    first = shard.first(at[inside], scores[inside], k)
                    score = dict(zip(at[inside].tolist(), scores[inside].tolist()))
                    out += [(rows[i], j, None if shard.unnamed[p] else shard.ids[p], shard.rows[p], score[p]) for p in first.tolist()]
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["anchor", "k", "vec_id", "row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            kinds = np.asarray(batch.column("kind"))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if keys[a] != key:
                    key, parts, shard = keys[a], [], None
                if kinds[a] == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if shard is None:
                    shard, parts = shard_of(parts), []
                yield from answer(shard, batch.slice(a, b - a))

    return run


def _bounds(sample: list, same: bool, k: int):
    """The task that sharpens the ranges of anchors: at least ``k`` sampled vectors reach the new lower end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for r in sample:
            by.setdefault(len(r.vec), []).append(r)
        known = {d: (np.array([r.vec for r in rs], np.int64).reshape(len(rs), d), np.array([r.label for r in rs]), np.array([r.row for r in rs])) for d, rs in by.items()}
        for batch in batches:
            out = []
            for vec, label, row, lows, highs in zip(*(batch.column(c).to_pylist() for c in ("vec", "label", "row", "lows", "highs"))):
                if len(vec) in known:
                    vectors, labels, rows = known[len(vec)]
                    scores = (vectors @ np.array(vec, np.int64))[(labels == label) & (rows != row) if same else labels != label]
                    for j, (low, high) in enumerate(zip(lows, highs)):
                        mine = scores[(scores >= low) & (scores <= high)]
                        if len(mine) >= k:
                            lows[j] = int(np.partition(mine, len(mine) - k)[len(mine) - k])
                out.append(lows)
            at = batch.schema.get_field_index("lows")
            yield batch.set_column(at, "lows", pa.array(out, batch.schema.field(at).type))

    return run


def items(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label, dim, square and integer vector of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    square = F.aggregate("wide", F.lit(0.0), lambda s, v: s + v * v)
    usable = table.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    wide = usable.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"), F.size(x).alias("dim"), whole.alias("wide"),
    ).withColumn("square", square).where(F.col("square") < 2.0**62)
    return wide.select("row", "vec_id", "label", "dim", F.col("square").cast("long").alias("square"), F.transform("wide", lambda v: v.cast("int")).alias("vec"))


def mine(
    table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = SCALE, shard: int = SHARD,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``table`` (vec_id, embedding, label).

    Components become ``floor(scale * x)``. A row's score is its integer inner product with the anchor; higher ones come
    first, ties by smaller vec_id. ``anchor`` says which rows are anchors, from ``vec_id`` and ``label``. An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other
    labels whose score is ``low`` to ``high`` percent of the positive's.

    Rows with a null label, vector or component, or a component that isn't finite, take no part, nor do those whose
    squared length reaches 2**62, as their scores fit no long. Only vectors of one dimension are compared; empty and zero
    vectors score 0. Rows that repeat a vec_id are rows of their own (as anchors, too); a null vec_id is never an anchor,
    comes after the others in ties and is returned as null. Other columns aren't read; an empty table gives no rows.
    """
    spark = table.sparkSession
    rows = stored(items(table, scale).withColumn("longest", -F.col("square")).withColumn("g", F.col("dim").cast("string")), "vectors")
    lined = ranked(rows, "g", ["label", "longest", "row"])
    size = F.greatest(F.lit(1), F.least(F.lit(shard), F.floor(F.lit(SHARD_CELLS) / F.greatest("dim", F.lit(1)))))
    lined = stored(lined.withColumn("shard", F.floor(F.col("rank") / size)), "shards")
    stats = stored(
        lined.groupBy("dim", "shard").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.max("square").alias("most")), "shard-stats"
    )
    widest = max(rows.agg(F.max("dim")).first()[0] or 1, 1)
    count = max(1, min(SAMPLE, SAMPLE_CELLS // widest))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(count).select("row", "label", "vec").collect()  # at most SAMPLE_CELLS integers
    key = F.concat_ws(":", "dim", "shard")
    longs = "array<long>"
    columns = [c.split()[0] for c in _PROBE.split(", ")]
    nothing = F.lit(None).cast(longs)
    kept = lined.select(key.alias("key"), F.lit(0).alias("kind"), "row", "vec_id", "label", "square", "vec", nothing.alias("lows"), nothing.alias("highs"))

    def probed(asked: DataFrame, same: bool, k: int) -> DataFrame:
        sent = asked.select(key.alias("key"), F.lit(1).alias("kind"), *columns[2:])
        met = kept.unionByName(sent).repartition("key").sortWithinPartitions("key", "kind")
        return met.mapInArrow(_search(same, k), _HIT)

    def sharpened(asked: DataFrame, same: bool, k: int) -> DataFrame:
        return asked.mapInArrow(_bounds(sample, same, k), asked.schema)

    def best(hits: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asking = rows.where(anchor & F.col("vec_id").isNotNull()).select("row", "vec_id", "label", "dim", "square", "vec")
    every = asking.withColumns({"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(2**63 - 1))})
    spans = lined.groupBy("dim", "label").agg(F.min("shard").alias("from"), F.max("shard").alias("to"))
    own = sharpened(every, True, positives).join(spans, ["dim", "label"]).withColumn("shard", F.explode(F.sequence("from", "to")))
    pairs = best(probed(own, True, positives), positives)
    pairs = stored(pairs.select("anchor", F.col("rank").alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    score = F.col("positive_score").cast("decimal(38,0)")
    ends = F.struct("k", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    ranges = pairs.where(F.col("positive_score") >= 0).groupBy("anchor").agg(F.array_sort(F.collect_list(ends)).alias("ends"))  # at most ``positives``
    second = asking.join(ranges, F.col("row") == F.col("anchor")).drop("anchor")
    second = second.withColumns({"lows": F.col("ends.low"), "highs": F.col("ends.high")}).drop("ends")
    second = sharpened(second, False, negatives).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    near = stats.select("dim", "first", "last", "most", "shard", (F.col("shard") % SALT).cast("int").alias("salt"))
    reach = (F.col("first") != F.col("label")) | (F.col("last") != F.col("label"))
    reach &= F.sqrt("square") * F.sqrt("most") * (1 + 1e-9) >= F.array_min("lows")
    other = second.join(near, ["dim", "salt"]).where(reach)
    found = best(probed(other, False, negatives), negatives)
    found = found.select("anchor", (F.col("k") + 1).alias("k"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asking.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(pairs, ["anchor", "k"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )

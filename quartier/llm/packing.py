"""Packing of tokenized documents into sequences by cutting-stock column generation.

Documents are cut at whole sequences; what remains of each is an item. The histogram of item lengths (``CLASSES`` at
most, whatever the table) is a cutting-stock problem: a linear program over patterns, ways to fill a sequence, whose
columns a knapsack by dynamic programming prices. Rounded patterns own intervals of ranks in each length class, so a
document's rank alone says its sequence. The worst sequences are then dissolved: their documents are poured into the
gaps of the others, by running sums over both, and what is left goes into sequences of powers of two: no padding.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartier.llm.bpe import Encoder, load
from quartier.llm.ranks import ranked, stored
from quartier.llm.text import blocks, id_text

LIMIT, CLASSES = 4096, 256
KNOWN_WORDS = 400_000  # words whose ids a task keeps
LOT_BYTES = 1 << 22  # of texts encoded together
OUT_BYTES = 1 << 21
CELL = 16  # sequences' worth of the poured stream that meet in one group
ODD_BLANKS = "\x1c\x1d\x1e\x1f"  # str.split() takes them for white space, the tokenizer doesn't

_TOKENS = "row long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` from each start, end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(size) else 0
    return ids[np.repeat(start - ends + size, size) + np.arange(total)]


class Table:
    """Keys with a stretch of ids each, learned in the order of their first use."""

    def __init__(self):
        self.keys: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.start, self.size = (np.empty(0, np.int64) for _ in range(3))

    def places(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.keys.__getitem__, keys), np.int64, len(keys))

    def fresh(self) -> list[str]:
        return list(islice(self.keys, len(self.start), None))

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(sizes) - sizes))
        self.size, self.ids = np.concatenate((self.size, sizes)), np.concatenate((self.ids, ids))

    def read(self, places: np.ndarray) -> np.ndarray:
        return _gather(self.ids, self.start[places], self.size[places])


class WordEncoder:
    """Token ids of texts by way of their distinct words and the words' distinct pieces: no piece crosses white space."""

    def __init__(self, spec: dict):
        self.inner = Encoder(spec)
        self.words, self.pieces = Table(), Table()

    def _spell(self, words: list[str], find) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and how many each has. Pieces tile the words, so lengths tell them apart."""
        text = " ".join(words)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma, as in ``Encoder``
        text = text.lower()
        found = find(text)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        lengths = np.cumsum(np.fromiter(map(len, text.split(" ")), np.int64, len(words)))
        at = self.pieces.places(found)
        if fresh := self.pieces.fresh():
            ids, offset = self.inner.index.encode([p.encode() for p in fresh])
            self.pieces.learn(ids, np.diff(offset))
        before = np.concatenate(([0], np.cumsum(self.pieces.size[at])))
        return self.pieces.read(at), np.diff(before[np.searchsorted(ends, lengths, "right")], prepend=0)

    def _learn(self) -> None:
        fresh = self.words.fresh()
        basic = np.fromiter((w.isascii() or max(w) < "\U00010000" for w in fresh), bool, len(fresh))
        ids, sizes, start = [], np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        for group, find in ((basic, self.inner.basic), (~basic, self.inner.full)):
            mine = np.flatnonzero(group)
            if len(mine):
                spelled, sizes[mine] = self._spell([fresh[i] for i in mine.tolist()], find)
                start[mine] = sum(map(len, ids)) + np.cumsum(sizes[mine]) - sizes[mine]
                ids.append(spelled)
        self.words.learn(_gather(np.concatenate(ids), start, sizes), sizes)

    def encode(self, texts: list) -> list[np.ndarray]:
        special = self.inner.special
        plain = [bool(t) and not any(s in t for s in special) and not any(c in t for c in ODD_BLANKS) for t in texts]
        owned = [self.words.places(t.split()) if p else None for t, p in zip(texts, plain)]
        if len(self.words.keys) > len(self.words.start):
            self._learn()
        out = [self.inner.encode([t])[0].astype(np.int64) if at is None else self.words.read(at) for t, at in zip(texts, owned)]
        if len(self.words.keys) > KNOWN_WORDS:
            self.words, self.pieces = Table(), Table()
        return out


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """row, doc_id, n and ids (little-endian, of the vocabulary's width) of every document; its last id is ``end``."""
    shipped = docs.sparkSession.sparkContext.broadcast(load(path))  # bounded by the vocabulary
    kind = width(path, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(shipped.value)
        for batch in batches:
            for a, b, texts in blocks(batch, limit=LOT_BYTES):
                coded = [np.append(ids, end).astype(kind) for ids in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, b - a) for c in ("row", "doc_id")),
                        pa.array(list(map(len, coded)), pa.int64()), pa.array([c.tobytes() for c in coded], pa.binary()),
                    ],
                    names=["row", "doc_id", "n", "ids"],
                )

    return id_text(docs, F.monotonically_increasing_id().alias("row")).mapInArrow(run, _TOKENS)


def width(path: str, end: int) -> str:
    return "<u2" if max(len(load(path)["names"]) - 1, end) < 1 << 16 else "<u4"


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The greatest total value of sizes (ascending, each as often as wanted) within the capacity, and how often each."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = int(np.searchsorted(sizes, room, "right"))
        best[room] = best[room - 1]
        if fit:
            gains = values[:fit] + best[room - sizes[:fit]]
            k = int(gains.argmax())
            if gains[k] > best[room] + 1e-12:
                best[room], took[room] = gains[k], k
    times, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            times[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), times


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the linear program, by the revised simplex method.

    Ends at the optimum, or where Farley's bound shows that less than half a sequence or the share ``gap`` can be won.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(basis)
    for step in range(1, 40 * m + 200):
        use = np.maximum(inverse @ demand, 0)
        value, times = knapsack(inverse.sum(0), sizes, capacity)
        if value <= 1 + 1e-9 or use.sum() * (1 - 1 / value) < max(0.5, gap * use.sum()):
            break
        column = inverse @ times
        ratios = np.where(column > 1e-11, use / np.where(column > 1e-11, column, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = times
        if step % 64:
            row = inverse[out] / column[out]
            inverse -= np.outer(column, row)
            inverse[out] = row
        else:
            inverse = np.linalg.inv(basis)
    return basis.astype(np.int64), np.maximum(inverse @ demand, 0)


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for what rounding leaves over: long items first, each into the first sequence with room."""
    rooms: list[int] = []
    made: list[np.ndarray] = []
    for k in range(len(sizes) - 1, -1, -1):
        size, n, at = int(sizes[k]), int(left[k]), 0
        while n:
            if at == len(rooms):
                rooms.append(capacity)
                made.append(np.zeros(len(sizes), np.int64))
            fit = min(n, rooms[at] // size)
            rooms[at] -= fit * size
            made[at][k] += fit
            n, at = n - fit, at + 1
    return made


def cutting_plan(demand: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {size: how many}) of each pattern, fullest first; together they hold exactly the demand."""
    sizes = np.array(sorted(demand), np.int64)
    if not len(sizes):
        return []
    wanted = np.array([demand[s] for s in sizes.tolist()], np.int64)
    patterns, use = relaxed(sizes, wanted.astype(float), capacity)
    often = np.floor(use + 1e-7).astype(np.int64)
    left = wanted - patterns @ often
    while (left < 0).any():  # what float sums overstate
        over = int(np.flatnonzero(left < 0)[0])
        p = int(np.flatnonzero((patterns[over] > 0) & (often > 0))[0])
        often[p] -= 1
        left += patterns[:, p]
    found = [(int(t), patterns[:, p]) for p, t in enumerate(often.tolist()) if t]
    found += [(1, p) for p in first_fit(sizes, left, capacity)]
    found.sort(key=lambda f: -int(f[1] @ sizes))
    return [(t, {int(s): int(k) for s, k in zip(sizes, p) if k}) for t, p in found]


def intervals(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end of ranks, first sequence, copies a sequence, first slot) of each pattern and class."""
    out, taken, sequence = [], defaultdict(int), 0
    for times, pattern in plan:
        slot = 0
        for size, copies in sorted(pattern.items(), reverse=True):
            out.append((size, taken[size], taken[size] + times * copies, sequence, copies, slot))
            taken[size] += times * copies
            slot += copies
        sequence += times
    return out


def poured(gaps: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """row, first, start, length, sequence_id, offset: ``items`` cut where the gaps they are poured into end.

    ``gaps`` (sequence_id, at, size) and ``items`` (row, first, base, rest, sequence_id, slot) stand in a row each, by
    running sums; cells of that line meet in a task, in which one sorted pass pairs them.
    """
    line = ranked(gaps.withColumn("all", F.lit(0)), "all", ["sequence_id"], "size")
    holes = line.select(F.col("before").alias("pos"), F.lit(0).alias("kind"), F.struct("sequence_id", "at", F.col("before").alias("from"), (F.col("before") + F.col("size")).alias("to")).alias("hole"))
    line = ranked(items.withColumn("all", F.lit(0)), "all", ["sequence_id", "slot"], "rest")
    things = line.select(F.col("before").alias("pos"), F.lit(1).alias("kind"), F.struct("row", "first", "base", F.col("before").alias("from"), (F.col("before") + F.col("rest")).alias("to")).alias("thing"))
    cell = lambda c: F.floor(c / F.lit(limit * CELL))
    holes = holes.withColumn("cell", cell(F.col("pos")))
    reach = F.sequence(cell(F.greatest(F.col("pos") - limit, F.lit(0))), cell(F.col("thing.to") - 1))  # two at most
    things = things.withColumn("cell", F.explode(reach))
    events = holes.unionByName(things, allowMissingColumns=True)
    order = Window.partitionBy("cell").orderBy("pos", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = events.select(
        "pos", F.lead("pos").over(order).alias("next"),
        F.last("hole", ignorenulls=True).over(so_far).alias("h"), F.last("thing", ignorenulls=True).over(so_far).alias("t"),
    )
    cut = seen.withColumn("end", F.least("next", "h.to", "t.to")).where(F.col("end") > F.col("pos"))
    return cut.where(F.col("pos") >= F.col("t.from")).select(
        "t.row", "t.first", (F.col("t.base") + F.col("pos") - F.col("t.from")).alias("start"), (F.col("end") - F.col("pos")).alias("length"),
        "h.sequence_id", (F.col("h.at") + F.col("pos") - F.col("h.from")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, end: int, limit: int = LIMIT) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece; ``limit`` is a power of two.

    A document's ids, with ``end`` after them, are cut into pieces; pieces of a sequence follow each other from offset 0
    and fill it to ``limit`` ids, except that less than ``limit`` ids in all go to sequences whose lengths are powers of
    two. ``ids`` are little-endian unsigned 32-bit integers. Sequences are numbered from 0 without gaps.

    Null and empty texts are documents of the one id ``end``; rows with equal or null doc_id are documents of their own;
    very long texts fill many sequences; an empty table gives no pieces; other columns aren't read.
    """
    spark, kind = docs.sparkSession, width(path, end)
    tokens = stored(tokenized(docs, path, end), "tokens")
    unit = max(1, limit // CLASSES)
    rest = F.col("n") % limit
    narrow = tokens.select("row", "n", rest.alias("rest"), F.ceil(rest / unit).cast("int").alias("class"), F.floor(F.col("n") / limit).alias("full"))
    counts = narrow.groupBy("class").agg(F.count("*").alias("count"), F.sum("full").alias("full"), F.sum("rest").alias("rest")).orderBy("class").collect()
    plan = cutting_plan({r["class"]: r["count"] for r in counts if r["class"]}, limit // unit)
    whole, left = divmod(sum(r["rest"] for r in counts), limit)
    tails = [(whole + k, 0, size) for k, size in enumerate(1 << b for b in range(limit.bit_length(), -1, -1) if left >> b & 1)]
    firsts, so_far = [], whole + len(tails)
    for r in counts:  # a row for each class
        firsts.append((r["class"], so_far))
        so_far += r["full"]

    numbers = spark.createDataFrame(firsts, "class int, base_sequence long")
    shares = spark.createDataFrame(intervals(plan), "class int, low long, high long, first_sequence long, copies long, first_slot long")
    lined = ranked(narrow, "class", ["rest", "row"], "full").withColumnRenamed("before", "ahead").drop("whole", "total")
    lined = lined.join(F.broadcast(numbers), "class")  # at most CLASSES + 1 rows
    lined = stored(lined.withColumn("first", F.col("base_sequence") + F.col("ahead")), "items")
    within = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    own = lined.alias("i").join(F.broadcast(shares).alias("s"), (F.col("i.class") == F.col("s.class")) & within)  # by pattern and class
    at = F.col("rank") - F.col("low")
    dealt = own.select(
        "row", "first", "rest", (F.col("n") - F.col("rest")).alias("base"),
        (F.col("first_sequence") + F.floor(at / F.col("copies"))).alias("sequence_id"), (F.col("first_slot") + at % F.col("copies")).alias("slot"),
    )
    sequence = Window.partitionBy("sequence_id")
    placed = dealt.withColumns({
        "offset": F.sum("rest").over(sequence.orderBy("slot")) - F.col("rest"), "filled": F.sum("rest").over(sequence),
    })
    placed = stored(placed, "placed")
    kept = placed.where(F.col("sequence_id") < whole)
    gaps = kept.where((F.col("slot") == 0) & (F.col("filled") < limit)).select("sequence_id", F.col("filled").alias("at"), (F.lit(limit) - F.col("filled")).alias("size"))
    gaps = gaps.unionByName(spark.createDataFrame(tails, "sequence_id long, at long, size long"))
    cut = poured(gaps, placed.where(F.col("sequence_id") >= whole).drop("offset", "filled"), limit)
    piece = F.struct("start", "length", "sequence_id", "offset")
    parts = kept.withColumnsRenamed({"base": "start", "rest": "length"}).select("row", "first", F.array(piece).alias("parts"))
    parts = parts.unionByName(cut.groupBy("row", "first").agg(F.collect_list(piece).alias("parts")))  # fewer than ``limit``
    parts = parts.unionByName(lined.where("rest = 0").select("row", "first", F.expr("array()").cast(parts.schema["parts"].dataType).alias("parts")))

    def cut_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for doc, n, raw, first, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n")), batch.column("ids"), *(batch.column(c).to_pylist() for c in ("first", "parts"))):
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                spans = [(k * limit, limit, first + k, 0) for k in range(n // limit)]
                spans += [(p["start"], p["length"], p["sequence_id"], p["offset"]) for p in sorted(own, key=lambda p: p["start"])]
                for start, length, sequence_id, offset in spans:
                    for column, value in zip(out, (doc, start, length, ids[start : start + length].tobytes(), n, sequence_id, offset)):
                        column.append(value)
                    held += 4 * length + 64
                    if held > OUT_BYTES:
                        yield _table(out, names)
                        out, held = [[] for _ in names], 0
            if held:
                yield _table(out, names)

    return tokens.join(parts, "row").mapInArrow(cut_ids, _PIECES)


def _table(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names)], names=names)

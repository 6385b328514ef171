"""Scoring by a hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). The most frequent tokens have a class each, all others
share classes by their last two bytes, so that rare words of one language or word form meet. Below a shared class a
path of branches, read off the word's hash, leads to a leaf of few words. The class and each branch of the path are a
softmax over hashed features of the history: the last word, the one before it (a skip) and both together; those of a
branch are hashed together with its place. The word within its leaf follows its count plus one, with one more place in
each leaf for words never seen. The counted words and tokens set the length of the paths and the number of hashed rows
for them. The weights start at the shares of classes and branches and are fitted by distributed gradient steps:
each task runs AdaGrad over its texts from the common weights and sends the change, and the changes are averaged, those
of a branch's row over the tasks that saw it. What a model holds is bounded, but for the token counts, which stay a
distributed table. Rare tokens meet their counts in a shuffle by token; frequent ones are few (at most
``1 / HOT_SHARE``) and are sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartier.llm.sums import summed
from quartier.llm.text import LOWER, Block, blocks, mix, utf8
from quartier.session import checkpointed

OWN = 24  # tokens with a class of their own, the end among them
SHARED_BITS = 3
CLASSES = OWN + (1 << SHARED_BITS)
ROW_BITS = 14  # hashed features
FAN_BITS = 3  # branches of a place in a path
FAN = 1 << FAN_BITS
MAX_LEVELS = 3  # branches of the longest path
LEAF_TOKENS = 128  # training tokens for each leaf, at least
PATH_BITS = (14, 18)  # hashed rows for paths: at least, at most
ROW_TOKENS = 16  # training tokens for each of them, between these
RATE = 0.3
ROUNDS = 1
STEP = 4_096  # tokens a gradient step
FRESH = 1e-4  # sum of squares of a row not seen yet
HOT_SHARE = 1 / 500_000  # tokens with a larger share of all occurrences are frequent
END = np.uint64(0xE4D0E4D0E4D0E4D1)  # stands for the end of a text
START = np.uint64(0x57A127C0DE57A127)  # stands before it
HELD = 1 << 20


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, spelling (last two bytes) and owner of every token; each text ends with one end token."""
    block = Block([t.translate(LOWER) for t in utf8(texts)])
    at = block.first[1:]
    ends = block.ends
    spelled = block.buf[ends - 1].astype(np.int64) << 8 | np.where(ends - block.starts > 1, block.buf[ends - 2], 0)
    places = np.arange(len(texts))
    return np.insert(block.word_hashes(), at, END), np.insert(spelled, at, 0), np.insert(block.doc, at, places)


@dataclass
class Counts:
    """Token counts: the distributed table of rare tokens, and the frequent ones on the driver, by hash."""

    rare: DataFrame
    hot: np.ndarray
    hot_count: np.ndarray
    hot_spelled: np.ndarray
    n_tokens: int
    n_types: int
    mass: np.ndarray  # of each shared class: sum of count + 1 over its training tokens that have no class of their own
    spelled: DataFrame | None = None  # the rare tokens learned from, with their spelling


def shared_class(spelled: np.ndarray) -> np.ndarray:
    return (mix(spelled.astype(np.uint64)) >> np.uint64(64 - SHARED_BITS)).astype(np.int64)


def count_tokens(docs: DataFrame, learn: Column) -> Counts:
    """Occurrences of every token in training texts and in all texts; partial counts meet by token."""
    base = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            known = np.array(batch.column("learn").to_pylist(), bool)
            for a, b, texts in blocks(batch):
                h, spelled, owner = tokens(texts)
                held.append((h, spelled, known[a:b][owner]))
                size += len(h)
                if size >= HELD:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    table = base.mapInArrow(partial, "token long, spelled int, c long, n long")
    table = checkpointed(table.groupBy("token").agg(F.first("spelled").alias("spelled"), F.sum("c").alias("c"), F.sum("n").alias("n")))
    all_tokens = table.agg(F.sum("n")).first()[0] or 0
    limit = max(1.0, all_tokens * HOT_SHARE)
    frequent = (F.col("n") > limit) | (F.col("token") == int(END.view(np.int64)))
    hot = table.where(frequent).select("token", "c", "spelled").toArrow()  # fewer than 1 / HOT_SHARE
    keys, c = hot.column("token").to_numpy().view(np.uint64), hot.column("c").to_numpy()
    order = np.argsort(keys)
    keys, c, spelled = keys[order], c[order], hot.column("spelled").to_numpy().astype(np.int64)[order]
    rare = table.where(~frequent)
    sums = table.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    by_spelling = rare.where("c > 0").groupBy("spelled").agg(F.sum(F.col("c") + 1).alias("m")).toArrow()  # at most 2**16
    mass = np.bincount(shared_class(by_spelling.column("spelled").to_numpy().astype(np.int64)), by_spelling.column("m").to_numpy(), 1 << SHARED_BITS)
    learned = rare.where("c > 0").select("token", "spelled", "c")
    return Counts(rare.select("token", "c"), keys, c, spelled, sums[0] or 0, sums[1] or 0, mass, learned)


def _counted(held: list) -> pa.RecordBatch:
    h, spelled, known = map(np.concatenate, zip(*held))
    unique, first, back = np.unique(h, return_index=True, return_inverse=True)
    n = np.bincount(back)
    c = np.bincount(back, known, len(unique)).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(unique.view(np.int64)), pa.array(spelled[first].astype(np.int32)), pa.array(c), pa.array(n)], names=["token", "spelled", "c", "n"]
    )


class Classes:
    """The class of every token, and the share of each class to start from."""

    def __init__(self, counts: Counts):
        trained = counts.hot_count > 0
        order = np.lexsort((counts.hot, -counts.hot_count))
        top = np.sort(counts.hot[order[trained[order]][: OWN - 1]])
        own = np.unique(np.append(top, END))[:OWN]
        self.own = own
        self.mass = np.zeros(CLASSES)
        at = np.searchsorted(own, counts.hot)
        is_own = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == counts.hot)
        self.mass[at[is_own]] = counts.hot_count[is_own] + 1
        self.mass[np.searchsorted(own, END)] = max(1.0, self.mass[np.searchsorted(own, END)])
        self.mass[OWN:] = counts.mass + 1  # and one place for words never seen
        rest = ~is_own & trained
        self.mass[OWN:] += np.bincount(shared_class(counts.hot_spelled[rest]), counts.hot_count[rest] + 1, CLASSES - OWN)
        share = self.mass / self.mass.sum()
        self.bias = np.where(share > 0, np.log(np.maximum(share, 1e-300)), -60.0).astype(np.float32)

    def of(self, h: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[at] == h, at, OWN + shared_class(spelled))


def leaf_of(h: np.ndarray, target: np.ndarray, levels: int) -> np.ndarray:
    """Number of the leaf of tokens in shared classes: class and branches taken."""
    width = FAN_BITS * levels
    code = mix(h, 5) >> np.uint64(64 - width) if width else np.zeros(len(h), np.uint64)
    return (target - OWN) << width | code.astype(np.int64)


class Paths:
    """The way from a shared class to the leaf of each token, and the shares of the branches to start from.

    A place is numbered by level, class and branches taken. ``bias`` has the log shares of the branches of every place,
    ``mass`` of every leaf the sum of count + 1 over its training tokens, and one place for words never seen.
    """

    def __init__(self, counts: Counts, classes: Classes):
        most, self.levels = min(counts.n_types, counts.n_tokens // LEAF_TOKENS), 0
        while self.levels < MAX_LEVELS and 1 << SHARED_BITS + FAN_BITS * (self.levels + 1) <= most:
            self.levels += 1
        self.bits = int(np.clip((counts.n_tokens // ROW_TOKENS).bit_length(), *PATH_BITS))
        self.first = [((1 << FAN_BITS * j) - 1) // (FAN - 1) << SHARED_BITS for j in range(self.levels)]
        target = classes.of(counts.hot, counts.hot_spelled)
        some = (target >= OWN) & (counts.hot_count > 0)
        size = 1 << SHARED_BITS + FAN_BITS * self.levels
        leaf = leaf_of(counts.hot[some], target[some], self.levels)
        self.mass = 1.0 + np.bincount(leaf, counts.hot_count[some] + 1, size)
        if counts.spelled is not None:
            levels = self.levels

            def add(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
                for batch in batches:
                    h, spelled, c = (batch.column(k).to_numpy() for k in ("token", "spelled", "c"))
                    at = leaf_of(h.view(np.uint64), OWN + shared_class(spelled.astype(np.int64)), levels)
                    total += np.bincount(at, c + 1, len(total))

            self.mass += summed(counts.spelled, add, size)
        shares = [np.zeros((0, FAN))]
        mass = self.mass
        for _ in range(self.levels):
            mass = mass.reshape(-1, FAN)
            shares.append(np.log(mass / mass.sum(1, keepdims=True)))
            mass = mass.sum(1)
        self.bias = np.concatenate([shares[0], *shares[:0:-1]]).astype(np.float32)

    def places(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and branch taken at each level, side by side."""
        down = FAN_BITS * np.arange(self.levels, 0, -1)
        place = (leaf[:, None] >> down) + np.array(self.first, np.int64)
        return place, leaf[:, None] >> down - FAN_BITS & FAN - 1

    def rows(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rows of the weights for each feature, token and level."""
        salt = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (codes[:, :, None] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def blank(self) -> np.ndarray:
        return np.zeros((1 << self.bits if self.levels else 0, FAN), np.float32)


def branch_shares(weights: np.ndarray, paths: Paths, place: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probability of every branch (last axis, flat over tokens and levels) after each history."""
    s = weights.take(rows[0], 0)
    for row in rows[1:]:
        s += weights.take(row, 0)
    s += paths.bias.take(place.ravel(), 0)
    np.clip(s, -60, 40, out=s)
    np.exp(s, out=s)
    s /= (s @ np.ones(FAN, s.dtype))[:, None]
    return s


def path_shares(weights: np.ndarray, paths: Paths, codes: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Probability of the leaf of each token, given its class."""
    place, branch = paths.places(leaf)
    shares = branch_shares(weights, paths, place, paths.rows(codes, place).reshape(len(codes), -1))
    return shares[np.arange(len(shares)), branch.ravel()].reshape(place.shape).prod(1)


def history(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Codes of the features of each token: last word, word before it, both."""
    new = np.append(True, owner[1:] != owner[:-1])
    one = np.append(START, h[:-1])
    one[new] = START
    two = np.append(START, one[:-1])
    two[new] = START
    return np.stack((mix(one, 1), mix(two, 2), mix(one * np.uint64(3) ^ mix(two, 3), 4)))


def features(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows of the class weights for each token."""
    return class_rows(history(h, owner))


def class_rows(codes: np.ndarray) -> np.ndarray:
    part = (1 << ROW_BITS) // 3
    rows = [((c >> np.uint64(32)) * np.uint64(part) >> np.uint64(32)).astype(np.int64) + k * part for k, c in enumerate(codes)]
    return np.stack(rows, axis=1)


def class_shares(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probability of every class after each history."""
    s = weights.take(rows[:, 0], 0)
    s += weights.take(rows[:, 1], 0)
    s += weights.take(rows[:, 2], 0)
    s += bias
    np.clip(s, -60, 40, out=s)
    np.exp(s, out=s)
    s /= (s @ np.ones(CLASSES, s.dtype))[:, None]
    return s


def fit(docs: DataFrame, learn: Column, classes: Classes, rounds: int = ROUNDS) -> np.ndarray:
    """Class weights alone, see ``fit_both``."""
    return fit_both(docs, learn, classes, None, rounds)[0]


def fit_both(docs: DataFrame, learn: Column, classes: Classes, paths: Paths | None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and of paths after ``rounds`` of averaged gradient steps over all training texts."""
    spark = docs.sparkSession
    base = docs.where(learn).select(F.col("text").cast("string").alias("text"))
    weights = np.zeros((1 << ROW_BITS, CLASSES), np.float32)
    inner = paths.blank() if paths else np.zeros((0, FAN), np.float32)
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast((weights, inner, classes, paths))

        def add(batches: Iterator[pa.RecordBatch], total: np.ndarray, shipped=shipped) -> None:
            start, start_inner, known, paths = shipped.value
            top, low = _fresh(start), _fresh(start_inner)
            steps = 0
            for batch in batches:
                for _, _, texts in blocks(batch):
                    h, spelled, owner = tokens(texts)
                    codes, target = history(h, owner), known.of(h, spelled)
                    rows = class_rows(codes)
                    for a in range(0, len(h), STEP):
                        _descend(top, known.bias, rows[a : a + STEP], target[a : a + STEP])
                        steps += 1
                        if len(start_inner):
                            below = a + np.flatnonzero(target[a : a + STEP] >= OWN)
                            leaf = leaf_of(h[below], target[below], paths.levels)
                            _descend_paths(low, paths, codes[:, below], leaf)
            total[0] += 1 if steps else 0
            parts = (top[0] - start, low[0] - start_inner, low[1] > np.float32(FRESH))
            total[1:] += np.concatenate([p.ravel() for p in parts])

        change = summed(base, add, 1 + weights.size + inner.size + len(inner), np.float32)
        shipped.unpersist()
        own, below, saw = np.split(change[1:], np.cumsum([weights.size, inner.size]))
        weights = weights + (own / max(1.0, change[0])).reshape(weights.shape)
        inner = inner + below.reshape(inner.shape) / np.maximum(saw, 1)[:, None]
    return weights, inner


def _descend(state, bias, rows, target) -> None:
    """One step on the mean loss of the classes of some tokens."""
    gap = class_shares(state[0], bias, rows)
    gap[np.arange(len(rows)), target] -= 1
    _adagrad(*state, rows.T, gap)


def _descend_paths(state, paths: Paths, codes, leaf) -> None:
    """One step on the branches that some tokens take on the way to their leaves."""
    place, branch = paths.places(leaf)
    rows = paths.rows(codes, place).reshape(len(codes), -1)
    gap = branch_shares(state[0], paths, place, rows)
    gap[np.arange(len(gap)), branch.ravel()] -= 1
    _adagrad(*state, rows, gap)


def _fresh(start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights to step on, and by row the sum of squares and a count. New arrays: those of a broadcast are slow in add.at."""
    weights = np.zeros(start.shape, np.float32)
    weights[:] = start
    return weights, np.full(len(start), FRESH, np.float32), np.zeros(len(start), np.float32)


def _adagrad(weights, squares, many, rows, gap) -> None:
    """Add the gradient ``gap`` of some softmaxes to the rows of each feature, with one rate for each row.

    ``many``, zeros before and after, counts the uses of a row, by whose root its sum is divided.
    """
    flat = rows.ravel()
    size = (gap * gap) @ np.full(gap.shape[1], 1 / gap.shape[1], gap.dtype)
    np.add.at(squares, flat, np.tile(size, len(rows)))
    np.add.at(many, flat, np.float32(1))
    pairs = weights.reshape(-1).view(np.complex64)  # two weights an addition
    n, width = gap.shape
    cells = np.empty((n, width // 2), np.int64)
    for row in rows:
        pace = -RATE / len(rows) / np.sqrt(squares.take(row) * many.take(row))
        step = gap.reshape(-1) * np.repeat(pace, width)  # narrow rows: faster than by broadcasting
        first = row * (width // 2)
        for j in range(width // 2):
            np.add(first, j, out=cells[:, j])
        np.add.at(pairs, cells.reshape(-1), step.view(np.complex64))
    many[flat] = 0


def score(docs: DataFrame, learn: Column, more: dict[str, Column] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, ``more`` columns, n_tokens, n_known, train_tokens, base_score and score of every row, log10.

    ``learn`` marks the rows to learn from. Null and empty texts are their end token alone. Rows with repeated or null
    ids keep a row each, told apart by their text. If nothing is learned from, every
    token is unknown. An empty table gives no rows; other columns are not read.
    """
    more = more or {}
    names = list(more)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(k) for k, c in more.items()])
    counts = count_tokens(docs, learn)
    classes = Classes(counts)
    paths = Paths(counts, classes)
    weights, inner = fit_both(docs, learn, classes, paths, rounds)
    logs = np.log10(counts.hot_count + 1.0)
    model = (weights, inner, classes, paths, counts.hot, logs, counts.hot_count > 0)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded rows, and 1 / HOT_SHARE tokens at most
    tagged = base.select("*", F.hash("text").alias("tag"))

    def rare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shipped.value[4]
        for batch in batches:
            for a, b, texts in blocks(batch):
                h, _, owner = tokens(texts)
                keep = ~_find(hot, h)[1]
                h, owner = h[keep], owner[keep]
                if len(h):
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
                    n = np.diff(np.append(first, len(h))).astype(np.int32)
                    own = pa.array(a + owner[first])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[first].view(np.int64)), batch.column("doc_id").take(own), batch.column("tag").take(own), pa.array(n)],
                        names=["token", "doc_id", "tag", "m"],
                    )

    rare = tagged.select("doc_id", "tag", "text").mapInArrow(rare_rows, "token long, doc_id long, tag int, m int")
    sums = rare.join(counts.rare, "token").groupBy("doc_id", "tag").agg(
        F.sum(F.col("m") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known")
    )

    def model_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, inner, classes, paths, hot, hot_logs, hot_known = shipped.value
        own_mass, leaf_mass = (np.log10(np.maximum(m, 1e-300)) for m in (classes.mass, paths.mass))
        for batch in batches:
            for a, b, texts in blocks(batch):
                h, spelled, owner = tokens(texts)
                n = len(texts)
                at, found = _find(hot, h)
                known = np.bincount(owner, np.where(found, hot_known[at] if len(hot) else False, False), n).astype(np.int64)
                base_logs = np.bincount(owner, np.where(found, hot_logs[at] if len(hot) else 0.0, 0.0), n)
                codes, target = history(h, owner), classes.of(h, spelled)
                rows, logs = class_rows(codes), np.empty(len(h))
                for s in range(0, len(h), STEP):
                    part = class_shares(weights, classes.bias, rows[s : s + STEP])
                    logs[s : s + STEP] = part[np.arange(len(part)), target[s : s + STEP]]
                logs = np.log10(np.maximum(logs, 1e-30))
                below = np.flatnonzero(target >= OWN)
                leaf = leaf_of(h[below], target[below], paths.levels)
                for s in range(0, len(below) if paths.levels else 0, STEP):
                    part = path_shares(inner, paths, codes[:, below[s : s + STEP]], leaf[s : s + STEP])
                    logs[below[s : s + STEP]] += np.log10(np.maximum(part, 1e-30))
                mass = own_mass[target]
                mass[below] = leaf_mass[leaf]
                model = np.bincount(owner, logs - mass, n)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "tag", *names)), pa.array(np.bincount(owner, minlength=n)), pa.array(known), pa.array(base_logs), pa.array(model)],
                    names=["doc_id", "tag", *names, "n_tokens", "hot_known", "hot_logs", "model"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in tagged.schema}
    kept = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "tag", *names))
    out = tagged.select("doc_id", "tag", *names, "text").mapInArrow(model_rows, kept + ", n_tokens long, hot_known long, hot_logs double, model double")
    # Rows that repeat an id and a text have all their rare tokens in one sum: each takes its part of it.
    both = out.alias("o").join(sums.alias("s"), F.col("o.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("o.tag") == F.col("s.tag")), "left")
    both = both.withColumn("copies", F.count("*").over(Window.partitionBy("o.doc_id", "o.tag")))
    logs = F.col("hot_logs") + F.coalesce("logs", F.lit(0.0)) / F.col("copies")
    total = float(counts.n_tokens + counts.n_types + 1)
    return both.select(
        F.col("o.doc_id").alias("doc_id"), *names, "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0)) / F.col("copies")).cast("long").alias("n_known"),
        F.lit(counts.n_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total))).alias("base_score"), (logs + F.col("model")).alias("score"),
    )


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among sorted keys, and whether it is one of them."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h

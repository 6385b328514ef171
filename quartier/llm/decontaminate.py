"""Benchmark decontamination by greedy string tiling.

Test items and documents are compared as words in lower case, ASCII punctuation taken as blanks; in scripts without
blanks between words each character is a word. An item of fewer words than a seed is found by all its words in a run. The test set goes to
all tasks in blocks of bounded size, one pass over the documents a block, whatever the number of items. In a task the
documents' five-word seeds are joined with those of the items; a pair needs enough shared seeds to be able to reach
the threshold. Each pair left is tiled: the longest common runs that overlap no earlier one are marked, longest first,
found by running Karp-Rabin hashes over what is unmarked, until no run of five words is left. The share of an item's
words under tiles is its coverage, so passages count in whatever order they stand. A text of very many words is tiled
whole; a word or phrase that it repeats at will costs one entry a place, not one a pair of places.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.llm.text import Block, blocks, gram_hashes, id_text, powers

LEAST = 5
COVERAGE = 0.8
BLOCK_CHARS = 8_000_000  # of test items sent to the tasks at once
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_FILTER_BITS = 22
_BASE = 0xD1342543DE82EF95  # any odd number; 5 modulo 8 for a long period
_BASE_INVERSE = pow(_BASE, -1, 2**64)
# Thai to Lao, Myanmar, Khmer, kana, ideographs, halfwidth kana, further ideographs
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af])")


def plain(texts: list) -> list[bytes]:
    return [_spaced(t.lower()).encode().translate(_PLAIN) if t else b"" for t in texts]


def _spaced(text: str) -> str:
    return text if text.isascii() else _UNSPACED.sub(r" \1 ", text)


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` words without a mark."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(total[size:] == total[:-size])


class Rolling:
    """Karp-Rabin sums of a sequence of word hashes: the hash of any run from two of them."""

    def __init__(self, words: np.ndarray):
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(_BASE, len(words)), out=self.total[1:])
        self.back = powers(_BASE_INVERSE, len(words) + 1)

    def at(self, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return (self.total[start + size] - self.total[start]) * self.back[start]


def _room(marked: np.ndarray) -> np.ndarray:
    """Words from each position on up to a mark or the end."""
    here = np.arange(len(marked))
    return np.minimum.accumulate(np.where(marked, here, len(marked))[::-1])[::-1] - here


def tile(text: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(text start, item start, length) of greedy tiles between two sequences of word hashes.

    Always the longest common run without a mark comes next, of equally long ones that which starts first in the item,
    then in the text. Runs are looked for from long to short, so that few are held at once.
    """
    in_text, in_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    sums = Rolling(text), Rolling(item)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(text)) // 2)
    while min(len(item), len(text)) >= size:
        a, b, length = _runs(text, item, sums, in_text, in_item, size)
        longest = int(length.max(initial=0))
        if longest > 2 * size:  # a long run: look again with a longer hash, so that few short ones are held
            size = longest
            continue
        tiles += _mark(a, b, length, size, in_text, in_item)
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


def _runs(text, item, sums, in_text, in_item, size):
    """Maximal common runs of unmarked words of at least ``size``: text starts, item starts, lengths.

    Only starts of runs are paired: places of one hash are sorted by the word before them, and a place of the item
    skips those with its own word before them. So a word repeated at will gives no pair inside a longer run.
    """
    none = np.empty(0, np.int64)
    at, of = _free(in_text, size), _free(in_item, size)
    if not len(at) or not len(of):
        return none, none, none
    grams, gram = np.unique(sums[1].at(of, size), return_inverse=True)
    hashes = sums[0].at(at, size)
    found = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
    hit = grams[found] == hashes
    at, found = at[hit], found[hit]
    words, before = np.unique(item[np.maximum(of - 1, 0)], return_inverse=True)
    before = np.where((of > 0) & ~in_item[np.maximum(of - 1, 0)], before + 1, 0)  # 0: no word before, skips nothing
    p = np.maximum(at - 1, 0)
    own = np.minimum(np.searchsorted(words, text[p]), len(words) - 1)
    own = np.where((at > 0) & ~in_text[p] & (words[own] == text[p]), own + 1, 0)
    wide = len(words) + 1
    key = found * wide + own
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    low, high = np.searchsorted(key, gram * wide), np.searchsorted(key, (gram + 1) * wide)
    skip = np.where(before > 0, np.searchsorted(key, gram * wide + before), high)
    after = np.where(before > 0, np.searchsorted(key, gram * wide + before, "right"), high)
    low, n = np.concatenate([low, after]), np.concatenate([skip - low, high - after])
    b = np.repeat(np.concatenate([of, of]), n)
    a = at[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    if not len(a):
        return none, none, none
    most = np.minimum(_room(in_text)[a], _room(in_item)[b])
    length = np.full(len(a), size)
    step = 1 << max(0, int(most.max()) - size).bit_length()
    while step := step >> 1:  # lengths grow by halving steps as long as the hashes agree
        grows = np.flatnonzero(length + step <= most)
        i, j = a[grows] + length[grows], b[grows] + length[grows]
        length[grows[sums[0].at(i, step) == sums[1].at(j, step)]] += step
    return a, b, length


def _mark(a, b, length, size, in_text, in_item) -> list[tuple[int, int, int]]:
    """Mark runs, longest first; what is left of a run that was covered in part goes back into the queue."""
    tiles: list[tuple[int, int, int]] = []
    found, left = _longest_first(a, b, length), []
    run = next(found, None)
    while run or left:
        if left and (run is None or left[0] < run):
            n, j, i = heapq.heappop(left)
        else:
            (n, j, i), run = run, next(found, None)
        n = -n
        taken = in_text[i : i + n] | in_item[j : j + n]
        if not taken.any():
            in_text[i : i + n] = in_item[j : j + n] = True
            tiles.append((i, j, n))
            if not len(_free(in_item, size)):
                break
            continue
        room = _room(taken)
        starts = np.flatnonzero((room >= size) & np.concatenate(([True], taken[:-1])))
        for k in starts.tolist():
            heapq.heappush(left, (-int(room[k]), j + k, i + k))
    return tiles


def _longest_first(a, b, length) -> Iterator[tuple[int, int, int]]:
    """(-length, item start, text start) in order."""
    order = np.lexsort((a, b, -length))
    for k in range(0, len(order), 4096):
        at = order[k : k + 4096]
        yield from zip((-length[at]).tolist(), b[at].tolist(), a[at].tolist())


class Items:
    """A block of test items: word hashes, and an index from seed to the items that hold it."""

    def __init__(self, texts: list, least: int):
        block = Block(plain(texts))
        words = block.word_hashes()
        self.words = [words[a:b] for a, b in zip(block.first[:-1], block.first[1:])]
        self.size = block.n_words
        grams = gram_hashes(words, least)
        last = np.repeat(block.first[:-1] + block.n_words - least, block.n_words)[: len(grams)]
        at = np.flatnonzero(np.arange(len(grams)) <= last)
        pairs = np.unique(np.rec.fromarrays([grams[at], block.doc[at]], names="gram,item")) if len(at) else None
        gram = pairs["gram"] if pairs is not None else np.empty(0, np.uint64)
        self.item = pairs["item"] if pairs is not None else np.empty(0, np.int64)
        self.seeds, first = np.unique(gram, return_index=True)
        self.first = np.append(first, len(gram))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True
        self.short = {}  # by number of words below ``least``: sorted hashes of whole items, and the items
        for n in range(1, least):
            of = np.flatnonzero(self.size == n)
            if len(of):
                whole = gram_hashes(words, n)[block.first[of]]
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], of[order]


class Tiler:
    """Finds the test items that a text covers; built once per task."""

    def __init__(self, items: Items, coverage: float, least: int):
        self.items, self.coverage, self.least = items, coverage, least
        need = np.ceil(items.size * coverage - 1e-9)
        # tiles over ``need`` words in runs of ``least`` or more hold at least so many distinct or repeated seeds;
        # a seed that an item repeats counts once, so one is enough there
        self.need = np.maximum(1, np.ceil(need / least))

    def find(self, texts: list) -> list[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(text, item, coverage, tiles) of each pair that reaches the threshold."""
        items, least = self.items, self.least
        block = Block(plain(texts))
        words = block.word_hashes()
        grams = gram_hashes(words, least)
        at = np.flatnonzero(items.filter[grams >> np.uint64(64 - _FILTER_BITS)])
        seed = np.searchsorted(items.seeds, grams[at])
        hit = seed < len(items.seeds)
        at, seed = at[hit], seed[hit]
        hit = (items.seeds[seed] == grams[at]) & (at + least <= block.first[1:][block.doc[at]])
        at, seed = at[hit], seed[hit]
        doc = block.doc[at]
        pairs = np.unique(doc * (len(items.seeds) + 1) + seed)
        doc, seed = pairs // (len(items.seeds) + 1), pairs % (len(items.seeds) + 1)
        n = items.first[seed + 1] - items.first[seed]
        item = items.item[np.repeat(items.first[seed] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pairs, shared = np.unique(np.repeat(doc, n) * len(items.words) + item, return_counts=True)
        out = []
        for pair, many in zip(pairs.tolist(), shared.tolist()):
            d, i = divmod(pair, len(items.words))
            if many < self._least_seeds(i):
                continue
            tiles = tile(words[block.first[d] : block.first[d + 1]], items.words[i], least)
            covered = sum(t[2] for t in tiles) / items.size[i]
            if covered >= self.coverage - 1e-9:
                out.append((d, i, float(covered), sorted(tiles)))
        for n, (whole, of) in items.short.items():
            out += self._short(block, words, n, whole, of)
        return out

    @staticmethod
    def _short(block: Block, words: np.ndarray, n: int, whole: np.ndarray, of: np.ndarray) -> list:
        """The first run in each text that is a whole item of ``n`` words."""
        grams = gram_hashes(words, n)
        doc = block.doc[: len(grams)]
        low, high = np.searchsorted(whole, grams, "left"), np.searchsorted(whole, grams, "right")
        at = np.flatnonzero((high > low) & (np.arange(len(grams)) + n <= block.first[1:][doc]))
        _, first = np.unique(np.rec.fromarrays([doc[at], grams[at]], names="doc,gram"), return_index=True)
        return [
            (int(doc[p]), int(i), 1.0, [(int(p - block.first[doc[p]]), 0, n)])
            for p in at[first].tolist()
            for i in of[low[p] : high[p]]
        ]

    def _least_seeds(self, i: int) -> float:
        words = self.items.words[i]
        return self.need[i] if len(np.unique(gram_hashes(words, self.least))) == len(words) - self.least + 1 else 1


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list]]:
    """Ids and texts of the test items in blocks of about ``block_chars``; null and empty items never match."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield table.column("item_id").to_pylist(), table.column("text").to_pylist()


TILE = "struct<doc_start:int,item_start:int,length:int>"
PAIRS = f"doc_id long, item_id long, coverage double, n_tiles int, tiles array<{TILE}>"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """A row for each document and test item it covers: doc_id, item_id, coverage, tiles (in words).

    Clean documents have no row. Null and empty texts match nothing. Items of fewer than ``least`` words match as a whole.
    Repeated documents and items each give their rows; null ids are kept. With either table empty there are no rows.
    """
    spark = docs.sparkSession
    tile_type = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
    out = spark.createDataFrame([], PAIRS)
    for ids, texts in item_blocks(benchmark, block_chars):
        shipped = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, texts = shipped.value
            tiler = Tiler(Items(texts, least), coverage, least)
            for batch in batches:
                for a, b, part in blocks(batch):
                    found = tiler.find(part)
                    if found:
                        rows = [[{"doc_start": i, "item_start": j, "length": n} for i, j, n in f[3]] for f in found]
                        own = batch.column("doc_id").take(pa.array([a + f[0] for f in found]))
                        yield pa.RecordBatch.from_arrays(
                            [
                                own, pa.array([ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found]),
                                pa.array([len(r) for r in rows], pa.int32()), pa.array(rows, tile_type),
                            ],
                            names=["doc_id", "item_id", "coverage", "n_tiles", "tiles"],
                        )

        out = out.unionByName(id_text(docs).mapInArrow(run, PAIRS))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """The rows and columns of ``docs`` that cover no test item; rows are judged one by one, without a shuffle."""
    out, spark = docs, docs.sparkSession
    for _, texts in item_blocks(benchmark):
        shipped = spark.sparkContext.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            tiler = Tiler(Items(shipped.value, least), coverage, least)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, part in blocks(batch):
                    keep[[a + f[0] for f in tiler.find(part)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out

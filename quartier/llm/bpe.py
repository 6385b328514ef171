"""Byte-pair encoding and decoding by a pair occurrence index.

The distinct pre-tokens of an Arrow batch are laid end to end as one array of symbols. An index maps each
mergeable pair to all its positions; active ranks are applied in ascending order, each to all its positions
at once, and only the lists of the pairs next to a merge change. Texts then take their ids from the table of
distinct pre-tokens. No shuffle; a task holds one batch.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quartier.llm.text import id_text

# Fixed value of the tokenizer family: white space is dropped, pieces are contractions, letters, one digit, others.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
END = "</w>"
ROWS_OUT = 512  # rows of a result batch, which hold more than the texts
NONE = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return [chr(hidden.get(b, b)) for b in range(256)]


def ranges(of: Callable[[str], bool], top: int = 0x10000) -> str:
    """The characters below ``top`` for which ``of`` holds, as ranges of a character class."""
    holds = np.fromiter((of(chr(c)) for c in range(top)), bool, top)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], holds.astype(np.int8), [0]))))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in edges.reshape(-1, 2).tolist())


def piece_finders() -> tuple[Callable, Callable]:
    """``findall`` for texts of the basic plane, by the standard library's faster classes, and for all texts."""
    kinds = {k: ranges(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN"}
    blank = regex.compile(r"\p{White_Space}").match
    basic = re.compile(PIECES.format(S=ranges(lambda c: blank(c) is not None), **kinds)).findall
    return basic, regex.compile(PIECES.format(S=r"\p{White_Space}", L=r"\p{L}", N=r"\p{N}")).findall


def load(path: str) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file, as plain data small enough to ship with a task."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    made = {}
    for rank, (_, _, c) in enumerate(merges.tolist()):
        made[c] = max(made.get(c, -1), rank)
    for rank, (a, b, _) in enumerate(merges.tolist()):
        if max(made.get(a, -1), made.get(b, -1)) > rank:
            raise ValueError("a merge stands before one of its parts; ranks can't be applied in ascending order")
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for name, i in chain(vocab.items(), special.items()):
        names[i] = name
    inner = np.array([vocab[c] for c in alphabet], np.int32)
    last = np.array([vocab[c + END] for c in alphabet], np.int32)
    return {"merges": merges, "inner": inner, "last": last, "names": names, "special": special}


class PairIndex:
    """Merge ranks by pair, and the merging of many words at once."""

    def __init__(self, spec: dict):
        self.merges, self.inner, self.last = spec["merges"], spec["inner"], spec["last"]
        key = self.merges[:, 0] << 32 | self.merges[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and the offset of each word in them."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = np.append(self.inner[raw], -1)  # the last slot ends every chain
        sym[ends - 1] = self.last[raw[ends - 1]]
        nxt = np.arange(1, n + 2, dtype=np.int64)
        nxt[ends - 1] = n
        prv = np.arange(-1, n, dtype=np.int64)
        prv[ends - lengths] = n
        nxt[n] = prv[n] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[nxt[at] != n] if len(at) else at
            ranks = self.rank(sym[at], sym[nxt[at]])
            known = ranks != NONE
            at, ranks = at[known], ranks[known]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cut.tolist(), len(at)]
            for r, a, b in zip(ranks[[0, *cut.tolist()]].tolist(), bounds[:-1], bounds[1:]):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(active, r)

        if n:
            add(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b, c = self.merges[r].tolist()
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[alive[at]]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at) > 1:  # of touching pairs every second one goes, from the left
                at = np.unique(at)
                joined = np.append(False, nxt[at[:-1]] == at[1:])
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(joined, 0, place))
                at = at[(place - run) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], alive[gone], nxt[at] = c, False, after
            prv[after] = at
            prv[n] = n
            left = prv[at]
            add(np.concatenate((left[left != n], at)))
        keep = np.flatnonzero(alive[:n])
        return sym[keep], np.searchsorted(keep, np.concatenate(([0], ends)))


class Encoder:
    """Encodes lists of texts; built once per task."""

    def __init__(self, spec: dict):
        self.index = PairIndex(spec)
        self.names = [s.encode() for s in spec["names"]]
        self.special = spec["special"]
        self.basic, self.full = piece_finders()
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def pretokens(self, text: str) -> list[str]:
        """Pieces of one text; a special token in it stands alone, as its own piece marked by its id."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list = []
        for k, part in enumerate(self.cut.split(text)):
            out += [self.special[part]] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: one character at a time
        text = text.lower()
        return self.basic(text) if text.isascii() or max(text) < "\U00010000" else self.full(text)

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        table: dict = defaultdict(count().__next__)
        put = table.__getitem__
        owned = [np.array(list(map(put, self.pretokens(t))), np.int64) if t else np.empty(0, np.int64) for t in texts]
        plain = [(k, i) for k, i in table.items() if isinstance(k, str)]
        ids, offset = self.index.encode([k.encode() for k, _ in plain])
        start, size = np.zeros(len(table), np.int64), np.ones(len(table), np.int64)
        own = np.fromiter((i for _, i in plain), np.int64, len(plain))
        start[own], size[own] = offset[:-1], np.diff(offset)
        marks = [(k, i) for k, i in table.items() if not isinstance(k, str)]
        for extra, (k, i) in enumerate(marks):
            start[i] = len(ids) + extra
        ids = np.concatenate((ids, np.array([k for k, _ in marks], np.int32)))
        out = []
        for at in owned:
            sizes = size[at]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(at) else 0
            out.append(ids[np.repeat(start[at] - ends + sizes, sizes) + np.arange(total)].astype("<u4"))
        return out

    def decode(self, ids) -> bytes:
        """The names of the ids, one blank between: what a tokenizer file without a decoder asks for."""
        names = self.names
        return b" ".join([names[i] for i in ids])


def _map(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(load(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            if batch.num_rows:
                coded = encoder.encode(batch.column("text").to_pylist())
                for a in range(0, len(coded), ROWS_OUT):
                    ids = batch.column("doc_id").slice(a, ROWS_OUT)
                    yield pa.RecordBatch.from_arrays([ids, *row(encoder, coded[a : a + ROWS_OUT])], names=NAMES[schema])

    return id_text(docs).mapInArrow(run, schema)


ENCODED = "doc_id long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NAMES = {s: [c.split()[0] for c in s.split(", ")] for s in (ENCODED, DIGEST)}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and their decoded text for every document.

    Null and empty texts have no ids and decode to the empty string; rows with equal or null ids stay apart; an
    empty table gives no rows; other columns are not read.
    """

    def row(encoder: Encoder, coded: list[np.ndarray]):
        lists = pa.array([c.astype(np.int32) for c in coded], pa.list_(pa.int32()))
        return lists, pa.array([encoder.decode(c.tolist()).decode() for c in coded], pa.string())

    return _map(docs, path, ENCODED, row)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, and SHA-256 of ids and decoded text; rows as in ``encode``."""

    def row(encoder: Encoder, coded: list[np.ndarray]):
        return (
            pa.array([len(c) for c in coded], pa.int64()),
            pa.array([hashlib.sha256(c.tobytes()).hexdigest() for c in coded], pa.string()),
            pa.array([hashlib.sha256(encoder.decode(c.tolist())).hexdigest() for c in coded], pa.string()),
        )

    return _map(docs, path, DIGEST, row)

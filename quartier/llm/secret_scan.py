"""Secret scans through a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: what any match must hold. Each block of texts
is indexed in its task (trigram -> postings of texts, letters folded), the posting lists are intersected and joined
as the query says, and the rule's pattern runs only over the whole texts that are left. A rule without mandatory
trigrams scans every text. The index is split by block like the rows, so nothing is shuffled and no posting list
outgrows its block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.llm.text import LOWER, blocks, id_text, utf8


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` has fewer than ``least`` characters drop."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds, in the order that breaks ties. A run of 16 or more hex digits is the same as a run
# that is dropped when shorter, and so is a key of 18 or more characters, as no shorter match can hide a longer one.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
# The header, headers of an encrypted key, and base64 lines up to the END line, or to the last base64 line without one.
# Line breaks may be written as escapes. A line has 16 characters or more, but for the last one before the END line.
_BREAK = r"(?:[\x20\t]*(?:\r?\n|\\r\\n|\\n))+[\x20\t]*"
_STOP = r"""(?=[\x20\t]*(?:[\r\n"'`\\]|-----END |\Z))"""
_KEY = (
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    rf"(?:{_BREAK}(?:Proc-Type|DEK-Info|Version|Comment|Hash):[^\r\n\\]*)*"
    rf"(?:{_BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}}{_STOP})*"
    rf"(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}={{0,2}}(?={_BREAK}(?:=[A-Za-z0-9+/]{{4}}{_BREAK})?-----END )|{_BREAK}[A-Za-z0-9+/]{{2,15}}={{1,2}}{_STOP})?"
    rf"(?:{_BREAK}=[A-Za-z0-9+/]{{4}}{_STOP})?"
    rf"(?:(?:{_BREAK})?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?"
)
# Publicly documented shapes of further secrets.
MORE = [
    Rule("private_key", _KEY),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google_api", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\s:/@]+:[^\s:/@]{3,}@"),
]
RULES = [*BASE, *MORE]
MAX_EXACT = 64

# Queries are None (anything), a trigram, ("and", {...}) or ("or", {...}).


def _all(*parts):
    kept = frozenset().union(*(p[1] if isinstance(p, tuple) and p[0] == "and" else [p] for p in parts if p is not None))
    return None if not kept else next(iter(kept)) if len(kept) == 1 else ("and", kept)


def _any(parts):
    parts = set(parts)
    if None in parts or not parts:
        return None
    return parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings) -> object:
    """All trigrams of one of the strings."""
    return _any(_all(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings)


def _folded(text: str) -> bytes:
    return text.encode().translate(LOWER)


def _walk(tree) -> tuple[set[bytes] | None, object]:
    """For a sequence: the finite set of its strings if small, and a query that any match meets."""
    found = []
    whole = True
    run: set[bytes] = {b""}

    def append(strings: set[bytes] | None, query) -> None:
        nonlocal run, whole
        if strings is not None and len(run) * len(strings) <= MAX_EXACT:
            run = {a + b for a in run for b in strings}
            return
        found.append(_of_strings(run))
        if strings is None or len(strings) > MAX_EXACT:
            found.append(query)
            run = {b""}
        else:
            run = set(strings)
        whole = False

    for kind, arg in tree:
        if kind is op.LITERAL:
            append({_folded(chr(arg))}, None)
        elif kind is op.IN:
            append(_letters(arg), None)
        elif kind is op.BRANCH:
            parts = [_walk(branch) for branch in arg[1]]
            sets = [p[0] for p in parts]
            strings = None if None in sets else set().union(*sets)
            append(strings, _any(p[1] for p in parts))
        elif kind is op.SUBPATTERN:
            append(*_walk(arg[3]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = arg
            strings, query = _walk(inner)
            if low == 0 and high == 1 and strings is not None:
                append(strings | {b""}, None)
            elif low == 0:
                append(None, None)
            else:
                for _ in range(min(low, 3)):
                    append(strings, query)
                if high != low or low > 3:
                    append(None, None)
        elif kind is op.AT:
            continue
        else:
            append(None, None)
    if whole:
        return run, _of_strings(run)
    found.append(_of_strings(run))
    return None, _all(*found)


def _letters(items) -> set[bytes] | None:
    """The folded characters of a small class."""
    out: set[bytes] = set()
    for kind, arg in items:
        if kind is op.LITERAL:
            out.add(_folded(chr(arg)))
        elif kind is op.RANGE and arg[1] - arg[0] < MAX_EXACT:
            out |= {_folded(chr(c)) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def trigram_query(pattern: str):
    """The Boolean trigram query of a pattern, over folded text; None if it has no mandatory trigram."""
    return _walk(_parser.parse(pattern))[1]


def _trigrams(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class Index:
    """Postings of the wanted trigrams over the texts of a block."""

    def __init__(self, wanted: list[bytes]):
        self.number = np.zeros(1 << 24, np.uint16)
        self.wanted = {t: k + 1 for k, t in enumerate(wanted)}
        for t, k in self.wanted.items():
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = k
        self.first = np.zeros(256, bool)
        self.first[[t[0] for t in wanted]] = True
        self.second = np.zeros(256, bool)
        self.second[[t[1] for t in wanted]] = True

    def build(self, texts: list[bytes]) -> None:
        self.all = np.arange(len(texts))
        buf = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        at = np.flatnonzero(self.first[buf[:-2]] & self.second[buf[1:-1]]) if len(buf) > 2 else np.empty(0, np.int64)
        code = buf[at].astype(np.int32) << 16 | buf[at + 1].astype(np.int32) << 8 | buf[at + 2]
        number = self.number[code]
        hit = np.flatnonzero(number)
        number, doc = number[hit], np.searchsorted(ends, at[hit], side="right")
        order = np.argsort(number, kind="stable")
        number, doc = number[order], doc[order]
        bounds = np.searchsorted(number, np.arange(1, len(self.wanted) + 2))
        self.postings = [np.unique(doc[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]

    def candidates(self, query) -> np.ndarray:
        """Texts that meet the query, by intersecting and joining postings."""
        if query is None:
            return self.all
        if isinstance(query, bytes):
            return self.postings[self.wanted[query] - 1]
        lists = sorted((self.candidates(q) for q in query[1]), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


class Scanner:
    """All spans of the rules in lists of texts; built once per task."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII)) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = Index(sorted(set().union(*map(_trigrams, self.queries))))

    def spans(self, texts: list) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each text in order; code points, end exclusive."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        self.index.build(utf8(texts))
        for k, ((rule, pattern), query) in enumerate(zip(self.rules, self.queries)):
            for i in self.index.candidates(query).tolist():
                text = texts[i]
                if not text:
                    continue
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


def scan(docs: DataFrame, rules: list[Rule] | None = None, base: int = len(BASE)) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> by start, then rule order, and per-kind base counts.

    Null text counts as empty and gives no span; every input row gives one row, repeated rows and null ids too; an
    empty table gives no rows. ``base`` is the number of leading rules that the base digest covers.
    """
    rules = RULES if rules is None else rules
    kinds = [r.kind for r in rules]
    counted = "".join(f", n_{k} long" for k in kinds[:base])
    schema = f"doc_id long{counted}, base_sha256 string, spans array<struct<kind:string,start:int,end:int>>"
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for a, b, texts in blocks(batch):
                found = scanner.spans(texts)
                counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(base)]
                digest = [",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in f if k < base) for f in found]
                out = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in f] for f in found]
                sha = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in digest], pa.string())
                ids = batch.column("doc_id").slice(a, b - a)
                names = ["doc_id", *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([ids, *counts, sha, pa.array(out, span_type)], names=names)

    return id_text(docs).mapInArrow(run, schema)


def joined(spans):
    """The spans column as ``kind:start:end``, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def redact(docs: DataFrame, rules: list[Rule] | None = None, mark: str = "[{kind}]") -> DataFrame:
    """The same rows and columns, each found span replaced by its kind; ``n_chars``, if there, is counted anew.

    Overlapping spans are replaced as one, under the kind that starts first. Null text stays null.
    """
    rules = RULES if rules is None else rules
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for a, b, texts in blocks(batch):
                part = batch.slice(a, b - a)
                clean = [_cut(t, f, rules, mark) for t, f in zip(texts, scanner.spans(texts))]
                columns = dict(zip(part.schema.names, part.columns))
                columns["text"] = pa.array(clean, part.schema.field("text").type)
                if "n_chars" in columns:
                    kept = columns["n_chars"].to_pylist()
                    counts = [n if c is t else len(c) for n, c, t in zip(kept, clean, texts)]
                    columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def _cut(text, spans, rules, mark):
    if not spans:
        return text
    out, done, until = [], 0, 0
    for start, k, end in spans:
        if start >= until:
            out += [text[done:start] if start >= done else "", mark.format(kind=rules[k].kind)]
        until = done = max(until, end)
    return "".join([*out, text[done:]])

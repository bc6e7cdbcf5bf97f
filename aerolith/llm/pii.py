"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans, which always stay. Around them a random field
labels tokens with O or one of KINDS. Its nodes are the tokens that hold a digit
or an at sign; its factors are

    shape   what a token looks like (digits, separators, checksum)
    chain   two such tokens that follow each other
    skip    two tokens of the same digits, or the same address, however far apart
    near    two tokens of 7 to 19 digits that differ in one of them, or two
            addresses with the same name at other places, however far apart

Tokens of base spans are observed. Loopy belief propagation passes messages over
a document at a time, so that an entity that a pattern found in one place pulls
its other mentions to the same label. A token whose belief in a kind reaches ADD
becomes a span if it could be one of that kind at all. A connected part of a
document's field without evidence (no observed token and none whose shape alone
speaks for a kind) keeps O throughout and is left out of the passing.

Potentials are fitted piecewise: each factor's table is a smoothed log
likelihood from counts over all documents, labelled by the base spans. Factor
names are a few hundred, whatever the corpus.

A document's field is arrays of small numbers: some 20 bytes for each token, and
about 200 for each token of a connected part with evidence while messages pass.

Defined cases: null text counts as empty and has no spans; a text of any length
is read whole; equal tokens are linked in a row, each with the one before, so a
token repeated n times has n - 1 skip factors, and a token has one near factor at
most, with the last one that is similar; spans that touch a base span are not
added; repeated rows and equal texts get the same spans each; an empty table
gives an empty result; other columns are not read, and a column of documents
named like a result's does not matter.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.text import whole_id
from aerolith.plans.staging import bounded_batches
from aerolith.plans.workers import tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
PAIRS = (">chain", ">skip", ">near")
ROUNDS, DAMPING, SMOOTH, ADD = 10, 0.5, 0.5, 0.9
#: Digits of numbers that can be near others, and messages that are worked out at once.
NEAR_DIGITS, AT_ONCE = (7, 19), 1 << 15

#: The base patterns. Possessive repeats match the same and keep no record of every turn.
_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),  # a match never starts inside a run of digits
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_FIRST = re.compile(r"[A-Za-z0-9+(]")
_LAST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789)")
_OTHERS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))
    digits = _OTHERS.sub("", text)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """(kind number, start, end) of what the patterns find, by kind, then start."""
    out: list[Span] = []
    if not _HINT.search(text):
        return out
    for k, kind in enumerate(KINDS):
        if (kind == "email" and "@" not in text) or (kind == "phone" and "+" not in text):
            continue
        pattern = _PATTERNS[kind]
        if kind == "email":
            out.extend((k, i, j) for i, j in _emails(text))
        else:
            out.extend((k, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m[0]))
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, looked for around at signs: a match starts where the run of local characters before one does."""
    end, at = 0, text.find("@")
    while at >= 0:
        i = at
        while i > end and text[i - 1] in _LOCAL:
            i -= 1
        m = _PATTERNS["email"].match(text, i) if i < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


class Spans:
    """Base spans of one text, to look up which kind covers a place; spans of a kind do not overlap."""

    def __init__(self, base: list[Span]) -> None:
        self._of: dict[int, tuple[list[int], list[int]]] = {}
        for kind, i, j in base:
            starts, ends = self._of.setdefault(kind, ([], []))
            starts.append(i)
            ends.append(j)

    def label(self, i: int, j: int) -> int:
        """1 + the first kind with a span that overlaps i:j, or 0."""
        for kind, (starts, ends) in self._of.items():
            k = bisect_right(ends, i)
            if k < len(starts) and starts[k] < j:
                return 1 + kind
        return 0


def _trim(token: str) -> tuple[int, int]:
    """Where a token starts and ends without the marks around it; an empty range if it is nothing else."""
    m = _FIRST.search(token)
    i, j = (m.start() if m else len(token)), len(token)
    while j > i and token[j - 1] not in _LAST:
        j -= 1
    return i, j


def shape(token: str) -> str:
    """What a token looks like: kind of characters, number of digits and checksums, in a few values."""
    digits = _OTHERS.sub("", token)
    n = len(digits)
    if "@" in token:
        head, _, tail = token.rpartition("@")
        return f"at:{bool(head)}:{'.' in tail.strip('.')}:{bool(tail)}"
    parts = token.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        return f"quad:{_valid('ip', token)}"
    letters = any(c.isalpha() for c in token)
    sums = luhn(digits) if 16 <= n <= 19 else ""
    return f"n:{n if n <= 20 else 21}:{letters}:{token.startswith('+')}:{'(' in token}:{'-' in token}:{'.' in token}:{sums}"


_short_shape = lru_cache(maxsize=1 << 12)(shape)


def _before(keys: np.ndarray) -> np.ndarray:
    """For each key the last place before it with an equal one, or -1."""
    out = np.full(len(keys), -1, np.int32)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


class Field:
    """Tokens of a document that hold a digit or an at sign, and what links each with one before it."""

    def __init__(self, text: str, base: list[Span], shapes: dict[str, int]) -> None:
        """``shapes`` numbers the shapes that occur and grows with new ones."""
        start, end, kind, seen, follows = array("i"), array("i"), array("i"), array("b"), array("b")
        content, number, digits, name = array("q"), array("Q"), array("b"), array("q")
        if _HINT.search(text):
            spans, last = Spans(base), -1
            for m in _TOKEN.finditer(text):
                if not _HINT.search(m[0]):
                    continue
                first, stop = _trim(m[0])
                if first == stop:
                    continue
                token, i = m[0][first:stop], m.start() + first
                start.append(i)
                end.append(m.start() + stop)
                kind.append(shapes.setdefault(_short_shape(token) if len(token) <= 24 else shape(token), len(shapes)))
                seen.append(spans.label(i, m.start() + stop))
                follows.append(last >= 0 and text[last : m.start()].isspace())
                last = m.end()
                at, own = "@" in token, _OTHERS.sub("", token)
                content.append(hash(token.lower() if at else own))
                long = not at and NEAR_DIGITS[0] <= len(own) <= NEAR_DIGITS[1]
                number.append(int(own) if long else 0)
                digits.append(len(own) if long else 0)
                name.append(hash(token.lower().rpartition("@")[0]) if at else 0)
        self.start, self.end, self.shape = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (start, end, kind))
        self.seen, self.follows = (np.frombuffer(x, np.int8) if x else np.zeros(0, np.int8) for x in (seen, follows))
        self.same, self.near = np.zeros(0, np.int32), np.zeros(0, np.int32)
        if len(self.start):
            self.same = _before(np.frombuffer(content, np.int64))
            self.near = self._near(np.frombuffer(number, np.uint64), np.frombuffer(digits, np.int8), np.frombuffer(name, np.int64))

    def __len__(self) -> int:
        return len(self.start)

    def _near(self, number: np.ndarray, digits: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The last similar token before each that has no equal one: one digit apart, or the same name at another place."""
        out = np.full(len(number), -1, np.int32)
        addresses = np.flatnonzero(name)
        if len(addresses) > 1:
            found = _before(name[addresses])
            out[addresses[found >= 0]] = addresses[found[found >= 0]]
        for n in np.unique(digits[digits > 0]).tolist():
            own = np.flatnonzero(digits == n)
            values = number[own]
            for k in range(n):
                ten = np.uint64(10**k)
                found = _before(values - values // ten % np.uint64(10) * ten)
                other = (found >= 0) & (values != values[found])
                out[own[other]] = np.maximum(out[own[other]], own[found[other]].astype(np.int32))
        out[self.same >= 0] = -1
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second token of each factor on two, and its number in PAIRS."""
        parts = [(k, np.flatnonzero(has), before[has]) for k, (has, before) in enumerate((
            (self.follows > 0, np.arange(-1, len(self) - 1, dtype=np.int32)), (self.same >= 0, self.same), (self.near >= 0, self.near),
        ))]
        second = np.concatenate([p[1] for p in parts]).astype(np.int32)
        return np.concatenate([p[2] for p in parts]).astype(np.int32), second, np.repeat(np.arange(len(parts), dtype=np.int8), [len(p[1]) for p in parts])


@dataclass
class Potentials:
    """Log potentials: of each shape [label], and of the factors of PAIRS [label, label]."""

    shapes: dict[str, np.ndarray]
    pairs: np.ndarray

    @classmethod
    def from_counts(cls, counts: Counter) -> Potentials:
        """counts: of (shape, label) and (name in PAIRS, label, label)."""
        n = len(LABELS)
        shapes: dict[str, np.ndarray] = {}
        pair = {name: np.full((n, n), SMOOTH) for name in PAIRS}
        for key, c in counts.items():
            if key[0] in pair:
                pair[key[0]][key[1], key[2]] += c
            else:
                shapes.setdefault(key[0], np.full(n, SMOOTH / n))[key[1]] += c
        tables = [np.log(p / p.sum()) - np.log(p.sum(1, keepdims=True) / p.sum()) - np.log(p.sum(0, keepdims=True) / p.sum()) for p in pair.values()]
        return cls({k: np.log(v / v.sum()) for k, v in shapes.items()}, np.stack(tables))

    def own(self, shapes: dict[str, int]) -> np.ndarray:
        """Rows for numbered shapes; one that was never counted is O for the most part."""
        unknown = np.log(np.array([0.9] + [0.1 / (len(LABELS) - 1)] * (len(LABELS) - 1)))
        return np.stack([self.shapes.get(x, unknown) for x in shapes]) if shapes else np.zeros((0, len(LABELS)))


def _evident(n: int, first: np.ndarray, second: np.ndarray, speaks: np.ndarray) -> np.ndarray:
    """Which of n tokens are in a connected part with evidence; ``speaks`` tells which tokens have some."""
    root = np.arange(n, dtype=np.int32)
    while True:  # roots hook onto lesser ones, then all paths are made short
        low, high = np.minimum(root[first], root[second]), np.maximum(root[first], root[second])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    has = np.zeros(n, bool)
    has[root[speaks]] = True
    return has[root]


def beliefs(field: Field, model: Potentials, own: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities [token, label] after loopy message passing over a document; ``own`` are the potentials of its shapes."""
    n, k = len(field), len(LABELS)
    out = np.zeros((n, k), np.float32)
    out[:, 0] = 1
    speaks = (field.seen > 0) | (own[:, 1:].max(1) > own[:, 0])[field.shape] if n else np.zeros(0, bool)
    if not speaks.any():
        return out
    first, second, kind = field.links()
    live = np.flatnonzero(_evident(n, first, second, speaks))
    number = np.full(n, -1, np.int32)
    number[live] = np.arange(len(live))
    node = own[field.shape[live]].astype(np.float32)
    seen = field.seen[live]
    node[seen > 0] = -50.0
    node[seen > 0, seen[seen > 0]] = 0.0
    some = number[first] >= 0  # then the other end is live as well
    first, second, kind = number[first[some]], number[second[some]], kind[some]
    total, m, pairs = node.copy(), len(first), model.pairs.astype(np.float32)
    sent = np.zeros((2 * m, k), np.float32)  # to the second of each link, then to the first
    for _ in range(rounds if m else 0):
        for way, (src, back) in enumerate(((first, m), (second, 0))):
            for lo in range(0, m, AT_ONCE):
                hi = min(m, lo + AT_ONCE)
                table = pairs[kind[lo:hi]]
                x = (total[src[lo:hi]] - sent[back + lo : back + hi])[:, :, None] + (table.transpose(0, 2, 1) if way else table)
                top = x.max(1)
                new = top + np.log(np.exp(x - top[:, None]).sum(1))
                new -= new.max(1, keepdims=True)
                at = slice((m if way else 0) + lo, (m if way else 0) + hi)
                sent[at] = DAMPING * sent[at] + (1 - DAMPING) * new
        for label in range(k):
            total[:, label] = node[:, label] + np.bincount(second, sent[:m, label], len(live)) + np.bincount(first, sent[m:, label], len(live))
    p = np.exp(total - total.max(1, keepdims=True))
    out[live] = p / p.sum(1, keepdims=True)
    return out


def _possible(kind: str, text: str) -> bool:
    """Whether an added span can be of this kind: what a pattern would want, less its strictness."""
    digits = len(_OTHERS.sub("", text))
    if kind == "email":
        return 0 < text.find("@") < len(text) - 1
    if kind == "ip":
        return _PATTERNS["ip"].fullmatch(text) is not None and _valid("ip", text)
    letters = any(c.isalpha() for c in text)
    return not letters and (16 <= digits <= 19 if kind == "card" else 7 <= digits <= 15)


def added_spans(texts: list[str], bases: list[list[Span]], model: Potentials) -> list[list[Span]]:
    """For each text the spans that the random field adds to its base spans."""
    return [_added(text, base, model) for text, base in zip(texts, bases, strict=True)]


def _added(text: str, base: list[Span], model: Potentials) -> list[Span]:
    shapes: dict[str, int] = {}
    field = Field(text, base, shapes)
    if not len(field):
        return []
    p = beliefs(field, model, model.own(shapes))
    label = np.where((p.max(1) >= ADD) & (field.seen == 0), p.argmax(1), 0)
    spans, out = Spans(base), []
    run: list[int] = []

    def place(first: int, last: int) -> tuple[int, int]:
        return int(field.start[first]), int(field.end[last])

    def close() -> None:
        if run:
            kind, (i, j) = int(label[run[0]]) - 1, place(run[0], run[-1])
            if not spans.label(i, j) and _possible(KINDS[kind], text[i:j]):
                out.append((kind, i, j))
        run.clear()

    for node in np.flatnonzero(label).tolist():
        joined = run and field.follows[node] and node - 1 == run[-1] and label[node] == label[run[-1]]
        if joined:
            kind = KINDS[int(label[node]) - 1]
            (i, j), (_, before) = place(run[0], node), place(run[0], run[-1])
            joined = _possible(kind, text[i:j]) or not _possible(kind, text[i:before])
        if not joined:
            close()
        run.append(node)
    close()
    return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of factors of a partition under the labels of the base spans: (name, left, right, n)."""
    n, shapes = len(LABELS), {}
    alone: Counter = Counter()
    pairs = np.zeros((len(PAIRS), n, n), np.int64)
    for b in batches:
        for text in b.column(0).to_pylist():
            field = Field(text, base_spans(text), shapes)
            alone.update(dict(enumerate(np.bincount(field.shape.astype(np.int64) * n + field.seen).tolist())))
            first, second, kind = field.links()
            np.add.at(pairs, (kind, field.seen[first], field.seen[second]), 1)
    rows = [(list(shapes)[k // n], k % n, 0, c) for k, c in alone.items() if c] if shapes else []
    rows += [(PAIRS[k], a, b, int(pairs[k, a, b])) for k, a, b in zip(*np.nonzero(pairs), strict=True)]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["name", "a", "b", "n"])


def train(docs: DataFrame) -> Potentials:
    """Fit the potentials on all documents; the counts, one row for each factor's name and labels, reach the driver."""
    bounded_batches(docs.sparkSession)
    some = docs.where(F.col("text").rlike("[0-9@]")).select("text")  # others have no token
    rows = some.mapInArrow(tidy(_observe), "name string, a int, b int, n long").groupBy("name", "a", "b").agg(F.sum("n").alias("n")).collect()
    counts = Counter()
    for r in rows:
        counts[(r["name"], r["a"], r["b"]) if r["name"][0] == ">" else (r["name"], r["a"])] += r["n"]
    return Potentials.from_counts(counts)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in sorted(spans))


def _find(shared):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, shared.value)
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in bases], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(shown(s).encode()).hexdigest() for s in bases], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, sha, pa.array([shown(x + y) for x, y in zip(bases, more, strict=True)], pa.string())], names=names
            )

    return run


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans (kind:start:end in code points) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # a few hundred shapes
    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return docs.select(whole_id(docs), "text").mapInArrow(tidy(_find(shared)), schema)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the outer ends count and the first kind stands."""
    out, at, merged = [], 0, []
    for k, i, j in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and i < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], j)
        else:
            merged.append([k, i, j])
    for k, i, j in merged:
        out += [text[at:i], f"[{KINDS[k].upper()}]"]
        at = j
    return "".join([*out, text[at:]])


def _mask(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(text_at).to_pylist()
            texts = [t or "" for t in given]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, shared.value)
            clean = [None if g is None else mask(t, x + y) for g, t, x, y in zip(given, texts, bases, more, strict=True)]
            yield b.set_column(text_at, b.schema.names[text_at], pa.array(clean, b.schema.types[text_at]))

    return run


def mask_rows(docs: DataFrame) -> DataFrame:
    """All rows of docs with personal data masked in text; n_chars, if there is such a column, is counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    out = docs.mapInArrow(tidy(_mask(shared, docs.columns.index("text"))), T.StructType(docs.schema.fields))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out

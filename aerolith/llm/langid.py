"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts, of order ORDER at most,
with escape probabilities by method C: a byte that was seen in a context of T
bytes and D different ones has probability count / (T + D); the escape to the
next shorter context has D / (T + D); below order 0 all bytes are alike. A byte
is coded in the longest context that the language has seen. The statistics are
frozen after training, nothing of them is left out, and a text's score in a
language is its exact code length, the sum over its bytes of -log2 of their
probabilities.

The trees of all languages are sorted arrays, two for each order: contexts with
the bits of their escapes, and contexts with a byte and its bits, each with the
languages that have seen them. They are one file that workers map. Every
different string of ORDER + 1 bytes of a batch is looked up once, from the
shortest context to the longest, in all languages together.

What trains is a sample of about TRAIN_BYTES of text, an equal part for each
language, so the file and what reaches the driver are bounded for any number of
languages: a byte of the sample adds ORDER + 1 entries at most.

Defined cases: null text, and text without a letter, is ``und`` with score 0;
rows without language do not train; with nothing to train on all is ``und``;
equal code lengths go to the language first in order; repeated rows are scored
each and train as often as they occur; a text of any length is read whole, in
pieces of GROUP bytes; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.mapped import map_arrays, pack_arrays
from aerolith.llm.sampling import spot
from aerolith.llm.text import flat, whole_id
from aerolith.plans.sharing import share_file
from aerolith.plans.staging import bounded_batches, stage_table
from aerolith.plans.workers import tidy

#: Longest context, in bytes.
ORDER = 5
#: Bytes of text that train, over all languages; beyond it, texts are left out by hash of their id.
TRAIN_BYTES = 8 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
GROUP, CELLS = 1 << 20, 1 << 22
#: Bytes that are looked at for letters at once.
LETTERS = 1 << 16
#: Languages up to this number are broadcast to the rows that may train.
BROADCAST_LANGS = 10_000
#: Bytes whose strings are counted at once.
COUNTED = 4 << 20
_SLOT_BITS = 21


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that never trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def strings(raw: np.ndarray, at: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For each byte from start to stop a number made of it and the ORDER bytes before it in its text.

    The byte itself comes first and the one before it next, so in sorted order
    strings with a longer context in common stand together. Newlines stand before
    a text's first byte.
    """
    i, j = np.searchsorted(at, start, "right") - 1, np.searchsorted(at, stop, "left")
    begins = np.repeat(np.maximum(at[i:j], start - ORDER), np.diff(np.clip(at[i : j + 1], start, stop)))
    room = np.minimum(np.arange(start, stop) - begins, ORDER).astype(np.int8)  # bytes before this one in its text
    before = np.concatenate([np.full(max(0, ORDER - start), 10, np.uint8), raw[max(0, start - ORDER) : stop]])
    out = np.zeros(stop - start, np.uint64)
    for back in range(ORDER + 1):
        out <<= np.uint64(8)
        out |= np.where(room >= back, before[ORDER - back : ORDER - back + stop - start], 10).astype(np.uint64)
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, sorted, and each element's place among them; hash slots find most of them."""
    slot = (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int32)
    held = np.zeros(1 << _SLOT_BITS, np.uint64)
    held[slot] = x
    used = np.zeros(1 << _SLOT_BITS, bool)
    used[slot] = True
    number = np.cumsum(used, dtype=np.int32) - 1
    place = number[slot]
    lost = np.flatnonzero(held[slot] != x)
    more, inverse = np.unique(x[lost], return_inverse=True)
    place[lost] = int(number[-1]) + 1 + inverse
    found = np.concatenate([held[used], more])
    order = np.argsort(found)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return found[order], rank[place]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, string as a number, count) for each piece of a language's texts in a batch."""
    for b in batches:
        langs = np.array(b.column(0).to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            raw, at = flat(b.column(1).filter(pa.array(langs == lang)))
            for start in range(0, len(raw), COUNTED):
                grams, n = np.unique(strings(raw, at, start, min(start + COUNTED, len(raw))), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"]
                )


def _table(parts: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """One sorted array of keys from those (keys, bits) of each language; entries (language, bits) of a key stand together."""
    keys = np.concatenate([k for k, _ in parts])
    lang = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(k) for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return {"key": distinct, "at": np.append(first, len(keys)).astype(np.int64), "lang": lang[order], "bits": np.concatenate([x for _, x in parts])[order]}


def compile_trees(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """The trees of languages, in sorted order of their names, from their strings and how often each occurred."""
    out: dict[str, np.ndarray] = {}
    for order in range(ORDER + 1):
        seen, escapes = [], []
        for lang in sorted(counts):
            grams, n = counts[lang]
            key, inverse = np.unique(grams >> np.uint64(8 * (ORDER - order)), return_inverse=True)
            times = np.bincount(inverse, n, len(key))
            context, own = np.unique(key & np.uint64((1 << 8 * order) - 1), return_inverse=True)
            kinds = np.bincount(own, minlength=len(context))
            whole = np.bincount(own, times, len(context)) + kinds
            seen.append((key, -np.log2(times / whole[own]).astype(np.float32)))
            escapes.append((context, -np.log2(kinds / whole).astype(np.float32)))
        for name, parts in (("seen", seen), ("escape", escapes)):
            out |= {f"{name}{order}_{k}": v for k, v in _table(parts).items()}
    return out


class ContextTrees:
    """Frozen statistics of all languages as sorted arrays."""

    def __init__(self, langs: list[str], arrays: dict[str, np.ndarray]) -> None:
        self.langs, self._arrays = langs, {k: np.asarray(v) for k, v in arrays.items()}

    def _entries(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the keys, language, bits) of all entries that a table has for keys."""
        table, at = self._arrays[f"{name}_key"], self._arrays[f"{name}_at"]
        k = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        hit = np.flatnonzero(table[k] == keys)
        first, n = at[k[hit]], at[k[hit] + 1] - at[k[hit]]
        entry = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hit) else first
        return np.repeat(hit, n), self._arrays[f"{name}_lang"][entry], self._arrays[f"{name}_bits"][entry]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the byte of each string in its context, in each language; strings are sorted and different.

        Every order works on its own different strings alone, and starts from the bits of the order below.
        """
        out = np.full((1, len(self.langs)), 8.0, np.float32)  # below order 0 all bytes are alike
        below = np.zeros(len(grams), np.int64)
        for order in range(ORDER + 1):
            key = grams >> np.uint64(8 * (ORDER - order))
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            own = key[new]
            out = out[below[new]]
            row, lang, bits = self._entries(f"escape{order}", own & np.uint64((1 << 8 * order) - 1))
            out[row, lang] += bits
            row, lang, bits = self._entries(f"seen{order}", own)
            out[row, lang] = bits
            below = np.cumsum(new) - 1
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        raw, at = flat(texts)
        step = max(1 << 12, CELLS // max(1, len(self.langs)))
        for start in range(0, len(raw), GROUP):
            own, place = _distinct(strings(raw, at, start, min(start + GROUP, len(raw))))
            bits = self.bits(own)
            for lo in range(start, min(start + GROUP, len(raw)), step):
                part = bits[place[lo - start : min(lo - start + step, GROUP)]]
                i, j = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, lo + len(part), "left")
                cuts = np.clip(at[i:j] - lo, 0, len(part))
                has = np.diff(np.append(cuts, len(part))) > 0
                if has.any():
                    out[i:j][has] += np.add.reduceat(part, cuts[has], axis=0, dtype=np.float64)
        return out


@lru_cache(maxsize=1)
def _mapped(file: str, langs: tuple[str, ...]) -> ContextTrees:
    return ContextTrees(list(langs), map_arrays(SparkFiles.get(file)))


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> tuple[list[str], bytes]:
    """Languages and the file of their trees, from rows with a language that are not held out: about ``train_bytes`` of text.

    The sample is a share of the hash range of the id, so it spreads over all
    of the table. What reaches the driver are counts of strings of that sample.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = stage_table(rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("__n")), "language-sizes")
    langs = sizes.count()
    share = F.lit(train_bytes / max(1, langs)) / F.greatest(F.col("__n"), F.lit(1))
    sizes = F.broadcast(sizes) if langs <= BROADCAST_LANGS else sizes
    some = rows.select("doc_id", "lang", "text").join(sizes, "lang").where(F.coalesce(spot(F.col("doc_id")), F.lit(0.0)) < share).select("lang", "text")
    found = some.mapInArrow(tidy(_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = found.column("lang").combine_chunks().dictionary_encode()
    code, names = np.asarray(langs.indices), langs.dictionary.to_pylist()
    grams, n = np.asarray(found.column("gram")).astype(np.uint64), np.asarray(found.column("n"))
    counts = {names[k]: (grams[code == k], n[code == k]) for k in range(len(names))}
    return sorted(counts), pack_arrays(compile_trees(counts)) if counts else b""


def _has_letter(texts: pa.Array) -> np.ndarray:
    """Which texts have a letter, looked for a piece at a time."""
    raw, at = flat(texts)
    piece = lambda k, end: raw[k : min(k + LETTERS + 3, end)].tobytes().decode("utf-8", "ignore")  # noqa: E731  a character cut at an edge is whole in the next piece
    return np.array([any(_LETTER.search(piece(k, j)) for k in range(i, j, LETTERS)) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], bool)


def _predict(file: str, langs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _mapped(file, langs) if langs else None
        for b in batches:
            known = _has_letter(b.column(1))
            lang = np.full(len(known), UNKNOWN, dtype=object)
            score = np.zeros(len(known))
            if trees and known.any():
                bits = trees.lengths(b.column(1) if known.all() else b.column(1).filter(pa.array(known)))
                lang[known] = np.array(langs, dtype=object)[bits.argmin(1)]
                score[known] = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], bytes]) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of the language under equal priors) of every whole text."""
    langs, content = model
    file = share_file(docs.sparkSession, content, "context-trees") if langs else ""
    return docs.select(whole_id(docs), "text").mapInArrow(tidy(_predict(file, tuple(langs))), "doc_id long, lang_pred string, score double")

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, vectorised over the bytes of
a batch, and staged as a small table. A bounded sample of labelled rows trains
the trees on the driver: each feature is cut into at most BINS quantile bins and
splits come from histograms of gradients. Fitted trees are flattened into arrays
(feature, threshold, child, leaf value) that numpy walks for all rows of a batch
at once, one step of depth at a time.

Defined cases: null and empty texts have all-zero statistics and get a score
like any other; a text of any length is measured whole; documents without label,
or with a null one, do not train; a document with several labels, or a repeated
one, trains with each; repeated rows are scored each; equal gains of splits go to
the feature and bin first in order; without both labels the score is the share of
1s (0.5 with no label at all); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.sampling import spot
from aerolith.llm.text import groups, lower_ascii, spans_hash, whole_id, windows_hash, words
from aerolith.plans.staging import bounded_batches, stage_table
from aerolith.plans.workers import tidy

#: The most labelled rows that train; beyond, a share of the hash range of the id is taken.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 60, 4, 64, 0.15, 1.0
#: Rows on either side of a split: a hundredth of the rows that train, within these limits.
LEAST = (3, 20)
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "distinct_words", "repeated_words", "upper", "lower", "digit", "newline", "stop",
    "comma", "bang", "symbol", "pipe", "not_ascii", "line_words", "repeated_lines", "symbol_words", "upper_words",
)


def held_out(doc_id: Column) -> Column:
    """The fifth of documents that never trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = {
    "upper": _class(bytes(range(65, 91))), "lower": _class(bytes(range(97, 123))), "digit": _class(b"0123456789"), "newline": _class(b"\n"),
    "stop": _class(b"."), "comma": _class(b","), "bang": _class(b"!?"), "symbol": _class(b"#*$%&<>{}[]\\^~=@"), "pipe": _class(b"|"),
    "not_ascii": _class(bytes(range(128, 256))),
}


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x between neighbouring offsets."""
    c = np.concatenate([[0], np.cumsum(x)])
    return c[at[1:]] - c[at[:-1]]


def _repeats(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, how many of its hashes equal another one of the same text that stands before them in sorted order."""
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, own))
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])]) if len(h) else np.zeros(0, bool)
    return np.bincount(own[order][same], minlength=len(at) - 1).astype(np.float64)


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """FEATURES of each text of a flat byte array."""
    n = len(at) - 1
    size = np.diff(at).astype(np.float64)
    starts, stops, word_at = words(raw, at)
    n_words = np.diff(word_at).astype(np.float64)
    low = lower_ascii(raw)
    h = spans_hash(low, starts, stops)
    length = stops - starts
    per_byte, per_word = np.maximum(size, 1), np.maximum(n_words, 1)
    out = {k: _sums(c[raw], at) / per_byte for k, c in _CLASSES.items()}
    three = windows_hash(h, 3)
    inside = np.repeat(np.arange(n), np.diff(word_at))
    whole = inside[: len(three)] == inside[2:] if len(three) else np.zeros(0, bool)
    three_at = np.concatenate([[0], np.cumsum(np.bincount(inside[: len(three)][whole], minlength=n))])
    line_starts, line_stops, line_at = _lines(raw, at)
    odd = _CLASSES["symbol"][raw]
    odd_sum = np.concatenate([[0], np.cumsum(odd)])
    big_sum = np.concatenate([[0], np.cumsum(_CLASSES["upper"][raw])])
    out |= {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n_words), "word_bytes": _sums(length, word_at) / per_word,
        "long_words": _sums(length > 12, word_at) / per_word, "distinct_words": 1 - _repeats(h, word_at) / per_word,
        "repeated_words": _repeats(three[whole], three_at) / per_word, "line_words": n_words / np.maximum(np.diff(line_at), 1),
        "repeated_lines": _repeats(spans_hash(raw, line_starts, line_stops), line_at) / np.maximum(np.diff(line_at), 1),
        "symbol_words": _sums(odd_sum[stops] > odd_sum[starts], word_at) / per_word,
        "upper_words": _sums((big_sum[stops] - big_sum[starts]) >= 2, word_at) / per_word,
    }
    return np.stack([out[f] for f in FEATURES], 1).astype(np.float32)


def _lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the lines of each text that are not empty."""
    own = at[:-1][np.diff(at) > 0]
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([own, breaks + 1]))
    starts = starts[starts < len(raw)]
    stops = np.append(starts[1:], len(raw))
    stops = stops - (raw[stops - 1] == 10) if len(starts) else stops[:0]
    keep = stops > starts
    starts, stops = starts[keep], stops[keep]
    return starts, stops, np.searchsorted(starts, at)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(raw, at) for _, _, raw, at in groups(b.column(1))] or [np.zeros((0, len(FEATURES)), np.float32)]
        flat = pa.array(np.concatenate(x).ravel())
        values = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(FEATURES)), flat)
        yield pa.RecordBatch.from_arrays([b.column(0), values], names=["doc_id", "features"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every whole text, staged."""
    bounded_batches(docs.sparkSession)
    return stage_table(docs.select(whole_id(docs), "text").mapInArrow(tidy(_measure), "doc_id long, features array<float>"), "quality-features")


@dataclass
class Trees:
    """Trees as arrays of shape [tree, node]; nodes of a level stand side by side, node k's children are 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all rows walk a tree together."""
        margin = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value) + 1)) - 1):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            margin += value[node]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2) -> Trees:
    """Boost trees of log loss on histograms of binned features."""
    nodes, leaves = 2 ** (depth + 1) - 1, 2**depth
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    out = Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return out
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    n, f = x.shape
    least = max(LEAST[0], min(LEAST[1], n // 100))
    margin = np.full(n, out.base)
    feature, threshold, value = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feat, thr, val = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * f + np.arange(f)) * bins + binned
            g, h, c = (np.bincount(key.ravel(), np.repeat(w, f), width * f * bins).reshape(width, f, bins).cumsum(2) for w in (grad, hess, np.ones(n)))
            all_g, all_h, all_c = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(c < least) | (all_c - c < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            ok = gain.reshape(width, -1).max(1) > 1e-9
            cut_f, cut_b = best // bins, best % bins
            for k in np.flatnonzero(ok):
                if cut_b[k] < len(edges[cut_f[k]]):
                    feat[first + k], thr[first + k] = cut_f[k], edges[cut_f[k]][cut_b[k]]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        leaf = node - (leaves - 1)
        val[leaves - 1 :] = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        margin += val[node]
        feature.append(feat)
        threshold.append(thr)
        value.append(val)
    return Trees(np.stack(feature), np.stack(threshold), np.stack(value), out.base)


def train(features: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Fit on labelled rows that are not held out; about ``most`` of them reach the driver."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("y"))
    share = min(1.0, most / max(1, known.count()))
    some = known.where(spot(F.col("doc_id")) < share)
    rows = features.join(some, "doc_id").select("features", "y").toArrow()
    x = np.array(rows.column("features").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows.column("y").to_pylist(), np.float64))


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(FEATURES))
            p = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (of label 1) and predicted for every document."""
    features = measure(docs)
    shared = docs.sparkSession.sparkContext.broadcast(train(features, labels, most))
    scored = features.mapInArrow(tidy(_score(shared, threshold)), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

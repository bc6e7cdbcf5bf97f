"""Texts of an Arrow batch as flat byte arrays, and hashes of their words.

Everything works on whole texts; a batch is cut into groups of rows of about
``GROUP_BYTES`` so that the arrays stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_BYTES = 1 << 20

#: Odd multiplier of the rolling hash, its inverse modulo 2**64, and the multiplier that joins words.
_Q = 0x9E3779B97F4A7C15
_Q_INV = pow(_Q, -1, 1 << 64)
_JOIN = np.uint64(0xD1342543DE82EF95)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(kind: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of the multiplier (0) or of its inverse (1), kept between calls."""
    if len(_powers[kind]) < n:
        base = np.full(n, (_Q, _Q_INV)[kind], np.uint64)
        base[0] = 1
        _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole_id(rows: DataFrame, column: str = "doc_id") -> Column:
    """A column of ids of any integer type as longs; ids of other types raise a TypeError."""
    kind = rows.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{column} is of type {kind.simpleString()}; ids have to be integers")
    return F.col(column).cast("long")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets into them; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of about ``most`` bytes."""
    raw, at = flat(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; none reaches over the end of a text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = at[1:][at[:-1] < at[1:]] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of each text, and n + 1 offsets of words by text.

    A word is a run of bytes other than ASCII space and 0x09-0x0D.
    """
    starts, stops = runs(~_SPACE[raw], at)
    return starts, stops, np.searchsorted(starts, at)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def spans_hash(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(0, len(raw)), out=sums[1:])
        h = (sums[stops] - sums[starts]) * _power(1, len(raw))[starts]
        return mix(h + (stops - starts).astype(np.uint64) * _JOIN)


def windows_hash(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, width):
            out = out * _JOIN + h[k : k + n]
        return mix(out)

"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best fit: a fixed number of bins is open at a time; a
bitset has bit f set while an open bin has f free places, so the tightest bin
that a piece fits is one shift and one lowest-set-bit away. When too many bins
are open the fullest closes. Every piece is placed as it arrives, and stays
where it was placed; nothing is sorted by length.

Only lengths and checksums are shuffled, never the ids: documents are tokenised
where they are read, and light rows are dealt to packers by hash of the document
and arrive in the order of that hash.

Defined cases: a null text counts as empty and an empty text is the end mark
alone; a text of any length is read whole; of equally full bins the last one
touched is taken; repeated rows are packed as often as they occur; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.text import whole_id
from aerolith.plans.staging import bounded_batches, stage_table
from aerolith.plans.workers import tidy

SEQUENCE = 2048
OPEN_BINS = 4096
PIECES_PER_PACKER = 200_000
END_ID = 0

_TOKENS = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{_TOKENS}, sequence_id long, offset long"


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """The byte-level vocabulary of a tokenizers file as a tiktoken encoding, and its special strings."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = byte_symbols()
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    encoding = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return encoding, frozenset(special)


@lru_cache(maxsize=2)
def _slow_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text. A run of over a million blanks is too long for the faster library's search; the other one cuts it."""
    encoding, special = byte_encoder(path)
    try:
        return encoding.encode_to_numpy(text, allowed_special=special)
    except ValueError:
        return np.array(_slow_encoder(path).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than size."""
    first = n % size or size
    return [(0, min(n, first)), *((s, size) for s in range(first, n, size))]


def _tokenise(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", path), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    for column, v in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


class BestFit:
    """Open bins by free space; place() gives (bin, offset)."""

    def __init__(self, size: int, open_bins: int, first: int = 0) -> None:
        self._size, self._most, self._next = size, open_bins, first
        self._bits, self._open = 0, 0
        self._by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _pop(self, free: int) -> int:
        bins = self._by_free[free]
        b = bins.pop()
        if not bins:
            self._bits ^= 1 << free
        self._open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        fits = self._bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._pop(free)
        else:
            free, b = self._size, self._next
            self._next += 1
        left = free - length
        if left:
            self._by_free[left].append(b)
            self._bits |= 1 << left
            self._open += 1
            if self._open > self._most:
                self._pop((self._bits & -self._bits).bit_length() - 1)
        return b, self._size - free


def _pack(size: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        bins = BestFit(size, open_bins, part << 40)
        for b in batches:
            placed = np.array([bins.place(n) for n in b.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield b.append_column("sequence_id", pa.array(placed[:, 0].copy())).append_column("offset", pa.array(placed[:, 1].copy()))

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, open_bins: int = OPEN_BINS, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Pieces of every document with the sequence and the offset that each gets.

    The number of packers follows the number of pieces, so a packer's work and
    the few bins it leaves unfilled do not depend on the size of the corpus.
    """
    bounded_batches(docs.sparkSession)
    pieces = stage_table(docs.select(whole_id(docs), "text").mapInArrow(tidy(_tokenise(tokenizer, size)), _TOKENS), "packing-pieces")
    packers = max(1, -(-pieces.count() // per_packer))
    order = F.xxhash64("doc_id", F.lit(5))  # ids often follow sources, and so lengths
    dealt = pieces.repartition(packers, "doc_id", "piece", "ids_crc32").sortWithinPartitions(order, "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(tidy(_pack(size, open_bins)), PACKED)


def fill(packed: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """One row: pieces, sequences, tokens and the least number of sequences that could hold them."""
    return packed.agg(
        F.count("*").alias("pieces"), F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens"),
        F.ceil(F.sum("length") / F.lit(size)).alias("bound"),
    )

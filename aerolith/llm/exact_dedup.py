"""Exact deduplication by Grace hashing.

Records are partitioned by bits of a content hash; a bucket whose distinct texts
fit a memory budget goes through an open-addressing table that compares complete
contents, so equal hashes never merge different texts. A bucket that turns out
larger while it is read is given back, and the records given back are partitioned
again, from the files they were spilled to, by further bits of the hash, until
every bucket fits. Each level is a Spark shuffle into a table in the shared
folder, so a lost executor costs its tasks alone, and the driver only learns how
many records are left.

Before the first shuffle every map task collapses equal texts of a chunk of its
own rows. A text that a third of all rows share therefore reaches its bucket once
per chunk and not once per row. What a chunk collapsed is written once, with the
number of each row's group, so outcomes find their rows by those numbers and the
input is read a single time.

Defined cases: a null text counts as empty; an empty text is a text like any
other; a text of any length is one record, and a bucket may be over the budget
by one text; of equal ids in a group one row stays; repeated rows are members of
a group like any others; a null id is below every other id; an empty table gives
an empty result; further columns ride along untouched (their names may not begin
with two underscores and grace).
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.plans.staging import bounded_batches, stage_table
from aerolith.plans.workers import tidy

#: Bytes of distinct text that one bucket may hold.
BUCKET_BYTES = 24 << 20
#: Rows and bytes of text that a map task collapses at once.
CHUNK_ROWS, CHUNK_BYTES = 50_000, 16 << 20
#: Buckets into which one level deals its records at most, and into which each bucket that is too large is dealt again.
FAN_OUT, AGAIN = 20_000, 64
#: Rows of a batch that tells what has come of chunks' groups.
OUTCOMES = 100_000
#: From this level on buckets are taken whole: records that so many hashes do not part have equal contents, but for chance.
LEVELS = 8

_H, _GROUP, _N, _SHA, _STAYS, _WINS, _LEFT, _BUCKET, _ALIAS = (f"__grace_{c}" for c in ("hash", "group", "rows", "sha", "stays", "wins", "left", "bucket", "alias"))
_OUTCOME = (("keep_id", pa.int64()), ("group_size", pa.int64()), (_WINS, pa.bool_()), (_ALIAS, pa.int64()))


class OpenAddressing:
    """Contents in a power-of-two table with linear probing; equal only if all bytes are."""

    def __init__(self) -> None:
        self._slots = [-1] * 1024
        self._hashes: list[int] = []
        self._contents: list[bytes] = []

    def __len__(self) -> int:
        return len(self._contents)

    def find_or_add(self, h: int, content: bytes) -> int:
        """The number of this content, a new one if no stored content is equal."""
        mask = len(self._slots) - 1
        at = h & mask
        while (k := self._slots[at]) >= 0:
            if self._hashes[k] == h and self._contents[k] == content:
                return k
            at = (at + 1) & mask
        self._slots[at] = k = len(self._contents)
        self._hashes.append(h)
        self._contents.append(content)
        if 2 * len(self._contents) > len(self._slots):
            self._grow()
        return k

    def _grow(self) -> None:
        self._slots = [-1] * (4 * len(self._slots))
        mask = len(self._slots) - 1
        for k, h in enumerate(self._hashes):
            at = h & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = k


def _id_key(v: int | None) -> tuple[bool, int]:
    return (v is not None, v or 0)


def _contents(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _collapse(chunk: pa.Table, id_col: str, text_col: str) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """For each row its number in the chunk; for each number the row that stays, the rows it has and its hash."""
    table, stays, counts, hashes, number = OpenAddressing(), [], [], [], np.empty(chunk.num_rows, np.int64)
    ids = chunk.column(id_col).to_pylist()
    for i, content in enumerate(_contents(chunk.column(text_col).combine_chunks())):
        h = xxhash.xxh3_64_intdigest(content)
        k = number[i] = table.find_or_add(h, content)
        if k == len(stays):
            stays.append(i)
            counts.append(0)
            hashes.append(h - (1 << 64) if h >> 63 else h)
        elif _id_key(ids[i]) > _id_key(ids[stays[k]]):
            stays[k] = i
        counts[k] += 1
    return number, stays, counts, hashes


def _group_ids() -> Iterator[int]:
    """Numbers that no other task of the stage gives."""
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    yield from range(first, first + (1 << 36))


def _members(id_col: str, text_col: str):
    """Every row with the number of its chunk's group; the row that stays for the chunk carries the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _group_ids()
        for chunk in _chunks(batches):
            number, stays, counts, hashes = _collapse(chunk, id_col, text_col)
            texts = chunk.column(text_col).combine_chunks()
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in _contents(texts.take(pa.array(stays, pa.int64())))], pa.string())
            ids = pa.array([next(numbers) for _ in stays], pa.int64())
            mark = np.zeros(chunk.num_rows, bool)
            mark[stays] = True
            at, mark = pa.array(number), pa.array(mark)
            yield from pa.table({
                id_col: chunk.column(id_col), text_col: pc.if_else(mark, pc.fill_null(texts, ""), None), _GROUP: ids.take(at),
                _H: pa.array(hashes, pa.int64()).take(at), _N: pa.array(counts, pa.int64()).take(at), _SHA: sha.take(at), _STAYS: mark,
            }).to_batches()

    return run


def _first_copies(id_col: str, text_col: str):
    """The rows that stay for their chunk, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _group_ids()
        for chunk in _chunks(batches):
            _, stays, counts, hashes = _collapse(chunk, id_col, text_col)
            out = chunk.take(pa.array(stays, pa.int64()))
            out = out.append_column(_GROUP, pa.array([next(numbers) for _ in stays], pa.int64()))
            out = out.append_column(_H, pa.array(hashes, pa.int64())).append_column(_N, pa.array(counts, pa.int64()))
            yield from out.to_batches()

    return run


class _Bucket:
    """The records of one bucket while they are read: settled by a table, or given back once their texts are too many.

    Of equal contents only the record with the largest id is held. When a bucket is
    given back that record stands for all so far, and each of the others leaves an
    alias: whatever comes of the record's group comes of theirs.
    """

    def __init__(self, id_col: str, text_col: str, most: int | None, rows: bool) -> None:
        self._id, self._text, self._most, self._rows = id_col, text_col, most, rows
        self._over = False
        self._empty()

    def _empty(self) -> None:
        self._table, self._bytes = OpenAddressing(), 0
        self._best: list[tuple] = []  # (key of the id, group) of each content
        self._total: list[int] = []
        self._groups, self._numbers = array("q"), array("q")  # every record's group, and the number of its content
        self._held: list[pa.RecordBatch] = []
        self._held_bytes = 0

    def add(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Take records in; yields what is given back."""
        if self._over:
            yield self._outcome(b, left=True)
            return
        ids, groups, hashes, counts = (b.column(c).to_pylist() for c in (self._id, _GROUP, _H, _N))
        new: list[int] = []
        for i, content in enumerate(_contents(b.column(self._text))):
            k = self._table.find_or_add(hashes[i] & ((1 << 64) - 1), content)
            key = (_id_key(ids[i]), groups[i])
            if k == len(self._best):
                self._best.append(key)
                self._total.append(0)
                self._bytes += len(content)
                new.append(i)
            elif key[0] > self._best[k][0]:
                self._best[k] = key
                new.append(i)
            self._total[k] += counts[i]
            self._groups.append(groups[i])
            self._numbers.append(k)
        if new:
            own = b.take(pa.array(new, pa.int64()))
            self._held.append(own)
            self._held_bytes += own.nbytes
            if self._held_bytes > 2 * BUCKET_BYTES:
                self._held = self._stay().to_batches()
                self._held_bytes = sum(x.nbytes for x in self._held)
        if self._most is not None and self._bytes > self._most and len(self._table) > 1:
            self._over = True
            stay = self._stay()
            total = {g: n for (_, g), n in zip(self._best, self._total, strict=True)}
            merged = pa.array([total[g] for g in stay.column(_GROUP).to_pylist()], pa.int64())
            stay = stay.set_column(stay.schema.get_field_index(_N), _N, merged)
            for x in stay.to_batches():
                yield self._outcome(x, left=True)
            if not self._rows:
                for lo in range(0, len(self._numbers), OUTCOMES):
                    own = zip(self._groups[lo : lo + OUTCOMES], self._numbers[lo : lo + OUTCOMES], strict=True)
                    pairs = [(g, self._best[k][1]) for g, k in own if self._best[k][1] != g]
                    yield self._rows_of(stay.schema, {_GROUP: [g for g, _ in pairs], _ALIAS: [t for _, t in pairs], _LEFT: [False] * len(pairs)})
            self._empty()

    def _stay(self) -> pa.Table:
        held = pa.Table.from_batches(self._held)
        return held.filter(pc.is_in(held.column(_GROUP), pa.array([g for _, g in self._best], pa.int64())))

    def _outcome(self, b: pa.RecordBatch, left: bool) -> pa.RecordBatch:
        out = b.append_column(_LEFT, pa.array(np.full(b.num_rows, left)))
        for name, kind in () if self._rows else _OUTCOME:
            out = out.append_column(name, pa.nulls(b.num_rows, kind))
        return out

    def _rows_of(self, schema: pa.Schema, given: dict[str, list]) -> pa.RecordBatch:
        """Rows with the given columns, all others null."""
        fields = [*((f.name, f.type) for f in schema), (_LEFT, pa.bool_()), *_OUTCOME]
        n = len(given[_GROUP])
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in fields], names=[c for c, _ in fields])

    def close(self) -> Iterator[pa.RecordBatch]:
        """What a bucket that fits has come to: the rows that stay, or the outcome of each chunk's group."""
        if self._over or not self._best:
            return
        if self._rows:
            for b in self._stay().to_batches():
                yield self._outcome(b, left=False)
            return
        keep = [key[1] if key[0] else None for key, _ in self._best]
        for lo in range(0, len(self._numbers), OUTCOMES):
            groups, n = self._groups[lo : lo + OUTCOMES], self._numbers[lo : lo + OUTCOMES]
            yield self._rows_of(self._held[0].schema, {
                _GROUP: groups, _LEFT: [False] * len(n), "keep_id": [keep[k] for k in n], "group_size": [self._total[k] for k in n],
                _WINS: [self._best[k][1] == g for g, k in zip(groups, n, strict=True)],
            })


def _settle(id_col: str, text_col: str, most: int | None, rows: bool):
    """Settle the buckets of a partition, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, name = None, None
        for b in batches:
            names = np.asarray(b.column(_BUCKET))
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if bucket is None or names[i] != name:
                    if bucket is not None:
                        yield from bucket.close()
                    bucket, name = _Bucket(id_col, text_col, most, rows), names[i]
                yield from bucket.add(b.slice(i, j - i))
        if bucket is not None:
            yield from bucket.close()

    return run


def _dealt(records: DataFrame, level: int, buckets: int) -> DataFrame:
    """Records partitioned by the bucket of their level, the records of a bucket side by side."""
    bucket = F.pmod(F.xxhash64(_H, F.lit(level)), F.lit(buckets))  # bits that no other level takes
    records = records.withColumn(_BUCKET, bucket)
    return records.repartition(min(buckets, FAN_OUT), _BUCKET).sortWithinPartitions(_BUCKET)


def grace(records: DataFrame, id_col: str, text_col: str, size: int, rows: bool, most: int | None = None) -> list[DataFrame]:
    """Partition records until every bucket is settled; the staged outcomes of each level, told from what was given back by _LEFT.

    ``size`` are the bytes of all texts, from which the first level's buckets
    follow; a level that follows it deals each bucket that was too large to AGAIN.
    """
    most = most or BUCKET_BYTES
    extra = [T.StructField(_LEFT, T.BooleanType())]
    if not rows:
        extra += [T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField(_WINS, T.BooleanType()), T.StructField(_ALIAS, T.LongType())]
    levels: list[DataFrame] = []
    buckets, level = max(1, -(-2 * size // most)), 0  # half full, so that few are too large by chance
    while True:
        dealt = _dealt(records, level, buckets)
        schema = T.StructType([*dealt.schema.fields, *extra])
        settle = _settle(id_col, text_col, most if level < LEVELS else None, rows)
        done = stage_table(dealt.mapInArrow(tidy(settle), schema), f"grace-level{level}")
        levels.append(done)
        left = done.where(_LEFT)
        large = left.select(_BUCKET).distinct().count()
        if not large:
            return levels
        records, buckets, level = left.select(*records.columns), large * AGAIN, level + 1


def _text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the largest id stays."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    schema = T.StructType([
        docs.schema[id_col], docs.schema[text_col], *(T.StructField(c, T.LongType()) for c in (_GROUP, _H, _N)),
        T.StructField(_SHA, T.StringType()), T.StructField(_STAYS, T.BooleanType()),
    ])
    members = stage_table(docs.mapInArrow(tidy(_members(id_col, text_col)), schema), "grace-members")
    records = members.where(_STAYS).select(id_col, text_col, _GROUP, _H, _N)
    levels = grace(records, id_col, text_col, _text_bytes(records, text_col), rows=False, most=most)
    done: DataFrame | None = None
    for x in reversed(levels):  # an alias of a level points at a group that a later one settled
        own = x.where(~F.col(_LEFT) & F.col(_ALIAS).isNull()).select(_GROUP, "keep_id", "group_size", _WINS)
        if done is not None:
            aliases = x.where(F.col(_ALIAS).isNotNull()).select(F.col(_GROUP).alias("__alias"), F.col(_ALIAS).alias(_GROUP))
            own = own.union(aliases.join(done, _GROUP).select("__alias", "keep_id", "group_size", F.lit(False))).union(done)
        done = own
    return members.select(id_col, _GROUP, _SHA, _STAYS).join(done, _GROUP).select(
        id_col, "keep_id", "group_size", (F.col(_WINS) & F.col(_STAYS)).alias("kept"), F.col(_SHA).alias("text_sha256")
    )


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; one row for each distinct text."""
    bounded_batches(docs.sparkSession)
    extra = [T.StructField(c, T.LongType()) for c in (_GROUP, _H, _N)]
    copies = docs.mapInArrow(tidy(_first_copies(id_col, text_col)), T.StructType([*docs.schema.fields, *extra]))
    levels = grace(copies, id_col, text_col, _text_bytes(docs, text_col), rows=True, most=most)
    return reduce(DataFrame.union, [x.where(~F.col(_LEFT)).select(*docs.columns) for x in levels])

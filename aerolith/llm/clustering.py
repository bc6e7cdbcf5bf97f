"""Centroid clustering in integers, with centroids screened by block norms.

A vector's components become integers, floor(SCALE * x). Beside them stands its
compressed form: one byte for each component, all shifted by the same number of
bits, and for each of SEGMENTS segments the norm of what the bytes leave out. With
c a centroid, b the bytes and r the rest,

    x . c  =  b . c + r . c  <=  b . c + sum over segments |r_s| |c_s|

by Cauchy and Schwarz, which bounds the distance of x and c from below. Norms are
rounded up, so the bound holds in integers. The centroid with the least bound gets its
exact distance first; of the others only those whose bounds are not above it are
measured, in integers. The result is that of measuring all of them.

Each round is one pass over the staged vectors: centroids go out with the tasks, and
each task returns one row of sums for each centroid and component, added up by Spark
in decimals. What reaches the driver is a row for each centroid and component.

Defined cases: vectors of another length, with a null or a component that is not
finite, and null vectors are left out; components beyond LIMIT after scaling raise a
ValueError, as their distances would not fit a long; of vectors with equal hashes of
their ids the least bytes come first; a null id is hashed as if empty; equal distances
go to the smaller number; with fewer vectors than centroids each has its own; equal
centroids are allowed, the first of them gets the vectors and the others stay;
repeated rows are vectors of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.plans.staging import bounded_batches, stage_table
from aerolith.plans.workers import tidy

COMPONENTS, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
SEGMENTS, CODE_BITS = 8, 7
LIMIT = 1 << 27
#: Vectors that are assigned at once.
AT_ONCE = 4096

_SCHEMA = "vec_id long, v binary, code binary, shift int, rest binary, square long"


def _root_up(x: np.ndarray) -> np.ndarray:
    """The least integers whose squares are not below x."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= (r > 0) & ((r - 1) * (r - 1) >= x)
    r += r * r < x
    return r


def block_norms(v: np.ndarray) -> np.ndarray:
    """Norms of the segments of vectors [n, components], rounded up."""
    return _root_up((v * v).reshape(len(v), SEGMENTS, -1).sum(2))


def compress(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes [n, components], the bits that each row is shifted by, and norms of the rest [n, SEGMENTS]."""
    most = np.abs(v).max(1, initial=0)
    shift = np.zeros(len(v), np.int64)
    while (wide := (most + (1 << shift >> 1)) >> shift >= 1 << CODE_BITS).any():
        shift += wide
    code = (v + (1 << shift >> 1)[:, None]) >> shift[:, None]
    return code.astype(np.int8), shift.astype(np.int32), block_norms(v - (code << shift[:, None]))


def assign(v: np.ndarray, code: np.ndarray, shift: np.ndarray, rest: np.ndarray, square: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, and how many distances were measured."""
    inner = (code.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)  # below 2**53, so exact
    inner = (inner << shift[:, None].astype(np.int64)) + rest @ block_norms(centroids).T
    least = square[:, None] + (centroids * centroids).sum(1) - 2 * inner

    def measured(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        d = v[rows] - centroids[cols]
        return np.einsum("ij,ij->i", d, d)

    every, first = np.arange(len(v)), least.argmin(1)
    best = measured(every, first)
    some = least <= best[:, None]
    some[every, first] = False
    out = np.full(least.shape, np.iinfo(np.int64).max)
    out[every, first] = best
    rows, cols = np.nonzero(some)
    for k in range(0, len(rows), AT_ONCE):
        at = rows[k : k + AT_ONCE], cols[k : k + AT_ONCE]
        out[at] = measured(*at)
    cluster = out.argmin(1)
    return cluster, out[every, cluster], len(v) + len(rows)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fixed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
    for b in batches:
        x = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS) * float(SCALE))
        if (np.abs(x) > LIMIT).any():
            raise ValueError(f"a component is beyond {LIMIT} after scaling by {SCALE}; distances would not fit a long")
        v = x.astype(np.int64)
        code, shift, rest = compress(v)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), fixed(v.astype("<i4")), fixed(code), pa.array(shift), fixed(rest.astype("<i4")), pa.array((v * v).sum(1))],
            names=["vec_id", "v", "code", "shift", "rest", "square"],
        )


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (components as little-endian 32-bit integers), code, shift and rest (the compressed form) and square (the squared norm) of all vectors that are kept."""
    bounded_batches(embeddings.sparkSession)
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return own.where((F.size("x") == COMPONENTS) & good).mapInArrow(tidy(_integers), _SCHEMA)


def _rows(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Values of equal length as an array of rows."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(-1, width)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batch, vectors, clusters and distances, a bounded number of rows at a time."""
    for whole in batches:
        for k in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(k, AT_ONCE)
            v = _rows(b.column("v"), "<i4", COMPONENTS).astype(np.int64)
            code, rest = _rows(b.column("code"), "i1", COMPONENTS), _rows(b.column("rest"), "<i4", SEGMENTS).astype(np.int64)
            cluster, far, _ = assign(v, code, b.column("shift").to_numpy(), rest, b.column("square").to_numpy(), centroids)
            yield b, v, cluster, far


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each cluster and component the sum over a partition; the vectors' number is component -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), 1 + COMPONENTS), np.int64)
        for _, v, cluster, _ in _assigned(batches, centroids):
            sums[:, 0] += np.bincount(cluster, minlength=len(centroids))
            for c in np.unique(cluster):
                sums[c, 1:] += v[cluster == c].sum(0)
        own = np.flatnonzero(sums[:, 0])
        at = np.broadcast_to(np.arange(-1, COMPONENTS), (len(own), 1 + COMPONENTS))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, 1 + COMPONENTS), pa.int32()), pa.array(at.ravel(), pa.int32()), pa.array(sums[own].ravel())], names=["cluster", "at", "s"])

    return run


def _places(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, cluster, far in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose ids, after the salt, have the k least hashes."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in rows], np.int64).reshape(-1, COMPONENTS)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of the vectors nearest to each centroid; one without vectors stays."""
    parts = vectors.drop("vec_id").mapInArrow(tidy(_sums(centroids)), "cluster int, at int, s long")
    sums = {(r.cluster, r["at"]): int(r.s) for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    out = centroids.copy()
    for c in range(len(centroids)):
        if n := sums.get((c, -1)):
            out[c] = [sums[c, i] // n for i in range(COMPONENTS)]
    return out


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""
    spark = embeddings.sparkSession
    vectors = stage_table(integer_vectors(embeddings), "vectors")
    centroids = first_centroids(vectors, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        new = next_centroids(vectors, centroids)
        if (new == centroids).all():  # further rounds would change nothing
            break
        centroids = new
    places = vectors.mapInArrow(tidy(_places(centroids)), "vec_id long, cluster int, distance long") if len(centroids) else vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    places = stage_table(places, "assigned-vectors")
    inertia = {r.cluster: int(r.s) for r in places.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), shown[c]) for c in range(len(shown))]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return places.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid

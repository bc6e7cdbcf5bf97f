"""Integer clustering against measuring every distance in Python's own integers."""

import hashlib

import numpy as np
import pytest

from aerolith.llm import clustering


def plain(rows, k=8, rounds=10):
    """rows of (vec_id, integers)."""
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centroids = [list(v) for _, v in sorted(rows, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for c in range(len(centroids)):
            mine = [v for (_, v), i in zip(rows, own, strict=True) if i == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(v) for _, v in rows]
    part = [sum(d for d, i in last if i == c) for c in range(len(centroids))]
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(r[0], i, d, part[i], sum(part), shown[i]) for r, (d, i) in zip(rows, last, strict=True)]


@pytest.mark.parametrize("spread", [0.001, 0.3, 4000.0])
def test_cluster(spark, spread):
    """Vectors left out, equal vectors and ids, ties, components of both signs and of very different sizes."""
    rng = np.random.default_rng(int(spread))
    x = (rng.normal(0, spread, (60, 64)) * rng.choice([0.01, 1.0], (60, 1))).astype("f4").astype(float)
    x[5:9] = x[4]
    x[9], x[10], x[11] = 0, -x[12], spread * (np.arange(64) == 3)
    rows = [(None if i == 3 else 7 if i in (20, 21) else i, v.tolist()) for i, v in enumerate(x)]
    odd = [(90, None), (91, [0.0] * 63), (92, [0.0] * 65), (93, [float("nan")] + [0.0] * 63), (94, [float("inf")] * 64), (95, [None] + [0.0] * 63), (96, [])]
    table = spark.createDataFrame([(*r, 1, "x", 0) for r in rows + odd], "vec_id int, embedding array<float>, label int, cluster string, distance int")
    got = [tuple(r) for r in clustering.cluster(table).collect()]
    want = plain([(i, [int(c) for c in np.floor(1024 * np.array(v))]) for i, v in rows])
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    table = spark.createDataFrame([(i, [float(i)] * 64) for i in range(n)], "vec_id long, embedding array<double>")
    got = clustering.cluster(table)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain([(i, [1024 * i] * 64) for i in range(n)]))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]


@pytest.mark.parametrize("size", [1, 100, 1 << 27])
def test_bounds_hold_and_spare_distances(size):
    """No bound is above its distance; far centroids are not measured; the largest components that are allowed do not overflow."""
    rng = np.random.default_rng(size)
    v, c = rng.integers(-size, size + 1, (500, 64)), rng.integers(-size, size + 1, (8, 64))
    v[:3], c[0] = [[size], [-size], [0]], -size
    code, shift, rest = clustering.compress(v)
    cluster, far, measured = clustering.assign(v, code, shift, rest, (v * v).sum(1), c)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
    assert far.tolist() == [min(e) for e in exact] and cluster.tolist() == [e.index(min(e)) for e in exact]
    assert measured < 2 * len(v) and (code.astype(int) << shift[:, None]).shape == v.shape


def test_components_beyond_the_limit_are_told(spark):
    table = spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit a long"):
        clustering.cluster(table)


def test_round_roots_up():
    x = np.array([0, 1, 2, 3, 4, 5, 2**40, 2**40 + 1, (2**30 - 1) ** 2, (2**30 - 1) ** 2 + 1, 2**60])
    r = clustering._root_up(x)
    assert (r * r >= x).all() and ((r - 1) ** 2 < x)[1:].all() and r[0] == 0

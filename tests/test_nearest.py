"""Nearest points against measuring all pairs: clusters, one spot with a third of the rows, ties, places beyond the grid."""

import math
import random

import pytest

from aerolith.operators.nearest import nearest


def plain(places, points, within=None):
    for c, g, x, y in places:
        near = [(math.hypot(px - x, py - y), i) for i, pg, px, py in points if pg == g and px is not None] if x is not None and g is not None else []
        if near and (within is None or min(near)[0] < within):
            yield c, min(near)[1], min(near)[0]


def made(seed, n=600, m=200):
    rng = random.Random(seed)
    def spot():
        kind = rng.random()
        if kind < 0.3:
            return 3.0, 4.0
        if kind < 0.6:
            return 500 + rng.random() * 1e-4, -20 + rng.random() * 1e-4
        return float(rng.randrange(-1000, 1000)), rng.choice([0.0, 0.5, float(rng.randrange(1000))])

    points = [(i, rng.choice("ab"), *spot()) for i in range(n)] + [(n, None, 0.0, 0.0), (n + 1, "c", 7.0, 7.0), (n + 2, "a", None, 1.0)]
    places = [(i, rng.choice("abcz"), *spot()) for i in range(m)] + [(m, "a", 1e7, -3e6), (m + 1, None, 0.0, 0.0), (m + 2, "a", None, 1.0), (m + 3, "c", -1e9, 1e9), (m + 4, "a", -1000.0, 0.25)]
    return places, points


@pytest.mark.parametrize(("seed", "within", "leaf"), [(1, None, 1), (2, None, 32), (3, 25.0, 4)])
def test_nearest(spark, seed, within, leaf):
    places, points = made(seed)
    p = spark.createDataFrame(places, "click int, g string, x double, y double")
    q = spark.createDataFrame(points, "id int, g string, x double, y double")
    got = nearest(p, q, within, ("g",), leaf)
    assert got.columns == ["click", "g", "x", "y", "id", "distance"]
    rows, want = sorted((r.click, r.id, r.distance) for r in got.collect()), sorted(plain(places, points, within))
    assert [r[:2] for r in rows] == [w[:2] for w in want] and all(math.isclose(r[2], w[2], rel_tol=1e-12) for r, w in zip(rows, want, strict=True)) and len(rows) > 60
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_edges(spark):
    p, q = spark.createDataFrame([(1, 2.0, 3.0)] * 2, "click int, x double, y double"), spark.createDataFrame([(5, 2.0, 3.0)], "id int, x double, y double")
    assert [(r.click, r.id, r.distance) for r in nearest(p, q).collect()] == [(1, 5, 0.0)] * 2
    assert nearest(p, q.limit(0)).count() == 0 and nearest(p.limit(0), q).count() == 0

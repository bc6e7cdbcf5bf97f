"""Scans over ranges against plain loops, whatever the number of ranges; states as of a table of times; one long route."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from aerolith.functions.geodesy import Haversine
from aerolith.operators import sequences, terrain, tracking

SCHEMA = "id string, seq long, lat double, lon double, height double, speed_mps double, track_heading_rad double, vertical_rate_mps double, last_ping_time double"


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_scans(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", None, "b"]), k, rng.choice([None, rng.randrange(1000)])) for k in range(300)] + [("one", 1, 7)]
    at = sequences.dealt(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], ["k"], parts)
    value = F.col("v")
    at = sequences.running_max(at, ["g"], ["k"], value, "most")
    at = sequences.running_sum(at, ["g"], ["k"], value.cast("double"), "before")
    at = sequences.following(at, ["g"], ["k"], F.col("k"), "next")
    at = sequences.largest(at, ["g"], F.col("k"), "end")
    want = []
    for _, own in groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        own = list(own)
        for i, (g, k, v) in enumerate(own):
            so_far = [x[2] for x in own[: i + 1] if x[2] is not None]
            want.append((g, k, v, max(so_far, default=None), float(sum(x[2] or 0 for x in own[:i])), own[i + 1][1] if i + 1 < len(own) else None, own[-1][1]))
    assert sorted(map(tuple, at.select("g", "k", "v", "most", "before", "next", "end").collect()), key=repr) == sorted(want, key=repr)
    if parts == 40:
        assert at.where("g = 'hot'").select(sequences.PART).distinct().count() > 5


@pytest.mark.parametrize("by", ["last_ping_time", "seq"])
def test_states_as_of(spark, by):
    """Ties of time, pings that come out of order, invalid ones, targets without pings, times of null, and a target with most of the rows."""
    rng = random.Random(7)
    pings = [(rng.choice(["hot", "hot", "hot", "a", "b"]), k, 0.1, 0.2, float(k), rng.choice([5.0, -1.0]), 1.0, 0.0, float(rng.randrange(60))) for k in range(200)]
    asks = [(k, rng.choice(["hot", "a", "none"]), float(rng.randrange(-5, 70)), "x") for k in range(150)] + [(900, "a", None, "x"), (901, None, 9.0, "x")]
    got = tracking.states_as_of(spark.createDataFrame(pings, SCHEMA), spark.createDataFrame(asks, "ask int, id string, time double, note string"), by, parts=7)
    place = (lambda p: (p[8], p[1])) if by == "last_ping_time" else (lambda p: p[1])
    want = []
    for a, i, t, _ in asks:
        known = [p for p in pings if p[0] == i and t is not None and p[8] <= t and p[5] >= 0]
        if known:
            want.append((a, i, t, "x", *max(known, key=place)[1:]))
    assert got.columns == ["ask", "id", "time", "note", *tracking.STATE]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60


def test_long_routes(spark):
    """One route of 20,000 legs in 2 and in 40 ranges, and with short ones beside it, gives the legs of plain windows."""
    k = F.col("id")
    one = spark.range(20_001).select(F.lit(1).alias("route_id"), k.alias("seq"), F.radians(k % 900 / 10.0 - 45).alias("lat"), F.radians(k % 3000 / 10.0 - 150).alias("lon"), k.cast("double").alias("height"))
    few = spark.createDataFrame([(2, 5, 0.1, 0.1, 1.0), (2, 9, 0.2, 0.1, 2.0), (3, 1, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), (None, 2, 0.1, 0.0, 0.0)], "route_id int, seq long, lat double, lon double, height double")
    routes = one.unionByName(few)
    shown = lambda d: sorted(map(repr, d.select("route_id", "seq", "next", "last", F.round("length", 3), F.round("before", 2), "height").collect()))
    want = shown(terrain.legs(routes, Haversine))
    assert shown(terrain.long_legs(routes, Haversine, 2)) == want == shown(terrain.long_legs(routes, Haversine, 40)) and len(want) == 20_002
    step = lambda long: sorted(map(repr, terrain.samples(few, 100_000.0, Haversine, long=long).select("route_id", F.round("distance_meters", 3), F.round("lat", 9)).collect()))
    assert step(True) == step(False)


@pytest.mark.parametrize(("n", "side", "edge"), [(1500, 2000, 100.0), (20_000, 9000, 600.0)])
def test_labels_of_one_frame_in_squares(spark, n, side, edge):
    """The same places as the sequential fold, with a crowd on one spot, labels of several widths, repeated ids and odd rows."""
    from aerolith.operators import screen

    rng = random.Random(n)
    rows = [(k % 2 if n < 2000 else 1, f"T{rng.randrange(10**6)}" if k % 50 else "T1", rng.uniform(-side, side), rng.uniform(-side, side) / 2, rng.choice([20.0, 60.0, 75.5])) for k in range(n)]
    rows += [(1, f"C{k}", 5.0, 5.0 + k % 3, 60.0) for k in range(300)]
    t = spark.createDataFrame(rows, "frame int, id string, x double, y double, label_w double").dropDuplicates(["frame", "id"])
    t = spark.createDataFrame(t.collect(), t.schema)
    want = sorted(map(tuple, screen.declutter(t).collect()))
    got = sorted(map(tuple, screen.declutter_spread(t, edge).collect()))
    assert got == want and len(got) > 900
    odd = t.limit(3).unionByName(spark.createDataFrame([(1, "odd", None, 1.0, 60.0), (1, "nan", float("nan"), 1.0, 60.0), (None, "null", 1.0, 1.0, 60.0)], t.schema))
    assert {r.id for r in screen.declutter_spread(odd).collect()} <= {r.id for r in t.limit(3).collect()} | {"null"}
    assert screen.declutter_spread(t.limit(0)).count() == 0


def test_crowded_frame_in_few_rounds(spark, monkeypatch):
    """Far more labels than a frame has room for: placed as in sequence, and most are looked at once."""
    from aerolith.operators import screen
    from aerolith.plans.staging import recorded

    k = F.col("id")
    t = spark.range(30_000).select(F.lit(1).alias("frame"), "id", (k * 37 % 4001).cast("double").alias("x"), (k * 91 % 1999).cast("double").alias("y"), F.lit(60.0).alias("label_w"))
    monkeypatch.setattr(screen, "_FIRST", 1024, raising=False)
    with recorded() as made:
        got = sorted(map(tuple, screen.declutter_spread(t, 300.0).collect()))
    assert got == sorted(map(tuple, screen.declutter(t).collect())) and len(got) > 2000
    assert len(made) < 25

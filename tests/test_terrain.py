from math import radians

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from aerolith.functions.geodesy import Haversine
from aerolith.operators import terrain
from aerolith.sources import dted


@pytest.fixture(scope="module")
def tiles(spark):
    files = spark.createDataFrame([("a", dted.encode("230000S", "0480000W", dted.ramp()))], "path string, content binary")
    return dted.decode_tiles(files).cache()


def heights(spark, tiles, points, **kw):
    p = spark.createDataFrame([(i, radians(a), radians(b)) for i, (a, b) in enumerate(points)], "id int, lat double, lon double")
    return [r.elevation for r in terrain.elevation(p, tiles, **kw).orderBy("id").collect()]


def test_bilinear(spark, tiles):
    h = 0.5 / 120
    got = heights(spark, tiles, [(-23, -48), (-22 - 1e-9, -47 - 1e-9), (-23 + h, -48 + h), (-23 + h / 2, -48 + h / 2), (-22, -47)])
    assert got[0] == 0.0 and got[1] == pytest.approx(1320, abs=1e-4) and got[2] == pytest.approx(5.5, abs=1e-6)
    assert got[3] == pytest.approx(2.75, abs=1e-6) and got[4] is None


def test_strict_names_the_tile(spark, tiles):
    with pytest.raises(PySparkException, match=r"TileNotLoaded\(-22, -47\)"):
        heights(spark, tiles, [(-22, -47)], strict=True)


def test_void_is_zero(spark):
    z = dted.ramp()
    z[60, 60] = -32767
    t = dted.decode_tiles(spark.createDataFrame([("v", dted.encode("230000S", "0480000W", z))], "path string, content binary"))
    assert heights(spark, t, [(-22.5, -47.5)]) == [0.0]


@pytest.mark.parametrize("cols,rows", [(121, 121), (1, 1), (65, 66), (130, 2)])
def test_blocks_agree_with_whole_tiles(spark, cols, rows):
    t = dted.decode_tiles(spark.createDataFrame([("a", dted.encode("230000S", "0480000W", dted.ramp(cols, rows)))], "path string, content binary"))
    points = [(-23 + k / 97, -48 + (k * 37 % 97) / 97) for k in range(97)] + [(-22.0000000001, -47.0000000001), (-10.0, 10.0)]
    want = heights(spark, t, points)
    assert heights(spark, t, points, most_bytes=0) == want and want[-1] is None and None not in want[:-1]


def test_route_and_degrees(spark, tiles):
    t = spark.createDataFrame([("a", radians(-22.5), radians(-47.5), 700.0, radians(90.0))], "id string, lat double, lon double, height double, heading_rad double")
    r = terrain.route_ahead(t).orderBy("seq").collect()
    assert len(r) == 41 and r[15].lat == radians(-22.5) and r[15].lon == radians(-47.5)
    flat = terrain.in_degrees(terrain.profile(terrain.route_ahead(t), tiles, 1500.0)).collect()
    assert flat[0].lat_deg == pytest.approx(-22.5) and all(len(x) == 6 for x in flat)


@pytest.mark.parametrize(
    "lat,lon,key", [("230000S", "0480000W", (-23, -48)), ("23.500S", "48.500W", (-24, -49)), ("230000X", "0480000Y", (23, 48))]
)
def test_origins(lat, lon, key):
    t = dted.decode(dted.encode(lat, lon, dted.ramp(4, 4)))
    assert (t["lat_deg"], t["lon_deg"]) == key and t["elevations"].tolist() == dted.ramp(4, 4).ravel().tolist()


def test_bad_files(spark):
    whole = dted.encode("230000S", "0480000W", dted.ramp(5, 5))
    files = [("short", whole[:100]), ("blank", bytes(3500)), ("cut", whole[:-10]), ("ok", whole)]
    got = {r.path: r.error for r in dted.decode_tiles(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"short": "InvalidHeader", "blank": "InvalidHeader", "cut": "MalformedData", "ok": None}


def test_registry(spark, tmp_path):
    for n, k in (("a.dt0", 1), ("b.dt0", 2)):
        (tmp_path / n).write_bytes(dted.encode("230000S", "0480000W", dted.ramp(3, 3) * k))
    read = dted.read_dted(spark, str(tmp_path)).withColumn("seq", F.when(F.col("path").endswith("b.dt0"), 2).otherwise(1))
    t = dted.register(read, "seq")
    assert t.first().elevations[-1] == 44
    assert dted.unload(t, spark.createDataFrame([(-23, -48)], "lat_deg int, lon_deg int")).count() == 0
    url = t.select(dted.tile_url("{lat}/{lon}/{latStr}_{lonStr}", "lat_deg", "lon_deg").alias("u")).first().u
    assert url == "-23/-48/230000S_0480000W"


def test_waves_and_analytic(spark):
    assert dted.waves()[0, 0] == 500
    k = spark.createDataFrame([(1, 2)], "lat_deg int, lon_deg int")
    assert np.array_equal(np.array(dted.analytic_tiles(k, 5, 4).first().elevations), dted.ramp(5, 4).ravel())


def route(spark, points, rid="r"):
    return spark.createDataFrame([(rid, i, radians(a), radians(b), 100.0) for i, (a, b) in enumerate(points)], "route_id string, seq int, lat double, lon double, height double")


def test_profile(spark, tiles):
    r = terrain.profile(route(spark, [(-22.9, -48.0), (-22.9, -47.9)]), tiles, 2000.0).orderBy("distance_meters").collect()
    assert len(r) >= 2 and r[0].distance_meters == 0 and r[1].distance_meters == 2000 and all(x.complete for x in r)
    out = terrain.profile(route(spark, [(-22.9, -48.0), (-21.5, -47.9)]), tiles, 20_000.0).collect()
    assert out and not any(x.complete for x in out)


def test_sampling_rules(spark):
    # 5 km in one leg with a step of 2 km: samples at 0 and 2 km and the end; a leg below the step gives the end alone
    five = route(spark, [(0.0, 0.0), (0.0, 5000 / 111194.9)])
    d = [round(x.distance_meters) for x in terrain.samples(five, 2000.0, Haversine).orderBy("distance_meters").collect()]
    assert d == [0, 2000, 5000]
    short = route(spark, [(0.0, 0.0), (0.0, 0.005), (0.0, 0.01)])
    assert terrain.samples(short, 2000.0, Haversine).count() == 1
    d = [round(x.distance_meters) for x in terrain.samples(short, 400.0, Haversine, uniform=True).orderBy("distance_meters").collect()]
    assert d == [0, 400, 800, 1112]
    assert terrain.samples(route(spark, [(0.0, 0.0)]), 100.0).count() == 0
    with pytest.raises(ValueError):
        terrain.samples(five, 0.0)


def test_clearance(spark, tiles):
    t = spark.createDataFrame([("a", radians(-22.5), radians(-47.5), 900.0), ("b", 0.0, 0.0, 299.0)], "id string, lat double, lon double, height double")
    got = {r.id: (r.clearance, r.hazard) for r in terrain.clearance(t, tiles).collect()}
    assert got["a"][0] == pytest.approx(240, abs=1e-3) and got["a"][1] and got["b"] == (299.0, True)


def test_sample_at_the_start_of_a_leg_is_its_point(spark):
    # beyond the antimeridian a point stays as it is given, at a leg's start as at the route's end
    r = spark.createDataFrame([(1, k, radians(-80.0), radians(180.1 + k * 0.2), 0.0) for k in range(2)], "route_id int, seq int, lat double, lon double, height double")
    got = terrain.samples(r, 10_000.0, Haversine).orderBy("distance_meters").collect()
    assert len(got) == 1
    got = terrain.samples(r, 3_000.0, Haversine).orderBy("distance_meters").collect()
    assert [x.lon for x in (got[0], got[-1])] == pytest.approx([radians(180.1), radians(180.3)])


def test_parts_of_legs_follow_the_number_of_points(spark, monkeypatch):
    from aerolith.plans import spreading
    from aerolith.queries.common import routes

    r = routes(spark, "/root/testdata/sf0.001")
    few = terrain.legs(r, Haversine)
    monkeypatch.setattr(spreading, "SORTED_ROWS", 100)
    many = terrain.legs(r, Haversine)
    assert few.rdd.getNumPartitions() == 8 and many.rdd.getNumPartitions() == -(-r.count() // 100) > 8
    assert sorted(few.collect()) == sorted(many.collect())


def test_profile_degrees_has_samples_on_every_leg(spark):
    from aerolith.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    points = QUERIES["route_ahead"](spark, sf).groupBy("route_id").agg(F.count("*").alias("points"))
    got = QUERIES["profile_degrees"](spark, sf).groupBy("route_id").agg(F.count("*").alias("samples"), F.count_distinct("lat_deg", "lon_deg").alias("places"))
    rows = points.join(got, "route_id", "left").collect()
    # legs of 1.9 to 2.1 km: samples at 0, 600 and 1200 m, each at a place of its own, and the route's end
    assert len(rows) == 150 and {(r.points, r.samples, r.places) for r in rows} == {(41, 121, 121)}

from math import degrees, pi, radians

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerolith.functions import geodesy as g
from aerolith.functions.ellipsoid import WGS84
from aerolith.functions.projections import LambertConic, Stereographic, WebMercator, projection

MUNICH, ZURICH = (48.137154, 11.576124), (47.376887, 8.541694)
JFK, LHR = (40.639722, -73.778889), (51.4775, -0.461389)


def row(spark, **cols):
    r = spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()
    return r


def rad(p):
    return [F.lit(radians(v)) for v in p]


def test_ellipsoid():
    assert WGS84.b == pytest.approx(6356752.314245179, abs=1e-8)
    assert WGS84.e_sq == pytest.approx(0.0066943799901413165, abs=1e-16)
    assert WGS84.e_prime_sq == pytest.approx(0.006739496742276434, abs=1e-16)
    assert WGS84.mean_radius == pytest.approx(6371008.771415059, abs=1e-8)


def test_vincenty_goldens(spark):
    r = row(spark, m=g.vincenty_inverse(*rad(MUNICH), *rad(ZURICH)), j=g.vincenty_inverse(*rad(JFK), *rad(LHR)))
    assert r.m.distance == pytest.approx(242682.04468548222, abs=1e-5)
    assert r.m.initial_bearing == pytest.approx(4.376328646326384, abs=1e-12)
    assert r.j.distance == pytest.approx(5554344.276459293, abs=1e-5)
    d, b = r.m.distance, r.m.initial_bearing
    back = row(spark, p=g.vincenty_direct(*rad(MUNICH), F.lit(7.0), F.lit(b), F.lit(d))).p
    assert degrees(back.lat) == pytest.approx(ZURICH[0], abs=1e-9) and degrees(back.lon) == pytest.approx(ZURICH[1], abs=1e-9) and back.height == 7.0


def test_antipode_falls_back_to_the_sphere(spark):
    r = row(spark, v=g.vincenty_inverse(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(pi)), h=g.haversine_inverse(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(pi)))
    assert r.v.distance == pytest.approx(20015114.352233686, abs=1e-3)
    assert r.v == pytest.approx(r.h, abs=1e-9)


def test_coincident_and_still(spark):
    r = row(spark, i=g.vincenty_inverse(*rad(JFK), *rad(JFK)), d=g.vincenty_direct(F.lit(0.1), F.lit(pi), F.lit(1.0), F.lit(2.0), F.lit(0.0)))
    assert tuple(r.i) == (0.0, 0.0, 0.0)
    assert r.d.lon == pi  # a still point keeps its longitude as it is


def test_haversine(spark):
    r = row(spark, h=g.haversine_inverse(*rad(JFK), *rad(LHR))).h
    assert r.distance == pytest.approx(5539456.565049038, abs=1e-3)
    assert 45 < degrees(r.initial_bearing) < 60


def test_nulls_pass_through(spark):
    rows = spark.createDataFrame([(None, 0.1, 0.2, 0.3), (0.1, 0.1, 0.2, 0.3)], "a double, b double, c double, d double")
    got = rows.select(g.haversine_inverse("a", "b", "c", "d")["distance"].alias("d")).collect()
    assert got[0].d is None and got[1].d is not None


@pytest.mark.parametrize("lat,lon,h", [(0, 0, 0), (90, 0, 10), (-90, 0, 10), (48.1, 11.5, 520), (-23.5, -46.6, 800), (10, 179.9, 400_000)])
def test_ecef_round_trip(spark, lat, lon, h):
    p = g.lla_to_ecef(F.lit(radians(lat)), F.lit(radians(lon)), F.lit(float(h)))
    q = row(spark, q=g.ecef_to_lla(p["x"], p["y"], p["z"])).q
    assert degrees(q.lat) == pytest.approx(lat, abs=1e-7) and degrees(q.lon) == pytest.approx(lon, abs=1e-9) and q.height == pytest.approx(h, abs=1e-2)


def test_enu(spark):
    a = (-23.5505, -46.6333)
    b = (-23.4505, -46.5333)
    e = row(spark, e=g.lla_to_enu(*rad(b), F.lit(1000.0), *rad(a), F.lit(800.0))).e
    d2 = e.east**2 + e.north**2
    assert e.east > 0 and e.north > 0 and e.up == pytest.approx(200 - d2 / (2 * WGS84.a), abs=1)


def test_validity(spark):
    r = row(
        spark, a=g.position_error(F.radians(F.lit(95.0)), F.radians(F.lit(185.0))), b=g.position_error(F.lit(0.0), F.radians(F.lit(185.0))),
        c=g.position_error(F.radians(F.lit(90.0)), F.radians(F.lit(-180.0))),
    )
    assert (r.a, r.b, r.c) == ("LatitudeOutOfRange", "LongitudeOutOfRange", None)


def test_angles(spark):
    r = row(spark, b=g.normalize_bearing(F.lit(-0.5)), l=g.normalize_longitude(F.lit(pi)), m=g.normalize_longitude(F.lit(3 * pi + 0.25)))
    assert r.b == pytest.approx(2 * pi - 0.5) and r.l == -pi and r.m == pytest.approx(-pi + 0.25)


@settings(max_examples=200, deadline=None)
@given(st.floats(-1.4, 1.4), st.floats(-3, 3), st.floats(0, 6.28), st.floats(1, 5e6))
def test_direct_undoes_inverse(lat, lon, bearing, distance):
    one = np.array
    lat2, lon2, _ = g.vincenty_direct_arrays(one([lat]), one([lon]), one([0.0]), one([bearing]), one([distance]))
    d, _, _ = g.vincenty_inverse_arrays(one([lat]), one([lon]), lat2, lon2)
    assert d[0] == pytest.approx(distance, abs=1e-3)


@pytest.mark.parametrize(
    "p,points",
    [
        (LambertConic(radians(33), radians(45), 0.0, radians(-96)), [(38.9, -77.0), (40.7, -74.0), (34.05, -118.2)]),
        (Stereographic(radians(-23.5505), radians(-46.6333)), [(-23.5505, -46.6333), (-23.4, -46.5), (-22.9, -43.2)]),
        (WebMercator(), [(0, 0), (51.48, 0), (-23.55, -46.63), (85.05112878, 10)]),
        (LambertConic(radians(-33), radians(-45), 0.0, radians(20)), [(-34, 18), (-40, 25)]),
    ],
)
def test_projection_round_trip(spark, p, points):
    rows = spark.createDataFrame([(radians(a), radians(b)) for a, b in points], "lat double, lon double")
    for r in rows.withColumn("p", p.project("lat", "lon")).withColumn("q", p.unproject("p.x", "p.y")).collect():
        assert r.q.lat == pytest.approx(r.lat, abs=1e-8) and r.q.lon == pytest.approx(r.lon, abs=1e-8) and r.q.height == 0
        assert p.project_point(r.lat, r.lon) == pytest.approx((r.p.x, r.p.y), abs=1e-6)


def test_singularity_is_null(spark):
    assert row(spark, p=Stereographic(0.0, 0.0).project(F.lit(0.0), F.lit(pi))).p is None
    assert Stereographic(0.0, 0.0).project_point(0.0, pi) is None


def test_new_centre_is_the_origin():
    for p in (projection("lcc", 33, 45, 0, -96), projection("stereographic", lat0=10, lon0=10)):
        q = p.recentered(radians(-23.5505), radians(-46.6333))
        assert q.project_point(radians(-23.5505), radians(-46.6333)) == pytest.approx((0, 0), abs=1e-6)
    with pytest.raises(ValueError):
        projection("globe")


def test_turns_of_angles_just_below_the_range(spark):
    below = -pi - 4.5e-16  # as x / a gives it back on the antimeridian
    lon = spark.createDataFrame([(below,), (-pi,), (-1e-17,)], "v double").select(g.normalize_longitude("v").alias("l"), g.normalize_bearing("v").alias("b")).collect()
    assert [r.l for r in lon] == [pi, -pi, 0.0]
    assert lon[2].b == 2 * pi

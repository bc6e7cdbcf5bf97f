from math import pi, radians

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions.camera import Camera, CameraError, multiply, on_screen, rotation_z, screen, translation
from aerolith.functions.projections import Stereographic

FLAT = Stereographic(0.0, 0.0)


def ndc(m, x, y):
    v = m @ np.array([x, y, 0, 1], np.float32)
    return v[:2] / v[3]


def test_ndc_axes():
    c = Camera(0.0, 0.0)
    assert ndc(c.matrix_2d(FLAT), 50_000, 0) == pytest.approx((1, 0), abs=1e-4)
    assert ndc(c.matrix_2d(FLAT), 0, 50_000) == pytest.approx((0, 1), abs=1e-4)
    turned = Camera(0.0, 0.0, rotation=pi / 2)
    assert ndc(turned.matrix_2d(FLAT), 0, 50_000) == pytest.approx((1, 0), abs=1e-4)
    assert ndc(turned.matrix_2d(FLAT), 50_000, 0) == pytest.approx((0, -1), abs=1e-4)


def test_multiply():
    assert multiply(rotation_z(pi / 2), translation(1, 2, 3))[:, 3] == pytest.approx((-2, 1, 3, 1), abs=1e-6)


@pytest.mark.parametrize("field,error", [("zoom", "InvalidZoom"), ("aspect_ratio", "InvalidAspectRatio"), ("viewport_base_meters", "InvalidViewportBase")])
def test_validation(field, error):
    with pytest.raises(CameraError, match=error):
        Camera(0.0, 0.0, **{field: 0.0}).matrix_2d(FLAT)


def test_centre_and_antipode(spark):
    c = Camera(0.0, 0.0, aspect_ratio=4 / 3)
    for mode in ("2D", "2.5D", "3D"):
        r = spark.range(1).select(screen(F.lit(0.0), F.lit(0.0), F.lit(0.0), c, FLAT, 800, 600, mode).alias("s")).first()
        assert (r.s.x, r.s.y) == pytest.approx((400, 300), abs=1)
        far = spark.range(1).select(screen(F.lit(0.0), F.lit(pi), F.lit(0.0), c, FLAT, 800, 600, mode).alias("s")).first()
        assert far.s is None


def test_culling_keeps_columns(spark):
    p = spark.createDataFrame([("near", 0.0, 0.0, 0.0), ("far", 0.0, 3.0, 0.0)], "id string, lat double, lon double, height double")
    r = on_screen(p, Camera(0.0, 0.0), None, 800, 600, "3D").collect()
    assert [x.id for x in r] == ["near"] and set(r[0].asDict()) == {"id", "lat", "lon", "height", "x", "y"}


def test_controls():
    c = Camera(0.0, 0.0)
    assert c.zoomed(1).zoom == pytest.approx(1.1) and c.zoomed(200).zoom == 1000 and c.zoomed(-200).zoom == 0.02
    assert c.pitched(9).pitch == pi and c.rolled(pi).roll == -pi
    assert c.in_mode("2.5D").pitch == radians(35) and c.in_mode("2.5D").in_mode("2D").pitch == 0
    assert c.pan_metres(80, 0, 800) == pytest.approx((-10_000, 0))

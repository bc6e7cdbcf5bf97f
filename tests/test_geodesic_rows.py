"""The solvers in generated code against the batch solvers."""

import numpy as np
from pyspark.sql import functions as F

from aerolith.functions.geodesic_rows import direct_rows, inverse_rows
from aerolith.functions.geodesy import vincenty_direct, vincenty_inverse


def _pairs(spark):
    rng = np.random.default_rng(3)
    lat1, lat2 = np.arcsin(rng.uniform(-1, 1, (2, 3000)))
    lon1, lon2 = rng.uniform(-np.pi, np.pi, (2, 3000))
    odd = [(0.0, 0.0, 0.0, 0.0), (np.pi / 2, 0.0, -np.pi / 2, 1.0), (np.pi / 2, 0.5, 0.1, 0.1), (0.0, 0.0, 0.0, np.pi), (0.0, 0.0, 1e-9, np.radians(179.999)), (0.3, 0.2, 0.3, 0.2 + 1e-13), (0.0, 0.1, 0.0, 2.0), (0.4, 3.1, 0.4, -3.1), (None, 0.0, 0.0, 0.0), (0.1, float("nan"), 0.0, 0.0), (0.5, 1.0, -0.5, 1.0)]
    rows = [tuple(map(float, r)) for r in zip(lat1, lon1, lat2, lon2, strict=True)] + odd
    return spark.createDataFrame([(k, *(None if v is None else float(v) for v in r)) for k, r in enumerate(rows)], "id int, lat double, lon double, lat2 double, lon2 double")


def _same(rows, other, angles, places):
    """Largest difference of fields, angles on the circle; nulls and NaN stand at the same rows."""
    for a, b in zip(rows, other, strict=True):
        for f in (*angles, *places):
            x, y = a[f], b[f]
            if x is None or y is None or x != x or y != y:
                assert (x is None or x != x) and (y is None or y != y), (a, b)
            else:
                d = abs(x - y)
                assert min(d, 2 * np.pi - d if f in angles else d) <= (1e-9 if f in angles else 1e-9 * max(1.0, abs(y))) or (f in angles and a["sigma"] < 1e-6), (a, b)


def test_inverse(spark):
    p = _pairs(spark).withColumn("sigma", F.abs(F.col("lat") - F.col("lat2")) + F.abs(F.col("lon") - F.col("lon2")))
    got = inverse_rows(p, "lat", "lon", "lat2", "lon2")
    assert got.columns == [*p.columns, "g"]
    want = p.withColumn("g", vincenty_inverse("lat", "lon", "lat2", "lon2"))
    flat = lambda d: d.select("id", "sigma", "g.*").orderBy("id").collect()
    assert got.count() == p.count()
    _same(flat(got), flat(want), ("initial_bearing", "final_bearing"), ("distance",))


def test_direct(spark):
    p = _pairs(spark).withColumn("sigma", F.lit(1.0)).withColumn("d", F.when(F.col("id") % 100 == 0, 0.0).otherwise(F.col("id") * 6000.0)).withColumn("h", F.lit(5.0))
    flat = lambda d: d.select("id", "sigma", "p.*").orderBy("id").collect()
    got, want = direct_rows(p, "lat", "lon", "h", "lon2", "d"), p.withColumn("p", vincenty_direct("lat", "lon", "h", "lon2", "d"))
    _same(flat(got), flat(want), ("lat", "lon"), ("height",))


def test_ordinary_rows_see_no_python(spark):
    near = spark.range(100).select((F.col("id") / 100.0).alias("a"), F.lit(0.1).alias("b"), F.lit(0.2).alias("c"), F.lit(0.3).alias("d"))
    plan = direct_rows(near, "a", "b", "c", "d", "d")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert inverse_rows(near, "a", "b", "c", "d")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # in the branch of the antipodes alone

"""The ellipsoidal solvers in generated code: their iterations unrolled as columns, a step after the other.

A column that is used more than once is a projection of its own, so nothing is worked
out twice. The inverse takes STEPS steps, which are enough for points less than
acos(ANTIPODAL) apart (154 degrees: the last step changes less than 5e-12); pairs
beyond that are few and go to the batch solver of module geodesy, as a second branch
of a union, so ordinary rows never see Python. The direct problem is always done
after DIRECT_STEPS steps (the last changes less than 5e-12) and has no second branch.

Results are those of the batch solvers to 1e-9. Nulls give nulls. Measured on 8 cores,
the direct problem is two to three times as fast as in batches, and dead reckoning uses
it; the inverse, whose code is too long for one method of the JVM and is cut into
several, is about half as fast as in batches, which stay the default. Profiles, whose
legs come from batches of Python, keep to batches as well.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.ellipsoid import WGS84, Ellipsoid
from aerolith.functions.geodesy import COINCIDENT, GEODETIC, NEAR_POLE, _c, normalize_bearing, normalize_longitude, vincenty_inverse

STEPS, DIRECT_STEPS, ANTIPODAL = 6, 4, -0.9
#: Steps in a generated method, and a number of partitions that no table has.
STEPS_A_METHOD, MOST_PARTITIONS = 2, 1 << 24

Names = dict[str, Column]


def _ratio(x: Column, y: Column) -> Column:
    """x / y, and 0 where y is 0; never null for numbers, so that generated code need not ask."""
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


class _Scratch:
    """A DataFrame with working columns, added a projection at a time."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self._given = rows, rows.columns

    def add(self, **named: Column) -> None:
        self.rows = self.rows.withColumns({f"__{k}": v for k, v in named.items()})

    def __getattr__(self, name: str) -> Column:
        return F.col(f"__{name}")

    def cut(self, *kept: str) -> None:
        """Begin another generated method, with the columns that go on: the JVM compiles none of over 8000 bytes. No row changes its partition."""
        self.rows = self.rows.select(*self._given, *(f"__{k}" for k in kept)).coalesce(MOST_PARTITIONS)

    def done(self, out: str, result: Column) -> DataFrame:
        return self.rows.select(*self._given, result.alias(out))


def _reduced_parts(lat: Column, e: Ellipsoid) -> tuple[Column, Column]:
    """Sine and cosine of the reduced latitude, from the latitude's: exact at the poles."""
    side, up = F.cos(lat), (1.0 - e.f) * F.sin(lat)
    slant = F.sqrt(side * side + up * up)
    pole = F.abs(lat) >= pi / 2 - NEAR_POLE
    return F.when(pole, F.signum(lat)).otherwise(_ratio(up, slant)), F.when(pole, 0.0).otherwise(_ratio(side, slant))


def _series(q: Column, e: Ellipsoid) -> tuple[Column, Column]:
    u = q * ((e.a**2 - e.b**2) / e.b**2)
    return 1.0 + u * (1.0 / 16384.0) * (4096.0 + u * (-768.0 + u * (320.0 - 175.0 * u))), u * (1.0 / 1024.0) * (256.0 + u * (-128.0 + u * (74.0 - 47.0 * u)))


def _correction(b: Column, sine: Column, cosine: Column, m: Column) -> Column:
    inner = cosine * (2.0 * m * m - 1.0) - b * (1.0 / 6.0) * m * (4.0 * sine * sine - 3.0) * (4.0 * m * m - 3.0)
    return b * sine * (m + b * 0.25 * inner)


def inverse_rows(rows: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, out: str = "g", e: Ellipsoid = WGS84) -> DataFrame:
    """Rows with struct<distance, initial_bearing, final_bearing> of the geodesic between two places; rows are read once for each branch, so stage what is dear."""
    given = [_c(x) for x in (lat1, lon1, lat2, lon2)]
    (s1, c1), (s2, c2) = _reduced_parts(given[0], e), _reduced_parts(given[2], e)
    ordinary = s1 * s2 + c1 * c2 * F.cos(given[3] - given[1]) > ANTIPODAL
    known = given[0].isNotNull() & given[1].isNotNull() & given[2].isNotNull() & given[3].isNotNull()
    near, far = _Scratch(rows.where(known & ordinary)), rows.where(~F.coalesce(known & ordinary, F.lit(False)))
    near.add(lat=given[0], lat2=given[2], l=given[3] - given[1], s1=s1, c1=c1, s2=s2, c2=c2)
    near.add(lam=near.l)
    for step in range(STEPS):
        if step % STEPS_A_METHOD == 0:
            near.cut("lat", "lat2", "l", "s1", "c1", "s2", "c2", "lam")
        near.add(sl=F.sin(near.lam), cl=F.cos(near.lam))
        near.add(x=near.c2 * near.sl, y=near.c1 * near.s2 - near.s1 * near.c2 * near.cl, cs=near.s1 * near.s2 + near.c1 * near.c2 * near.cl)
        near.add(ss=F.sqrt(near.x * near.x + near.y * near.y))
        near.add(sg=F.atan2(near.ss, near.cs), sa=_ratio(near.c1 * near.x, near.ss))
        near.add(q=1.0 - near.sa * near.sa)
        near.add(m=F.when(near.q == 0, 0.0).otherwise(near.cs - 2.0 * _ratio(near.s1 * near.s2, near.q)), c=e.f / 16.0 * near.q * (4.0 + e.f * (4.0 - 3.0 * near.q)))
        near.add(lam=near.l + (1.0 - near.c) * e.f * near.sa * (near.sg + near.c * near.ss * (near.m + near.c * near.cs * (2.0 * near.m * near.m - 1.0))))
    near.cut("lat", "lat2", "l", "s1", "c1", "s2", "c2", "lam", "q", "m", "ss", "cs", "sg")
    a, b = _series(near.q, e)
    near.add(big_a=a, big_b=b, sl=F.sin(near.lam), cl=F.cos(near.lam), same=(F.abs(near.lat - near.lat2) < COINCIDENT) & (F.abs(near.l) < COINCIDENT))
    own = lambda v: F.when(near.same, 0.0).otherwise(v)
    result = F.struct(
        own(e.b * near.big_a * (near.sg - _correction(near.big_b, near.ss, near.cs, near.m))).alias("distance"),
        own(normalize_bearing(F.atan2(near.c2 * near.sl, near.c1 * near.s2 - near.s1 * near.c2 * near.cl))).alias("initial_bearing"),
        own(normalize_bearing(F.atan2(near.c1 * near.sl, near.c1 * near.s2 * near.cl - near.s1 * near.c2))).alias("final_bearing"),
    )
    shape = f"struct<{', '.join(x.replace(' ', ':') for x in GEODETIC.split(', '))}>"
    return near.done(out, result.cast(shape)).unionByName(far.withColumn(out, vincenty_inverse(lat1, lon1, lat2, lon2).cast(shape)))


def direct_rows(rows: DataFrame, lat: str, lon: str, height: str, bearing: str, distance: str, out: str = "p", e: Ellipsoid = WGS84) -> DataFrame:
    """Rows with struct<lat, lon, height> where a geodesic leads."""
    w = _Scratch(rows)
    w.add(lat=_c(lat), lon=_c(lon), d=_c(distance), ca=F.cos(_c(bearing)), sb=F.sin(_c(bearing)))
    su, cu = _reduced_parts(w.lat, e)
    w.add(su=su, cu=cu)
    w.add(start=F.atan2(w.su, w.cu * w.ca), sa=w.cu * w.sb)
    w.add(q=1.0 - w.sa * w.sa)
    a, b = _series(w.q, e)
    w.add(big_b=b, straight=w.d / (e.b * a))
    w.add(sg=w.straight)
    for _ in range(DIRECT_STEPS):
        w.add(m=F.cos(2.0 * w.start + w.sg), ss=F.sin(w.sg), cs=F.cos(w.sg))
        w.add(sg=w.straight + _correction(w.big_b, w.ss, w.cs, w.m))
    w.add(ss=F.sin(w.sg), cs=F.cos(w.sg))
    w.add(back=w.su * w.ss - w.cu * w.cs * w.ca, c=e.f / 16.0 * w.q * (4.0 + e.f * (4.0 - 3.0 * w.q)))
    w.add(turn=F.atan2(w.ss * w.sb, w.cu * w.cs - w.su * w.ss * w.ca) - (1.0 - w.c) * e.f * w.sa * (w.sg + w.c * w.ss * (w.m + w.c * w.cs * (2.0 * w.m * w.m - 1.0))))
    stay, known = F.abs(w.d) < COINCIDENT, w.lat.isNotNull() & w.lon.isNotNull() & w.sb.isNotNull() & w.d.isNotNull()
    result = F.struct(
        F.when(stay, w.lat).when(known, F.atan2(w.su * w.cs + w.cu * w.ss * w.ca, (1.0 - e.f) * F.sqrt(w.sa * w.sa + w.back * w.back))).alias("lat"),
        F.when(stay, w.lon).when(known, normalize_longitude(w.lon + w.turn)).alias("lon"),
        _c(height).alias("height"),
    )
    return w.done(out, result)

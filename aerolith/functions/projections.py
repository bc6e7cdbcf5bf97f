"""Map projections: constants on the driver, forward and closed inverse forms as columns.

The inverses of the conformal conic and the stereographic projection iterate;
they run in numpy batches, and a row that does not converge is null.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field, replace
from math import atan, copysign, cos, log, pi, radians, sin, sqrt, tan

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.functions.ellipsoid import WGS84, Ellipsoid
from aerolith.functions.geodesy import _c, _struct, normalize_longitude

#: Latitudes where projections clamp, singularity and iteration limits.
LCC_CLAMP_DEG, MERCATOR_CLAMP_DEG, SINGULAR, MAX_STEPS, CONVERGED = 89.9, 85.05112878, 1e-10, 15, 1e-12
#: Fixed value: half the edge of the square Mercator world in metres.
HALF_WORLD = 20037508.342789244

LATLON = "lat double, lon double, height double"


class Projection(ABC):
    """project() gives struct<x, y>, unproject() struct<lat, lon, height>; null where a point has no image."""

    @abstractmethod
    def project(self, lat, lon) -> Column: ...

    @abstractmethod
    def unproject(self, x, y) -> Column: ...

    @abstractmethod
    def project_point(self, lat: float, lon: float) -> tuple[float, float] | None:
        """The image of one point, for constants of a plan."""

    @abstractmethod
    def recentered(self, lat: float, lon: float) -> Projection:
        """The same projection about another centre."""


def _latitude(t: np.ndarray, start: np.ndarray, e: float) -> np.ndarray:
    """Geodetic latitude by fixed-point steps from an isometric one; NaN where they do not settle."""
    lat, done = start.copy(), np.zeros(len(start), bool)
    with np.errstate(all="ignore"):
        for _ in range(MAX_STEPS):
            con = e * np.sin(lat)
            new = pi / 2 - 2 * np.arctan(t * ((1 - con) / (1 + con)) ** (e / 2))
            close = np.abs(new - lat) < CONVERGED
            lat = np.where(done, lat, new)
            done |= close
    return np.where(done, lat, np.nan)


def _frame(lat: np.ndarray, lon: np.ndarray) -> pd.DataFrame:
    good = ~np.isnan(lat)
    lon = (lon + pi) % (2 * pi) - pi
    return pd.DataFrame({"lat": pd.Series(lat).where(good, None), "lon": pd.Series(lon).where(good, None), "height": pd.Series(np.zeros(len(lat))).where(good, None)})


def _whole(point: Column) -> Column:
    """Null instead of a struct of nulls."""
    return F.when(point["lat"].isNotNull() & ~F.isnan(point["lat"]), point)


@dataclass(frozen=True)
class WebMercator(Projection):
    ellipsoid: Ellipsoid = WGS84

    def project(self, lat, lon) -> Column:
        most = radians(MERCATOR_CLAMP_DEG)
        lat = F.greatest(F.lit(-most), F.least(F.lit(most), _c(lat)))
        return _struct(x=self.ellipsoid.a * _c(lon), y=self.ellipsoid.a * F.log(F.tan(pi / 4 + lat / 2.0)))

    def unproject(self, x, y) -> Column:
        most = radians(MERCATOR_CLAMP_DEG)
        lat = 2.0 * F.atan(F.exp(_c(y) / F.lit(self.ellipsoid.a))) - pi / 2
        lat = F.greatest(F.lit(-most), F.least(F.lit(most), lat))
        return _struct(lat=lat, lon=normalize_longitude(_c(x) / F.lit(self.ellipsoid.a)), height=F.lit(0.0))

    def project_point(self, lat: float, lon: float) -> tuple[float, float]:
        most = radians(MERCATOR_CLAMP_DEG)
        return self.ellipsoid.a * lon, self.ellipsoid.a * log(tan(pi / 4 + max(-most, min(most, lat)) / 2))

    def recentered(self, lat: float, lon: float) -> WebMercator:
        return self


@dataclass(frozen=True)
class Stereographic(Projection):
    center_lat: float
    center_lon: float
    ellipsoid: Ellipsoid = WGS84

    def _conformal(self, lat: float) -> float:
        e = self.ellipsoid.e
        return 2 * atan(tan(pi / 4 + lat / 2) * ((1 - e * sin(lat)) / (1 + e * sin(lat))) ** (e / 2)) - pi / 2

    @property
    def _radius(self) -> float:
        e2 = self.ellipsoid.e_sq
        return self.ellipsoid.a * sqrt(1 - e2) / (1 - e2 * sin(self.center_lat) ** 2)

    def project(self, lat, lon) -> Column:
        lat, d, e = _c(lat), _c(lon) - self.center_lon, self.ellipsoid.e
        chi_c = self._conformal(self.center_lat)
        con = e * F.sin(lat)
        chi = 2.0 * F.atan(F.tan(pi / 4 + lat / 2.0) * F.pow((1.0 - con) / (1.0 + con), F.lit(e / 2))) - pi / 2
        denominator = 1.0 + sin(chi_c) * F.sin(chi) + cos(chi_c) * F.cos(chi) * F.cos(d)
        k = F.try_divide(F.lit(2.0 * self._radius), denominator)
        xy = _struct(x=k * F.cos(chi) * F.sin(d), y=k * (cos(chi_c) * F.sin(chi) - sin(chi_c) * F.cos(chi) * F.cos(d)))
        return F.when(F.abs(denominator) >= SINGULAR, xy)

    def project_point(self, lat: float, lon: float) -> tuple[float, float] | None:
        chi_c, chi, d = self._conformal(self.center_lat), self._conformal(lat), lon - self.center_lon
        denominator = 1 + sin(chi_c) * sin(chi) + cos(chi_c) * cos(chi) * cos(d)
        if abs(denominator) < SINGULAR:
            return None
        k = 2 * self._radius / denominator
        return k * cos(chi) * sin(d), k * (cos(chi_c) * sin(chi) - sin(chi_c) * cos(chi) * cos(d))

    def unproject(self, x, y) -> Column:
        chi_c, radius, e, lat0, lon0 = self._conformal(self.center_lat), self._radius, self.ellipsoid.e, self.center_lat, self.center_lon

        @F.pandas_udf(LATLON)
        def back(x: pd.Series, y: pd.Series) -> pd.DataFrame:
            x, y = x.to_numpy(np.float64, na_value=np.nan), y.to_numpy(np.float64, na_value=np.nan)
            rho = np.hypot(x, y)
            with np.errstate(all="ignore"):
                c = 2 * np.arctan(rho / (2 * radius))
                chi = np.arcsin(np.cos(c) * sin(chi_c) + y * np.sin(c) * cos(chi_c) / rho)
                lon = lon0 + np.arctan2(x * np.sin(c), rho * cos(chi_c) * np.cos(c) - y * sin(chi_c) * np.sin(c))
            lat = _latitude(np.tan(pi / 4 - chi / 2), chi, e)
            centre = rho < SINGULAR
            return _frame(np.where(centre, lat0, lat), np.where(centre, lon0, lon))

        return _whole(back(_c(x), _c(y)))

    def recentered(self, lat: float, lon: float) -> Stereographic:
        return replace(self, center_lat=lat, center_lon=lon)


@dataclass(frozen=True)
class LambertConic(Projection):
    """Conformal conic on two standard parallels. A new centre moves the origin; the cone stays."""

    parallel_1: float
    parallel_2: float
    origin_lat: float
    origin_lon: float
    ellipsoid: Ellipsoid = WGS84
    n: float = field(init=False)
    scale: float = field(init=False)

    def _t(self, lat: float) -> float:
        e = self.ellipsoid.e
        return tan(pi / 4 - lat / 2) * ((1 + e * sin(lat)) / (1 - e * sin(lat))) ** (e / 2)

    def __post_init__(self) -> None:
        m = lambda p: cos(p) / sqrt(1 - self.ellipsoid.e_sq * sin(p) ** 2)
        p, q = self.parallel_1, self.parallel_2
        n = sin(p) if abs(p - q) < 1e-10 else (log(m(p)) - log(m(q))) / (log(self._t(p)) - log(self._t(q)))
        object.__setattr__(self, "n", n)
        object.__setattr__(self, "scale", self.ellipsoid.a * m(p) / (n * self._t(p) ** n))

    @property
    def _rho_0(self) -> float:
        return self.scale * self._t(self.origin_lat) ** self.n

    def project(self, lat, lon) -> Column:
        most, e = radians(LCC_CLAMP_DEG), self.ellipsoid.e
        lat = F.greatest(F.lit(-most), F.least(F.lit(most), _c(lat)))
        con = e * F.sin(lat)
        t = F.tan(pi / 4 - lat / 2.0) * F.pow((1.0 + con) / (1.0 - con), F.lit(e / 2))
        rho, theta = self.scale * F.pow(t, F.lit(self.n)), self.n * (_c(lon) - self.origin_lon)
        return _struct(x=rho * F.sin(theta), y=self._rho_0 - rho * F.cos(theta))

    def project_point(self, lat: float, lon: float) -> tuple[float, float]:
        most = radians(LCC_CLAMP_DEG)
        rho, theta = self.scale * self._t(max(-most, min(most, lat))) ** self.n, self.n * (lon - self.origin_lon)
        return rho * sin(theta), self._rho_0 - rho * cos(theta)

    def unproject(self, x, y) -> Column:
        n, scale, rho_0, e, lon0 = self.n, self.scale, self._rho_0, self.ellipsoid.e, self.origin_lon

        @F.pandas_udf(LATLON)
        def back(x: pd.Series, y: pd.Series) -> pd.DataFrame:
            x, down = x.to_numpy(np.float64, na_value=np.nan), rho_0 - y.to_numpy(np.float64, na_value=np.nan)
            rho, side = np.hypot(x, down) * copysign(1.0, n), copysign(1.0, n)
            lon = lon0 + np.arctan2(side * x, side * down) / n
            with np.errstate(all="ignore"):
                t = np.where(np.abs(rho) < SINGULAR, 0.0, (rho / scale) ** (1 / n))
            return _frame(_latitude(t, pi / 2 - 2 * np.arctan(t), e), lon)

        return _whole(back(_c(x), _c(y)))

    def recentered(self, lat: float, lon: float) -> LambertConic:
        return replace(self, origin_lat=lat, origin_lon=lon)


def projection(kind: str, p1: float = 0.0, p2: float = 0.0, lat0: float = 0.0, lon0: float = 0.0) -> Projection:
    """By name: lcc, stereographic or mercator. Angles in degrees."""
    made = {
        "lcc": lambda: LambertConic(radians(p1), radians(p2), radians(lat0), radians(lon0)),
        "stereographic": lambda: Stereographic(radians(lat0), radians(lon0)),
        "mercator": WebMercator,
    }
    if kind not in made:
        raise ValueError(f"unknown projection {kind!r}; there are {', '.join(made)}")
    return made[kind]()


def metres_to_latlon(x, y) -> Column:
    """EPSG:900913 metres to radians without clamping or wrapping, as feature files have them."""
    return _struct(lat=2.0 * F.atan(F.exp(_c(y) / F.lit(WGS84.a))) - pi / 2, lon=_c(x) / F.lit(WGS84.a))

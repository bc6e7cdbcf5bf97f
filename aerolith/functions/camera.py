"""Cameras as driver objects, view matrices in float32 and screen positions as columns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import cos, pi, radians, sin

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.ellipsoid import WGS84
from aerolith.functions.geodesy import _c, _struct, lla_to_ecef, normalize_longitude
from aerolith.functions.projections import Projection

#: How far the globe camera stands off at zoom 1, its clipping planes, the field of view and limits of the controls.
GLOBE_DISTANCE, GLOBE_NEAR, GLOBE_FAR, FIELD_OF_VIEW_DEG = 15_000_000.0, 50_000.0, 40_000_000.0, 45.0
TILTED_DISTANCE, TILTED_NEAR, TILTED_FAR, DEPTH_2D = 0.8, 0.01, 10.0, 1000.0
ZOOM_LIMITS, ZOOM_IN, ZOOM_OUT, TILTED_PITCH_DEG = (0.02, 1000.0), 1.1, 0.9, 35.0


class CameraError(ValueError):
    """InvalidZoom, InvalidAspectRatio, InvalidViewportBase or a centre that has no image."""


# -- matrices: 4 x 4, row first here; flat() gives the column-major order


def _eye() -> np.ndarray:
    return np.eye(4, dtype=np.float32)


def translation(x: float, y: float, z: float) -> np.ndarray:
    m = _eye()
    m[:3, 3] = np.array([x, y, z], np.float32)
    return m


def _rotation(i: int, j: int, angle: float) -> np.ndarray:
    m, a = _eye(), np.float32(angle)
    m[i, i] = m[j, j] = np.cos(a)
    m[i, j], m[j, i] = -np.sin(a), np.sin(a)
    return m


def rotation_x(angle: float) -> np.ndarray:
    return _rotation(1, 2, angle)


def rotation_y(angle: float) -> np.ndarray:
    return _rotation(2, 0, angle)


def rotation_z(angle: float) -> np.ndarray:
    return _rotation(0, 1, angle)


def ortho(left: float, right: float, bottom: float, top: float, near: float, far: float) -> np.ndarray:
    lo, hi = np.array([left, bottom, near], np.float32), np.array([right, top, far], np.float32)
    m = np.diag(np.append(np.float32(2) / (hi - lo) * np.array([1, 1, -1], np.float32), np.float32(1))).astype(np.float32)
    m[:3, 3] = -(hi + lo) / (hi - lo)
    return m


def perspective(fovy: float, aspect: float, near: float, far: float) -> np.ndarray:
    m = np.zeros((4, 4), np.float32)
    f = np.float32(1) / np.tan(np.float32(fovy) / np.float32(2))
    near, far = np.float32(near), np.float32(far)
    m[0, 0], m[1, 1] = f / np.float32(aspect), f
    m[2, 2], m[2, 3], m[3, 2] = (far + near) / (near - far), np.float32(2) * far * near / (near - far), np.float32(-1)
    return m


def multiply(*matrices: np.ndarray) -> np.ndarray:
    """Left to right, each entry summed in float32 in index order."""
    out = matrices[0]
    for m in matrices[1:]:
        terms = out[:, :, None] * m[None]
        out = ((terms[:, 0] + terms[:, 1]) + terms[:, 2]) + terms[:, 3]
    return out


def flat(m: np.ndarray) -> list[float]:
    return [float(v) for v in m.T.ravel()]


@dataclass(frozen=True)
class Camera:
    """A view of the map. Angles in radians."""

    lat: float
    lon: float
    height: float = 0.0
    zoom: float = 1.0
    rotation: float = 0.0
    pitch: float = 0.0
    roll: float = 0.0
    aspect_ratio: float = 1.0
    viewport_base_meters: float = 100_000.0

    def validate(self) -> Camera:
        for name, value in (("InvalidZoom", self.zoom), ("InvalidAspectRatio", self.aspect_ratio), ("InvalidViewportBase", self.viewport_base_meters)):
            if value <= 0:
                raise CameraError(name)
        return self

    def _centre(self, projection: Projection) -> tuple[float, float]:
        xy = projection.project_point(self.lat, self.lon)
        if xy is None:
            raise CameraError("Projection(Singularity)")
        return xy

    @property
    def width(self) -> float:
        return self.viewport_base_meters / self.zoom

    def matrix_2d(self, projection: Projection) -> np.ndarray:
        cx, cy = self.validate()._centre(projection)
        w = np.float32(self.width)
        h = w / np.float32(self.aspect_ratio)
        return multiply(ortho(-w / 2, w / 2, -h / 2, h / 2, -DEPTH_2D, DEPTH_2D), multiply(rotation_z(-self.rotation), translation(-cx, -cy, 0)))

    def matrix_tilted(self, projection: Projection) -> np.ndarray:
        cx, cy = self.validate()._centre(projection)
        d = np.float32(self.width) * np.float32(TILTED_DISTANCE)
        view = multiply(translation(0, 0, -d), rotation_y(self.roll), rotation_x(self.pitch), rotation_z(-self.rotation), translation(-cx, -cy, 0))
        return multiply(perspective(radians(FIELD_OF_VIEW_DEG), self.aspect_ratio, d * np.float32(TILTED_NEAR), d * np.float32(TILTED_FAR)), view)

    def matrix_globe(self) -> np.ndarray:
        self.validate()
        turn = multiply(rotation_x(self.lat - pi / 2), rotation_z(-self.lon - pi / 2))
        view = multiply(translation(0, 0, -self.globe_distance), rotation_y(self.roll), rotation_x(self.pitch), rotation_z(-self.rotation), turn)
        return multiply(perspective(radians(FIELD_OF_VIEW_DEG), self.aspect_ratio, GLOBE_NEAR, GLOBE_FAR), view)

    @property
    def globe_distance(self) -> float:
        return WGS84.a + GLOBE_DISTANCE / self.zoom

    # -- controls

    def zoomed(self, steps: int) -> Camera:
        """Wheel steps, in for positive ones."""
        z = self.zoom * (ZOOM_IN if steps > 0 else ZOOM_OUT) ** abs(steps)
        return replace(self, zoom=max(ZOOM_LIMITS[0], min(ZOOM_LIMITS[1], z)))

    def pitched(self, pitch: float) -> Camera:
        return replace(self, pitch=max(-pi, min(pi, pitch)))

    def rolled(self, roll: float) -> Camera:
        return replace(self, roll=(roll + pi) % (2 * pi) - pi)

    def in_mode(self, mode: str) -> Camera:
        return replace(self, pitch={"2.5D": radians(TILTED_PITCH_DEG), "2D": 0.0}.get(mode, self.pitch))

    def pan_metres(self, dx_px: float, dy_px: float, canvas_width: float) -> tuple[float, float]:
        """A drag on the screen as a move of the centre in the plane of the projection."""
        per_px = self.width / canvas_width
        x, y = -dx_px * per_px, dy_px * per_px
        return x * cos(self.rotation) - y * sin(self.rotation), x * sin(self.rotation) + y * cos(self.rotation)


def zoomed(zoom, steps) -> Column:
    """A camera's zoom after wheel steps, in for positive ones."""
    zoom, steps = _c(zoom), _c(steps)
    z = zoom * F.pow(F.when(steps > 0, ZOOM_IN).otherwise(ZOOM_OUT), F.abs(steps))
    return F.greatest(F.lit(ZOOM_LIMITS[0]), F.least(F.lit(ZOOM_LIMITS[1]), z))


def pitched(pitch) -> Column:
    return F.greatest(F.lit(-pi), F.least(F.lit(pi), _c(pitch)))


def rolled(roll) -> Column:
    """Into [-pi, pi)."""
    return normalize_longitude(roll)


def transformed(matrix: np.ndarray, x, y, z, row: int) -> Column:
    """A component of a point under a matrix, in double."""
    m = flat(matrix)
    return m[row] * _c(x) + m[4 + row] * _c(y) + m[8 + row] * _c(z) + m[12 + row]


def _perspective_pixels(m: list[float], x: Column, y: Column, z: Column, width: float, height: float) -> Column:
    """Pixels of a point under a matrix; null behind the near plane. The entries are float32, the arithmetic is double."""
    row = lambda k: m[k] * x + m[4 + k] * y + m[8 + k] * z + m[12 + k]
    w = row(3)
    px = (F.try_divide(row(0), w) + 1.0) * 0.5 * width
    py = (1.0 - F.try_divide(row(1), w)) * 0.5 * height
    return F.when(w > 0, _struct(x=px, y=py))


def screen(lat, lon, height, camera: Camera, projection: Projection | None, width: float, height_px: float, mode: str = "2D") -> Column:
    """Screen position struct<x, y> in mode 2D, 2.5D or 3D; null where the point is not seen."""
    lat, lon, height = _c(lat), _c(lon), _c(height)
    if mode == "3D":
        p, c = lla_to_ecef(lat, lon, height), _camera_ecef(camera)
        facing = c[0] * p["x"] + c[1] * p["y"] + c[2] * p["z"]
        pixels = _perspective_pixels(flat(camera.matrix_globe()), p["x"], p["y"], p["z"], width, height_px)
        return F.when(facing >= WGS84.a**2, pixels)
    xy = projection.project(lat, lon)
    if mode == "2.5D":
        return F.when(xy.isNotNull(), _perspective_pixels(flat(camera.matrix_tilted(projection)), xy["x"], xy["y"], height, width, height_px))
    cx, cy = camera._centre(projection)
    tx, ty, c, s = xy["x"] - cx, xy["y"] - cy, cos(-camera.rotation), sin(-camera.rotation)
    w = camera.width
    h = w / (width / height_px)
    px = ((tx * c - ty * s) / (w / 2) + 1.0) * 0.5 * width
    py = (1.0 - (tx * s + ty * c) / (h / 2)) * 0.5 * height_px
    return F.when(xy.isNotNull(), _struct(x=px, y=py))


def screen_single(lat, lon, height, camera: Camera, projection: Projection | None, width: int, height_px: int, mode: str = "2D") -> Column:
    """Screen position struct<x, y> in float32, as a renderer works it out: positions are made single before the matrix, and in 2D the aspect is the camera's own."""
    lat, lon, height = _c(lat), _c(lon), _c(height)
    one = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("float")
    across, down = one(width), one(height_px)
    half, unit = one(0.5), one(1.0)

    def pixels(m: list[float], x: Column, y: Column, z: Column) -> Column:
        row = lambda k: one(m[k]) * one(x) + one(m[4 + k]) * one(y) + one(m[8 + k]) * one(z) + one(m[12 + k])
        at = lambda k: (row(k) / row(3)).cast("float")  # noqa: E731  a quotient of singles is made single again
        return F.when(row(3) > 0, _struct(x=(at(0) + unit) * half * across, y=(unit - at(1)) * half * down))

    if mode == "3D":
        p, c = lla_to_ecef(lat, lon, height), _camera_ecef(camera)
        return F.when(c[0] * p["x"] + c[1] * p["y"] + c[2] * p["z"] >= WGS84.a**2, pixels(flat(camera.matrix_globe()), p["x"], p["y"], p["z"]))
    xy = projection.project(lat, lon)
    if mode == "2.5D":
        return F.when(xy.isNotNull(), pixels(flat(camera.matrix_tilted(projection)), xy["x"], xy["y"], height))
    cx, cy = projection.project_point(camera.lat, camera.lon) or (0.0, 0.0)
    tx, ty, c, s = xy["x"] - cx, xy["y"] - cy, cos(-camera.rotation), sin(-camera.rotation)
    w = np.float32(camera.width)
    h = w / np.float32(camera.aspect_ratio)
    ndc_x = (one(tx * c - ty * s) / one(w / np.float32(2))).cast("float")
    ndc_y = (one(tx * s + ty * c) / one(h / np.float32(2))).cast("float")
    return F.when(xy.isNotNull(), _struct(x=(ndc_x + unit) * half * across, y=(unit - ndc_y) * half * down))


def _camera_ecef(camera: Camera) -> tuple[float, float, float]:
    e, s = WGS84, sin(camera.lat)
    n = e.a / (1 - e.e_sq * s * s) ** 0.5
    h = camera.globe_distance - e.a
    return (n + h) * cos(camera.lat) * cos(camera.lon), (n + h) * cos(camera.lat) * sin(camera.lon), (n * (1 - e.e_sq) + h) * s


def on_screen(points: DataFrame, camera: Camera, projection: Projection | None, width: float, height_px: float, mode: str = "2D") -> DataFrame:
    """Points that are seen, with columns x and y; points have lat, lon and height in radians and metres."""
    at = screen("lat", "lon", "height", camera, projection, width, height_px, mode)
    return points.withColumn("__at", at).where(F.col("__at").isNotNull()).withColumns({"x": F.col("__at.x"), "y": F.col("__at.y")}).drop("__at")

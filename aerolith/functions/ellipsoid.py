"""The WGS84 ellipsoid and unit factors as plan-time constants."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def b(self) -> float:
        return self.a * (1.0 - self.f)

    @property
    def e_sq(self) -> float:
        return self.f * (2.0 - self.f)

    @property
    def e(self) -> float:
        return sqrt(self.e_sq)

    @property
    def e_prime_sq(self) -> float:
        return self.e_sq / (1.0 - self.e_sq)

    @property
    def mean_radius(self) -> float:
        """(2a + b) / 3, the sphere of the haversine solver."""
        return (2.0 * self.a + self.b) / 3.0


#: The reference ellipsoid, and conversions of display units.
WGS84 = Ellipsoid(a=6378137.0, f=1.0 / 298.257223563)
FEET_PER_METRE, KNOTS_PER_MPS = 3.28084, 1.94384

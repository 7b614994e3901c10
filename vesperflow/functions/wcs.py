"""Pixel to sky and back for tangent-plane headers, with SIP distortion; header values are plain numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesperflow.functions.mathx import col
from vesperflow.functions.sphere import gnomonic, gnomonic_inverse


@dataclass(frozen=True)
class Tan:
    """Reference pixel, reference direction (radians), CD matrix (radians a pixel), SIP coefficients by (p, q)."""

    x0: float
    y0: float
    ra: float
    dec: float
    cd: tuple[float, float, float, float]
    a: dict = field(default_factory=dict)
    b: dict = field(default_factory=dict)
    ap: dict = field(default_factory=dict)
    bp: dict = field(default_factory=dict)

    @staticmethod
    def from_header(h: dict) -> Tan:
        d = math.pi / 180
        scale = (float(h.get("CDELT1", 1)), float(h.get("CDELT2", 1)))
        rot = float(h.get("CROTA2", 0)) * d
        cd = (scale[0] * math.cos(rot), -scale[1] * math.sin(rot), scale[0] * math.sin(rot), scale[1] * math.cos(rot))
        if "CD1_1" in h:
            cd = tuple(float(h.get(f"CD{i}_{j}", 0)) for i in (1, 2) for j in (1, 2))
        sip = {k: {(p, q): float(h[f"{k}_{p}_{q}"]) for p in range(10) for q in range(10) if f"{k}_{p}_{q}" in h} for k in ("A", "B", "AP", "BP")}
        return Tan(float(h["CRPIX1"]), float(h["CRPIX2"]), float(h["CRVAL1"]) * d, float(h["CRVAL2"]) * d, tuple(v * d for v in cd), sip["A"], sip["B"], sip["AP"], sip["BP"])

    def to_sky(self, x, y) -> tuple[Column, Column]:
        u, v = col(x) - self.x0, col(y) - self.y0
        u, v = u + _poly(self.a, u, v), v + _poly(self.b, u, v)
        xi, eta = u * self.cd[0] + v * self.cd[1], u * self.cd[2] + v * self.cd[3]
        return gnomonic_inverse(xi, eta, self.ra, self.dec)

    def to_pixel(self, ra, dec) -> tuple[Column, Column]:
        xi, eta = gnomonic(ra, dec, self.ra, self.dec)
        det = self.cd[0] * self.cd[3] - self.cd[1] * self.cd[2]
        u, v = (xi * self.cd[3] - eta * self.cd[1]) / det, (eta * self.cd[0] - xi * self.cd[2]) / det
        return u + _poly(self.ap, u, v) + self.x0, v + _poly(self.bp, u, v) + self.y0


def _poly(c: dict, u: Column, v: Column) -> Column:
    return sum((F.pow(u, F.lit(float(p))) * F.pow(v, F.lit(float(q))) * k for (p, q), k in c.items()), F.lit(0.0))

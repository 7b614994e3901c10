"""Sky regions as predicates: coarse boxes that reach the Parquet scan, and an exact test as columns.

A region gives both. `within(df, region)` filters by their conjunction: the coarse part is plain comparisons of stored
columns, so row groups are skipped by statistics; the exact part runs on what is left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperflow.functions import healpix
from vesperflow.functions.angles import wrap_signed
from vesperflow.functions.mathx import TAU, col
from vesperflow.functions.sphere import separation, unit

EPSILON = 1e-12


@dataclass(frozen=True)
class Box:
    """Right ascension and declination bounds, inclusive; ra_max may be below ra_min for a box over RA 0."""

    ra_min: float
    ra_max: float
    dec_min: float
    dec_max: float

    def __post_init__(self):
        if self.dec_min > self.dec_max:
            raise ValueError("declination bounds are inverted")

    def parts(self) -> list[tuple[float, float, float, float]]:
        """The box as one or two that do not cross RA 0."""
        if self.ra_max - self.ra_min >= TAU - EPSILON:
            return [(0.0, TAU, self.dec_min, self.dec_max)]
        a, b = self.ra_min % TAU, self.ra_max % TAU
        if a <= b:
            return [(a, b, self.dec_min, self.dec_max)]
        return [(a, TAU, self.dec_min, self.dec_max), (0.0, b, self.dec_min, self.dec_max)]

    def coarse(self, ra="ra", dec="decl") -> Column:
        return reduce(Column.__or__, (col(ra).between(a - EPSILON, b + EPSILON) & col(dec).between(lo - EPSILON, hi + EPSILON) for a, b, lo, hi in self.parts()))

    def exact(self, ra="ra", dec="decl") -> Column:
        return self.coarse(ra, dec)

    def sql(self, ra: str = "ra", dec: str = "decl", degrees: bool = False) -> str:
        """The box as SQL text for a remote catalogue."""
        k = 180 / math.pi if degrees else 1.0
        return " OR ".join(f"({ra} >= {a * k!r} AND {ra} <= {b * k!r} AND {dec} >= {lo * k!r} AND {dec} <= {hi * k!r})" for a, b, lo, hi in self.parts())


@dataclass(frozen=True)
class Cone:
    """All within a radius of a centre, the edge included."""

    ra: float
    dec: float
    radius: float

    def __post_init__(self):
        if not 0 <= self.radius <= math.pi or not abs(self.dec) <= math.pi / 2:
            raise ValueError("radius must be within 0 and pi, declination within -pi/2 and pi/2")

    def box(self) -> Box:
        lo, hi = self.dec - self.radius, self.dec + self.radius
        if lo <= -math.pi / 2 or hi >= math.pi / 2:  # touches a pole: every RA
            return Box(0.0, TAU, max(lo, -math.pi / 2), min(hi, math.pi / 2))
        half = math.asin(min(1.0, math.sin(self.radius) / math.cos(self.dec)))
        return Box(self.ra - half, self.ra + half, lo, hi)

    def coarse(self, ra="ra", dec="decl") -> Column:
        return self.box().coarse(ra, dec)

    def exact(self, ra="ra", dec="decl") -> Column:
        return separation(F.lit(self.ra), F.lit(self.dec), ra, dec) <= self.radius + EPSILON


@dataclass(frozen=True)
class Polygon:
    """A simple polygon of (ra, dec) vertices, or a triangle with three.

    mode "planar": even-odd rule in the plane (delta ra * cos dec0, delta dec) about the vertices' mean, edges inside.
    mode "spherical": inside all great-circle half spaces of a convex ring.
    """

    vertices: tuple[tuple[float, float], ...]
    mode: str = "planar"
    centre: tuple[float, float] = field(init=False)

    def __post_init__(self):
        if len(self.vertices) < 3:
            raise ValueError("a polygon needs at least three vertices")
        s, c = sum(math.sin(a) for a, _ in self.vertices), sum(math.cos(a) for a, _ in self.vertices)
        object.__setattr__(self, "centre", (math.atan2(s, c) % TAU, sum(d for _, d in self.vertices) / len(self.vertices)))
        if self.mode == "spherical" and not self._normals():
            raise ValueError("a spherical region must be convex and not degenerate")

    def flat(self) -> list[tuple[float, float]]:
        a0, d0 = self.centre
        return [(((a - a0 + math.pi) % TAU - math.pi) * math.cos(d0), d - d0) for a, d in self.vertices]

    def box(self) -> Box:
        a0, d0 = self.centre
        xs, ys = zip(*self.flat(), strict=True)
        if self.mode == "spherical":  # great-circle edges may bulge beyond their ends: a cone about the centre
            r = max(math.acos(max(-1.0, min(1.0, math.sin(d) * math.sin(d0) + math.cos(d) * math.cos(d0) * math.cos(a - a0)))) for a, d in self.vertices)
            return Cone(a0, d0, min(r, math.pi)).box()
        c = math.cos(d0)
        return Box(a0 + min(xs) / c, a0 + max(xs) / c, d0 + min(ys), d0 + max(ys))

    def coarse(self, ra="ra", dec="decl") -> Column:
        return self.box().coarse(ra, dec)

    def _normals(self) -> list[tuple[float, float, float]]:
        v = [(math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)) for a, d in dict.fromkeys(self.vertices)]
        out = []
        for sign in (1, -1):
            out = []
            for p, q in zip(v, v[1:] + v[:1], strict=True):
                n = tuple(sign * (p[(k + 1) % 3] * q[(k + 2) % 3] - p[(k + 2) % 3] * q[(k + 1) % 3]) for k in range(3))
                if math.hypot(*n) < EPSILON or any(sum(a * b for a, b in zip(n, w, strict=True)) < -1e-10 for w in v):
                    break
                out.append(n)
            if len(out) == len(v) >= 3:
                return out
        return []

    def exact(self, ra="ra", dec="decl") -> Column:
        if self.mode == "spherical":
            u = unit(ra, dec)
            return reduce(Column.__and__, (u[0] * F.lit(n[0]) + u[1] * F.lit(n[1]) + u[2] * F.lit(n[2]) >= -EPSILON for n in self._normals()))
        a0, d0 = self.centre
        x, y = wrap_signed(col(ra) - a0) * math.cos(d0), col(dec) - d0
        crossings, on_edge = F.lit(0), F.lit(False)
        ring = self.flat()
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            length = math.hypot(x2 - x1, y2 - y1) or 1.0
            cross = ((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) / length
            along = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / length
            on_edge = on_edge | ((F.abs(cross) <= EPSILON) & along.between(-EPSILON, length + EPSILON))
            if y1 != y2:
                crossings = crossings + (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)).cast("int")
        return on_edge | (F.pmod(crossings, F.lit(2)) == 1)


def Triangle(a, b, c, mode: str = "planar") -> Polygon:
    return Polygon((a, b, c), mode)


@dataclass(frozen=True)
class Square:
    """|delta ra * cos dec0| and |delta dec| both strictly below a half width: not a cone."""

    ra: float
    dec: float
    half: float

    def coarse(self, ra="ra", dec="decl") -> Column:
        c = math.cos(self.dec)
        half = min(math.pi, self.half / c) if c > EPSILON else math.pi
        return Box(self.ra - half, self.ra + half, self.dec - self.half, self.dec + self.half).coarse(ra, dec)

    def exact(self, ra="ra", dec="decl") -> Column:
        return (F.abs(wrap_signed(col(ra) - self.ra) * math.cos(self.dec)) < self.half) & (F.abs(col(dec) - self.dec) < self.half)


def within(df: DataFrame, region, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """The rows inside a region."""
    return df.where(region.coarse(ra, dec)).where(region.exact(ra, dec))


def any_of(df: DataFrame, regions: list, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """The rows inside at least one of several regions, each once."""
    return df.where(reduce(Column.__or__, (r.coarse(ra, dec) & r.exact(ra, dec) for r in regions)))


def magnitude_range(df: DataFrame, low: float | None = None, high: float | None = None, mag: str = "mag") -> DataFrame:
    """Rows with a magnitude, within the bounds that are given."""
    df = df.where(F.col(mag).isNotNull())
    df = df if low is None else df.where(F.col(mag) >= low)
    return df if high is None else df.where(F.col(mag) <= high)


#: Pixels of a cover that go into the plan as a list; larger covers are joined.
COVER_LITERALS = 4096


def by_cover(df: DataFrame, cone: Cone, nside: int = 64, pixel: str = "hpx", ra: str = "ra", dec: str = "decl", literals: int = COVER_LITERALS) -> DataFrame:
    """A cone search over a stored NESTED pixel column: cover pixels first, then the exact test.

    A small cover, of at most `literals` pixels, is a list in the filter, which prunes partitions and row groups; a larger one is a semi-join whose
    strategy the optimizer takes from its size.
    """
    cover = healpix.cone_cover(cone.ra, cone.dec, cone.radius, nside)
    if len(cover) <= literals:
        return df.where(F.col(pixel).isin(cover)).where(cone.exact(ra, dec))
    pixels = df.sparkSession.createDataFrame([(p,) for p in cover], f"{pixel} long")
    return df.join(pixels, pixel, "left_semi").where(cone.exact(ra, dec))

"""What a caller may plug in: projections, time models, catalogues, event handlers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame

from vesperflow.functions import sphere
from vesperflow.functions import time as times


class Projection(Protocol):
    """A projection gives the columns (x, y) of directions, and the directions of points."""

    def project(self, ra, dec) -> tuple[Column, Column]: ...

    def unproject(self, x, y) -> tuple[Column, Column]: ...


class Catalogue(Protocol):
    """A catalogue gives candidates (id, ra, decl, mag) for a region's coarse boxes; the exact test is made after it."""

    def candidates(self, boxes: list[tuple[float, float, float, float]]) -> DataFrame: ...


class Handler(Protocol):
    """A handler makes a table of a batch of messages."""

    def __call__(self, batch: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Azimuthal:
    """One of the azimuthal projections about a centre."""

    name: str
    ra: float = 0.0
    dec: float = 0.0

    def project(self, ra, dec) -> tuple[Column, Column]:
        return sphere.PROJECTIONS[self.name](ra, dec, self.ra, self.dec)

    def unproject(self, x, y) -> tuple[Column, Column]:
        return sphere.azimuthal_inverse(self.name, x, y, self.ra, self.dec)


@dataclass(frozen=True)
class Cylindrical:
    """One of the cylindrical projections, by name or by family and standard parallel (degrees)."""

    name: str
    ra: float = 0.0
    parallel: float | None = None
    eccentricity: float = 0.0

    def project(self, ra, dec) -> tuple[Column, Column]:
        return sphere.cylindrical(self.name, ra, dec, self.ra, self.parallel, self.eccentricity)

    def unproject(self, x, y) -> tuple[Column, Column]:
        return sphere.cylindrical_inverse(self.name, x, y, self.ra, self.parallel, self.eccentricity)


def with_plane(df: DataFrame, projection: Projection, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """`df` with x and y by any projection."""
    x, y = projection.project(ra, dec)
    return df.withColumns({"x": x, "y": y})


def in_region(catalogue: Catalogue, region, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """A catalogue's stars in a region: its candidates for the region's boxes, then the exact test."""
    boxes = (region.box() if hasattr(region, "box") else region).parts()
    return catalogue.candidates(boxes).where(region.exact(ra, dec))


@dataclass(frozen=True)
class TimeModels:
    """The models a time conversion asks: leap seconds by MJD, TT - UT1 by year, TDB from TT. Any may be replaced."""

    leap: Callable[[Column], Column] = field(default=times.tai_minus_utc)
    delta_t: Callable[[Column], Column] = field(default=times.delta_t)
    tdb: Callable[[Column], Column] = field(default=times.tt_to_tdb)

    def utc_to_tt(self, t: Column) -> Column:
        return times.tai_to_tt(times.shift(t, lambda u: self.leap(times.mjd(u)) / 86400))

    def tt_to_ut1(self, t: Column) -> Column:
        return times.shift(t, lambda u: -self.delta_t((times.mjd(u) - 51544.5) / 365.25 + 2000) / 86400)

    def utc_to_tdb(self, t: Column) -> Column:
        return self.tdb(self.utc_to_tt(t))

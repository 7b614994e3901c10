"""Mount geometry: polar alignment, meridian flips, dome slits, sensor fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperflow.functions.angles import wrap_positive, wrap_signed
from vesperflow.functions.mathx import col, cross, norm
from vesperflow.operators.robust import linear


def axis_of_three(p: list[tuple[float, float]]) -> tuple[float, float]:
    """(azimuth, altitude) of the axis about which three directions (azimuth, altitude) turn, on the upper side."""
    v = np.array([[math.cos(h) * math.cos(a), math.cos(h) * math.sin(a), math.sin(h)] for a, h in p])
    n = np.cross(v[1] - v[0], v[2] - v[1])
    if np.linalg.norm(n) < 1e-12:
        raise ValueError("the directions do not turn")
    n = n / np.linalg.norm(n) * (1 if n[2] >= 0 else -1)
    return math.atan2(n[1], n[0]) % (2 * math.pi), math.asin(n[2])


def axes_of_three(df: DataFrame, key: str, points: list[tuple[str, str]]) -> DataFrame:
    """(key, azimuth, altitude) of the axis of each row's three directions, named by (azimuth, altitude) columns; null
    where they do not turn. In columns: the cross product of the two steps."""
    v = [F.array(F.cos(h) * F.cos(a), F.cos(h) * F.sin(a), F.sin(h)) for a, h in ((col(x), col(y)) for x, y in points)]
    step = lambda p, q: F.zip_with(q, p, lambda x, y: x - y)
    n = df.select(key, cross(step(v[0], v[1]), step(v[1], v[2])).alias("_n")).withColumn("_l", norm("_n"))
    up = F.when(F.col("_n")[2] >= 0, 1.0).otherwise(-1.0) / F.when(F.col("_l") > 1e-12, F.col("_l"))
    return n.select(key, wrap_positive(F.atan2(F.col("_n")[1] * up, F.col("_n")[0] * up)).alias("azimuth"), F.asin(F.col("_n")[2] * up).alias("altitude"))


def polar_error(p: list[tuple[float, float]], latitude: float) -> tuple[float, float]:
    """(azimuth, altitude) errors of the mount's axis from three directions at one declination; north is azimuth 0.

    In the south the axis is compared with the southern pole.
    """
    a, h = axis_of_three(p)
    pole = 0.0 if latitude >= 0 else math.pi
    return (a - pole + math.pi) % (2 * math.pi) - math.pi, h - abs(latitude)


def pier_side(hour_angle) -> Column:
    """west for objects east of the meridian (the telescope's side), east for those west of it."""
    return F.when(wrap_signed(col(hour_angle)) < 0, "west").otherwise("east")


def flip_decision(hour_angle, flipped, *, before: float = 0.0, after: float = 0.1, limit: float = 0.5, tracking=None, exposing=None) -> Column:
    """none, wait, flip, or stop for telemetry: hour angles in radians relative to the meridian.

    A flip is due from `after` past the meridian; within `before` ahead of it or during an exposure it waits; beyond
    `limit` without a flip the mount stops.
    """
    h = wrap_signed(col(hour_angle))
    on = F.lit(True) if tracking is None else col(tracking)
    busy = F.lit(False) if exposing is None else col(exposing)
    return F.when(~on | col(flipped) | (h < -before), "none").when(h >= limit, "stop").when((h >= after) & ~busy, "flip").otherwise("wait")


def dome_azimuth(azimuth, altitude, *, radius: float, north: float = 0.0, east: float = 0.0, up: float = 0.0, arm=0.0) -> Column:
    """The azimuth at which the telescope's axis leaves a round dome.

    The mount's centre is (north, east, up) from the dome's; `arm` moves the tube sideways, to the right of its azimuth.
    """
    a, h = col(azimuth), col(altitude)
    px, py = F.lit(north) - F.sin(a) * col(arm), F.lit(east) + F.cos(a) * col(arm)
    dx, dy, dz = F.cos(h) * F.cos(a), F.cos(h) * F.sin(a), F.sin(h)
    b = px * dx + py * dy + dz * up
    t = -b + F.sqrt(b * b + radius * radius - px * px - py * py - up * up)
    return wrap_positive(F.atan2(py + dy * t, px + dx * t))


# ---- sensor characterisation over measured levels --------------------------------------------------------------------


def photon_transfer(points: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """(by, gain, read_noise): electrons a unit from the slope of variance over mean between two levels, and the noise at 0."""
    s = linear(points.where(F.col("mean").between(low, high)), by, "mean", "variance")
    gain = F.when(F.col("slope") > 0, F.lit(1.0) / F.col("slope"))
    return s.select(*by, gain.alias("gain"), (F.sqrt(F.greatest(F.col("intercept"), F.lit(0.0))) * gain).alias("read_noise"), "n")


def linearity(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, slope, intercept, error): the line of mean over exposure and the largest deviation in percent of the range."""
    s = linear(points, by, "exposure", "mean").select(*by, "slope", "intercept")
    d = points.join(s, by).withColumn("_e", F.abs(F.col("mean") - F.col("intercept") - F.col("slope") * F.col("exposure")))
    return d.groupBy(*by).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), (F.max("_e") * 100 / (F.max("mean") - F.min("mean"))).alias("error"))


def dark_current(points: DataFrame, by: list[str], gain: float) -> DataFrame:
    """(by, rate): electrons a second from the slope of dark level over exposure."""
    return linear(points, by, "exposure", "mean").select(*by, (F.col("slope") * gain).alias("rate"))

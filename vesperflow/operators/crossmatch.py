"""Image to catalogue cross-match: a cone of the catalogue projected about the image's centre, its brightest stars matched
by pattern, the centre mended, every detection with its star or none."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesperflow.functions.sphere import gnomonic
from vesperflow.operators import joins, matching, region, stack

#: Brightest stars of either side that find the pattern, and rounds of a new centre.
BRIGHTEST, ROUNDS = 256, 2
ARCSEC = math.pi / 648000


def project(catalogue: DataFrame, ra: float, dec: float, radius: float, scale: float, faintest: float | None = None) -> DataFrame:
    """(id, ra, decl, mag, x, y): the stars of a cone, x and y on its tangent plane in units of `scale` radians."""
    cone = region.within(catalogue, region.Cone(ra, dec, radius))
    cone = cone if faintest is None else cone.where(F.col("mag") <= faintest)
    x, y = gnomonic("ra", "decl", ra, dec)
    return cone.select("id", "ra", "decl", "mag", (x / scale).alias("x"), (y / scale).alias("y")).dropna(subset=["x", "y"])


def brightest(stars: DataFrame, order, n: int = BRIGHTEST) -> DataFrame:
    return stars.orderBy(order, stars.columns[0]).limit(n)


@dataclass(frozen=True)
class Solution:
    """matrix: from detection to tangent plane about (ra, dec); rounds: how often the centre was mended."""

    ra: float
    dec: float
    matrix: np.ndarray
    rounds: int


def _sky(ra: float, dec: float, x: float, y: float) -> tuple[float, float]:
    """The direction of a point of the tangent plane at (ra, dec)."""
    r = math.sqrt(x * x + y * y + 1)
    return (ra + math.atan2(x, math.cos(dec) - y * math.sin(dec))) % (2 * math.pi), math.asin((y * math.cos(dec) + math.sin(dec)) / r)


def solve(detections: DataFrame, catalogue: DataFrame, ra: float, dec: float, radius: float, scale: float, centre: tuple[float, float], tolerance: float = 3.0, rounds: int = ROUNDS) -> Solution | None:
    """The similarity of detections (idx, x, y, flux) to the sky about a first guess; None without a sure pattern.

    Only the brightest stars of both sides reach the driver. While the image's `centre` comes out more than an arcsecond
    from where the plane touches, the plane is moved there and the match made again, `rounds` times at most.
    """
    seen = np.array([(r.x, r.y) for r in brightest(detections, F.desc("flux")).select("idx", "x", "y").collect()], float).reshape(-1, 2)
    found = None
    for k in range(rounds + 1):
        stars = brightest(project(catalogue, ra, dec, radius, scale), F.col("mag")).select("id", "x", "y").collect()
        matrix, pairs = matching.match(np.array([(r.x, r.y) for r in stars], float).reshape(-1, 2), seen, tolerance)
        if len(pairs) < 3 or not np.isfinite(matrix).all():
            return found
        found = Solution(ra, dec, matrix, k)
        x, y = matrix[:, :2] @ centre + matrix[:, 2]
        moved = _sky(ra, dec, x * scale, y * scale)
        gap = math.hypot(x * scale, y * scale)
        if gap <= ARCSEC:
            break
        ra, dec = moved
    return found


def match(detections: DataFrame, catalogue: DataFrame, solution: Solution, radius: float, scale: float, within: float = 3.0, top: int | None = None) -> DataFrame:
    """(idx, id, residual, sep): every detection with the star it pairs with one to one within so many pixels, or nulls.

    Pairs come by cells of the plane; those that compete are taken by rising distance. top: only so many of the brightest stars.
    """
    m = solution.matrix
    placed = detections.select("idx", (F.col("x") * float(m[0, 0]) + F.col("y") * float(m[0, 1]) + float(m[0, 2])).alias("x"), (F.col("x") * float(m[1, 0]) + F.col("y") * float(m[1, 1]) + float(m[1, 2])).alias("y"))
    stars = project(catalogue, solution.ra, solution.dec, radius, scale)
    stars = stars if top is None else brightest(stars, F.col("mag"), top)
    near = joins.radius_join(placed, stars.select("id", "x", "y"), within).select(F.lit(0).alias("frame"), "idx", F.col("r_id").alias("id"), "d2")
    near = near.withColumn("_n", F.greatest(F.count("*").over(Window.partitionBy("idx")), F.count("*").over(Window.partitionBy("id"))))
    sure = near.where(F.col("_n") == 1).select("idx", "id", "d2")
    # pairs that share a detection or star with another, which are few, are walked in order
    walked = stack.greedy_pairs(near.where(F.col("_n") > 1), "frame", "idx", "id", "d2").select("idx", "id", "d2")
    kept = sure.unionByName(walked).select("idx", "id", F.sqrt("d2").alias("residual"))
    return detections.select("idx").join(kept, "idx", "left")


def summary(matches: DataFrame) -> DataFrame:
    """(detections, matched, mean, median, rms) of residuals."""
    r = F.col("residual")
    return matches.agg(F.count("*").alias("detections"), F.count("id").alias("matched"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.sqrt(F.avg(r * r)).alias("rms"))


def unambiguous(matches: DataFrame, stars: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Matches whose star has no other detection's star within `ratio` times the residual: (idx, id, residual)."""
    near = joins.radius_join(stars.select("id", "x", "y"), stars.select("id", "x", "y"), 1.0).where("id != r_id")
    crowded = near.groupBy("id").agg(F.min("d2").alias("_d"))
    m = matches.join(crowded, "id", "left")
    return m.where(F.col("_d").isNull() | (F.sqrt("_d") > F.col("residual") * ratio)).select("idx", "id", "residual")

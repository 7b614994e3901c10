"""HEALPix pixels as columns (Gorski et al. 2005), and covers of cones made on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperflow.functions.mathx import col

_RING_OF_FACE = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
_LONGITUDE_OF_FACE = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def _check(nside: int) -> int:
    if nside < 1 or nside & (nside - 1) or nside > 1 << 24:
        raise ValueError("nside must be a power of two up to 2 ** 24")
    return nside


def _quarter(a) -> Column:
    t = col(a) * F.lit(2 / math.pi)
    return t - F.floor(t / 4) * 4


def _prepared(df: DataFrame, ra: str, dec: str, n: int) -> DataFrame:
    """Columns _z, _t (longitude in quarter turns), and the numbers of the diagonals _jp, _jm through the direction."""
    df = df.withColumns({"_z": F.sin(col(dec)), "_t": _quarter(ra)})
    return df.withColumns({"_jp": F.floor((F.col("_t") + 0.5) * n - F.col("_z") * (0.75 * n)).cast("long"), "_jm": F.floor((F.col("_t") + 0.5) * n + F.col("_z") * (0.75 * n)).cast("long")})


def with_ring_pixel(df: DataFrame, out: str, nside: int, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """`df` with the RING pixel of each direction. Steps are columns of their own, so no expression is repeated."""
    n = _check(nside)
    d = _prepared(df, ra, dec, n)
    z, t, jp, jm = (F.col(c) for c in ("_z", "_t", "_jp", "_jm"))
    d = d.withColumns({"_ir": jp - jm + (n + 1), "_w": F.sqrt((F.lit(1.0) - F.abs(z)) * 3) * n, "_tp": t - F.floor(t)})
    d = d.withColumn("_ring", F.floor(F.col("_tp") * F.col("_w")) + F.floor((F.lit(1.0) - F.col("_tp")) * F.col("_w")) + 1)
    ir, ring = F.col("_ir"), F.col("_ring")
    ip = F.pmod(F.floor((jp + jm - n + (F.lit(1) - F.pmod(ir, F.lit(2))) + 1) / 2), F.lit(4 * n))
    ipc = F.pmod(F.floor(t * ring), ring * 4)
    cap = F.when(z > 0, ring * 2 * (ring - 1) + ipc).otherwise(F.lit(12 * n * n) - ring * 2 * (ring + 1) + ipc)
    d = d.withColumn(out, F.when(F.abs(z) <= 2 / 3, F.lit(2 * n * (n - 1)) + (ir - 1) * (4 * n) + ip).otherwise(cap).cast("long"))
    return d.drop("_z", "_t", "_jp", "_jm", "_ir", "_w", "_tp", "_ring")


def _spread(v: Column, bits: int) -> Column:
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), 2 * b))
    return out


def with_nested_pixel(df: DataFrame, out: str, nside: int, ra: str = "ra", dec: str = "decl") -> DataFrame:
    """`df` with the NESTED pixel of each direction. Steps are columns of their own, so no expression is repeated."""
    n = _check(nside)
    d = _prepared(df, ra, dec, n)
    z, t, jp, jm = (F.col(c) for c in ("_z", "_t", "_jp", "_jm"))
    d = d.withColumns({"_fp": F.floor(jp / n).cast("long"), "_fm": F.floor(jm / n).cast("long"), "_q": F.least(F.floor(t), F.lit(3)).cast("long"), "_w": F.sqrt((F.lit(1.0) - F.abs(z)) * 3) * n})
    fp, fm, q, w = (F.col(c) for c in ("_fp", "_fm", "_q", "_w"))
    d = d.withColumns({"_up": F.least(F.floor((t - q) * w), F.lit(n - 1)).cast("long"), "_um": F.least(F.floor((F.lit(1.0) - (t - q)) * w), F.lit(n - 1)).cast("long")})
    up, um, north, belt = F.col("_up"), F.col("_um"), z > 0, F.abs(z) <= 2 / 3
    face = F.when(belt, F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, F.pmod(fp, F.lit(4))).otherwise(F.pmod(fm, F.lit(4)) + 8)).otherwise(F.when(north, q).otherwise(q + 8))
    x = F.when(belt, F.pmod(jm, F.lit(n))).otherwise(F.when(north, F.lit(n - 1) - um).otherwise(up))
    y = F.when(belt, F.lit(n - 1) - F.pmod(jp, F.lit(n))).otherwise(F.when(north, F.lit(n - 1) - up).otherwise(um))
    d = d.withColumns({"_face": face.cast("long"), "_x": x.cast("long"), "_y": y.cast("long")})
    bits = n.bit_length() - 1
    d = d.withColumn(out, F.col("_face") * (n * n) + _spread(F.col("_x"), bits) + F.shiftleft(_spread(F.col("_y"), bits), 1))
    return d.drop("_z", "_t", "_jp", "_jm", "_fp", "_fm", "_q", "_w", "_up", "_um", "_face", "_x", "_y")


def parent(pixel, levels: int) -> Column:
    """The NESTED pixel that holds this one, so many levels up."""
    return F.shiftright(col(pixel), 2 * levels)


def nested_centre(pixels: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    """(longitude, latitude) of NESTED pixel centres."""
    n = _check(nside)
    p = np.asarray(pixels, np.int64)
    face, rest = p // (n * n), p % (n * n)
    x, y = np.zeros_like(p), np.zeros_like(p)
    for b in range(n.bit_length() - 1):
        x |= ((rest >> (2 * b)) & 1) << b
        y |= ((rest >> (2 * b + 1)) & 1) << b
    jr = np.array(_RING_OF_FACE)[face] * n - x - y - 1
    nr = np.where(jr < n, jr, np.where(jr > 3 * n, 4 * n - jr, n))
    z = np.where(jr < n, 1 - nr**2 / (3 * n * n), np.where(jr > 3 * n, nr**2 / (3 * n * n) - 1, (2 * n - jr) * 2 / (3 * n)))
    shift = np.where((jr < n) | (jr > 3 * n), 0, (jr - n) & 1)
    jp = (np.array(_LONGITUDE_OF_FACE)[face] * nr + x - y + 1 + shift) // 2
    jp = np.where(jp > 4 * n, jp - 4 * n, np.where(jp < 1, jp + 4 * n, jp))
    return (jp - (shift + 1) / 2) * (math.pi / 2) / nr, np.arcsin(z)


def reach(nside: int) -> float:
    """An upper bound of the distance from a pixel's centre to its corners."""
    return min(math.pi, 1.6 / nside)


def _cover(nside: int, touches) -> list[int]:
    """NESTED pixels that may touch a region, by refining those whose parents may. `touches(u, reach)` says of centres as
    unit vectors whether a pixel of that reach may."""
    pixels, n = np.arange(12), 1
    while True:
        lon, lat = nested_centre(pixels, n)
        u = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
        pixels = pixels[touches(u, reach(n))]
        if n == nside:
            return pixels.tolist()
        n *= 2
        pixels = (pixels[:, None] * 4 + np.arange(4)).ravel()


def polygon_cover(normals, nside: int) -> list[int]:
    """Pixels that may touch a convex spherical polygon, given by the inward normals of its sides."""
    m = np.asarray(normals, float)
    m = m / np.linalg.norm(m, axis=1)[:, None]
    return _cover(nside, lambda u, r: (np.arcsin(np.clip(u @ m.T, -1, 1)) >= -r).all(1))


def box_cover(parts: list[tuple[float, float, float, float]], nside: int) -> list[int]:
    """Pixels that may touch any of some boxes (ra_min, ra_max, dec_min, dec_max) that do not cross RA 0."""

    def touches(u: np.ndarray, r: float) -> np.ndarray:
        lat, lon = np.arcsin(np.clip(u[:, 2], -1, 1)), np.arctan2(u[:, 1], u[:, 0]) % (2 * math.pi)
        out = np.zeros(len(u), bool)
        for a0, a1, d0, d1 in parts:
            rows = (lat >= d0 - r) & (lat <= d1 + r)
            near_pole = np.minimum(np.abs(lat) + r, math.pi / 2)
            wide = np.where(near_pole >= math.pi / 2 - 1e-9, math.pi, np.arcsin(np.minimum(1.0, np.sin(min(r, math.pi / 2)) / np.maximum(np.cos(np.abs(lat)), 1e-12))))
            mid, half = (a0 + a1) / 2, (a1 - a0) / 2
            out |= rows & (np.abs((lon - mid + math.pi) % (2 * math.pi) - math.pi) <= half + wide)
        return out

    return _cover(nside, touches)


def cone_cover(a: float, d: float, radius: float, nside: int) -> list[int]:
    """NESTED pixels that may touch a cone, by refining those whose parents may; none that touches is left out."""
    v = np.array([math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)])
    return _cover(nside, lambda u, r: np.arccos(np.clip(u @ v, -1, 1)) <= radius + r)

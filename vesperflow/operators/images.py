"""Whole-image kernels: a row of an image table is one frame, decoded, worked on and handed on by one task.

An image table has any key columns and (width, height, channels, pixels), pixels row by row with channels interleaved.
Frames are independent, so these scale with their number; relational pixel operators are in `stack`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def planes(width: int, height: int, channels: int, pixels) -> np.ndarray:
    return np.asarray(pixels, float).reshape(height, width, channels).transpose(2, 0, 1)


def from_pixels(pixels: DataFrame, by: str, width: int, height: int, channels: int = 1) -> DataFrame:
    """(by, width, height, channels, pixels) from rows (by, x, y, c, value), one value a place; what is not there is 0."""
    place = ((F.col("y") * width + F.col("x")) * channels + (F.col("c") if "c" in pixels.columns else F.lit(0))).cast("int")
    m = pixels.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(place, F.col("value").cast("double")))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(width * height * channels - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    return m.select(by, F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(channels).alias("channels"), values.alias("pixels"))


def to_pixels(images: DataFrame, by: str) -> DataFrame:
    """(by, x, y, c, value): one row for each sample."""
    p = images.select(by, "width", "channels", F.posexplode("pixels").alias("_i", "value"))
    at = F.floor(F.col("_i") / F.col("channels"))
    return p.select(by, F.pmod(at, F.col("width")).cast("int").alias("x"), F.floor(at / F.col("width")).cast("int").alias("y"), F.pmod("_i", F.col("channels")).cast("int").alias("c"), "value")


def map_images(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`images` with f applied to the planes (channel, y, x) of each frame; f may change their shape."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):  # one frame at a time in memory
                row = b.iloc[[i]].copy()
                out = f(planes(*(row[c].iloc[0] for c in ("width", "height", "channels", "pixels"))))
                row["width"], row["height"], row["channels"] = np.int32(out.shape[2]), np.int32(out.shape[1]), np.int32(out.shape[0])
                row["pixels"] = pd.Series([out.transpose(1, 2, 0).ravel()], index=row.index)
                yield row

    return images.mapInPandas(run, images.schema)


def rows_of_images(images: DataFrame, keys: list[str], f: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that f makes of each frame's planes, after the frame's keys."""
    kinds = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):
                r = b.iloc[i]
                out = f(planes(r["width"], r["height"], r["channels"], r["pixels"]))
                for k in reversed(keys):
                    out.insert(0, k, r[k])
                yield out

    return images.select(*keys, "width", "height", "channels", "pixels").mapInPandas(run, f"{kinds}, {schema}")


def luminance(p: np.ndarray) -> np.ndarray:
    return p[0] if len(p) == 1 else np.tensordot([0.2125, 0.7154, 0.0721], p[:3], 1)


def convolve(p: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Each plane's kernel sums over the weights that lie inside the frame."""
    kernel = np.asarray(kernel, float)
    h, w = kernel.shape
    pad = ((0, 0), (h // 2, h // 2), (w // 2, w // 2))
    a, ones = np.pad(p, pad), np.pad(np.ones((1, *p.shape[1:])), pad)
    out, norm = np.zeros_like(p), np.zeros((1, *p.shape[1:]))
    for y in range(h):
        for x in range(w):
            if kernel[y, x]:
                out += kernel[y, x] * a[:, y : y + p.shape[1], x : x + p.shape[2]]
                norm += kernel[y, x] * ones[:, y : y + p.shape[1], x : x + p.shape[2]]
    return out / np.where(np.abs(norm) > 1e-12, norm, 1.0)


def gaussian(sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k = np.outer(g, g)
    return k / k.sum()


SHARPEN = np.array([[0, -1, 0], [-1, 5, -1], [0, -1, 0]])
EDGES = np.array([[0, -1, 0], [-1, 4, -1], [0, -1, 0]])


def median_filter(p: np.ndarray, size: int = 3) -> np.ndarray:
    r = size // 2
    a = np.pad(p, ((0, 0), (r, r), (r, r)), mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(a, (size, size), axis=(1, 2))
    return np.median(view, axis=(3, 4))


def band_filter(p: np.ndarray, kind: str = "low", cutoff: float = 0.2, order: int = 2, weight: float = 1.0) -> np.ndarray:
    """Butterworth low or high pass of each plane by its discrete Fourier transform; cutoff is in cycles a pixel."""
    fy, fx = np.fft.fftfreq(p.shape[1])[:, None], np.fft.rfftfreq(p.shape[2])[None, :]
    low = 1 / (1 + (np.hypot(fy, fx) / cutoff) ** (2 * order))
    gain = low if kind == "low" else 1 - low
    out = np.fft.irfft2(np.fft.rfft2(p) * gain, s=p.shape[1:])
    return weight * out + (1 - weight) * p


_B3 = np.array([1, 4, 6, 4, 1]) / 16


def starlet(p: np.ndarray, levels: int) -> list[np.ndarray]:
    """The detail layers and the residual of the a trous transform; their sum is the frame."""
    out, now = [], p
    for j in range(levels):
        step, smooth = 2**j, now
        for axis in (1, 2):
            a = np.pad(smooth, [(0, 0) if k != axis else (2 * step, 2 * step) for k in range(3)], mode="symmetric" if smooth.shape[axis] >= 2 * step else "edge")
            smooth = sum(c * np.take(a, np.arange(smooth.shape[axis]) + i * step, axis=axis) for i, c in enumerate(_B3))
        out.append(now - smooth)
        now = smooth
    return [*out, now]


def median_pyramid(p: np.ndarray, levels: int) -> list[np.ndarray]:
    """Detail layers of medians of growing size and the residual; their sum is the frame."""
    out, now = [], p
    for j in range(levels):
        smooth = median_filter(now, 2 ** (j + 1) + 1)
        out.append(now - smooth)
        now = smooth
    return [*out, now]


def weigh_layers(p: np.ndarray, weights: list[float], transform: Callable = starlet) -> np.ndarray:
    """The layers put together again with weights, the residual with 1."""
    *details, rest = transform(p, len(weights))
    return sum((w * d for w, d in zip(weights, details, strict=True)), rest)


def background(p: np.ndarray, boxes: int = 8, degree: int = 2, sigma: float = 2.5) -> np.ndarray:
    """A polynomial surface of each plane through the clipped medians of a grid of boxes."""
    from vesperflow.operators.models import robust_least_squares

    out = np.empty_like(p)
    h, w = p.shape[1:]
    ys, xs = (np.linspace(0, n, min(boxes, n) + 1).astype(int) for n in (h, w))
    yy, xx = np.mgrid[0:h, 0:w]
    terms = lambda x, y: np.stack([x**i * y**j for i in range(degree + 1) for j in range(degree + 1 - i)], -1)
    for c, plane in enumerate(p):
        at, level = [], []
        for y0, y1 in zip(ys, ys[1:], strict=False):
            for x0, x1 in zip(xs, xs[1:], strict=False):
                v = plane[y0:y1, x0:x1].ravel()
                for _ in range(3):
                    m, s = np.median(v), 1.4826 * np.median(np.abs(v - np.median(v)))
                    if s == 0:
                        break
                    v = v[np.abs(v - m) <= sigma * s]
                at.append(((x0 + x1 - 1) / w - 1, (y0 + y1 - 1) / h - 1))
                level.append(np.median(v))
        x, _ = robust_least_squares(terms(*np.array(at).T), np.array(level), method="tukey")
        out[c] = terms(2 * xx / w - 1, 2 * yy / h - 1) @ x
    return out


def detect_stars(p: np.ndarray, most: int = 500, min_snr: float = 5.0, radius: int = 6) -> pd.DataFrame:
    """(x, y, flux, snr, hfd): local maxima of the smoothed frame above the noise, by aperture photometry and moments.

    Stars closer than the aperture to a brighter one go with it; the brightest `most` stay.
    """
    a = luminance(p)
    level = float(np.median(a))
    noise = 1.4826 * float(np.median(np.abs(a - level))) or 1e-9
    s = convolve(a[None], gaussian(1.0))[0]
    pad = np.pad(s, 1, constant_values=-np.inf)
    around = np.max([pad[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], axis=0)
    ys, xs = np.nonzero((s > around) & (s > level + min_snr * noise / 3))
    order = np.argsort(-s[ys, xs], kind="stable")
    rows, kept = [], []
    for y, x in zip(ys[order], xs[order], strict=True):
        if any((x - u) ** 2 + (y - v) ** 2 < radius * radius for u, v in kept):
            continue
        y0, y1, x0, x1 = max(0, y - radius), min(a.shape[0], y + radius + 1), max(0, x - radius), min(a.shape[1], x + radius + 1)
        gy, gx = np.mgrid[y0:y1, x0:x1]
        inside = (gx - x) ** 2 + (gy - y) ** 2 <= radius * radius
        v = np.where(inside, a[y0:y1, x0:x1] - level, 0.0)
        flux = float(v.sum())
        snr = flux / (noise * math.sqrt(inside.sum()))
        if flux <= 0 or snr < min_snr:
            continue
        vp = np.maximum(v, 0)
        cx, cy = float((vp * gx).sum() / vp.sum()), float((vp * gy).sum() / vp.sum())
        hfd = 2 * float((vp * np.hypot(gx - cx, gy - cy)).sum() / vp.sum())
        kept.append((x, y))
        rows.append((cx, cy, flux, snr, hfd))
        if len(rows) >= most:
            break
    return pd.DataFrame(rows, columns=["x", "y", "flux", "snr", "hfd"])


def find_stars(images: DataFrame, keys: list[str], most: int = 500, min_snr: float = 5.0) -> DataFrame:
    return rows_of_images(images, keys, lambda p: detect_stars(p, most, min_snr), "x double, y double, flux double, snr double, hfd double")


def warp(p: np.ndarray, matrix: np.ndarray, shape: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(planes, valid): bilinear samples at matrix @ (x, y, 1) for each pixel (x, y) of the result."""
    h, w = shape or p.shape[1:]
    yy, xx = np.mgrid[0:h, 0:w]
    u, v = (matrix[i][0] * xx + matrix[i][1] * yy + matrix[i][2] for i in (0, 1))
    u, v = (np.where(np.abs(c - np.rint(c)) < 1e-9, np.rint(c), c) for c in (u, v))
    valid = (u >= 0) & (v >= 0) & (u <= p.shape[2] - 1) & (v <= p.shape[1] - 1)
    x0, y0 = np.clip(np.floor(u).astype(int), 0, max(0, p.shape[2] - 2)), np.clip(np.floor(v).astype(int), 0, max(0, p.shape[1] - 2))
    x1, y1 = np.minimum(x0 + 1, p.shape[2] - 1), np.minimum(y0 + 1, p.shape[1] - 1)
    fx, fy = u - x0, v - y0
    out = p[:, y0, x0] * (1 - fx) * (1 - fy) + p[:, y0, x1] * fx * (1 - fy) + p[:, y1, x0] * (1 - fx) * fy + p[:, y1, x1] * fx * fy
    return np.where(valid, out, 0.0), valid


def curve(points: list[tuple[float, float]], size: int = 65536) -> np.ndarray:
    """A lookup table of a natural cubic spline through (input, output) points, clipped to 0..1."""
    from vesperflow.functions.splines import natural_cubic

    x, y = (np.array(c, float) for c in zip(*sorted(points), strict=True))
    return np.clip(natural_cubic(x, y)(np.linspace(0, 1, size)), 0, 1)


def apply_curve(p: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.clip(np.rint(p * (len(table) - 1)), 0, len(table) - 1).astype(int)]


def synthesize(width: int, height: int, stars: np.ndarray, seeing: float = 2.0, level: float = 0.05, noise: float = 0.005, seed: int = 1) -> np.ndarray:
    """One plane with Gaussian stars (x, y, flux), a sky level and Gaussian noise from a seed."""
    a = np.random.default_rng(seed).normal(level, noise, (height, width))
    r, s2 = math.ceil(4 * seeing), 2 * (seeing / 2.3548) ** 2
    for x, y, flux in stars:
        y0, y1, x0, x1 = max(0, int(y) - r), min(height, int(y) + r + 1), max(0, int(x) - r), min(width, int(x) + r + 1)
        gy, gx = np.mgrid[y0:y1, x0:x1]
        a[y0:y1, x0:x1] += flux / (math.pi * s2) * np.exp(-((gx - x) ** 2 + (gy - y) ** 2) / s2)
    return a[None]

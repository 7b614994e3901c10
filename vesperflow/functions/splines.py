"""Splines, Chebyshev fits, seeded generators and root finding in NumPy, for grouped functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def natural_cubic(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The cubic spline through the points with no curvature at the ends; held as straight lines beyond them."""
    n = len(x)
    if n == 1:
        return lambda t: np.full(np.shape(t), y[0], float)
    h = np.diff(x)
    m = np.zeros(n)
    if n > 2:
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        m[1:-1] = np.linalg.solve(a, 6 * np.diff(np.diff(y) / h))
    slope = np.diff(y) / h - h * (2 * m[:-1] + m[1:]) / 6
    last = np.diff(y)[-1] / h[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6

    def at(t):
        t = np.asarray(t, float)
        k = np.clip(np.searchsorted(x, t, "right") - 1, 0, n - 2)
        d = t - x[k]
        inner = y[k] + d * (slope[k] + d * (m[k] / 2 + d * (m[k + 1] - m[k]) / (6 * h[k])))
        return np.where(t < x[0], y[0] + slope[0] * (t - x[0]), np.where(t > x[-1], y[-1] + last * (t - x[-1]), inner))

    return at


def hermite(x: np.ndarray, y: np.ndarray, slope: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The piecewise cubic with given values and slopes (see `series.pchip_slopes`)."""

    def at(t):
        t = np.clip(np.asarray(t, float), x[0], x[-1])
        k = np.clip(np.searchsorted(x, t, "right") - 1, 0, len(x) - 2)
        h = x[k + 1] - x[k]
        s = (t - x[k]) / h
        return y[k] * (1 + 2 * s) * (1 - s) ** 2 + slope[k] * h * s * (1 - s) ** 2 + y[k + 1] * s * s * (3 - 2 * s) + slope[k + 1] * h * s * s * (s - 1)

    return at


def interpolate_groups(samples: DataFrame, points: DataFrame, by: str, x: str, y: str, kind: str = "cubic", degree: int = 8) -> DataFrame:
    """(by, x, y) at the x of `points` from each group's samples: natural cubic spline or Chebyshev fit of a degree.

    A group is one series; its samples and points meet in one task. Equal x take their mean; groups without samples go.
    """
    kinds = {c: samples.schema[c].dataType.simpleString() for c in (by,)}

    def run(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(s) or not len(p):
            return pd.DataFrame({by: [], x: [], y: []})
        m = s.groupby(x)[y].mean().sort_index()
        sx, sy, t = m.index.to_numpy(float), m.to_numpy(float), p["_x"].to_numpy(float)
        if kind == "cubic":
            v = natural_cubic(sx, sy)(t)
        else:
            v = np.polynomial.Chebyshev.fit(sx, sy, min(degree, len(sx) - 1), domain=[sx[0], sx[-1]] if len(sx) > 1 else [sx[0] - 1, sx[0] + 1])(t)
        return pd.DataFrame({by: p["_by"].to_numpy(), x: t, y: v})

    from pyspark.sql import functions as F

    a = samples.select(by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).groupBy(by)
    b = points.select(F.col(by).alias("_by"), F.col(x).cast("double").alias("_x")).groupBy("_by")
    return a.cogroup(b).applyInPandas(run, f"{by} {kinds[by]}, {x} double, {y} double")


def brent_root(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-12, steps: int = 200) -> float:
    """A root between a and b, where f changes sign: secants and inverse quadratics, halving where they stray."""
    fa, fb = f(a), f(b)
    if fa * fb > 0:
        raise ValueError("f must change sign")
    c, fc, d, e = a, fa, b - a, b - a
    for _ in range(steps):
        if fb * fc > 0:
            c, fc, d, e = a, fa, b - a, b - a
        if abs(fc) < abs(fb):
            a, b, c, fa, fb, fc = b, c, b, fb, fc, fb
        tol, m = 2 * np.finfo(float).eps * abs(b) + tolerance / 2, (c - b) / 2
        if abs(m) <= tol or fb == 0:
            return b
        if abs(e) >= tol and abs(fa) > abs(fb):
            s = fb / fa
            p, q = (2 * m * s, 1 - s) if a == c else (s * (2 * m * fa / fc * (fa / fc - fb / fc) - (b - a) * (fb / fc - 1)), (fa / fc - 1) * (fb / fc - 1) * (s - 1))
            p, q = (p, -q) if p > 0 else (-p, q)
            e, d = (d, p / q) if 2 * p < min(3 * m * q - abs(tol * q), abs(e * q)) else (m, m)
        else:
            d = e = m
        a, fa = b, fb
        b += d if abs(d) > tol else (tol if m > 0 else -tol)
        fb = f(b)
    return b


def solve_column(f: Callable[..., float], low, high, *parameters, tolerance: float = 1e-12):
    """A column of roots of f(x, *parameters) between two columns, where it changes sign; null where it does not."""
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, *p: pd.Series) -> pd.Series:
        out = []
        for x, y, *own in zip(a, b, *p, strict=True):
            g = lambda t, own=own: f(t, *own)
            out.append(brent_root(g, x, y, tolerance) if g(x) * g(y) <= 0 else None)
        return pd.Series(out, dtype="float64")

    return run(low, high, *parameters)


def mulberry32(seed: int, n: int) -> np.ndarray:
    """The first n numbers in [0, 1) of the 32-bit generator of that name."""
    k = 0xFFFFFFFF
    state = (np.uint64(seed & k) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5)) & np.uint64(k)
    t = ((state ^ (state >> np.uint64(15))) * (state | np.uint64(1))) & np.uint64(k)
    t ^= (t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & np.uint64(k))) & np.uint64(k)
    return ((t ^ (t >> np.uint64(14))) & np.uint64(k)).astype(float) / 4294967296.0

"""Minimisers, orbit distances, covariances, B-plane and SIP distortion fits."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vesperflow.operators.models import least_squares
from vesperflow.operators.orbits import SUN, from_elements, propagate


def golden_minimum(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-9) -> float:
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def simplex_minimum(f: Callable[[np.ndarray], float], start: np.ndarray, size: float = 0.1, tolerance: float = 1e-10, steps: int = 2000) -> np.ndarray:
    """A minimum by a simplex that reflects, stretches and shrinks (Nelder and Mead)."""
    start = np.asarray(start, float)
    p = np.vstack([start, start + np.eye(len(start)) * np.where(start != 0, size * np.abs(start), size)[:, None]])
    y = np.array([f(x) for x in p])
    for _ in range(steps):
        by = np.argsort(y, kind="stable")
        p, y = p[by], y[by]
        if np.abs(p - p[0]).max() < tolerance and abs(y[-1] - y[0]) < tolerance:
            break
        c = p[:-1].mean(0)
        r = 2 * c - p[-1]
        fr = f(r)
        if fr < y[0]:
            s = c + 2 * (r - c)
            fs = f(s)
            p[-1], y[-1] = (s, fs) if fs < fr else (r, fr)
        elif fr < y[-2]:
            p[-1], y[-1] = r, fr
        else:
            s = c + 0.5 * ((r if fr < y[-1] else p[-1]) - c)
            fs = f(s)
            if fs < min(fr, y[-1]):
                p[-1], y[-1] = s, fs
            else:
                p[1:] = p[0] + 0.5 * (p[1:] - p[0])
                y[1:] = [f(x) for x in p[1:]]
    return p[np.argmin(y)]


def levenberg_marquardt(residuals: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 200, tolerance: float = 1e-12) -> np.ndarray:
    """Parameters of least squared residuals; derivatives by central differences."""
    x, lam = np.asarray(start, float).copy(), 1e-3
    r = residuals(x)
    for _ in range(steps):
        h = 1e-6 * np.maximum(1, np.abs(x))
        j = np.stack([(residuals(x + e) - residuals(x - e)) / (2 * e.sum()) for e in np.diag(h)], 1)
        a, g = j.T @ j, j.T @ r
        step = -np.linalg.solve(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), g)
        new = residuals(x + step)
        if new @ new < r @ r:
            done = abs(r @ r - new @ new) <= tolerance * max(1e-300, r @ r) or np.abs(step).max() < tolerance
            x, r, lam = x + step, new, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return x


def hyperbola_focus(position: np.ndarray, size: np.ndarray) -> tuple[float, float, float]:
    """(best position, least size, slope) of a hyperbola through focus measurements."""
    k = int(np.argmin(size))
    s = max(1e-9, (size.max() - size.min()) / max(1e-9, np.abs(position - position[k]).max()))
    x = levenberg_marquardt(lambda p: np.sqrt(p[1] ** 2 + (p[2] * (position - p[0])) ** 2) - size, np.array([position[k], size[k], s]))
    return float(x[0]), float(abs(x[1])), float(abs(x[2]))


def ellipse(q: float, e: float, i: float, node: float, arg: float, n: int) -> np.ndarray:
    """n points of an orbit by equal steps of the eccentric anomaly."""
    p, v = from_elements(*(np.array([x]) for x in (q, e, i, node, arg)))
    a = q / (1 - e)
    u = np.linspace(0, 2 * math.pi, n, endpoint=False)
    along, across = p[0] / q, v[0] / np.linalg.norm(v[0])
    return np.outer(a * (np.cos(u) - e), along) + np.outer(a * math.sqrt(1 - e * e) * np.sin(u), across)


def moid(first: tuple, second: tuple, n: int = 360) -> float:
    """The least distance between two elliptic orbits (q, e, i, node, arg): a grid, then a simplex from its best cells."""

    def at(o: tuple, u: float) -> np.ndarray:
        q, e = o[0], o[1]
        p, v = bases[o]
        return q / (1 - e) * (math.cos(u) - e) * p + q / (1 - e) * math.sqrt(1 - e * e) * math.sin(u) * v

    bases = {}
    for o in (first, second):
        p, v = from_elements(*(np.array([x]) for x in o))
        bases[o] = (p[0] / o[0], v[0] / np.linalg.norm(v[0]))
    a, b = ellipse(*first, n), ellipse(*second, n)
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    best = math.inf
    for k in np.argsort(d, axis=None)[: 6 * n : n]:
        i, j = divmod(int(k), n)
        x = simplex_minimum(lambda u: float(np.linalg.norm(at(first, u[0]) - at(second, u[1]))), np.array([i, j]) * 2 * math.pi / n + 1e-3, 0.01)
        best = min(best, float(np.linalg.norm(at(first, x[0]) - at(second, x[1]))))
    return best


def transition(p: np.ndarray, v: np.ndarray, dt: float, mu: float = SUN) -> np.ndarray:
    """The 6 x 6 derivative of a two-body state after dt by the state before, by central differences."""
    s = np.concatenate([p, v])
    h = 1e-6 * np.maximum(np.abs(s), np.repeat([np.linalg.norm(p), np.linalg.norm(v)], 3) * 0.1)
    states = np.concatenate([s + np.diag(h), s - np.diag(h)])
    q, w = propagate(states[:, :3], states[:, 3:], np.full(12, dt), mu)
    out = np.hstack([q, w])
    return ((out[:6] - out[6:]) / (2 * h[:, None])).T


def propagate_covariance(c: np.ndarray, p: np.ndarray, v: np.ndarray, dt: float, mu: float = SUN) -> np.ndarray:
    m = transition(p, v, dt, mu)
    return m @ c @ m.T


def b_plane(p: np.ndarray, v: np.ndarray, mu: float) -> tuple[float, float, float]:
    """(B.T, B.R, speed at infinity) of a hyperbolic encounter; the pole for T is the z axis."""
    r = np.linalg.norm(p)
    h = np.cross(p, v)
    e = np.cross(v, h) / mu - p / r
    en = float(np.linalg.norm(e))
    if en <= 1:
        raise ValueError("the orbit is not a hyperbola")
    a = 1 / (2 / r - v @ v / mu)
    b = abs(a) * math.sqrt(en * en - 1)
    eh, q = e / en, np.cross(h, e) / np.linalg.norm(np.cross(h, e))
    s = eh / en + math.sqrt(1 - 1 / en**2) * q
    t = np.cross(s, [0.0, 0.0, 1.0])
    t = t / np.linalg.norm(t)
    bv = b * (math.sqrt(1 - 1 / en**2) * eh - q / en)
    return float(bv @ t), float(bv @ np.cross(s, t)), math.sqrt(mu / abs(a))


def fit_sip(frames: DataFrame, by: str = "frame", order: int = 2, sigma: float = 3.0, iterations: int = 5) -> DataFrame:
    """(by, a, b, rms, n): SIP polynomials that take pixel offsets (u, v) to undistorted ones (u2, v2), outliers clipped.

    a and b map "p_q" to coefficients of u ** p v ** q with 2 <= p + q <= order; a linear part is fitted and dropped.
    """
    kind = frames.schema[by].dataType.simpleString()
    powers = [(p, q) for p in range(order + 1) for q in range(order + 1 - p)]

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        u, v, x, y = (d[c].to_numpy(float) for c in ("u", "v", "u2", "v2"))
        scale = max(1.0, float(np.abs(np.concatenate([u, v])).max()))
        m = np.stack([(u / scale) ** p * (v / scale) ** q for p, q in powers], 1)
        keep = np.ones(len(u), bool)
        for _ in range(iterations):
            ca, cb = least_squares(m[keep], (x - u)[keep]), least_squares(m[keep], (y - v)[keep])
            e = np.hypot(x - u - m @ ca, y - v - m @ cb)
            s = math.sqrt(float((e[keep] ** 2).mean())) or 1e-300
            new = e <= sigma * s
            if (new == keep).all() or new.sum() <= len(powers):
                break
            keep = new
        name = lambda c: {f"{p}_{q}": float(k / scale ** (p + q)) for (p, q), k in zip(powers, c, strict=True) if p + q >= 2}
        return pd.DataFrame({by: [d[by].iloc[0]], "a": [name(ca)], "b": [name(cb)], "rms": [float(np.sqrt((e[keep] ** 2).mean()))], "n": [int(keep.sum())]})

    return frames.select(by, "u", "v", "u2", "v2").groupBy(by).applyInPandas(fit, f"{by} {kind}, a map<string,double>, b map<string,double>, rms double, n long")

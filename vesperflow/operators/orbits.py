"""Orbit propagation and determination as vectorised kernels behind Arrow functions.

Units: astronomical units and days for the Sun's orbits, kilometres and seconds for satellites, radians throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Gravitational parameter of the Sun, AU ** 3 / day ** 2.
SUN = 0.01720209895**2


def stumpff(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions c2 and c3 of universal variables."""
    s = np.sqrt(np.abs(z))
    small = np.abs(z) < 1e-6
    s_ = np.where(small, 1.0, s)
    z_ = np.where(small, 1.0, z)
    c2 = np.where(z > 0, (1 - np.cos(s_)) / np.abs(z_), (np.cosh(np.minimum(s_, 300)) - 1) / np.abs(z_))
    c3 = np.where(z > 0, (s_ - np.sin(s_)) / s_**3, (np.sinh(np.minimum(s_, 300)) - s_) / s_**3)
    return np.where(small, 0.5 - z / 24, c2), np.where(small, 1 / 6 - z / 120, c3)


def propagate(p: np.ndarray, v: np.ndarray, dt: np.ndarray, mu: float = SUN) -> tuple[np.ndarray, np.ndarray]:
    """Two-body states after times dt, any conic, by universal variables and Newton-Laguerre steps; arrays of n x 3."""
    p, v, dt = np.atleast_2d(p).astype(float), np.atleast_2d(v).astype(float), np.atleast_1d(dt).astype(float)
    r0 = np.linalg.norm(p, axis=1)
    rv = (p * v).sum(1) / math.sqrt(mu)
    alpha = 2 / r0 - (v * v).sum(1) / mu
    x = math.sqrt(mu) * dt * np.where(np.abs(alpha) > 1e-9, np.abs(alpha), 1 / r0)
    for _ in range(60):
        z = alpha * x * x
        c2, c3 = stumpff(z)
        f = rv * x * x * c2 + (1 - alpha * r0) * x**3 * c3 + r0 * x - math.sqrt(mu) * dt
        d = rv * x * (1 - z * c3) + (1 - alpha * r0) * x * x * c2 + r0
        dd = rv * (1 - z * c2) + (1 - alpha * r0) * x * (1 - z * c3)
        step = 5 * f / (d + np.sign(d) * np.sqrt(np.abs(16 * d * d - 20 * f * dd)))
        x = x - step
        if np.all(np.abs(step) < 1e-12 * np.maximum(1, np.abs(x))):
            break
    z = alpha * x * x
    c2, c3 = stumpff(z)
    fg, g = 1 - x * x / r0 * c2, dt - x**3 * c3 / math.sqrt(mu)
    q = fg[:, None] * p + g[:, None] * v
    r = np.linalg.norm(q, axis=1)
    fd, gd = math.sqrt(mu) / (r * r0) * x * (z * c3 - 1), 1 - x * x / r * c2
    return q, fd[:, None] * p + gd[:, None] * v


def from_elements(q: np.ndarray, e: np.ndarray, i: np.ndarray, node: np.ndarray, arg: np.ndarray, mu: float = SUN) -> tuple[np.ndarray, np.ndarray]:
    """The state at perihelion from perihelion distance and orientation."""
    cn, sn, ca, sa, ci, si = np.cos(node), np.sin(node), np.cos(arg), np.sin(arg), np.cos(i), np.sin(i)
    along = np.stack([cn * ca - sn * sa * ci, sn * ca + cn * sa * ci, sa * si], 1)
    across = np.stack([-cn * sa - sn * ca * ci, -sn * sa + cn * ca * ci, ca * si], 1)
    speed = np.sqrt(mu * (1 + e) / q)
    return along * q[:, None], across * speed[:, None]


def to_elements(p: np.ndarray, v: np.ndarray, mu: float = SUN) -> dict[str, np.ndarray]:
    """Semi-major axis (negative for hyperbolas), eccentricity, inclination, node, argument and true anomaly."""
    h = np.cross(p, v)
    r, hn = np.linalg.norm(p, axis=1), np.linalg.norm(h, axis=1)
    e = np.cross(v, h) / mu - p / r[:, None]
    en = np.linalg.norm(e, axis=1)
    n = np.stack([-h[:, 1], h[:, 0], np.zeros(len(h))], 1)
    nn = np.linalg.norm(n, axis=1)
    u = np.where((nn > 1e-12)[:, None], n / np.maximum(nn, 1e-300)[:, None], [1.0, 0, 0])
    w = h / hn[:, None]
    arg = np.arctan2((np.cross(u, e) * w).sum(1), (u * e).sum(1))
    true = np.arctan2((np.cross(e, p) * w).sum(1), (e * p).sum(1))
    a = 1 / (2 / r - (v * v).sum(1) / mu)
    return {"a": a, "e": en, "i": np.arccos(np.clip(h[:, 2] / hn, -1, 1)), "node": np.arctan2(u[:, 1], u[:, 0]) % (2 * math.pi), "arg": arg % (2 * math.pi), "true": true % (2 * math.pi)}


_STATE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "vx", "vy", "vz")])


def _frame(p: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(np.hstack([p, v]), columns=["x", "y", "z", "vx", "vy", "vz"])


@F.pandas_udf(_STATE)
def kepler_state(q: pd.Series, e: pd.Series, i: pd.Series, node: pd.Series, arg: pd.Series, since_perihelion: pd.Series) -> pd.DataFrame:
    """Heliocentric ecliptic states so many days after perihelion."""
    p, v = from_elements(*(s.to_numpy(float) for s in (q, e, i, node, arg)))
    return _frame(*propagate(p, v, since_perihelion.to_numpy(float)))


# ---- satellites -----------------------------------------------------------------------------------------------------

#: WGS-72 values of the analytic satellite theory.
EARTH_KM, XKE, J2, J3, J4 = 6378.135, 0.0743669161331734, 0.001082616, -0.00000253881, -0.00000165597


def sgp4(minutes: np.ndarray, n0: np.ndarray, e0: np.ndarray, i0: np.ndarray, node0: np.ndarray, arg0: np.ndarray, m0: np.ndarray, bstar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(km, km/s) in the true-equator mean-equinox frame, near-Earth theory (Hoots and Roehrich 1980).

    Mean motion is in radians a minute. Periods of 225 minutes and more need the deep-space terms and give NaN, as do
    orbits that have decayed.
    """
    k2, k4, a30 = J2 / 2, -3 * J4 / 8, -J3
    c, s = np.cos(i0), np.sin(i0)
    t2 = c * c
    x3 = 3 * t2 - 1
    b2 = 1 - e0 * e0
    b = np.sqrt(b2)
    a1 = (XKE / n0) ** (2 / 3)
    d1 = 1.5 * k2 * x3 / (a1 * a1 * b * b2)
    a0 = a1 * (1 - d1 * (1 / 3 + d1 * (1 + 134 / 81 * d1)))
    d0 = 1.5 * k2 * x3 / (a0 * a0 * b * b2)
    n, a = n0 / (1 + d0), a0 / (1 - d0)
    deep = 2 * math.pi / n >= 225
    perigee = (a * (1 - e0) - 1) * EARTH_KM
    low = perigee < 220
    s_km = np.where(perigee < 98, 20.0, np.where(perigee < 156, perigee - 78, 78.0))
    s4 = s_km / EARTH_KM + 1
    q4 = ((120 - s_km) / EARTH_KM) ** 4
    pinv = 1 / (a * a * b2 * b2)
    ts = 1 / (a - s4)
    eta = a * e0 * ts
    ee, eeta = eta * eta, e0 * eta
    psi = np.abs(1 - ee)
    c_ = q4 * ts**4
    c1_ = c_ / psi**3.5
    c2 = c1_ * n * (a * (1 + 1.5 * ee + eeta * (4 + ee)) + 0.75 * k2 * ts / psi * x3 * (8 + 3 * ee * (8 + ee)))
    c1 = bstar * c2
    c3 = np.where(e0 > 1e-4, c_ * ts * a30 / k2 * n * s / np.maximum(e0, 1e-4), 0.0)
    x1 = 1 - t2
    c4 = 2 * n * c1_ * a * b2 * (eta * (2 + 0.5 * ee) + e0 * (0.5 + 2 * ee) - 2 * k2 * ts / (a * psi) * (-3 * x3 * (1 - 2 * eeta + ee * (1.5 - 0.5 * eeta)) + 0.75 * x1 * (2 * ee - eeta * (1 + ee)) * np.cos(2 * arg0)))
    c5 = 2 * c1_ * a * b2 * (1 + 2.75 * (ee + eeta) + eeta * ee)
    t4 = t2 * t2
    p1 = 3 * k2 * pinv * n
    p2 = p1 * k2 * pinv
    p3 = 1.25 * k4 * pinv * pinv * n
    mdot = n + 0.5 * p1 * b * x3 + 0.0625 * p2 * b * (13 - 78 * t2 + 137 * t4)
    adot = -0.5 * p1 * (1 - 5 * t2) + 0.0625 * p2 * (7 - 114 * t2 + 395 * t4) + p3 * (3 - 36 * t2 + 49 * t4)
    h1 = -p1 * c
    ndot = h1 + (0.5 * p2 * (4 - 19 * t2) + 2 * p3 * (3 - 7 * t2)) * c
    omega_c = bstar * c3 * np.cos(arg0)
    m_c = np.where(e0 > 1e-4, -2 / 3 * c_ * bstar / np.maximum(eeta, 1e-12), 0.0)
    node_c = 3.5 * b2 * h1 * c1
    t2c = 1.5 * c1
    lcof = 0.125 * a30 / k2 * s * (3 + 5 * c) / np.where(np.abs(1 + c) > 1e-12, 1 + c, 1e-12)
    ycof = 0.25 * a30 / k2 * s
    dm0, sm0 = (1 + eta * np.cos(m0)) ** 3, np.sin(m0)
    c1sq = c1 * c1
    d2 = 4 * a * ts * c1sq
    tmp = d2 * ts * c1 / 3
    d3 = (17 * a + s4) * tmp
    d4 = 0.5 * tmp * a * ts * (221 * a + 31 * s4) * c1
    t3c, t4c = d2 + 2 * c1sq, 0.25 * (3 * d3 + c1 * (12 * d2 + 10 * c1sq))
    t5c = 0.2 * (3 * d4 + 12 * c1 * d3 + 6 * d2 * d2 + 15 * c1sq * (2 * d2 + c1sq))

    t = minutes
    mp, arg, node = m0 + mdot * t, arg0 + adot * t, node0 + ndot * t
    tsq = t * t
    node = node + node_c * tsq
    da, de, dl = 1 - c1 * t, bstar * c4 * t, t2c * tsq
    dw = omega_c * t + m_c * ((1 + eta * np.cos(mp)) ** 3 - dm0)
    mp2 = np.where(low, mp, mp + dw)
    arg = np.where(low, arg, arg - dw)
    da = np.where(low, da, da - d2 * tsq - d3 * tsq * t - d4 * tsq * tsq)
    de = np.where(low, de, de + bstar * c5 * (np.sin(mp2) - sm0))
    dl = np.where(low, dl, dl + t3c * tsq * t + tsq * tsq * (t4c + t * t5c))
    a_t = a * da * da
    e_t = np.clip(e0 - de, 1e-6, 0.999999)
    gone = (e0 - de >= 1) | (e0 - de < -0.001) | (a_t < 0.95)
    a_t = np.where(gone, 1.0, a_t)
    long = mp2 + arg + node + n * dl
    n_t = XKE / a_t**1.5
    axn = e_t * np.cos(arg)
    k = 1 / (a_t * (1 - e_t * e_t))
    ayn = e_t * np.sin(arg) + k * ycof
    u = (long + k * lcof * axn - node) % (2 * math.pi)
    w = u.copy()
    for _ in range(12):
        sw, cw = np.sin(w), np.cos(w)
        w = w + np.clip((u - ayn * cw + axn * sw - w) / (1 - cw * axn - sw * ayn), -0.95, 0.95)
    sw, cw = np.sin(w), np.cos(w)
    ecos, esin = axn * cw + ayn * sw, axn * sw - ayn * cw
    el2 = axn * axn + ayn * ayn
    pl = a_t * (1 - el2)
    r = a_t * (1 - ecos)
    rd, rf = XKE * np.sqrt(a_t) / r * esin, XKE * np.sqrt(np.maximum(pl, 0)) / r
    bl = np.sqrt(1 - el2)
    q = esin / (1 + bl)
    cu, su = a_t / r * (cw - axn + ayn * q), a_t / r * (sw - ayn - axn * q)
    uu = np.arctan2(su, cu)
    s2, c2u = 2 * su * cu, 2 * cu * cu - 1
    w1, w2 = k2 / pl, k2 / pl / pl
    rk = r * (1 - 1.5 * w2 * bl * x3) + 0.5 * w1 * x1 * c2u
    uk = uu - 0.25 * w2 * (7 * t2 - 1) * s2
    nk = node + 1.5 * w2 * c * s2
    ik = i0 + 1.5 * w2 * c * s * c2u
    rdk = rd - n_t * w1 * x1 * s2
    rfk = rf + n_t * w1 * (x1 * c2u + 1.5 * x3)
    sk, ck, sn, cn, si, ci = np.sin(uk), np.cos(uk), np.sin(nk), np.cos(nk), np.sin(ik), np.cos(ik)
    x, y = -sn * ci, cn * ci
    un = np.stack([x * sk + cn * ck, y * sk + sn * ck, si * sk], 1)
    vn = np.stack([x * ck - cn * sk, y * ck - sn * sk, si * ck], 1)
    bad = (deep | gone | (rk < 0.95))[:, None]
    pos = un * (rk * EARTH_KM)[:, None]
    vel = (un * rdk[:, None] + vn * rfk[:, None]) * (EARTH_KM / 60)
    return np.where(bad, np.nan, pos), np.where(bad, np.nan, vel)


@F.pandas_udf(_STATE)
def sgp4_state(minutes: pd.Series, n: pd.Series, e: pd.Series, i: pd.Series, node: pd.Series, arg: pd.Series, m: pd.Series, bstar: pd.Series) -> pd.DataFrame:
    """Satellite states (km, km/s) so many minutes after their elements' epoch."""
    return _frame(*sgp4(*(s.to_numpy(float) for s in (minutes, n, e, i, node, arg, m, bstar))))


# ---- orbit determination --------------------------------------------------------------------------------------------


def gibbs(r1: np.ndarray, r2: np.ndarray, r3: np.ndarray, mu: float = SUN) -> np.ndarray:
    """The velocity at the second of three coplanar positions."""
    a, b, c = (float(np.linalg.norm(r)) for r in (r1, r2, r3))
    n = a * np.cross(r2, r3) + b * np.cross(r3, r1) + c * np.cross(r1, r2)
    d = np.cross(r1, r2) + np.cross(r2, r3) + np.cross(r3, r1)
    s = r1 * (b - c) + r2 * (c - a) + r3 * (a - b)
    return math.sqrt(mu / (np.linalg.norm(n) * np.linalg.norm(d))) * (np.cross(d, r2) / b + s)


def herrick_gibbs(r1: np.ndarray, r2: np.ndarray, r3: np.ndarray, t1: float, t2: float, t3: float, mu: float = SUN) -> np.ndarray:
    """The velocity at the second of three close positions, from their times."""
    d31, d32, d21 = t3 - t1, t3 - t2, t2 - t1
    a, b, c = (np.linalg.norm(r) ** 3 for r in (r1, r2, r3))
    return -d32 * (1 / (d21 * d31) + mu / (12 * a)) * r1 + (d32 - d21) * (1 / (d21 * d32) + mu / (12 * b)) * r2 + d21 * (1 / (d32 * d31) + mu / (12 * c)) * r3


def gauss(directions: np.ndarray, observers: np.ndarray, times: np.ndarray, mu: float = SUN, near: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(position, velocity) at the second of three observed directions (n x 3 unit vectors) from observer positions.

    A short arc may allow several distances: the one closest to `near` is taken, or the one that sees the outer
    directions best.
    """
    t1, t3 = times[0] - times[1], times[2] - times[1]
    t = t3 - t1
    p = np.array([np.cross(directions[1], directions[2]), np.cross(directions[0], directions[2]), np.cross(directions[0], directions[1])])
    d0 = directions[0] @ p[0]
    d = observers @ p.T
    a = (-d[0, 1] * t3 / t + d[1, 1] + d[2, 1] * t1 / t) / d0
    b = (d[0, 1] * (t3 * t3 - t * t) * t3 / t + d[2, 1] * (t * t - t1 * t1) * t1 / t) / (6 * d0)
    e, rr = observers[1] @ directions[1], observers[1] @ observers[1]
    roots = np.roots([1, 0, -(a * a + 2 * a * e + rr), 0, 0, -2 * mu * b * (a + e), 0, 0, -mu * mu * b * b])
    real = sorted(float(x.real) for x in roots if abs(x.imag) < 1e-8 * max(1, abs(x.real)) and x.real > 0)
    best = (math.inf, None)
    for r2 in real:  # the root whose orbit sees the outer directions best, from the right side
        u = mu / r2**3
        rho = np.array([
            ((6 * (d[2, 0] * t1 / t3 + d[1, 0] * t / t3) * r2**3 + mu * d[2, 0] * (t * t - t1 * t1) * t1 / t3) / (6 * r2**3 + mu * (t * t - t3 * t3)) - d[0, 0]) / d0,
            a + mu * b / r2**3,
            ((6 * (d[0, 2] * t3 / t1 - d[1, 2] * t / t1) * r2**3 + mu * d[0, 2] * (t * t - t3 * t3) * t3 / t1) / (6 * r2**3 + mu * (t * t - t1 * t1)) - d[2, 2]) / d0,
        ])
        r = observers + rho[:, None] * directions
        f1, f3, g1, g3 = 1 - u * t1 * t1 / 2, 1 - u * t3 * t3 / 2, t1 - u * t1**3 / 6, t3 - u * t3**3 / 6
        v = (-f3 * r[0] + f1 * r[2]) / (f1 * g3 - f3 * g1)
        seen = propagate(np.repeat(r[1:2], 2, 0), np.repeat(v[None], 2, 0), np.array([t1, t3]), mu)[0] - observers[[0, 2]]
        error = sum(float(np.linalg.norm(np.cross(s / np.linalg.norm(s), w))) for s, w in zip(seen, directions[[0, 2]], strict=True)) + (10.0 if (rho <= 0).any() else 0.0)
        error = error if near is None else abs(float(np.linalg.norm(r[1])) - near)
        if error < best[0]:
            best = (error, (r[1], v))
    if best[1] is None:
        raise ValueError("no positive root")
    return best[1]


def determine(df, by: str, mu: float = SUN):
    """(by, x .. vz): states from three positions (t, x, y, z) of each object, Herrick-Gibbs under 1 degree, else Gibbs."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        r = p[["x", "y", "z"]].to_numpy(float)[:3]
        if len(r) < 3:
            return pd.DataFrame({by: [], **{c: [] for c in ("x", "y", "z", "vx", "vy", "vz")}}).astype({by: p[by].dtype})
        cosine = r[0] @ r[2] / np.linalg.norm(r[0]) / np.linalg.norm(r[2])
        t = p["t"].to_numpy(float)[:3]
        v = herrick_gibbs(*r, *t, mu) if math.acos(max(-1, min(1, cosine))) < math.pi / 180 else gibbs(*r, mu)
        return _frame(r[1:2], v[None, :]).assign(**{by: p[by].iloc[0]})[[by, "x", "y", "z", "vx", "vy", "vz"]]

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, "t", "x", "y", "z").groupBy(by).applyInPandas(fit, f"{by} {kind}, x double, y double, z double, vx double, vy double, vz double")

"""Approximate planet positions, and searches built on them: conjunctions, oppositions, transits, satellite passes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesperflow.operators.events import TAU, altitude, extrema, roots, sidereal

#: Approximate Keplerian elements at J2000 and their change a century (JPL, valid 1800 to 2050):
#: semi-major axis, eccentricity, inclination, mean longitude, longitude of perihelion, longitude of the node.
ELEMENTS = {
    "mercury": ((0.38709927, 0.20563593, 7.00497902, 252.25032350, 77.45779628, 48.33076593), (0.00000037, 0.00001906, -0.00594749, 149472.67411175, 0.16047689, -0.12534081)),
    "venus": ((0.72333566, 0.00677672, 3.39467605, 181.97909950, 131.60246718, 76.67984255), (0.00000390, -0.00004107, -0.00078890, 58517.81538729, 0.00268329, -0.27769418)),
    "earth": ((1.00000261, 0.01671123, -0.00001531, 100.46457166, 102.93768193, 0.0), (0.00000562, -0.00004392, -0.01294668, 35999.37244981, 0.32327364, 0.0)),
    "mars": ((1.52371034, 0.09339410, 1.84969142, -4.55343205, -23.94362959, 49.55953891), (0.00001847, 0.00007882, -0.00813131, 19140.30268499, 0.44441088, -0.29257343)),
    "jupiter": ((5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-0.00011607, -0.00013253, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "saturn": ((9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-0.00125060, -0.00050991, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
    "uranus": ((19.18916464, 0.04725744, 0.77263783, 313.23810451, 170.95427630, 74.01692503), (-0.00196176, -0.00004397, -0.00242939, 428.48202785, 0.40805281, 0.04240589)),
    "neptune": ((30.06992276, 0.00859048, 1.77004347, -55.12002969, 44.96476227, 131.78422574), (0.00026291, 0.00005105, 0.00035372, 218.45945325, -0.32241464, -0.00508664)),
}
OBLIQUITY = math.radians(23.43928)


def heliocentric(planet: str, jd: np.ndarray) -> np.ndarray:
    """Ecliptic J2000 positions in AU, n x 3."""
    t = (np.asarray(jd, float) - 2451545.0) / 36525
    base, rate = ELEMENTS[planet]
    a, e, i, long, peri, node = (b + r * t for b, r in zip(base, rate, strict=True))
    i, node, arg = np.radians(i), np.radians(node), np.radians(peri - node)
    m = np.radians((long - peri + 180) % 360 - 180)
    u = m + e * np.sin(m)
    for _ in range(12):
        u = u - (u - e * np.sin(u) - m) / (1 - e * np.cos(u))
    x, y = a * (np.cos(u) - e), a * np.sqrt(1 - e * e) * np.sin(u)
    cn, sn, ca, sa, ci, si = np.cos(node), np.sin(node), np.cos(arg), np.sin(arg), np.cos(i), np.sin(i)
    return np.stack([(ca * cn - sa * sn * ci) * x - (sa * cn + ca * sn * ci) * y, (ca * sn + sa * cn * ci) * x - (sa * sn - ca * cn * ci) * y, sa * si * x + ca * si * y], -1)


def geocentric(planet: str, jd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(right ascension, declination, distance) seen from the Earth's centre, light time allowed for."""
    jd = np.asarray(jd, float)
    earth = heliocentric("earth", jd)
    v = (0 if planet == "sun" else heliocentric(planet, jd)) - earth
    if planet != "sun":
        v = heliocentric(planet, jd - np.linalg.norm(v, axis=-1) * 0.0057755183) - earth
    c, s = math.cos(OBLIQUITY), math.sin(OBLIQUITY)
    x, y, z = v[..., 0], c * v[..., 1] - s * v[..., 2], s * v[..., 1] + c * v[..., 2]
    r = np.linalg.norm(v, axis=-1)
    return np.arctan2(y, x) % TAU, np.arcsin(z / r), r


_PLACE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("ra", "decl", "distance")])


def place(planet: str):
    """An Arrow function of Julian dates: struct(ra, decl, distance)."""

    @F.pandas_udf(_PLACE)
    def f(jd: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("ra", "decl", "distance"), geocentric(planet, jd.to_numpy(float)), strict=True)))

    return f


def elongation(a: str, b: str, jd: np.ndarray) -> np.ndarray:
    """The angle between two bodies as seen from the Earth."""
    (ra, da, _), (rb, db, _) = geocentric(a, jd), geocentric(b, jd)
    return np.arccos(np.clip(np.sin(da) * np.sin(db) + np.cos(da) * np.cos(db) * np.cos(ra - rb), -1, 1))


def conjunctions(a: str, b: str, start: float, stop: float, step: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(times, separations) of closest approaches in the sky."""
    t, sign = extrema(lambda x: elongation(a, b, x), start, stop, step)
    t = t[sign < 0]
    return t, elongation(a, b, t)


def oppositions(planet: str, start: float, stop: float, step: float = 5.0) -> np.ndarray:
    """Times at which an outer planet stands farthest from the Sun in the sky."""
    t, sign = extrema(lambda x: elongation(planet, "sun", x), start, stop, step)
    t = t[sign > 0]
    return t[elongation(planet, "sun", t) > 2.8]


def transits(planet: str, start: float, stop: float) -> pd.DataFrame:
    """(begin, middle, end, separation) of an inner planet's passages before the Sun's disc, for the Earth's centre."""
    rows = []
    for t, s in zip(*conjunctions(planet, "sun", start, stop), strict=True):
        distance, sun = geocentric(planet, np.array([t]))[2][0], geocentric("sun", np.array([t]))[2][0]
        radius = 0.00465047 / sun
        if s < radius and distance < sun:
            c = roots(lambda x: elongation(planet, "sun", x) - radius, t - 0.5, t + 0.5, 1 / 96)
            if len(c) == 2:
                rows.append((c[0], t, c[1], s))
    return pd.DataFrame(rows, columns=["begin", "middle", "end", "separation"])


def satellite_altitude(elements: tuple, epoch: float, latitude: float, longitude: float, jd: np.ndarray) -> np.ndarray:
    """Altitude of a satellite over a site on a spherical Earth, from (n, e, i, node, arg, m, bstar) at an epoch."""
    from vesperflow.operators.orbits import EARTH_KM, sgp4

    p, _ = sgp4((jd - epoch) * 1440, *(np.full(len(jd), x) for x in elements))
    st = sidereal(jd) + longitude
    up = np.stack([math.cos(latitude) * np.cos(st), math.cos(latitude) * np.sin(st), np.full(len(jd), math.sin(latitude))], 1)
    d = p - EARTH_KM * up
    return np.arcsin((d * up).sum(1) / np.linalg.norm(d, axis=1))


def passes(elements: tuple, epoch: float, latitude: float, longitude: float, start: float, stop: float, least: float = 0.0, step: float = 1 / 1440, open_ends: bool = False) -> pd.DataFrame:
    """(rise, culmination, set, altitude) of a satellite above an altitude; passes cut by the window's ends if asked for."""
    f = lambda t: satellite_altitude(elements, epoch, latitude, longitude, np.atleast_1d(t)) - least
    z = roots(f, start, stop, step, 1e-8)
    edges = np.concatenate([[start], z, [stop]])
    rows = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        cut = k == 0 or k == len(edges) - 2
        if b <= a or f((a + b) / 2)[0] <= 0 or (cut and not open_ends):
            continue
        t = np.linspace(a, b, 200)
        y = f(t)
        rows.append((a if k else math.nan, float(t[y.argmax()]), b if k < len(edges) - 2 else math.nan, float(y.max() + least)))
    return pd.DataFrame(rows, columns=["rise", "culmination", "set", "altitude"])


def satellite_passes(satellites: DataFrame, latitude: float, longitude: float, start: float, stop: float, key: str = "satellite", least: float = 0.0) -> DataFrame:
    """Passes of every satellite of a table of elements with an epoch as a Julian date in `epoch_jd`."""
    kind = satellites.schema[key].dataType.simpleString()
    names = ["mean_motion", "eccentricity", "inclination", "node", "argument", "mean_anomaly", "bstar"]

    def run(batches):
        for b in batches:
            for k, epoch, *e in zip(b[key], b["epoch_jd"], *(b[n] for n in names), strict=True):
                out = passes(tuple(e), epoch, latitude, longitude, start, stop, least)
                out.insert(0, key, k)
                yield out

    return satellites.select(key, "epoch_jd", *names).mapInPandas(run, f"{key} {kind}, rise double, culmination double, set double, altitude double")


def heliacal_rising(ra: float, dec: float, latitude: float, longitude: float, start: float, days: int = 366, sun_depth: float = math.radians(10), star_altitude: float = math.radians(2)) -> float:
    """The first day from `start` on which a star stands high enough before sunrise while the Sun is low enough; NaN if none."""
    from vesperflow.operators.events import sun_position

    seen_before = True
    for day in range(days):
        t = start + day + np.arange(0, 1, 1 / 288)
        sun = altitude(t, *sun_position(t), latitude, longitude)
        rising = np.append(np.diff(sun) > 0, False)
        star = altitude(t, np.full_like(t, ra), np.full_like(t, dec), latitude, longitude)
        seen = bool(((sun < -sun_depth) & rising & (star > star_altitude) & (np.append(np.diff(star) > 0, False))).any())
        if seen and not seen_before:
            return start + day
        seen_before = seen
    return math.nan


def spot_transits(longitude: float, start: float, stop: float, observer=None) -> np.ndarray:
    """Julian dates at which a spot of that System II longitude is on Jupiter's central meridian, from start to stop.

    observer(jd) gives the observer from Jupiter's centre (AU, three arrays); by default the Earth by mean elements.
    The far side's crossings, half a turn off, are left out.
    """
    from vesperflow.functions.bodies import JUPITER_POLE, JUPITER_SYSTEMS, LIGHT_DAYS_AU
    from vesperflow.operators.events import roots

    def seen(jd: np.ndarray) -> np.ndarray:
        if observer is not None:
            return np.asarray(observer(jd), float)
        ra, dec, distance = geocentric("jupiter", jd)
        return -np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)]) * distance

    def meridian(jd: np.ndarray) -> np.ndarray:
        x, y, z = seen(jd)
        century = (jd - 2451545.0) / 36525
        a, p = (np.radians(JUPITER_POLE[i] + JUPITER_POLE[i + 1] * century) for i in (0, 2))
        first, growth = JUPITER_SYSTEMS["II"]
        turn = np.radians(first + growth * (jd - 2451545.0 - np.sqrt(x * x + y * y + z * z) * LIGHT_DAYS_AU))
        return turn - np.arctan2(z * np.cos(p) - np.sin(p) * (x * np.cos(a) + y * np.sin(a)), y * np.cos(a) - x * np.sin(a))

    found = roots(lambda t: np.sin(meridian(np.asarray(t, float)) - longitude), start, stop)
    return np.array([t for t in found if math.cos(float(meridian(np.array([t]))[0]) - longitude) > 0])

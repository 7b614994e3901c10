"""Event searches over time: roots and extrema of sampled functions refined in vectors, rise and set, Moon phases."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAU = 2 * math.pi


def roots(f: Callable[[np.ndarray], np.ndarray], start: float, stop: float, step: float = 1 / 24, tolerance: float = 1e-6) -> np.ndarray:
    """Times in [start, stop] at which f is zero: sign changes of a grid, all halved together; exact zeros once, ends included."""
    t = np.append(np.arange(start, stop, step), stop)
    y = f(t)
    exact = t[y == 0]
    k = np.flatnonzero(y[:-1] * y[1:] < 0)
    a, b, fa = t[k], t[k + 1], y[k]
    while len(a) and (b - a).max() > tolerance:
        m = (a + b) / 2
        fm = f(m)
        left = fa * fm <= 0
        a, fa, b = np.where(left, a, m), np.where(left, fa, fm), np.where(left, m, b)
    return np.sort(np.concatenate([exact, (a + b) / 2]))


def extrema(f: Callable[[np.ndarray], np.ndarray], start: float, stop: float, step: float = 1 / 24, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(times, +1 for maxima and -1 for minima): strict triples of a grid, refined by golden sections all together."""
    t = np.append(np.arange(start, stop, step), stop)
    y = f(t)
    up = (y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])
    down = (y[1:-1] < y[:-2]) & (y[1:-1] < y[2:])
    k = np.flatnonzero(up | down) + 1
    sign = np.where(up[k - 1], 1.0, -1.0)
    a, b, g = t[k - 1], t[k + 1], (math.sqrt(5) - 1) / 2
    while len(a) and (b - a).max() > tolerance:
        c, d = b - g * (b - a), a + g * (b - a)
        left = sign * f(c) > sign * f(d)
        a, b = np.where(left, a, c), np.where(left, d, b)
    return (a + b) / 2, sign


def sun_position(jd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apparent right ascension and declination of the Sun, to about an arcminute (Meeus, low precision)."""
    t = (np.asarray(jd, float) - 2451545.0) / 36525
    d = math.pi / 180
    m = (357.52911 + t * (35999.05029 - 0.0001537 * t)) * d
    lon = 280.46646 + t * (36000.76983 + 0.0003032 * t) + (1.914602 - t * (0.004817 + 0.000014 * t)) * np.sin(m) + (0.019993 - 0.000101 * t) * np.sin(2 * m) + 0.000289 * np.sin(3 * m)
    node = (125.04 - 1934.136 * t) * d
    lam = (lon - 0.00569 - 0.00478 * np.sin(node)) * d
    eps = (23.4392911 - 0.0130042 * t + 0.00256 * np.cos(node)) * d
    return np.arctan2(np.cos(eps) * np.sin(lam), np.cos(lam)) % TAU, np.arcsin(np.sin(eps) * np.sin(lam))


def sidereal(jd: np.ndarray) -> np.ndarray:
    """Greenwich mean sidereal time of UT (Meeus)."""
    d = np.asarray(jd, float) - 2451545.0
    t = d / 36525
    return (280.46061837 + 360.98564736629 * d + t * t * (0.000387933 - t / 38710000)) * (math.pi / 180) % TAU


def altitude(jd: np.ndarray, ra: np.ndarray, dec: np.ndarray, latitude: float, longitude: float) -> np.ndarray:
    h = sidereal(jd) + longitude - ra
    return np.arcsin(math.sin(latitude) * np.sin(dec) + math.cos(latitude) * np.cos(dec) * np.cos(h))


def rise_transit_set(direction: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: float, latitude: float, longitude: float, horizon: float = -0.0145386, days: float = 1.0, nearest: bool = False) -> dict:
    """rise, transit, set of a day from `start` and always_up or always_down where the horizon is not crossed.

    Transit is the highest maximum; rise is the nearest rising crossing before it and set the nearest setting one after.
    A day that is shorter than the body's may have no transit: with `nearest` it takes the one nearest to it.
    """
    f = lambda t: altitude(t, *direction(t), latitude, longitude) - horizon
    out = {"rise": math.nan, "transit": math.nan, "set": math.nan, "always_up": False, "always_down": False}
    peaks, sign = extrema(f, start - days / 2, start + 1.5 * days, 1 / 48)
    peaks = peaks[sign > 0]
    inside = peaks[(peaks >= start) & (peaks < start + days)]
    if nearest and len(peaks) and not len(inside):
        inside = peaks[[np.abs(peaks - (start + days / 2)).argmin()]]
    peaks = inside
    if len(peaks):
        out["transit"] = float(peaks[np.argmax(f(peaks))])
    middle = out["transit"] if len(peaks) else start + days / 2
    zeros = roots(f, middle - days, middle + days, 1 / 48)
    if not len(zeros):
        above = bool(f(np.array([middle]))[0] > 0)
        out["always_up"], out["always_down"] = above, not above
        return out
    rising = f(zeros + 1e-4) > f(zeros - 1e-4)
    before, after = zeros[rising & (zeros <= middle)], zeros[~rising & (zeros >= middle)]
    out["rise"] = float(before[-1]) if len(before) else math.nan
    out["set"] = float(after[0]) if len(after) else math.nan
    return out


def rise_transit_set_rows(direction: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, latitude: np.ndarray, longitude: np.ndarray, horizon: float = -0.0145386, days: float = 1.0, nearest: bool = False) -> pd.DataFrame:
    """As `rise_transit_set`, all rows together: grids of the days a row each, brackets refined in vectors. Only peaks that
    can be a row's transit are refined, of the grid of two days one or two."""
    lat, lon = np.asarray(latitude, float)[:, None], np.asarray(longitude, float)[:, None]

    def f(t: np.ndarray, lat: np.ndarray = lat, lon: np.ndarray = lon) -> np.ndarray:  # times by row
        ra, dec = direction(t)
        h = sidereal(t) + lon - ra
        return np.arcsin(np.clip(np.sin(lat) * np.sin(dec) + np.cos(lat) * np.cos(dec) * np.cos(h), -1, 1)) - horizon

    start = np.asarray(start, float)[:, None]
    n, step = len(start), 1 / 48
    row = np.arange(n)

    def grid(first: np.ndarray, length: float) -> np.ndarray:
        return first + np.arange(int(round(length / step)) + 1) * step

    t = grid(start - days / 2, 2 * days)
    y = f(t)
    peak = (y[:, 1:-1] > y[:, :-2]) & (y[:, 1:-1] > y[:, 2:])
    if not nearest:  # a peak lies within a step of its triple's middle
        peak &= (t[:, 2:] >= start) & (t[:, :-2] < start + days)
    at_row, at_col = np.nonzero(peak)
    lo, hi, g = t[at_row, at_col], t[at_row, at_col + 2], (math.sqrt(5) - 1) / 2
    own = lat[at_row, 0], lon[at_row, 0]
    for _ in range(40):  # golden sections of all of them
        if (hi - lo).max(initial=0.0) <= 1e-6:
            break
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = f(c, *own) > f(d, *own)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    at, first = (lo + hi) / 2, start[at_row, 0]
    inside = (at >= first) & (at < first + days)
    # of each row the highest inside comes first, then, with `nearest`, the one nearest to the day's middle; equal ones by time
    rank = np.where(inside, -f(at, *own), np.abs(at - (first + days / 2)))
    order = np.lexsort((at, rank, ~inside, at_row))
    order = order if nearest else order[inside[order]]
    which, lead = np.unique(at_row[order], return_index=True)
    transit = np.full(n, np.nan)
    transit[which] = at[order[lead]]
    found = ~np.isnan(transit)
    middle = np.where(found, transit, start[:, 0] + days / 2)[:, None]
    t = grid(middle - days, 2 * days)
    y = f(t)
    change = y[:, :-1] * y[:, 1:] <= 0
    rising = y[:, 1:] > y[:, :-1]

    def refined(pick: np.ndarray, last: bool, side: int) -> np.ndarray:
        """The crossing of the last or first picked bracket of each row, on its side of the middle."""
        k = np.where(last, pick.shape[1] - 1 - pick[:, ::-1].argmax(1), pick.argmax(1))
        a, b = t[row, k][:, None], t[row, k + 1][:, None]
        fa = f(a)
        for _ in range(20):
            m = (a + b) / 2
            fm = f(m)
            left = fa * fm <= 0
            a, fa, b = np.where(left, a, m), np.where(left, fa, fm), np.where(left, m, b)
        out = ((a + b) / 2)[:, 0]
        return np.where(pick.any(1) & ((out - middle[:, 0]) * side >= 0), out, np.nan)

    # a bracket that holds the middle counts for the side its crossing is on
    rise, set_ = refined(change & rising & (t[:, :-1] <= middle), True, -1), refined(change & ~rising & (t[:, 1:] >= middle), False, 1)
    none = ~change.any(1)
    above = f(middle)[:, 0] > 0
    return pd.DataFrame({"rise": np.where(none, np.nan, rise), "transit": transit, "set": np.where(none, np.nan, set_), "always_up": none & above, "always_down": none & ~above})


def sun_events(sites: DataFrame, key: str = "site", nearest: bool = False) -> DataFrame:
    """(key, rise, transit, set, always_up, always_down) of the Sun for rows (key, jd, latitude, longitude).

    nearest: a day on which the Sun does not transit, as solar days may be longer, takes the transit nearest to it."""
    kind = sites.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            if len(b):
                out = rise_transit_set_rows(sun_position, b["jd"], b["latitude"], b["longitude"], nearest=nearest)
                out.insert(0, key, b[key].to_numpy())
                yield out

    return sites.select(key, "jd", "latitude", "longitude").mapInPandas(run, f"{key} {kind}, rise double, transit double, set double, always_up boolean, always_down boolean")


@F.pandas_udf(T.DoubleType())
def sun_altitude(jd: pd.Series, latitude: pd.Series, longitude: pd.Series) -> pd.Series:
    """The Sun's altitude at times and places."""
    ra, dec = sun_position(jd.to_numpy(float))
    h = sidereal(jd.to_numpy(float)) + longitude.to_numpy(float) - ra
    lat = latitude.to_numpy(float)
    return pd.Series(np.arcsin(np.clip(np.sin(lat) * np.sin(dec) + np.cos(lat) * np.cos(dec) * np.cos(h), -1, 1)))


def moon_phase(k: np.ndarray) -> np.ndarray:
    """Julian dates (TT) of Moon phases: k whole for new, + 0.25, 0.5, 0.75 for the others, from 2000; Meeus' main terms."""
    k = np.asarray(k, float)
    t = k / 1236.85
    d = math.pi / 180
    jd = 2451550.09766 + 29.530588861 * k + t * t * (0.00015437 - t * (0.00000015 - 0.00000000073 * t))
    e = 1 - 0.002516 * t - 0.0000074 * t * t
    m = (2.5534 + 29.10535670 * k - 0.0000014 * t * t) * d
    mp = (201.5643 + 385.81693528 * k + 0.0107582 * t * t) * d
    f = (160.7108 + 390.67050284 * k - 0.0016118 * t * t) * d
    om = (124.7746 - 1.56375588 * k + 0.0020672 * t * t) * d
    quarter = np.round((k % 1) * 4).astype(int) % 2 == 1
    full = np.round((k % 1) * 4).astype(int) == 2
    new = np.where(full, -0.40614, -0.40720) * np.sin(mp) + np.where(full, 0.17302, 0.17241) * e * np.sin(m) + np.where(full, 0.01614, 0.01608) * np.sin(2 * mp) + np.where(full, 0.01043, 0.01039) * np.sin(2 * f)
    new += np.where(full, 0.00734, 0.00739) * e * np.sin(mp - m) - np.where(full, 0.00515, 0.00514) * e * np.sin(mp + m) + np.where(full, 0.00209, 0.00208) * e * e * np.sin(2 * m) - 0.00111 * np.sin(mp - 2 * f) - 0.00017 * np.sin(om)
    half = -0.62801 * np.sin(mp) + 0.17172 * e * np.sin(m) - 0.01183 * e * np.sin(mp + m) + 0.00862 * np.sin(2 * mp) + 0.00804 * np.sin(2 * f) + 0.00454 * e * np.sin(mp - m) + 0.00204 * e * e * np.sin(2 * m) - 0.00180 * np.sin(mp - 2 * f) - 0.00017 * np.sin(om)
    w = 0.00306 - 0.00038 * e * np.cos(m) + 0.00026 * np.cos(mp) - 0.00002 * np.cos(mp - m) + 0.00002 * np.cos(mp + m) + 0.00002 * np.cos(2 * f)
    return jd + np.where(quarter, half + np.where(np.round((k % 1) * 4).astype(int) == 1, w, -w), new)


@F.pandas_udf(T.DoubleType())
def moon_phase_jd(k: pd.Series) -> pd.Series:
    return pd.Series(moon_phase(k.to_numpy(float)))

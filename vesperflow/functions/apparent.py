"""Nutation, aberration and apparent places by the main terms (Meeus): good to half an arcsecond or so."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesperflow.functions.angles import wrap_positive
from vesperflow.functions.mathx import col, horner, let
from vesperflow.functions.time import gmst, mjd, obliquity

ARCSEC = math.pi / 648000
DEG = math.pi / 180
#: Constant of aberration (arcseconds).
ABERRATION = 20.49552


def centuries(tt: Column) -> Column:
    """Julian centuries from 2000 of a time."""
    return (mjd(tt) - 51544.5) / 36525


def nutation(t) -> Column:
    """struct(longitude, obliquity) in radians, t in centuries from 2000."""

    def terms(u: Column) -> Column:
        node, sun, moon = ((u * b + a) * DEG for a, b in ((125.04452, -1934.136261), (280.4665, 36000.7698), (218.3165, 481267.8813)))
        lon = F.sin(node) * -17.20 - F.sin(sun * 2) * 1.32 - F.sin(moon * 2) * 0.23 + F.sin(node * 2) * 0.21
        obl = F.cos(node) * 9.20 + F.cos(sun * 2) * 0.57 + F.cos(moon * 2) * 0.10 - F.cos(node * 2) * 0.09
        return F.struct((lon * ARCSEC).alias("longitude"), (obl * ARCSEC).alias("obliquity"))

    return let(col(t), terms)


def true_obliquity(tt: Column) -> Column:
    return obliquity(tt) + nutation(centuries(tt))["obliquity"]


def gast(ut1: Column, tt: Column | None = None) -> Column:
    """Greenwich apparent sidereal time: the mean one and the equation of the equinoxes."""
    at = ut1 if tt is None else tt
    return wrap_positive(gmst(ut1, tt) + nutation(centuries(at))["longitude"] * F.cos(true_obliquity(at)))


def sun_longitude(t) -> Column:
    """The Sun's true longitude of date, t in centuries from 2000."""

    def of(u: Column) -> Column:
        m = horner(u, [357.52911, 35999.05029, -0.0001537]) * DEG
        c = F.sin(m) * horner(u, [1.914602, -0.004817, -0.000014]) + F.sin(m * 2) * horner(u, [0.019993, -0.000101]) + F.sin(m * 3) * 0.000289
        return (horner(u, [280.46646, 36000.76983, 0.0003032]) + c) * DEG

    return let(col(t), of)


def apparent_place(ra, dec, t, mean_obliquity) -> Column:
    """struct(ra, decl) of a mean place of date with nutation and the Earth's yearly aberration; t in centuries from
    2000. Within a degree or so of a pole its first-order terms grow without bound."""
    args = F.struct(col(ra).alias("a"), col(dec).alias("d"), col(t).cast("double").alias("t"), col(mean_obliquity).cast("double").alias("e"), nutation(t).alias("n"), sun_longitude(t).alias("s"))

    def moved(v: Column) -> Column:
        a, d, e, s, u = v["a"], v["d"], v["e"], v["s"], v["t"]
        sa, ca, td, ce, se = F.sin(a), F.cos(a), F.tan(d), F.cos(e), F.sin(e)
        lon, obl = v["n"]["longitude"], v["n"]["obliquity"]
        k, ecc, peri = ABERRATION * ARCSEC, horner(u, [0.016708634, -0.000042037, -0.0000001267]), horner(u, [102.93735, 1.71946, 0.00046]) * DEG

        def yearly(x: Column) -> tuple[Column, Column]:  # of a direction in longitude
            return (ca * F.cos(x) * ce + sa * F.sin(x)) / F.cos(d), F.cos(x) * ce * (se / ce * F.cos(d) - sa * F.sin(d)) + ca * F.sin(d) * F.sin(x)

        (a1, d1), (a2, d2) = yearly(s), yearly(peri)
        da = (ce + se * sa * td) * lon - ca * td * obl - a1 * k + a2 * ecc * k
        dd = se * ca * lon + sa * obl - d1 * k + d2 * ecc * k
        return F.struct(wrap_positive(a + da).alias("ra"), (d + dd).alias("decl"))

    return let(args, moved)


#: The seasons' mean dates by powers of millennia from 2000 (March, June, September, December), and their
#: periodic terms (size in 0.00001 days, angle and its growth a century in degrees), from 1000 to 3000.
SEASONS = (
    (2451623.80984, 365242.37404, 0.05169, -0.00411, -0.00057), (2451716.56767, 365241.62603, 0.00325, 0.00888, -0.00030),
    (2451810.21715, 365242.01767, -0.11575, 0.00337, 0.00078), (2451900.05952, 365242.74049, -0.06223, -0.00823, 0.00032),
)
SEASON_TERMS = (
    (485, 324.96, 1934.136), (203, 337.23, 32964.467), (199, 342.08, 20.186), (182, 27.85, 445267.112), (156, 73.14, 45036.886), (136, 171.52, 22518.443), (77, 222.54, 65928.934), (74, 296.72, 3034.906),
    (70, 243.58, 9037.513), (58, 119.81, 33718.147), (52, 297.17, 150.678), (50, 21.02, 2281.226), (45, 247.54, 29929.562), (44, 325.15, 31555.956), (29, 60.93, 4443.417), (18, 155.12, 67555.328),
    (17, 288.79, 4562.452), (16, 198.04, 62894.029), (14, 199.76, 31436.921), (12, 95.39, 14577.848), (12, 287.11, 31931.756), (12, 320.81, 34777.259), (9, 227.73, 1222.114), (8, 15.45, 16859.074),
)


def season_jd(year, season) -> Column:
    """The Julian date (TT) at which a season (0 March, 1 June, 2 September, 3 December) of a year begins."""
    y, k = (col(year) - 2000) / 1000.0, col(season)
    mean = F.get(F.array(*(horner(y, list(c)) for c in SEASONS)), k.cast("int"))

    def corrected(j: Column) -> Column:
        t = (j - 2451545.0) / 36525
        w = (t * 35999.373 - 2.47) * DEG
        s = sum((F.cos((t * c + b) * DEG) * float(a) for a, b, c in SEASON_TERMS), F.lit(0.0))
        return j + s * 0.00001 / (F.cos(w) * 0.0334 + F.cos(w * 2) * 0.0007 + 1)

    return let(mean, corrected)

"""Solar and lunar eclipses by lunation, from the main terms of the Moon's phases (Meeus, chapter 54)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def eclipses(k: np.ndarray) -> pd.DataFrame:
    """One row for each lunation k (whole: new Moon, solar; half: full Moon, lunar) that has an eclipse.

    (k, jd of the greatest eclipse in TT, kind, gamma, magnitude): kind is total, annular, hybrid, partial or, for
    the Moon, total, partial, penumbral. A central solar eclipse has no magnitude.
    """
    k = np.asarray(k, float)
    lunar = np.abs(k % 1 - 0.5) < 1e-9
    t = k / 1236.85
    d = np.pi / 180
    e = 1 - 0.002516 * t - 0.0000074 * t * t
    m = (2.5534 + 29.10535670 * k - 0.0000014 * t * t) * d
    mp = (201.5643 + 385.81693528 * k + 0.0107582 * t * t + 0.00001238 * t**3) * d
    f = (160.7108 + 390.67050284 * k - 0.0016118 * t * t - 0.00000227 * t**3) * d
    om = (124.7746 - 1.56375588 * k + 0.0020672 * t * t + 0.00000215 * t**3) * d
    f1 = f - 0.02665 * d * np.sin(om)
    a1 = (299.77 + 0.107408 * k - 0.009173 * t * t) * d
    jd = 2451550.09766 + 29.530588861 * k + 0.00015437 * t * t - 0.00000015 * t**3
    jd += np.where(lunar, -0.4065, -0.4075) * np.sin(mp) + np.where(lunar, 0.1727, 0.1721) * e * np.sin(m) + 0.0161 * np.sin(2 * mp) - 0.0097 * np.sin(2 * f1) + 0.0073 * e * np.sin(mp - m) - 0.0050 * e * np.sin(mp + m) - 0.0023 * np.sin(mp - 2 * f1)
    jd += 0.0021 * e * np.sin(2 * m) + 0.0012 * np.sin(mp + 2 * f1) + 0.0006 * e * np.sin(2 * mp + m) - 0.0004 * np.sin(3 * mp) - 0.0003 * e * np.sin(m + 2 * f1) + 0.0003 * np.sin(a1) - 0.0002 * e * np.sin(m - 2 * f1) - 0.0002 * e * np.sin(2 * mp - m) - 0.0002 * np.sin(om)
    p = 0.2070 * e * np.sin(m) + 0.0024 * e * np.sin(2 * m) - 0.0392 * np.sin(mp) + 0.0116 * np.sin(2 * mp) - 0.0073 * e * np.sin(mp + m) + 0.0067 * e * np.sin(mp - m) + 0.0118 * np.sin(2 * f1)
    q = 5.2207 - 0.0048 * e * np.cos(m) + 0.0020 * e * np.cos(2 * m) - 0.3299 * np.cos(mp) - 0.0060 * e * np.cos(mp + m) + 0.0041 * e * np.cos(mp - m)
    w = np.abs(np.cos(f1))
    gamma = (p * np.cos(f1) + q * np.sin(f1)) * (1 - 0.0048 * w)
    u = 0.0059 + 0.0046 * e * np.cos(m) - 0.0182 * np.cos(mp) + 0.0004 * np.cos(2 * mp) - 0.0005 * np.cos(m + mp)
    g = np.abs(gamma)
    central = g < 0.9972
    partial = ~central & (g <= 1.5433 + u)
    hybrid = (u > 0) & (u < 0.0047)
    limit = 0.00464 * np.sqrt(np.maximum(0, 1 - gamma * gamma))
    beyond = ~central & (g < 0.9972 + np.abs(u))  # the axis misses the Earth but the umbra does not
    solar_kind = np.where(central | beyond, np.where(u < 0, "total", np.where(u > 0.0047, "annular", np.where(hybrid & (u < limit), "hybrid", "annular"))), np.where(partial, "partial", ""))
    penumbral, umbral = (1.5573 + u - g) / 0.5450, (1.0128 - u - g) / 0.5450
    lunar_kind = np.where(umbral >= 1, "total", np.where(umbral > 0, "partial", np.where(penumbral > 0, "penumbral", "")))
    near = np.abs(np.sin(f)) <= 0.36
    kind = np.where(near, np.where(lunar, lunar_kind, solar_kind), "")
    magnitude = np.where(lunar, np.where(umbral > 0, umbral, penumbral), np.where(kind == "partial", (1.5433 + u - g) / (0.5461 + 2 * u), np.nan))
    ok = kind != ""
    return pd.DataFrame({"k": k[ok], "jd": jd[ok], "body": np.where(lunar[ok], "moon", "sun"), "kind": kind[ok], "gamma": gamma[ok], "magnitude": magnitude[ok]})


def eclipse_table(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Eclipses of the lunations from `first` to `last`, counted from the new Moon of 2000 January 6."""

    def run(batches):
        for b in batches:
            yield eclipses(b["id"].to_numpy() / 2.0).replace({np.nan: None})

    return spark.range(2 * first, 2 * last + 1).mapInPandas(run, "k double, jd double, body string, kind string, gamma double, magnitude double").orderBy(F.col("jd"))

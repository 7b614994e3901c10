"""Angles in radians, distances in AU, velocities in AU a day, pressures in hPa, temperatures in Celsius."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesperflow.functions.mathx import TAU, col, fmod

AU_KM = 149597870.7
DAY_S = 86400.0
PARSEC_AU = 648000.0 / math.pi
LIGHT_YEAR_AU = 63241.07708426628
DEGREES_IN = {"deg": 1.0, "arcmin": 1 / 60, "arcsec": 1 / 3600, "mas": 1 / 3600000, "hour": 15.0, "minute": 0.25, "second": 15 / 3600}


def from_unit(v, unit: str) -> Column:
    """Radians of an angle in deg, arcmin, arcsec, mas, hour, minute or second (of time)."""
    return col(v) * F.lit(DEGREES_IN[unit] * math.pi / 180)


def to_unit(v, unit: str) -> Column:
    return col(v) / F.lit(DEGREES_IN[unit] * math.pi / 180)


def dms(d, m, s) -> Column:
    """Radians of degrees, minutes, seconds; the sign is that of the degrees, -0.0 included."""
    d = col(d).cast("double")
    minus = (d < 0) | (d.cast("string") == "-0.0")
    return F.when(minus, -1.0).otherwise(1.0) * (F.abs(d) + col(m) / 60 + col(s) / 3600) * F.lit(math.pi / 180)


def hms(h, m, s) -> Column:
    return dms(h, m, s) * 15


def wrap_positive(v) -> Column:
    """In [0, 2 pi)."""
    return fmod(v, TAU)


def wrap_signed(v) -> Column:
    """In (-pi, pi]."""
    v = col(v)
    return v - F.ceil((v - math.pi) / TAU) * F.lit(TAU)


def parse(text, hours: bool = False) -> Column:
    """Radians of sexagesimal text; null if it is none.

    Takes a sign and one to three numbers parted by blanks, colons, degree, minute, second or letter marks; an h
    after the first number, or `hours`, makes it hours.
    """
    t = F.trim(F.lower(col(text)))
    pattern = r"^([+\-−]?)\s*(\d+(?:\.\d+)?)\s*(?:[h°d:]|deg|\s)?\s*(?:(\d+(?:\.\d+)?)\s*(?:[m'′:]|min|\s)?\s*)?(?:(\d+(?:\.\d+)?)\s*(?:s|\"|″|''|sec)?\s*)?$"

    def part(k: int) -> Column:
        g = F.regexp_extract(t, pattern, k)
        return F.when(g == "", 0.0).otherwise(F.try_to_number(g, F.lit("999999999999.999999999999")).cast("double"))

    value = part(2) + part(3) / 60 + part(4) / 3600
    unit = F.when(F.lit(hours) | t.rlike(r"^[+\-−]?\s*\d+(\.\d+)?\s*h"), 15.0).otherwise(1.0)
    sign = F.when(F.regexp_extract(t, pattern, 1).isin("-", "−"), -1.0).otherwise(1.0)
    return F.when(t.rlike(pattern), sign * value * unit * F.lit(math.pi / 180))


def format_sexagesimal(v, hours: bool = False, digits: int = 1, separators: tuple[str, str, str] = (":", ":", ""), plus: bool = True) -> Column:
    """Text such as +05:04:03.2. Rounding to the last digit comes first, so 59.96 seconds carry over."""
    x = col(v) * F.lit(180 / math.pi / (15 if hours else 1))
    scale = 10**digits
    units = F.floor(F.abs(x) * 3600 * scale + 0.5).cast("long")
    seconds = F.pmod(units, F.lit(60 * scale))
    minutes = F.pmod(F.floor(units / (60 * scale)), F.lit(60))
    first = F.floor(units / (3600 * scale))
    sign = F.when((x < 0) & (units > 0), "-").otherwise("+" if plus else "")
    tail = F.lpad(F.floor(seconds / scale).cast("string"), 2, "0")
    if digits:
        tail = F.concat(tail, F.lit("."), F.lpad(F.pmod(seconds, F.lit(scale)).cast("string"), digits, "0"))
    return F.concat(sign, F.lpad(first.cast("string"), 2, "0"), F.lit(separators[0]), F.lpad(minutes.cast("string"), 2, "0"), F.lit(separators[1]), tail, F.lit(separators[2]))


def parsec(v) -> Column:
    return col(v) * F.lit(PARSEC_AU)


def light_year(v) -> Column:
    return col(v) * F.lit(LIGHT_YEAR_AU)


def kilometer(v) -> Column:
    return col(v) / F.lit(AU_KM)


def km_per_second(v) -> Column:
    return col(v) * F.lit(DAY_S / AU_KM)


def kelvin(v) -> Column:
    return col(v) - 273.15


def fahrenheit(v) -> Column:
    return (col(v) - 32) / 1.8


def pressure_at(altitude_m, temperature_c=15.0) -> Column:
    """hPa at an altitude by the barometric formula with a lapse of 6.5 K a kilometre, 1013.25 hPa at sea level."""
    h, t = col(altitude_m), col(temperature_c) + 273.15
    return F.lit(1013.25) * F.pow(F.lit(1.0) - h * 0.0065 / (t + h * 0.0065), F.lit(5.257))

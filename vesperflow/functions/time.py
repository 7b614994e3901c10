"""Two-part Julian dates, time scales, Delta T, sidereal time and civil dates as columns.

A time is struct(day double, fraction double): day is whole or half, fraction the rest in days; the scale is the
caller's. Differences subtract days first and keep sub-microsecond precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesperflow.functions.angles import wrap_positive
from vesperflow.functions.mathx import TAU, col, horner, let

TT_MINUS_TAI = 32.184
#: MJD from which TAI - UTC is so many seconds.
LEAP_SECONDS = (
    (41317, 10), (41499, 11), (41683, 12), (42048, 13), (42413, 14), (42778, 15), (43144, 16), (43509, 17), (43874, 18), (44239, 19), (44786, 20), (45151, 21), (45516, 22), (46247, 23),
    (47161, 24), (47892, 25), (48257, 26), (48804, 27), (49169, 28), (49534, 29), (50083, 30), (50630, 31), (51179, 32), (53736, 33), (54832, 34), (56109, 35), (57204, 36), (57754, 37),
)
#: TT - UT1 polynomials of Espenak and Meeus (2006): first year not covered, origin, unit, coefficients.
DELTA_T = (
    (-500, 1820, 100, (-20, 0, 32)),
    (500, 0, 100, (10583.6, -1014.41, 33.78311, -5.952053, -0.1798452, 0.022174192, 0.0090316521)),
    (1600, 1000, 100, (1574.2, -556.01, 71.23472, 0.319781, -0.8503463, -0.005050998, 0.0083572073)),
    (1700, 1600, 1, (120, -0.9808, -0.01532, 1 / 7129)),
    (1800, 1700, 1, (8.83, 0.1603, -0.0059285, 0.00013336, -1 / 1174000)),
    (1860, 1800, 1, (13.72, -0.332447, 0.0068612, 0.0041116, -0.00037436, 0.0000121272, -0.0000001699, 0.000000000875)),
    (1900, 1860, 1, (7.62, 0.5737, -0.251754, 0.01680668, -0.0004473624, 1 / 233174)),
    (1920, 1900, 1, (-2.79, 1.494119, -0.0598939, 0.0061966, -0.000197)),
    (1941, 1920, 1, (21.20, 0.84493, -0.076100, 0.0020936)),
    (1961, 1950, 1, (29.07, 0.407, -1 / 233, 1 / 2547)),
    (1986, 1975, 1, (45.45, 1.067, -1 / 260, -1 / 718)),
    (2005, 2000, 1, (63.86, 0.3345, -0.060374, 0.0017275, 0.000651814, 0.00002373599)),
    (2050, 2000, 1, (62.92, 0.32217, 0.005589)),
)


def time(day, fraction) -> Column:
    """A normalised time: the fraction in [-0.5, 0.5), the rest in the day."""
    raw = F.struct(col(day).cast("double").alias("day"), col(fraction).cast("double").alias("fraction"))
    return let(raw, lambda t: F.struct((t["day"] + F.floor(t["fraction"] + 0.5)).alias("day"), (t["fraction"] - F.floor(t["fraction"] + 0.5)).alias("fraction")))


def from_mjd(mjd) -> Column:
    m = col(mjd).cast("double")
    return F.struct((F.floor(m) + 2400000.5).alias("day"), (m - F.floor(m)).alias("fraction"))


def from_timestamp(ts) -> Column:
    """The time of a civil timestamp (UTC): the day at midnight and the fraction of it."""
    ts = col(ts).cast("timestamp_ntz")
    midnight = F.date_trunc("day", ts)
    days = F.datediff(ts, F.lit("1858-11-17").cast("date"))
    seconds = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(midnight.cast("timestamp"))
    return F.struct((days + F.lit(2400000.5)).alias("day"), (seconds / F.lit(86400e6)).alias("fraction"))


def shift(t: Column, days) -> Column:
    """The time moved by days: a number, a column, or a function of the time."""
    return let(t, lambda u: time(u["day"], u["fraction"] + (days(u) if callable(days) and not isinstance(days, Column) else col(days))))


def difference(a: Column, b: Column) -> Column:
    """Days from b to a."""
    return (a["day"] - b["day"]) + (a["fraction"] - b["fraction"])


def mjd(t: Column) -> Column:
    return (t["day"] - 2400000.5) + t["fraction"]


def tai_minus_utc(m) -> Column:
    """Seconds, from 1972; before, the first value. The table rises by one second an entry, so entries are counted."""
    starts, first = F.array(*(F.lit(float(d)) for d, _ in LEAP_SECONDS)), LEAP_SECONDS[0][1]
    return let(col(m), lambda x: F.greatest(F.lit(first), F.size(F.filter(starts, lambda s: s <= x)) + (first - 1)).cast("double"))


def utc_to_tai(t: Column) -> Column:
    return shift(t, lambda u: tai_minus_utc(mjd(u)) / 86400)


def tai_to_utc(t: Column) -> Column:
    return shift(t, lambda u: -tai_minus_utc(mjd(u) - tai_minus_utc(mjd(u)) / 86400) / 86400)


def tai_to_tt(t: Column) -> Column:
    return shift(t, TT_MINUS_TAI / 86400)


def tt_to_tai(t: Column) -> Column:
    return shift(t, -TT_MINUS_TAI / 86400)


def tt_to_tdb(t: Column) -> Column:
    """By the main periodic terms, good to about 50 microseconds."""

    def terms(u: Column) -> Column:
        g = (mjd(u) - 51544.5) * (0.98560028 * math.pi / 180) + 357.53 * math.pi / 180
        return (F.sin(g) * 0.001657 + F.sin(g * 2) * 0.000022) / 86400

    return shift(t, terms)


def tt_to_tcg(t: Column) -> Column:
    return shift(t, lambda u: (mjd(u) - 43144.0003725) * (6.969290134e-10 / (1 - 6.969290134e-10)))


def tdb_to_tcb(t: Column) -> Column:
    return shift(t, lambda u: (mjd(u) - 43144.0003725) * (1.550519768e-8 / (1 - 1.550519768e-8)) + 6.55e-5 / 86400)


def delta_t(year) -> Column:
    """TT - UT1 in seconds for a decimal year; beyond the pieces the long-term parabola, blended in until 2150."""
    y = col(year)
    parabola = horner((y - 1820) / 100, [-20, 0, 32])
    out = F.when(y < 2150, parabola - (F.lit(2150) - y) * 0.5628).otherwise(parabola)
    for last, origin, unit, c in reversed(DELTA_T):
        out = F.when(y < last, horner((y - origin) / unit if unit != 1 else y - origin, list(c))).otherwise(out)
    return out


def delta_t_spline(points, table, year: str = "year", out: str = "delta_t"):
    """`points` with TT - UT1 by a published table of cubic segments (start, end, a0, a1, a2, a3): within a segment
    a0 + t (a1 + t (a2 + t a3)), t running from 0 to 1; outside all of them as `delta_t`.

    The table is the caller's, some ten rows a century; years meet segments in buckets.
    """
    from vesperflow.operators.joins import range_join

    rows = points.withColumn("_id", F.monotonically_increasing_id())
    seg = table.select(*(F.col(c).cast("double").alias(f"_{c}") for c in ("start", "end", "a0", "a1", "a2", "a3")))
    hit = range_join(rows.select("_id", year), seg, year, "_start", "_end", 50.0).groupBy("_id").agg(F.max_by(F.struct("_start", "_end", "_a0", "_a1", "_a2", "_a3"), "_start").alias("_s"))
    t = (F.col(year) - F.col("_s._start")) / (F.col("_s._end") - F.col("_s._start"))
    spline = F.col("_s._a0") + t * (F.col("_s._a1") + t * (F.col("_s._a2") + t * F.col("_s._a3")))
    return rows.join(hit, "_id", "left").withColumn(out, F.coalesce(spline, delta_t(year))).drop("_id", "_s")


def decimal_year(ts) -> Column:
    d = col(ts)
    return F.year(d) + (F.dayofyear(d) - 1) / F.when(is_leap(F.year(d)), 366.0).otherwise(365.0)


def is_leap(year) -> Column:
    y = col(year)
    return ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0)) | (F.pmod(y, F.lit(400)) == 0)


def earth_rotation_angle(ut1: Column) -> Column:
    t = (ut1["day"] - 2451545.0) + ut1["fraction"]
    f = ut1["day"] - F.floor(ut1["day"]) + ut1["fraction"]
    return wrap_positive((f + F.lit(0.7790572732640) + t * 0.00273781191135448) * TAU)


def gmst(ut1: Column, tt: Column | None = None) -> Column:
    """Greenwich mean sidereal time, IAU 2006."""
    tt = ut1 if tt is None else tt
    t = ((tt["day"] - 2451545.0) + tt["fraction"]) / 36525
    p = horner(t, [0.014506, 4612.156534, 1.3915817, -0.00000044, -0.000029956, -0.0000000368])
    return wrap_positive(earth_rotation_angle(ut1) + p * F.lit(math.pi / 648000))


def obliquity(tt: Column) -> Column:
    """Mean obliquity, IAU 2006."""
    t = ((tt["day"] - 2451545.0) + tt["fraction"]) / 36525
    return horner(t, [84381.406, -46.836769, -0.0001831, 0.00200340, -0.000000576, -0.0000000434]) * F.lit(math.pi / 648000)


def interpolate_eop(points, eop, key: str = "mjd", value: str = "ut1_utc"):
    """`points` with the Earth-orientation value at their MJD, linear between days, held beyond the table's ends.

    The table has one row a day, so the bracketing rows are found by an equi-join on the whole day; a gap gives null.
    """
    low, high = eop.agg(F.min(key)).scalar(), eop.agg(F.max(key)).scalar()
    at = points.withColumn("_t", F.least(F.greatest(F.col(key), low), high)).withColumn("_day", F.floor("_t"))
    a = eop.select(F.floor(key).alias("_day"), F.col(value).alias("_a"))
    b = eop.select((F.floor(key) - 1).alias("_day"), F.col(value).alias("_b"))
    f = F.col("_t") - F.col("_day")
    return at.join(a, "_day", "left").join(b, "_day", "left").withColumn(value, F.when(f == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * f)).drop("_t", "_day", "_a", "_b")


# ---- civil dates ----------------------------------------------------------------------------------------------------


def add(ts, amount, unit: str) -> Column:
    """A timestamp moved by an amount of years, months, days, hours, minutes, seconds or milliseconds; months clamp."""
    t = col(ts)
    if unit in ("year", "month"):
        n = col(amount) * (12 if unit == "year" else 1)
        return t + F.make_ym_interval(F.lit(0), n.cast("int"))
    ms = {"day": 86400000, "hour": 3600000, "minute": 60000, "second": 1000, "millisecond": 1}[unit]
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (col(amount) * ms / 1000).cast("decimal(18,6)"))


def start_of_day(ts) -> Column:
    return F.date_trunc("day", col(ts))


def end_of_day(ts) -> Column:
    return F.date_trunc("day", col(ts)) + F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND")


def days_in_month(ts) -> Column:
    return F.dayofmonth(F.last_day(col(ts)))


def day_of_week(ts) -> Column:
    """0 for Sunday."""
    return F.dayofweek(col(ts)) - 1


#: Format letters of `YYYY-MM-DD HH:mm:ss.SSS` style patterns and the engine's.
_TOKENS = (("YYYY", "yyyy"), ("DD", "dd"), ("SSS", "SSS"))


def format_timestamp(ts, pattern: str = "YYYY-MM-DD HH:mm:ss.SSS", offset_minutes: int = 0) -> Column:
    for a, b in _TOKENS:
        pattern = pattern.replace(a, b)
    return F.date_format(add(ts, offset_minutes, "minute") if offset_minutes else col(ts), pattern)


def parse_timestamp(text, pattern: str = "YYYY-MM-DD HH:mm:ss.SSS") -> Column:
    for a, b in _TOKENS:
        pattern = pattern.replace(a, b)
    return F.try_to_timestamp(col(text), F.lit(pattern))

"""Scalar functions: arithmetic, angles, text, time, frames, projections and planning formulas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vesperflow.functions import angles, formulas, mathx, sphere
from vesperflow.functions import time as times
from vesperflow.plans.common import SKY, lit, query, r, sky
from vesperflow.session import table


@query("""SELECT o_orderkey id, CAST((((o_orderkey % 17 - 8) % 5) + 5) % 5 AS BIGINT) pm, round(least(greatest(o_totalprice / 99991.0E0, 1), 4), 6) cl, round(o_totalprice / 99991.0E0 - floor(o_totalprice / 99991.0E0), 6) fr, round(2 + 3 * (o_totalprice / 499979.0E0), 6) le,
round(CASE WHEN o_totalprice <= 1e5 THEN 0 WHEN o_totalprice >= 399993 THEN 1 ELSE pow((o_totalprice - 1e5) / 299993.0E0, 2) * (3 - 2 * (o_totalprice - 1e5) / 299993.0E0) END, 6) sm, sign(o_orderkey % 9 - 4) * floor(abs((o_orderkey % 9 - 4) * 0.5E0) + 0.5E0) rw, CAST(((o_orderkey + 128) % 256) - 128 AS BIGINT) s8 FROM orders""")
def math_scalar(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), mathx.pmod(F.pmod(k, F.lit(17)) - 8, F.lit(-5)).alias("pm"), r(mathx.clamp(p / 99991.0, 1.0, 4.0)).alias("cl"), r(mathx.fract(p / 99991.0)).alias("fr"), r(mathx.lerp(2.0, 5.0, p / 499979.0)).alias("le"),
        r(mathx.smoothstep(1e5, 399993.0, p)).alias("sm"), mathx.round_whole((F.pmod(k, F.lit(9)) - 4) * 0.5).alias("rw"), mathx.signed(k, 8).alias("s8"))


def _sexagesimal(x: str, digits: int) -> str:
    s = 10**digits
    u = f"CAST(floor(abs({x}) * {3600 * s} + 0.5E0) AS BIGINT)"
    return f"""CASE WHEN {x} < 0 AND {u} > 0 THEN '-' ELSE '+' END || lpad(CAST({u} // {3600 * s} AS VARCHAR), 2, '0') || ':' || lpad(CAST(({u} // {60 * s}) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({u} % {60 * s}) // {s} AS VARCHAR), 2, '0') || '.' || lpad(CAST({u} % {s} AS VARCHAR), {digits}, '0')"""


@query(f"WITH {SKY} SELECT id, {_sexagesimal(f'(decl * {lit(180 / math.pi)})', 1)} dec_text, {_sexagesimal(f'(ra * {lit(12 / math.pi)})', 2)} ra_text FROM sky")
def angle_format_sexagesimal(spark, sf_dir):
    return sky(spark, sf_dir).select("id", angles.format_sexagesimal("decl").alias("dec_text"), angles.format_sexagesimal("ra", hours=True, digits=2).alias("ra_text"))


@query("""SELECT o_orderkey id, round((CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 90 + (o_orderkey % 60) / 60.0E0 + (o_orderkey % 59 + 0.5E0) / 3600) * 0.017453292519943295E0, 9) a,
round((o_orderkey % 24 + (o_orderkey % 60) / 60.0E0) * 15 * 0.017453292519943295E0, 9) b FROM orders""")
def angle_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    d, m, s, h = (F.pmod(k, F.lit(n)).cast("string") for n in (90, 60, 59, 24))
    a = F.concat(F.when(k % 2 == 0, "-").otherwise("+"), d, F.lit(" "), m, F.lit(" "), s, F.lit(".5"))
    b = F.concat(h, F.lit("h"), m, F.lit("m"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), r(angles.parse(a), 9).alias("a"), r(angles.parse(b), 9).alias("b"))


@query(f"""SELECT o_orderkey id, round(o_totalprice / 1000 * {lit(angles.PARSEC_AU)}, 3) pc, round(o_totalprice / 149597870.7E0, 9) km, round(o_totalprice / 1000 * 86400 / 149597870.7E0, 9) kms, round((o_totalprice / 1000 - 32) / 1.8E0, 6) fahr, round(o_totalprice / 1000 * {lit(math.pi / 648000)}, 9) arcsec,
round(1013.25E0 * pow(1 - 0.0065E0 * (o_totalprice / 100) / (288.15E0 + 0.0065E0 * (o_totalprice / 100)), 5.257E0), 4) hpa FROM orders""")
def units_convert(spark, sf_dir):
    v = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), r(angles.parsec(v), 3).alias("pc"), r(angles.kilometer("o_totalprice"), 9).alias("km"), r(angles.km_per_second(v), 9).alias("kms"), r(angles.fahrenheit(v)).alias("fahr"), r(angles.from_unit(v, "arcsec"), 9).alias("arcsec"), r(angles.pressure_at(F.col("o_totalprice") / 100), 4).alias("hpa"))


@query(f"""SELECT event_id, 2400000.5E0 + datediff('day', DATE '1858-11-17', CAST(ts AS DATE)) AS day, round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400e6, 9) fraction,
round(((datediff('day', DATE '1858-11-17', CAST(ts AS DATE)) - 51544.5E0) + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400e6), 6) since, 37.0E0 leap FROM events""")
def julian_date_parts(spark, sf_dir):
    t = times.from_timestamp("ts")
    return table(spark, sf_dir, "events").withColumn("t", t).select("event_id", F.col("t.day").alias("day"), r("t.fraction", 9).alias("fraction"), r(times.difference(F.col("t"), F.struct(F.lit(2451545.0).alias("day"), F.lit(0.0).alias("fraction")))).alias("since"), times.tai_minus_utc(times.mjd(F.col("t"))).alias("leap"))


def _delta_sql(y: str) -> str:
    def poly(c, u):
        out = lit(c[-1])
        for k in reversed(c[:-1]):
            out = f"({out} * {u} + {lit(k)})"
        return out

    arms = " ".join(f"WHEN {y} < {last} THEN {poly(c, f'(({y} - {origin}) / {lit(unit)})')}" for last, origin, unit, c in times.DELTA_T)
    p = f"(32 * pow(({y} - 1820) / 100.0E0, 2) - 20)"
    return f"CASE {arms} WHEN {y} < 2150 THEN {p} - 0.5628E0 * (2150 - {y}) ELSE {p} END"


@query(f"SELECT o_orderkey id, round({_delta_sql('yr')}, 3) dt FROM (SELECT o_orderkey, (o_orderkey * 7919) % 4000 - 1000 + 0.25E0 yr FROM orders)")
def delta_t_piecewise(spark, sf_dir):
    y = F.pmod(F.col("o_orderkey") * 7919, F.lit(4000)) - 1000 + F.lit(0.25)
    return table(spark, sf_dir, "orders").withColumn("yr", y).select(F.col("o_orderkey").alias("id"), r(times.delta_t("yr"), 3).alias("dt"))


_ERA = "(0.7790572732640E0 + 1.00273781191135448E0 * d)"


@query(f"""WITH t AS (SELECT event_id, datediff('day', DATE '2000-01-01', CAST(ts AS DATE)) - 0.5E0 d0, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400e6 f FROM events),
e AS (SELECT event_id, (0.5E0 + f + 0.7790572732640E0 + (d0 + f) * 0.00273781191135448E0) turns, (d0 + f) / 36525 c FROM t), g AS (SELECT event_id, (turns - floor(turns)) * {lit(2 * math.pi)} + (0.014506E0 + c * (4612.156534E0 + c * (1.3915817E0 + c * (-0.00000044E0 + c * (-0.000029956E0 + c * -0.0000000368E0))))) * {lit(math.pi / 648000)} a FROM e)
SELECT event_id, round(a - floor(a / {lit(2 * math.pi)}) * {lit(2 * math.pi)}, 8) gmst FROM g""")
def gmst(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", times.from_timestamp("ts"))
    return e.select("event_id", r(times.gmst(F.col("t")), 8).alias("gmst"))


@query("""SELECT o_orderkey id, o_orderdate + to_months(CAST(o_orderkey % 30 AS INTEGER)) plus_months, o_orderdate + to_days(CAST(o_orderkey % 50 AS INTEGER)) plus_days, CAST(day(last_day(o_orderdate)) AS INTEGER) month_days, CAST(dayofweek(o_orderdate) AS INTEGER) weekday,
(year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 leap, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.000') txt, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / CASE WHEN year(o_orderdate) % 4 = 0 THEN 366.0E0 ELSE 365.0E0 END, 9) yr FROM orders""")
def civil_date_ops(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), times.add(d, F.pmod("o_orderkey", F.lit(30)), "month").alias("plus_months"), times.add(d, F.pmod("o_orderkey", F.lit(50)), "day").alias("plus_days"), times.days_in_month(d).alias("month_days"),
        times.day_of_week(d).alias("weekday"), times.is_leap(F.year(d)).alias("leap"), times.format_timestamp(d).alias("txt"), r(times.decimal_year(d), 9).alias("yr"))


_LAT = 0.6


@query(f"""WITH {SKY}, h AS (SELECT *, (id % 628) / 100.0E0 - ra h FROM sky), c AS (SELECT *, {lit(math.cos(_LAT))} * sin(decl) - {lit(math.sin(_LAT))} * cos(decl) * cos(h) x, -cos(decl) * sin(h) y FROM h)
SELECT id, round(atan2(y, x) - floor(atan2(y, x) / {lit(2 * math.pi)}) * {lit(2 * math.pi)}, 7) az, round(asin({lit(math.sin(_LAT))} * sin(decl) + {lit(math.cos(_LAT))} * cos(decl) * cos(h)), 7) alt FROM c""")
def equatorial_to_horizontal(spark, sf_dir):
    az, alt = sphere.to_horizontal("ra", "decl", F.lit(_LAT), F.pmod("id", F.lit(628)) / 100.0)
    return sky(spark, sf_dir).select("id", r(az, 7).alias("az"), r(alt, 7).alias("alt"))


def _rotated(m, a: str, b: str) -> str:
    v = ("cos(decl) * cos(ra)", "cos(decl) * sin(ra)", "sin(decl)")
    x, y, z = (" + ".join(f"{v[j]} * {lit(row[j])}" for j in range(3)) for row in m)
    return f"round(atan2({y}, {x}) - floor(atan2({y}, {x}) / {lit(2 * math.pi)}) * {lit(2 * math.pi)}, 7) {a}, round(atan2({z}, sqrt(({x}) * ({x}) + ({y}) * ({y}))), 7) {b}"


@query(f"WITH {SKY} SELECT id, {_rotated(sphere.GALACTIC, 'l', 'b')}, {_rotated(sphere._about_x(sphere.OBLIQUITY), 'lon', 'lat')}, {_rotated(sphere.precession_matrix(2460000.5), 'ra_now', 'dec_now')} FROM sky")
def frame_rotations(spark, sf_dir):
    g, e, p = sphere.to_galactic("ra", "decl"), sphere.to_ecliptic("ra", "decl"), sphere.precess("ra", "decl", 2460000.5)
    return sky(spark, sf_dir).select("id", *(r(c, 7).alias(n) for c, n in zip((*g, *e, *p), ("l", "b", "lon", "lat", "ra_now", "dec_now"), strict=True)))


@query(f"""WITH {SKY}, s AS (SELECT *, cos(decl) * sin(ra - 1) x, {lit(math.cos(0.3))} * sin(decl) - {lit(math.sin(0.3))} * cos(decl) * cos(ra - 1) y, {lit(math.sin(0.3))} * sin(decl) + {lit(math.cos(0.3))} * cos(decl) * cos(ra - 1) z FROM sky)
SELECT id, round(atan2(sqrt(x * x + y * y), z), 8) sep, round(atan2(x, y) - floor(atan2(x, y) / {lit(2 * math.pi)}) * {lit(2 * math.pi)}, 7) pa FROM s""")
def sphere_separation_angle(spark, sf_dir):
    one, d = F.lit(1.0), F.lit(0.3)
    return sky(spark, sf_dir).select("id", r(sphere.separation(one, d, "ra", "decl"), 8).alias("sep"), r(sphere.position_angle(one, d, "ra", "decl"), 7).alias("pa"))


@query(f"""WITH {SKY}, s AS (SELECT *, cos(decl) * sin(ra - 2) x, sin(decl) * {lit(math.cos(0.4))} - cos(decl) * {lit(math.sin(0.4))} * cos(ra - 2) y, sin(decl) * {lit(math.sin(0.4))} + cos(decl) * {lit(math.cos(0.4))} * cos(ra - 2) c FROM sky)
SELECT id, round(CASE WHEN c > 0.05 THEN x / c END, 6) gx, round(CASE WHEN c > 0.05 THEN y / c END, 6) gy, round(CASE WHEN c > -0.9 THEN x * 2 / (1 + c) END, 6) sx, round(CASE WHEN c >= 0 THEN x END, 6) ox, round(CASE WHEN c > -0.9 THEN y * sqrt(2 / (1 + c)) END, 6) ly FROM s""")
def project_azimuthal(spark, sf_dir):
    s = sky(spark, sf_dir)
    c = F.sin("decl") * math.sin(0.4) + F.cos("decl") * math.cos(0.4) * F.cos(F.col("ra") - 2.0)
    g, st, o, la = (f("ra", "decl", 2.0, 0.4) for f in (sphere.gnomonic, sphere.stereographic, sphere.orthographic, sphere.azimuthal_equal_area))
    return s.select("id", r(F.when(c > 0.05, g[0])).alias("gx"), r(F.when(c > 0.05, g[1])).alias("gy"), r(F.when(c > -0.9, st[0])).alias("sx"), r(o[0]).alias("ox"), r(F.when(c > -0.9, la[1])).alias("ly"))


_W = f"((ra - 2) - {lit(2 * math.pi)} * ceil((ra - 2 - {lit(math.pi)}) / {lit(2 * math.pi)}))"


@query(f"""WITH {SKY} SELECT id, round({_W}, 6) mx, round(CASE WHEN abs(decl) < 1.5 THEN ln(tan(decl / 2 + {lit(math.pi / 4)})) END, 6) my, round({_W} * cos(decl), 6) sx, round(1.25E0 * ln(tan(0.4E0 * decl + {lit(math.pi / 4)})), 6) miller,
round(2 * cos(decl) * sin({_W} / 2) * sqrt(2 / (1 + cos(decl) * cos({_W} / 2))), 5) hx FROM sky""")
def project_cylindrical(spark, sf_dir):
    m = sphere.mercator("ra", "decl", 2.0)
    return sky(spark, sf_dir).select("id", r(sphere.plate_carree("ra", "decl", 2.0)[0]).alias("mx"), r(F.when(F.abs("decl") < 1.5, m[1])).alias("my"), r(sphere.sinusoidal("ra", "decl", 2.0)[0]).alias("sx"), r(sphere.miller("ra", "decl", 2.0)[1]).alias("miller"), r(sphere.hammer("ra", "decl", 2.0)[0], 5).alias("hx"))


@query("""SELECT l_orderkey id, l_linenumber line, round(1 / cos(l_quantity / 40), 6) am, round(1 / (sin(l_quantity / 40) + 0.50572E0 * pow(l_quantity / 40 * 57.29577951308232E0 + 6.07995E0, -1.6364E0)), 6) ky, round(l_extendedprice / sqrt(l_extendedprice + l_quantity * (4 + l_tax + 9)), 6) snr,
round(206264.80624709636E0 / 1000 * 3.76E0 / l_quantity, 6) scale_, round(1.25E0 * log10(l_quantity), 6) gain, round(1.02E0 / tan((l_quantity / 40 * 57.29577951308232E0 + 10.3E0 / (l_quantity / 40 * 57.29577951308232E0 + 5.11E0)) * 0.017453292519943295E0), 6) refr,
round(243.04E0 * (17.625E0 * (l_quantity - 20) / (243.04E0 + (l_quantity - 20)) + ln(0.6E0)) / (17.625E0 - (17.625E0 * (l_quantity - 20) / (243.04E0 + (l_quantity - 20)) + ln(0.6E0))), 6) dew FROM lineitem""")
def airmass_snr_formulas(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), r(formulas.airmass(q / 40)).alias("am"), r(formulas.airmass_kasten_young(q / 40)).alias("ky"), r(formulas.snr("l_extendedprice", q, F.lit(4.0), "l_tax", F.lit(3.0))).alias("snr"),
        r(formulas.pixel_scale(F.lit(3.76), q)).alias("scale_"), r(formulas.stacking_magnitude_gain(q)).alias("gain"), r(formulas.refraction(q / 40)).alias("refr"), r(formulas.dew_point(q - 20, F.lit(60.0))).alias("dew"))


@query(f"""WITH t AS (SELECT CAST(c_nationkey AS INTEGER) grp, c_custkey k, ((c_custkey * 7919) % 1000) / 500.0E0 a, ((c_custkey * 104729) % 997) / 1000.0E0 d FROM customer), e AS (SELECT grp, a, d, coalesce(lead(a) OVER w, first_value(a) OVER (PARTITION BY grp ORDER BY k)) a2, coalesce(lead(d) OVER w, first_value(d) OVER (PARTITION BY grp ORDER BY k)) d2 FROM t WINDOW w AS (PARTITION BY grp ORDER BY k))
SELECT grp, round(sum(2 * atan(tan((a2 - a) / 2) * (tan(d / 2) + tan(d2 / 2)) / (1 + tan(d / 2) * tan(d2 / 2)))), 6) area FROM e GROUP BY 1""")
def spherical_polygon_area(spark, sf_dir):
    """The signed area of a ring of vertices, by edges to the equator."""
    from pyspark.sql import Window

    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), k, (F.pmod(k * 7919, F.lit(1000)) / 500.0).alias("a"), (F.pmod(k * 104729, F.lit(997)) / 1000.0).alias("d"))
    w = Window.partitionBy("grp").orderBy("c_custkey")
    t = t.withColumn("a2", F.coalesce(F.lead("a").over(w), F.first("a").over(w))).withColumn("d2", F.coalesce(F.lead("d").over(w), F.first("d").over(w)))
    return t.groupBy("grp").agg(r(F.sum(sphere.edge_excess("a", "d", "a2", "d2"))).alias("area"))


@query("""WITH p AS (SELECT r, c, CASE WHEN r % 2 = 1 THEN 5 - c ELSE c END cc FROM range(4) t(r), range(6) u(c)) SELECT CAST(r * 6 + c AS INTEGER) panel, round((cc - 2.5E0) * 1.5E0 * 0.8E0, 6) x, round((r - 1.5E0) * 1.0E0 * 0.8E0, 6) y FROM p""")
def mosaic_panels(spark, sf_dir):
    from vesperflow.operators.mosaic import plan

    return plan(spark, 6, 4, 1.5, 1.0, 0.2, serpentine=True).select("panel", r("x").alias("x"), r("y").alias("y"))

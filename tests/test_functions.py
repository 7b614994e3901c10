import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vesperflow.functions import angles, formulas, mathx, sphere, wcs
from vesperflow.functions import time as times

D = math.pi / 180


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_arithmetic_edges(spark):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    r = one(spark, mathx.pmod(F.lit(-1), F.lit(-3)), mathx.clamp(nan, 1.0, 2.0), mathx.round_whole(F.lit(-2.5)), mathx.signed(F.lit(200), 8), mathx.finite(inf), mathx.fmod(F.lit(-0.5), 2.0), mathx.round_decimals(F.lit(1.005), 2), mathx.smoothstep(0.0, 1.0, F.lit(0.5)))
    assert tuple(r) == (2, 1.0, -3.0, -56, None, 1.5, 1.01, 0.5)
    s = one(spark, mathx.two_sum(F.lit(1.0), F.lit(1e-20)), mathx.two_product(F.lit(134217729.0), F.lit(134217729.0)))
    assert s.c0.error == 1e-20 and int(s.c1.product) + int(s.c1.error) == 134217729**2
    with pytest.raises(Exception, match="positive"):
        one(spark, mathx.require_positive(F.lit(-1.0)))


@settings(max_examples=25, deadline=None)
@given(st.floats(-1.5, 1.5))
def test_sexagesimal_round_trips(spark, v):
    t = angles.format_sexagesimal(F.lit(v), digits=4)
    assert abs(one(spark, angles.parse(t)).c0 - v) < 1e-9


def test_angle_text(spark):
    r = one(spark, angles.format_sexagesimal(F.lit((5 + 59 / 60 + 59.96 / 3600) * D)), angles.parse(F.lit("-00 30 00")), angles.parse(F.lit("05h35m16.8s")), angles.parse(F.lit("x")), angles.dms(F.lit(-0.0), F.lit(30), F.lit(0)), angles.wrap_signed(F.lit(-math.pi)))
    assert r.c0 == "+06:00:00.0" and abs(r.c1 + 0.5 * D) < 1e-15 and abs(r.c2 - (5 + 35 / 60 + 16.8 / 3600) * 15 * D) < 1e-12 and r.c3 is None and abs(r.c4 + 0.5 * D) < 1e-15 and abs(r.c5 - math.pi) < 1e-15


def test_time_scales(spark):
    t = times.from_timestamp(F.lit("2017-01-01 12:00:00").cast("timestamp_ntz"))
    tt = times.tai_to_tt(times.utc_to_tai(t))
    back = times.tai_to_utc(times.tt_to_tai(tt))
    r = one(spark, t, times.difference(tt, t) * 86400, times.difference(back, t) * 86400, times.gmst(times.time(F.lit(2446895.5), F.lit(0.0))), times.delta_t(F.lit(2000.0)), times.delta_t(F.lit(1700.0)), times.delta_t(F.lit(-600.0)), times.obliquity(times.time(F.lit(2451545.0), F.lit(0.0))))
    assert (r.c0.day, r.c0.fraction) == (2457754.5, 0.5)
    assert abs(r.c1 - 69.184) < 1e-6 and abs(r.c2) < 1e-9
    assert abs(r.c3 * 12 / math.pi - (13 + 10 / 60 + 46.3668 / 3600)) < 2e-6  # a textbook value of 1987 April 10
    assert abs(r.c4 - 63.86) < 1.0 and abs(r.c5 - 8.83) < 1e-9 and abs(r.c6 - (-20 + 32 * 24.2**2)) < 1e-9
    assert abs(r.c7 - 84381.406 / 3600 * D) < 1e-12


def test_earth_orientation_holds_at_the_ends(spark):
    eop = spark.createDataFrame([(100.0, 1.0), (101.0, 3.0), (102.0, 2.0)], "mjd double, ut1_utc double")
    at = spark.createDataFrame([(99.0,), (100.0,), (100.25,), (101.5,), (102.0,), (105.0,)], "mjd double")
    got = [r.ut1_utc for r in times.interpolate_eop(at, eop).orderBy("mjd").collect()]
    assert got == [1.0, 1.0, 1.5, 2.5, 2.0, 2.0]


def test_frames_round_trip(spark):
    a, d = F.lit(1.2), F.lit(-0.4)
    g = sphere.from_galactic(*sphere.to_galactic(a, d))
    e = sphere.from_ecliptic(*sphere.to_ecliptic(a, d))
    h = sphere.from_horizontal(*sphere.to_horizontal(a, d, F.lit(0.7), F.lit(2.0)), F.lit(0.7), F.lit(2.0))
    p = sphere.destination(a, d, sphere.position_angle(a, d, F.lit(2.0), F.lit(0.3)), sphere.separation(a, d, F.lit(2.0), F.lit(0.3)))
    r = one(spark, *g, *e, *h, *p, *sphere.to_galactic(F.lit(192.85948 * D), F.lit(27.12825 * D)))
    assert [round(x, 9) for x in r[:6]] == [1.2, -0.4] * 3 and [round(x, 9) for x in r[6:8]] == [2.0, 0.3]
    assert abs(r[9] - math.pi / 2) < 1e-5  # the galactic pole


def test_projections_invert_and_hide(spark):
    r = one(spark, *sphere.gnomonic_inverse(*sphere.gnomonic(F.lit(1.1), F.lit(0.3), 1.0, 0.2), 1.0, 0.2), *sphere.mercator_inverse(*sphere.mercator(F.lit(1.1), F.lit(0.3), 1.0), 1.0), sphere.gnomonic(F.lit(4.2), F.lit(0.0), 1.0, 0.0)[0], sphere.orthographic(F.lit(4.2), F.lit(0.0), 1.0, 0.0)[0], sphere.azimuthal_equidistant(F.lit(1.0), F.lit(0.5), 1.0, 0.0)[1])
    assert [round(x, 9) for x in r[:4]] == [1.1, 0.3, 1.1, 0.3] and r[4] is None and r[5] is None and abs(r[6] - 0.5) < 1e-12
    assert all(len(one(spark, *f(F.lit(0.3), F.lit(0.2)))) == 2 for f in sphere.PROJECTIONS.values())


def test_wcs_round_trips(spark):
    h = {"CRPIX1": 512.0, "CRPIX2": 400.0, "CRVAL1": 83.8, "CRVAL2": -5.4, "CD1_1": -4e-4, "CD1_2": 1e-5, "CD2_1": 1e-5, "CD2_2": 4e-4}
    w = wcs.Tan.from_header(h)
    r = one(spark, *w.to_sky(F.lit(512.0), F.lit(400.0)), *w.to_pixel(*w.to_sky(F.lit(100.0), F.lit(900.0))))
    assert abs(r[0] - 83.8 * D) < 1e-12 and abs(r[1] + 5.4 * D) < 1e-12 and abs(r[2] - 100) < 1e-6 and abs(r[3] - 900) < 1e-6
    bent = wcs.Tan.from_header(h | {"A_2_0": 1e-6, "AP_2_0": -1e-6})
    assert abs(one(spark, *bent.to_sky(F.lit(0.0), F.lit(0.0)))[0] - one(spark, *w.to_sky(F.lit(0.0), F.lit(0.0)))[0]) > 1e-7


def test_formulas_have_domains(spark):
    r = one(spark, formulas.magnification(F.lit(1000.0), F.lit(10.0)), formulas.dawes_limit(F.lit(-1.0)), formulas.pixel_scale(F.lit(3.76), F.lit(1000.0)), formulas.airmass(F.lit(1.6)), formulas.dew_point(F.lit(20.0), F.lit(60.0)), formulas.relative_humidity(F.lit(20.0), formulas.dew_point(F.lit(20.0), F.lit(60.0))), formulas.mosaic_panels(F.lit(10.0), F.lit(3.0), F.lit(0.1)), formulas.hour_angle_at(F.lit(1.5), F.lit(1.0), F.lit(0.0)), formulas.hg_magnitude(F.lit(3.0), F.lit(0.15), F.lit(1.0), F.lit(1.0), F.lit(0.0)))
    assert r.c0 == 100 and r.c1 is None and abs(r.c2 - 0.77556) < 1e-4 and r.c3 is None and abs(r.c4 - 12.0) < 0.05 and abs(r.c5 - 60) < 1e-9 and r.c6 == 4 and r.c7 is None and abs(r.c8 - 3) < 1e-12


def test_apparent_places_of_the_textbook(spark):
    from vesperflow.functions import apparent

    # Meeus, chapters 22 and 23: 1987 April 10 nutation -3.788", +9.443"; Theta Persei on 2028 November 13.19
    t = (2446895.5 - 2451545.0) / 36525
    n = spark.range(1).select(apparent.nutation(F.lit(t)).alias("n")).first().n
    assert abs(n.longitude * 206264.806 + 3.788) < 0.5 and abs(n.obliquity * 206264.806 - 9.443) < 0.1
    t = (2462088.69 - 2451545.0) / 36525
    ra, dec = math.radians(41.54714), math.radians(49.34848)
    p = spark.range(1).select(apparent.apparent_place(F.lit(ra), F.lit(dec), F.lit(t), F.lit(math.radians(23.436))).alias("p")).first().p
    assert abs((p.ra - ra) * 206264.806 - (15.843 + 30.045)) < 1.5 and abs((p.decl - dec) * 206264.806 - (6.218 + 6.697)) < 1.0
    when = spark.range(1).select(times.from_mjd(F.lit(46895.0)).alias("u"))  # 0h: apparent 13h 10m 46.1351s
    g = when.select(apparent.gast(F.col("u")).alias("g"), times.gmst(F.col("u")).alias("m")).first()
    assert abs(g.g - g.m - (-0.2317 * 15 / 206264.806)) < 0.03 * 15 / 206264.806


def test_seasons_of_the_textbook(spark):
    from vesperflow.functions import apparent

    # Meeus, example 27.a: the June solstice of 1962
    assert abs(spark.range(1).select(apparent.season_jd(F.lit(1962), F.lit(1)).alias("j")).first().j - 2437837.39245) < 2e-4

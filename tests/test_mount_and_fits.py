import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesperflow.functions import bodies
from vesperflow.operators import eclipses, mount, optimize, orbits

D = math.pi / 180


def test_eclipses_of_known_lunations(spark):
    e = eclipses.eclipses(np.array([-82.0, 118.0, -328.5, -28.5, 117.0]))
    got = {r.k: r for r in e.itertuples()}
    assert 117.0 not in got
    assert got[-82.0].kind == "partial" and abs(got[-82.0].jd - 2449129.0978) < 1e-3 and abs(got[-82.0].gamma - 1.1348) < 2e-4 and abs(got[-82.0].magnitude - 0.740) < 1e-3
    assert got[118.0].kind == "total" and abs(got[118.0].jd - 2455034.6088) < 1e-3 and abs(got[118.0].gamma - 0.0695) < 2e-4
    assert got[-328.5].body == "moon" and got[-328.5].kind == "penumbral" and abs(got[-328.5].jd - 2441849.3687) < 1e-3 and abs(got[-328.5].magnitude - 0.4625) < 2e-3
    assert got[-28.5].kind == "total" and abs(got[-28.5].jd - 2450708.2835) < 1e-3 and abs(got[-28.5].magnitude - 1.1868) < 2e-3
    n = eclipses.eclipse_table(spark, 0, 124).groupBy("body").count().collect()
    assert {r.body: 15 < r["count"] < 30 for r in n} == {"sun": True, "moon": True}


def test_star_motion_and_magnitudes(spark):
    # Barnard's star: 10.4 arcseconds a year
    s = bodies.space_motion(F.lit(269.452 * D), F.lit(4.693 * D), F.lit(-802.8), F.lit(10362.5), F.lit(547.45), F.lit(-110.5), F.lit(100.0))
    r = spark.range(1).select(s.alias("s"), bodies.space_motion(F.lit(1.0), F.lit(0.5), F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(100.0)).alias("t"), bodies.planet_magnitude("mars", F.lit(1.5), F.lit(0.5), F.lit(0.0)).alias("m"), bodies.phase_angle(F.lit(1.5), F.lit(0.5), F.lit(1.0)).alias("p"), bodies.illuminated(F.lit(math.pi)).alias("i")).first()
    assert abs((r.s.decl / D - 4.693) * 3600 - 1041) < 5 and r.s.parallax > 547.45
    assert abs(r.t.ra - 1.0) < 1e-9 and abs(r.t.decl - 0.5) < 1e-9
    assert abs(r.m - (-1.52 + 5 * math.log10(0.75))) < 1e-12 and abs(r.p) < 1e-6 and r.i == 0


def test_grid_labels(spark):
    t = 2 * math.pi
    grid = spark.createDataFrame([(0.0, t, -2.0, "south"), (0.0, t / 2, 0.0, "near"), (t / 2, t, 0.5, "far"), (0.0, t, 1.4, "pole")], "ra_low double, ra_high double, dec_low double, label string")
    stars = spark.createDataFrame([(1, 1.0, 0.3), (2, 4.0, 0.3), (3, 4.0, 0.9), (4, 2.0, 1.55), (5, 1.0, -1.0)], "id int, ra double, decl double")
    assert {r.id: r.constellation for r in bodies.constellation(stars, grid).collect()} == {1: "near", 2: "south", 3: "far", 4: "pole", 5: "south"}


def test_polar_alignment_and_decisions(spark):
    for lat, (ea, eh) in ((0.8, (0.01, -0.02)), (-0.6, (0.0, 0.01))):
        a, h = (ea if lat > 0 else math.pi + ea), abs(lat) + eh
        axis = np.array([math.cos(h) * math.cos(a), math.cos(h) * math.sin(a), math.sin(h)])
        u = np.cross(axis, [0, 0, 1.0])
        u /= np.linalg.norm(u)
        w = np.cross(axis, u)
        v = [math.cos(0.5) * axis + math.sin(0.5) * (math.cos(x) * u + math.sin(x) * w) for x in (0.1, 0.7, 1.5)]
        got = mount.polar_error([(math.atan2(p[1], p[0]), math.asin(p[2])) for p in v], lat)
        assert abs(got[0] - ea) < 1e-9 and abs(got[1] - eh) < 1e-9
    with pytest.raises(ValueError):
        mount.axis_of_three([(0.0, 0.5)] * 3)
    rows = spark.createDataFrame([(-1.0, False), (0.05, False), (0.2, False), (0.7, False), (0.7, True)], "h double, f boolean")
    got = [r.d for r in rows.select("h", "f", mount.flip_decision("h", "f").alias("d")).orderBy("h", "f").collect()]
    assert got == ["none", "wait", "flip", "stop", "none"]
    z = spark.range(1).select(mount.dome_azimuth(F.lit(1.0), F.lit(0.5), radius=3.0).alias("a"), mount.dome_azimuth(F.lit(0.0), F.lit(0.0), radius=2.0, east=1.0).alias("b"), mount.pier_side(F.lit(-0.1)).alias("s")).first()
    assert abs(z.a - 1.0) < 1e-12 and abs(z.b - math.asin(0.5)) < 1e-12 and z.s == "west"


def test_sensor_fits(spark):
    p = spark.createDataFrame([(0, float(m), 4.0 + m / 2.5, m / 100.0) for m in range(100, 5000, 100)], "plane int, mean double, variance double, exposure double")
    r = mount.photon_transfer(p, ["plane"], 0, 4000).first()
    assert abs(r.gain - 2.5) < 1e-9 and abs(r.read_noise - 5.0) < 1e-6
    assert mount.linearity(p, ["plane"]).first().error < 1e-9 and abs(mount.dark_current(p, ["plane"], 2.0).first().rate - 200) < 1e-6


def test_minimisers():
    rosen = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    assert np.abs(optimize.simplex_minimum(rosen, np.array([-1.2, 1.0])) - 1).max() < 1e-4
    assert np.abs(optimize.levenberg_marquardt(lambda x: np.array([1 - x[0], 10 * (x[1] - x[0] ** 2)]), np.array([-1.2, 1.0])) - 1).max() < 1e-6
    assert abs(optimize.golden_minimum(lambda x: (x - 0.3) ** 2, 0, 1) - 0.3) < 1e-6
    x = np.linspace(0, 100, 15)
    assert np.allclose(optimize.hyperbola_focus(x, np.sqrt(4 + (0.2 * (x - 43)) ** 2)), (43, 2, 0.2), atol=1e-4)


def test_orbit_geometry():
    assert abs(optimize.moid((1.0, 0.0, 0.0, 0.0, 0.0), (1.5, 0.0, 0.5, 1.0, 0.0)) - 0.5) < 1e-4
    assert optimize.moid((0.8, 0.3, 0.2, 1.0, 2.0), (0.8, 0.3, 0.2, 1.0, 2.0)) < 1e-4
    p, v = orbits.from_elements(*(np.array([x]) for x in (1.0, 0.2, 0.3, 0.4, 0.5)))
    c = np.diag([1e-8] * 3 + [1e-12] * 3)
    back = optimize.propagate_covariance(optimize.propagate_covariance(c, p[0], v[0], 50.0), *(x[0] for x in orbits.propagate(p, v, np.array([50.0]))), -50.0)
    assert np.abs(back - c).max() < 1e-11
    mu = 398600.4418
    q, w = np.array([1e6, 2e4, 5e3]), np.array([-5.0, 0.0, 0.0])
    bt, br, speed = optimize.b_plane(q, w, mu)
    assert abs(math.hypot(bt, br) - np.linalg.norm(np.cross(q, w)) / speed) < 1e-3 and abs(speed**2 - (25 - 2 * mu / np.linalg.norm(q))) < 1e-9


def test_sip_fit_clips_outliers(spark):
    rng = np.random.default_rng(1)
    u, v = rng.uniform(-500, 500, (2, 200))
    x = u + 1e-5 * u * u - 2e-6 * u * v
    y = v + 3e-6 * v * v
    x[:5] += 40
    df = spark.createDataFrame([("f", *map(float, r)) for r in zip(u, v, x, y, strict=True)], "frame string, u double, v double, u2 double, v2 double")
    r = optimize.fit_sip(df).first()
    assert abs(r.a["2_0"] - 1e-5) < 1e-10 and abs(r.a["1_1"] + 2e-6) < 1e-10 and abs(r.b["0_2"] - 3e-6) < 1e-10 and r.n == 195

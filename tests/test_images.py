import math

import numpy as np
from pyspark.sql import functions as F

from vesperflow.functions import splines
from vesperflow.operators import images, matching

RNG = np.random.default_rng(3)


def scene(n=25, size=240, seed=1):
    rng = np.random.default_rng(seed)
    at = []
    while len(at) < n:
        p = rng.uniform(15, size - 15, 2)
        if all(math.hypot(*(p - q)) > 18 for q in at):
            at.append(p)
    return np.column_stack([np.array(at), rng.uniform(5, 40, n)])


def table(spark, frames):
    rows = [(k, p.shape[2], p.shape[1], p.shape[0], p.transpose(1, 2, 0).ravel().tolist()) for k, p in frames.items()]
    return spark.createDataFrame(rows, "frame int, width int, height int, channels int, pixels array<double>")


def test_stars_are_found_where_they_are(spark):
    stars = scene()
    df = table(spark, {1: images.synthesize(240, 240, stars), 2: images.synthesize(240, 240, stars[:0])})
    got = images.find_stars(df, ["frame"]).collect()
    one = np.array([(r.x, r.y) for r in got if r.frame == 1])
    d = np.hypot(*(stars[:, None, :2] - one[None]).transpose(2, 0, 1))
    assert (d.min(1) < 0.5).all() and len(one) <= len(stars) + 2 and sum(r.frame == 2 for r in got) <= 2
    best = max((r for r in got if r.frame == 1), key=lambda r: r.flux)
    assert abs(best.flux - stars[:, 2].max()) < 0.15 * stars[:, 2].max() and best.hfd > 1


def test_images_map_and_change_shape(spark):
    p = RNG.random((3, 4, 5))
    r = images.map_images(table(spark, {1: p}), lambda a: a[:, ::-1, 1:]).first()
    assert (r.width, r.height, r.channels) == (4, 4, 3)
    assert np.allclose(images.planes(4, 4, 3, r.pixels), p[:, ::-1, 1:])


def test_filters_keep_what_they_should():
    flat = np.full((1, 9, 11), 3.0)
    assert np.allclose(images.convolve(flat, images.gaussian(1.5)), 3) and np.allclose(images.median_filter(flat), 3) and np.allclose(images.band_filter(flat), 3)
    p = RNG.random((2, 32, 24))
    assert np.allclose(sum(images.starlet(p, 3)), p) and np.allclose(sum(images.median_pyramid(p, 2)), p)
    assert np.allclose(images.weigh_layers(p, [1, 1, 1]), p)
    assert np.allclose(images.band_filter(p, "low") + images.band_filter(p, "high"), p)
    spot = np.zeros((1, 5, 5))
    spot[0, 2, 2] = 9
    assert images.median_filter(spot).max() == 0 and np.isclose(images.convolve(spot, np.ones((3, 3)))[0, 1, 1], 1.0)


def test_background_surface_is_recovered():
    yy, xx = np.mgrid[0:80, 0:100]
    truth = 0.1 + 0.001 * xx + 0.00001 * yy**2
    p = truth + RNG.normal(0, 0.001, truth.shape)
    p[20:24, 30:34] += 5
    assert np.abs(images.background(p[None])[0] - truth).max() < 0.003


def test_warp_and_curve():
    p = RNG.random((1, 6, 8))
    out, ok = images.warp(p, np.array([[1, 0, 2], [0, 1, 1]]))
    assert np.allclose(out[0, :5, :6], p[0, 1:, 2:]) and ok[:5, :6].all() and not ok[5].any()
    table = images.curve([(0, 0), (0.5, 0.5), (1, 1)])
    assert np.abs(images.apply_curve(p, table) - p).max() < 1e-4


def test_splines_and_generators():
    x = np.linspace(0, 3, 12)
    s = splines.natural_cubic(x, np.sin(x))
    assert np.abs(s(x) - np.sin(x)).max() < 1e-12 and abs(s(1.3) - math.sin(1.3)) < 1e-3
    h = splines.hermite(x, np.sin(x), np.cos(x))
    assert np.abs(h(np.linspace(0, 3, 50)) - np.sin(np.linspace(0, 3, 50))).max() < 1e-4
    assert abs(splines.brent_root(lambda t: math.cos(t) - t, 0, 1) - 0.7390851332151607) < 1e-12
    r = splines.mulberry32(1, 1000)
    assert r[0] == 0.6270739405881613
    assert (r == splines.mulberry32(1, 1000)).all() and ((r >= 0) & (r < 1)).all() and abs(r.mean() - 0.5) < 0.05


def test_series_are_interpolated_by_group(spark):
    t = spark.range(40).select(F.pmod("id", F.lit(2)).alias("k"), (F.col("id") / 10).alias("x"), F.sin(F.col("id") / 10).alias("y"))
    p = spark.createDataFrame([(0, 1.03), (1, 2.22), (7, 1.0)], "k long, x double")
    for kind in ("cubic", "chebyshev"):
        got = {r.k: r.y for r in splines.interpolate_groups(t, p, "k", "x", "y", kind).collect()}
        assert set(got) == {0, 1} and abs(got[0] - math.sin(1.03)) < 2e-3 and abs(got[1] - math.sin(2.22)) < 2e-3


def test_patterns_match_rotated_mirrored_frames(spark):
    ref = scene(40, 600, 5)
    rows, truth = [], {}
    for frame, (angle, scale, mirror) in enumerate([(0.4, 1.1, 1), (2.5, 0.9, -1)]):
        m = scale * np.array([[math.cos(angle), -math.sin(angle) * mirror], [math.sin(angle), math.cos(angle) * mirror]])
        moved = ref[:, :2] @ m.T + [50, -20] + np.random.default_rng(frame).normal(0, 0.2, (40, 2))
        for i in range(30):
            rows.append((frame, 100 + i, float(moved[i, 0]), float(moved[i, 1]), float(ref[i, 2])))
            truth[frame, 100 + i] = i
        rows += [(frame, 500 + k, float(x), float(y), 3.0) for k, (x, y) in enumerate(np.random.default_rng(9).uniform(0, 600, (6, 2)))]
    rows.append((2, 1, 5.0, 5.0, 1.0))
    d = spark.createDataFrame(rows, "frame int, idx long, x double, y double, flux double")
    r = spark.createDataFrame([(f, i, float(a), float(b), float(c)) for f in range(3) for i, (a, b, c) in enumerate(ref)], "frame int, idx long, x double, y double, flux double")
    got = {(x.frame, x.idx): x.r_idx for x in matching.match_frames(d, r).collect()}
    assert len(got) == len(rows)
    assert sum(got[k] == v for k, v in truth.items()) >= 58 and got[2, 1] is None

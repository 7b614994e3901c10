import math

import numpy as np
import pytest

from vesperflow.functions import healpix
from vesperflow.operators import region

D = math.pi / 180
#: A small truth table of stars in degrees.
STARS = {"box-east": (0.1, 5), "box-west": (359.9, 0), "box-outside-dec": (0, 20), "box-outside-ra": (20, 0), "cone-center": (120, 0), "cone-edge": (130, 0), "cone-outside": (130.2, 0), "polygon-inside": (220, 30), "polygon-outside": (228, 34), "triangle-inside": (102, 12), "triangle-outside": (108, 18)}


@pytest.fixture(scope="module")
def stars(spark):
    return spark.createDataFrame([(k, a * D, d * D) for k, (a, d) in STARS.items()], "id string, ra double, decl double")


def ids(df):
    return {r.id for r in df.collect()}


def test_truth_table(stars):
    assert ids(region.within(stars, region.Cone(120 * D, 0, 10 * D))) == {"cone-center", "cone-edge"}
    assert ids(region.within(stars, region.Box(359.7 * D, 0.3 * D, -0.1 * D, 10 * D))) == {"box-east", "box-west"}
    tri = ((100 * D, 10 * D), (110 * D, 10 * D), (100 * D, 20 * D))
    assert ids(region.within(stars, region.Triangle(*tri))) == ids(region.within(stars, region.Triangle(*tri, mode="spherical"))) == {"triangle-inside"}
    poly = tuple((a * D, d * D) for a, d in ((220, 25), (230, 30), (220, 35), (210, 30)))
    assert ids(region.within(stars, region.Polygon(poly))) == {"polygon-inside"}


def test_bad_regions_are_refused():
    with pytest.raises(ValueError, match="three vertices"):
        region.Polygon(((1, 1),))
    with pytest.raises(ValueError):
        region.Box(0, 1, 1, 0)
    with pytest.raises(ValueError):
        region.Cone(0, 0, 4)
    with pytest.raises(ValueError):
        region.Polygon(((0, 0), (1, 0), (0.2, 0.2), (0, 1)), mode="spherical")


@pytest.mark.parametrize(("a", "d", "r"), [(0.0, 1.5, 0.3), (6.2, -0.2, 0.4), (3.0, -1.57, 0.1), (1.0, 0.5, 3.0), (2.0, 0.0, 0.0)])
def test_cones_match_brute_force_and_covers_hold_them(spark, a, d, r):
    rng = np.random.default_rng(1)
    ra, dec = rng.uniform(0, 2 * math.pi, 3000), np.arcsin(rng.uniform(-1, 1, 3000))
    cos = np.sin(d) * np.sin(dec) + np.cos(d) * np.cos(dec) * np.cos(ra - a)
    want = set(np.flatnonzero(np.arccos(np.clip(cos, -1, 1)) <= r).tolist())
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(ra, dec, strict=True))], "id int, ra double, decl double")
    cone = region.Cone(a, d, r)
    assert ids(region.within(df, cone)) == want
    pixels = healpix.with_nested_pixel(df, "hpx", 8)
    assert ids(region.by_cover(pixels, cone, 8)) == ids(region.by_cover(pixels, cone, 8, literals=0)) == want


def test_pixels_of_centres_are_themselves(spark):
    for nside in (1, 2, 16):
        lon, lat = healpix.nested_centre(np.arange(12 * nside * nside), nside)
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))], "id int, ra double, decl double")
        rows = healpix.with_ring_pixel(healpix.with_nested_pixel(df, "n", nside), "r", nside).collect()
        assert all(r.n == r.id for r in rows) and len({r.r for r in rows}) == 12 * nside * nside


def test_region_filter_reaches_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/sky"
    spark.range(1000).selectExpr("id", "id * 0.006D AS ra", "0.1D AS decl").write.parquet(path)
    df = region.within(spark.read.parquet(path), region.Cone(1.0, 0.1, 0.05)).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ra" in plan

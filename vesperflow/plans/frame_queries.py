"""Whole frames, splines, alignment and what callers plug in: inputs whose answer SQL can write down."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from vesperflow.functions import plugins, splines
from vesperflow.functions import time as times
from vesperflow.operators import images, matching, mount, region
from vesperflow.plans.common import DEG, PIXELS, SKY, STARS, lit, pixels, query, r, sky, stars
from vesperflow.session import scratch_path, table
from vesperflow.sources import binary
from vesperflow.sources import bytes as files

_MEAN = f"WITH {PIXELS}, u AS (SELECT frame, x, y, avg(value) AS value FROM pixels GROUP BY ALL), g AS (SELECT f.frame, CAST(a AS INTEGER) x, CAST(b AS INTEGER) y FROM (SELECT DISTINCT frame FROM u) f, range(40) i(a), range(25) j(b)), p AS (SELECT g.*, coalesce(u.value, 0) AS value FROM g LEFT JOIN u USING (frame, x, y))"


def _images(spark, sf_dir):
    """Frames of 40 x 25 pixels."""
    u = pixels(spark, sf_dir).groupBy("frame", "x", "y").agg(F.avg("value").alias("value"))
    return images.from_pixels(u, "frame", 40, 25)


def _rows(df, digits: int = 6):
    return images.to_pixels(df, "frame").select("frame", "x", "y", r("value", digits).alias("value"))


@query(f"{_MEAN} SELECT frame, x, y, round(value, 6) + 0.0E0 AS value FROM p")
def image_layers(spark, sf_dir):
    """Wavelet and median layers, taken apart and put together."""
    back = lambda p: images.weigh_layers(images.weigh_layers(p, [1.0, 1.0, 1.0]), [1.0, 1.0], images.median_pyramid)
    return _rows(images.map_images(_images(spark, sf_dir), back))


@query(f"{_MEAN} SELECT frame, x, y, round(0.3E0 * value + 0.7E0 * (SELECT avg(value) FROM p q WHERE q.frame = p.frame), 6) + 0.0E0 AS value FROM p")
def image_band_filter(spark, sf_dir):
    """A low pass so low that only the mean is left, mixed with the frame."""
    return _rows(images.map_images(_images(spark, sf_dir), lambda p: images.band_filter(p, "low", 1e-6, 4, 0.7)))


@query(f"{_MEAN} SELECT frame, x, y, round(0.1E0 + 0.8E0 * (round(least(greatest(value, 0), 1) * 16777215) / 16777215), 7) AS value FROM p")
def image_curves(spark, sf_dir):
    """A curve through points of a line."""
    t = images.curve([(0.0, 0.1), (0.25, 0.3), (1.0, 0.9)], 1 << 24)
    return _rows(images.map_images(_images(spark, sf_dir), lambda p: images.apply_curve(p, t)), digits=7)


@query(f"{_MEAN} SELECT a.frame, a.x, a.y, round(coalesce(b.value, 0), 6) + 0.0E0 AS value FROM p a LEFT JOIN p b ON b.frame = a.frame AND b.x = a.x + 3 AND b.y = a.y - 2")
def image_warp(spark, sf_dir):
    """Frames moved by whole pixels; what comes from outside is 0."""
    return _rows(images.map_images(_images(spark, sf_dir), lambda p: images.warp(p, np.array([[1.0, 0.0, 3.0], [0.0, 1.0, -2.0]]))[0]))


@query("SELECT CAST(f AS INTEGER) frame, CAST(a AS INTEGER) x, CAST(b AS INTEGER) y, round(0.2E0 + f * 0.001E0 + a * 0.003E0 - b * 0.002E0 + a * b * 0.0001E0, 5) AS value FROM range(30) k(f), range(40) i(a), range(25) j(b)")
def image_background_surface(spark, sf_dir):
    """Surfaces that are polynomials come back whole, a bright block on them left out."""
    g = spark.range(30 * 1000).select(F.floor(F.col("id") / 1000).cast("int").alias("frame"), F.pmod("id", F.lit(40)).cast("int").alias("x"), F.pmod(F.floor(F.col("id") / 40), F.lit(25)).cast("int").alias("y"))
    v = F.col("frame") * 0.001 + F.col("x") * 0.003 - F.col("y") * 0.002 + F.col("x") * F.col("y") * 0.0001 + 0.2
    g = g.withColumn("value", v)
    return _rows(images.map_images(images.from_pixels(g, "frame", 40, 25), lambda p: images.background(p, 8, 2)), digits=5)


@query("SELECT CAST(f AS INTEGER) frame, 20 + 30 * (i % 3) + f % 5 AS x, 20 + 30 * (i // 3) + f % 7 AS y FROM range(12) k(f), range(9) s(i)")
def image_stars(spark, sf_dir):
    """Stars put into noisy frames and found where they are."""

    def draw(batches):
        import pandas as pd

        for b in batches:
            for f in b["id"]:
                at = np.array([(20 + 30 * (i % 3) + f % 5, 20 + 30 * (i // 3) + f % 7, 20.0 + i) for i in range(9)], float)
                p = images.synthesize(110, 110, at, seed=int(f))
                yield pd.DataFrame({"frame": [int(f)], "width": [110], "height": [110], "channels": [1], "pixels": [p.ravel().tolist()]})

    made = spark.range(12).mapInPandas(draw, "frame int, width int, height int, channels int, pixels array<double>")
    found = images.find_stars(made, ["frame"], min_snr=20.0)
    return found.select("frame", F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"))


@query(f"""WITH {PIXELS}, u AS (SELECT frame, x, y, avg(value) AS value FROM pixels GROUP BY ALL), d AS (SELECT CAST(dx AS INTEGER) - 1 dx, CAST(dy AS INTEGER) - 1 dy FROM range(3) a(dx), range(3) b(dy)), m AS (SELECT p.frame, p.x, p.y, any_value(p.value) v, median(n.value) m FROM u p, d, u n WHERE n.frame = p.frame AND n.x = p.x + dx AND n.y = p.y + dy AND NOT (dx = 0 AND dy = 0) GROUP BY ALL),
s AS (SELECT frame, median(abs(v - m)) * 1.482602218505602E0 s FROM m GROUP BY 1) SELECT u.frame, count(*) FILTER (s > 0 AND abs(v - m) > 1.5E0 * s) repaired, round(sum(CASE WHEN s > 0 AND abs(v - m) > 1.5E0 * s THEN m ELSE u.value END), 4) total FROM u LEFT JOIN m ON m.frame = u.frame AND m.x = u.x AND m.y = u.y LEFT JOIN s ON s.frame = u.frame GROUP BY 1""")
def image_repair(spark, sf_dir):
    from vesperflow.operators import stack

    u = pixels(spark, sf_dir).groupBy("frame", "x", "y").agg(F.avg("value").alias("value"))
    c = stack.cosmetic(u, 1.5)
    return c.groupBy("frame").agg(F.count_if("repaired").alias("repaired"), r(F.sum("value"), 4).alias("total"))


@query(f"{_MEAN} SELECT frame, round(sum(value), 4) total, count(*) n FROM p GROUP BY 1")
def image_kinds_read(spark, sf_dir):
    """A folder of FITS and XISF files, each read as what it is."""
    folder = scratch_path(spark, "mixed")
    u = images.to_pixels(_images(spark, sf_dir), "frame")
    files.write_files(binary.images_of(u.where("frame % 2 = 0"), "frame"), folder)
    files.write_files(binary.images_of(u.where("frame % 2 = 1"), "frame", lambda p: binary.encode_xisf(p, "Float64", True), "xisf"), folder)
    files.write_files(spark.createDataFrame([("notes.txt", bytearray(b"not an image"))], "name string, content binary"), folder)
    p = binary.explode_pixels(binary.read_images(spark, folder))
    return p.groupBy(F.regexp_extract("path", r"image(\d+)\.", 1).cast("int").alias("frame")).agg(r(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


# ---- splines and roots ----------------------------------------------------------------------------------------------


def _points(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(40)).cast("int").alias("k"), (F.pmod("o_orderkey", F.lit(97)) / 10.0).alias("x")).distinct()


@query("SELECT DISTINCT CAST(o_custkey % 40 AS INTEGER) k, (o_orderkey % 97) / 10.0E0 x, round(2 + CAST(o_custkey % 40 AS INTEGER) * 0.5E0 - 1.5E0 * ((o_orderkey % 97) / 10.0E0), 5) + 0.0E0 y FROM orders")
def spline_interpolation(spark, sf_dir):
    """A natural cubic spline through points of a line is the line."""
    grid = spark.range(40 * 9).select(F.floor(F.col("id") / 9).cast("int").alias("k"), (F.pmod("id", F.lit(9)) * 1.25).alias("x"))
    line = grid.withColumn("y", F.col("k") * 0.5 + 2 - F.col("x") * 1.5)
    return splines.interpolate_groups(line, _points(spark, sf_dir), "k", "x", "y").select("k", "x", r("y", 5).alias("y"))


@query("SELECT DISTINCT CAST(o_custkey % 40 AS INTEGER) k, (o_orderkey % 97) / 10.0E0 x, round(1 + CAST(o_custkey % 40 AS INTEGER) * 0.1E0 + pow((o_orderkey % 97) / 10.0E0, 3) * 0.01E0 - pow((o_orderkey % 97) / 10.0E0, 2) * 0.2E0, 5) + 0.0E0 y FROM orders")
def chebyshev_series(spark, sf_dir):
    """A Chebyshev fit of a cubic's samples is the cubic."""
    grid = spark.range(40 * 20).select(F.floor(F.col("id") / 20).cast("int").alias("k"), (F.pmod("id", F.lit(20)) * 0.55).alias("x"))
    cubic = grid.withColumn("y", F.col("k") * 0.1 + 1 + F.pow("x", 3) * 0.01 - F.pow("x", 2) * 0.2)
    return splines.interpolate_groups(cubic, _points(spark, sf_dir), "k", "x", "y", "chebyshev", 5).select("k", "x", r("y", 5).alias("y"))


@query("SELECT o_orderkey id, round(cbrt(o_totalprice), 6) root FROM orders")
def bracketed_roots(spark, sf_dir):
    """Roots of a function of a row's own parameter."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), r(splines.solve_column(lambda x, p: x**3 - p, F.lit(0.0), F.lit(1000.0), F.col("o_totalprice"))).alias("root"))


# ---- alignment ------------------------------------------------------------------------------------------------------


@query(f"""WITH {SKY} SELECT id, round(ra, 5) + 0.0E0 azimuth, round(abs(decl), 5) + 0.0E0 altitude FROM sky WHERE decl > 0.05 AND decl < 1.4 AND ra > 0.001 AND ra < 6.28""")
def rotation_axes(spark, sf_dir):
    """The axis of three directions that a turn about it gives."""
    from vesperflow.functions.mathx import rotate_about
    from vesperflow.functions.sphere import unit

    s = sky(spark, sf_dir).where("decl > 0.05D AND decl < 1.4D AND ra > 0.001D AND ra < 6.28D")
    axis = F.array(*unit("ra", "decl"))
    start = F.array(*unit(F.col("ra") + 0.3, F.col("decl") - 0.4))
    s = s.withColumn("axis", axis).withColumn("v0", start)
    for i, t in ((1, 0.5), (2, 1.1)):
        s = s.withColumn(f"v{i}", rotate_about("v0", "axis", F.lit(t)))
    for i in range(3):
        s = s.withColumn(f"a{i}", F.atan2(F.col(f"v{i}")[1], F.col(f"v{i}")[0])).withColumn(f"h{i}", F.asin(F.col(f"v{i}")[2]))
    return mount.axes_of_three(s, "id", [(f"a{i}", f"h{i}") for i in range(3)]).select("id", r("azimuth", 5).alias("azimuth"), r("altitude", 5).alias("altitude"))


@query("""WITH t AS (SELECT event_id, (event_id % 200 - 100) / 100.0E0 h, event_id % 3 = 0 flipped, event_id % 5 = 0 busy, event_id % 11 <> 0 AS tracking FROM events)
SELECT event_id, CASE WHEN NOT tracking OR flipped OR h < -0.05 THEN 'none' WHEN h >= 0.5 THEN 'stop' WHEN h >= 0.1 AND NOT busy THEN 'flip' ELSE 'wait' END decision, CASE WHEN h < 0 THEN 'west' ELSE 'east' END side FROM t""")
def meridian_flips(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = lambda n: F.pmod("event_id", F.lit(n))
    h = (m(200) - 100) / 100.0
    d = mount.flip_decision(h, m(3) == 0, before=0.05, after=0.1, limit=0.5, tracking=m(11) != 0, exposing=m(5) == 0)
    return e.select("event_id", d.alias("decision"), mount.pier_side(h).alias("side"))


_BOX = f"""WITH {STARS}, s AS (SELECT DISTINCT frame, idx, x, y FROM stars), d AS (SELECT a.frame, a.idx, b.idx r_idx, row_number() OVER (PARTITION BY a.frame, a.idx ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.idx) k FROM s a JOIN s b ON a.frame = b.frame AND a.idx <> b.idx),
t AS (SELECT DISTINCT p.frame, list_sort([p.idx, p.r_idx, q.r_idx]) v FROM d p JOIN d q ON p.frame = q.frame AND p.idx = q.idx AND p.r_idx < q.r_idx WHERE p.k <= 4 AND q.k <= 4),
l AS (SELECT t.frame, list_reverse_sort([sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)), sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2))]) s FROM t JOIN s a ON a.frame = t.frame AND a.idx = v[1] JOIN s b ON b.frame = t.frame AND b.idx = v[2] JOIN s c ON c.frame = t.frame AND c.idx = v[3])"""


@query(f"{_BOX} SELECT frame, count(*) n, round(sum(s[2] / s[1]), 4) middle, round(sum(s[3] / s[1]), 4) short FROM l WHERE s[3] > 0 GROUP BY 1")
def neighbour_triangles(spark, sf_dir):
    """Triangles of stars with pairs of their four nearest, each once, and their side ratios."""
    t = matching.triangle_table(stars(spark, sf_dir).select("frame", "idx", "x", "y").distinct(), "frame", neighbours=4)
    return t.groupBy("frame").agg(F.count("*").alias("n"), r(F.sum(F.col("middle") / F.col("long")), 4).alias("middle"), r(F.sum(F.col("short") / F.col("long")), 4).alias("short"))


# ---- plug-ins -------------------------------------------------------------------------------------------------------

_CONE = region.Cone(83.0 * DEG, -5.0 * DEG, 12.0 * DEG)


class _Sky:
    """The sky table as a catalogue that knows coarse boxes only."""

    def __init__(self, spark, sf_dir):
        self.rows = sky(spark, sf_dir)

    def candidates(self, boxes):
        hit = F.lit(False)
        for a0, a1, d0, d1 in boxes:
            hit = hit | (F.col("ra").between(a0, a1) & F.col("decl").between(d0, d1))
        return self.rows.where(hit)


@query(f"""WITH {SKY}, c AS (SELECT *, sin(decl) * {lit(math.sin(_CONE.dec))} + cos(decl) * {lit(math.cos(_CONE.dec))} * cos(ra - {lit(_CONE.ra)}) c FROM sky)
SELECT id, round(cos(decl) * sin(ra - {lit(_CONE.ra)}) * sqrt(2 / (1 + c)), 6) + 0.0E0 x, round((sin(decl) * {lit(math.cos(_CONE.dec))} - cos(decl) * {lit(math.sin(_CONE.dec))} * cos(ra - {lit(_CONE.ra)})) * sqrt(2 / (1 + c)), 6) + 0.0E0 y FROM c
WHERE 2 * asin(sqrt(least(1, pow(sin((decl - {lit(_CONE.dec)}) / 2), 2) + cos(decl) * {lit(math.cos(_CONE.dec))} * pow(sin((ra - {lit(_CONE.ra)}) / 2), 2)))) <= {lit(_CONE.radius)}""")
def plugged_catalogue(spark, sf_dir):
    """A caller's catalogue searched by a cone and drawn by a projection of their choice."""
    found = plugins.in_region(_Sky(spark, sf_dir), _CONE)
    return plugins.with_plane(found, plugins.Azimuthal("azimuthal_equal_area", _CONE.ra, _CONE.dec)).select("id", r("x").alias("x"), r("y").alias("y"))


@query("SELECT event_id, round((36 + 32.184E0) + 0.0E0, 4) tt_utc, round(65 + 0.0E0, 4) tt_ut1 FROM events")
def plugged_time_models(spark, sf_dir):
    """Conversions by a caller's leap seconds and TT - UT1."""
    m = plugins.TimeModels(leap=lambda _: F.lit(36.0), delta_t=lambda _: F.lit(65.0))
    e = table(spark, sf_dir, "events").withColumn("u", times.from_timestamp("ts"))
    e = e.withColumn("tt", m.utc_to_tt(F.col("u"))).withColumn("ut1", m.tt_to_ut1(F.col("tt")))
    return e.select("event_id", r(times.difference(F.col("tt"), F.col("u")) * 86400, 4).alias("tt_utc"), r(times.difference(F.col("tt"), F.col("ut1")) * 86400, 4).alias("tt_ut1"))


@query("""WITH p AS (SELECT event_id, datediff('day', DATE '1858-11-17', CAST(ts AS DATE)) + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400e6 m FROM events), e AS (SELECT 60300.0E0 + i m, ((i * 7919) % 1000) / 10007.0E0 v FROM range(40) t(i)), q AS (SELECT event_id, least(greatest(m, 60300), 60339) t FROM p)
SELECT event_id, round(a.v + (coalesce(b.v, a.v) - a.v) * (t - floor(t)), 6) + 0.0E0 ut1_utc FROM q JOIN e a ON a.m = floor(t) LEFT JOIN e b ON b.m = floor(t) + 1""")
def earth_orientation_lookup(spark, sf_dir):
    """UT1 - UTC at times between a table's days, held beyond its ends."""
    eop = spark.range(40).select((F.col("id") + 60300.0).alias("mjd"), (F.pmod(F.col("id") * 7919, F.lit(1000)) / 10007.0).alias("ut1_utc"))
    p = table(spark, sf_dir, "events").select("event_id", times.mjd(times.from_timestamp("ts")).alias("mjd"))
    return times.interpolate_eop(p, eop).select("event_id", r("ut1_utc").alias("ut1_utc"))


# ---- pictures, pages, Jupiter, updated series -----------------------------------------------------------------------


@query("SELECT 'flat' || i || '.jpg' AS name, 24 AS width, 16 AS height, round((40 + 13 * i) / 255.0E0, 6) level FROM range(12) t(i)")
def jpeg_pictures(spark, sf_dir):
    """Pictures of one grey, encoded by the platform and read by Spark's image source."""
    jvm = spark._jvm
    rows = []
    for i in range(12):
        v = 40 + 13 * i
        picture = jvm.java.awt.image.BufferedImage(24, 16, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
        raster = picture.getRaster()
        for y in range(16):
            for x in range(24):
                raster.setSample(x, y, 0, v)
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
        rows.append((f"flat{i}.jpg", bytearray(out.toByteArray())))
    folder = scratch_path(spark, "jpeg")
    files.write_files(spark.createDataFrame([*rows, ("notes.txt", bytearray(b"none"))], "name string, content binary"), folder)
    p = binary.read_jpeg(spark, folder)
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x) / F.size("pixels")
    return p.select(F.substring_index("path", "/", -1).alias("name"), "width", "height", r(mean).alias("level"))


@query("SELECT CAST(n_nationkey // 10 + 1 AS INTEGER) page, CAST(n_nationkey AS BIGINT) id, n_name AS name FROM nation")
def service_pages(spark, sf_dir):
    """A service's pages of ten rows each, asked for until one names no next."""
    import json

    from vesperflow.sources import services

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # what the made service has
    last = max(row.n_nationkey for row in rows) // 10 + 1

    def ask(page: int) -> str:
        return json.dumps({"count": len(rows), "next": page + 1 if page < last else None, "results": [{"id": row.n_nationkey, "name": row.n_name} for row in rows if row.n_nationkey // 10 + 1 == page]})

    return services.paged(spark, ask, "id: bigint, name: string")


def _jupiter_sql(system: str) -> str:
    from vesperflow.functions.bodies import JUPITER_SYSTEMS, LIGHT_DAYS_AU

    start, growth = JUPITER_SYSTEMS[system]
    turn = f"({lit(start)} + {lit(growth)} * (d - sqrt(x * x + y * y + z * z) * {lit(LIGHT_DAYS_AU)})) * {lit(math.pi / 180)}"
    angle = f"({turn} - atan2(z * cos(p) - sin(p) * (x * cos(a) + y * sin(a)), y * cos(a) - x * sin(a)))"
    return f"round({angle} - floor({angle} / {lit(2 * math.pi)}) * {lit(2 * math.pi)}, 5)"


def _jupiter_from() -> str:
    from vesperflow.functions.bodies import JUPITER_POLE as P

    return f"""WITH {SKY}, s AS (SELECT id, ((id % 9000) + 0.37E0 + 2451545.0E0) - 2451545.0E0 d, 5 * cos(decl) * cos(ra) x, 5 * cos(decl) * sin(ra) y, 5 * sin(decl) z FROM sky),
    b AS (SELECT *, ({lit(P[0])} + {lit(P[1])} * d / 36525) * {lit(math.pi / 180)} a, ({lit(P[2])} + {lit(P[3])} * d / 36525) * {lit(math.pi / 180)} p FROM s)"""


@query(f"{_jupiter_from()} SELECT id, {_jupiter_sql('I')} one, {_jupiter_sql('II')} two FROM b")
def jupiter_meridians(spark, sf_dir):
    """Central meridians of two systems of Jupiter from made places of the observer."""
    from vesperflow.functions.bodies import jupiter_meridian

    s = sky(spark, sf_dir).withColumn("jd", F.pmod("id", F.lit(9000)) + 0.37 + 2451545.0)
    x, y, z = (c * 5 for c in (F.cos("decl") * F.cos("ra"), F.cos("decl") * F.sin("ra"), F.sin("decl")))
    return s.select("id", r(jupiter_meridian("I", "jd", x, y, z), 5).alias("one"), r(jupiter_meridian("II", "jd", x, y, z), 5).alias("two"))


@query("""WITH s AS (SELECT user_id k, epoch_us(ts) / 3600e6 - 473328 x, max(value) y FROM events GROUP BY ALL), p AS (SELECT CAST(i AS BIGINT) id, i % 150 AS k, (i // 150) * 30.0E0 x FROM range(3000) t(i)), a AS (SELECT id, any_value(p.x) x, max_by({'x': s.x, 'y': s.y}, s.x) FILTER (s.x <= p.x) lo, min_by({'x': s.x, 'y': s.y}, s.x) FILTER (s.x >= p.x) hi FROM p JOIN s USING (k) GROUP BY 1)
SELECT id, round(CASE WHEN lo IS NULL THEN hi.y WHEN hi IS NULL OR hi.x = lo.x THEN lo.y ELSE lo.y + (hi.y - lo.y) * (x - lo.x) / (hi.x - lo.x) END, 5) y FROM a""")
def interpolator_stream(spark, sf_dir):
    """Values between a stream's samples, made anew with every batch that comes."""
    from vesperflow.operators import joins
    from vesperflow.plans.science_queries import _stream
    from vesperflow.streaming import frames

    points = spark.range(3000).select("id", F.pmod("id", F.lit(150)).alias("k"), (F.floor(F.col("id") / 150) * 30.0).cast("double").alias("x"))

    def snapshot(every):
        s = every.groupBy(F.col("user_id").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6 - 473328).alias("x")).agg(F.max("value").alias("y"))
        return joins.interpolate(points, s, "k", "x", "y").where("y IS NOT NULL").select("id", r("y", 5).alias("y"))

    return frames.collect(_stream(spark, sf_dir, "events"), snapshot, "interpolator")

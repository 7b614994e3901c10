"""Numbers, vectors, generators, image figures, order-dependent matching, fits and events beyond the first modules."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from vesperflow.functions import angles, bodies, mathx, random, sphere, wcs
from vesperflow.functions import formulas as f
from vesperflow.operators import joins, models, mount, region, robust, series, stack
from vesperflow.plans.common import DEG, PIXELS, SAMPLES, SKY, STARS, lit, pixels, query, r, samples, sky, stars
from vesperflow.session import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))


def _unit(c, n: int, m: int):
    return F.pmod(F.col(c) * n, F.lit(m)) / float(m)


def _unit_sql(c: str, n: int, m: int) -> str:
    return f"((({c} * {n}) % {m}) / {lit(m)})"


# ---- numbers, vectors, angles ---------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT o_orderkey id, [o_orderkey % 7 + 0.5E0, (o_orderkey % 11) * 1.0E0, (o_orderkey % 5) - 2.0E0] a, [(o_custkey % 3) + 1.0E0, (o_custkey % 13) - 6.0E0, (o_custkey % 4) * 0.5E0] b FROM orders),
x AS (SELECT *, a[1] * b[1] + a[2] * b[2] + a[3] * b[3] d, [a[2] * b[3] - a[3] * b[2], a[3] * b[1] - a[1] * b[3], a[1] * b[2] - a[2] * b[1]] k FROM v)
SELECT id, round(d, 6) dot, round(sqrt(k[1] * k[1] + k[2] * k[2] + k[3] * k[3]), 6) cross_length, round(atan2(sqrt(k[1] * k[1] + k[2] * k[2] + k[3] * k[3]), d), 8) angle, round(a[1] * cos(0.3E0) - a[2] * sin(0.3E0), 6) turned FROM x""")
def vector_operations(spark, sf_dir):
    m = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("double")
    v = _orders(spark, sf_dir).select("id", F.array(m("id", 7) + 0.5, m("id", 11), m("id", 5) - 2).alias("a"), F.array(m("c", 3) + 1, m("c", 13) - 6, m("c", 4) * 0.5).alias("b"))
    up = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return v.select("id", r(mathx.dot("a", "b")).alias("dot"), r(mathx.norm(mathx.cross("a", "b"))).alias("cross_length"), r(mathx.angle_between("a", "b"), 8).alias("angle"), r(mathx.rotate_about("a", up, F.lit(0.3))[0]).alias("turned"))


@query("""WITH m AS (SELECT o_orderkey id, 4.0E0 + o_orderkey % 5 a, 1.0E0 b, (o_orderkey % 3) * 1.0E0 c, 2.0E0 d, 7.0E0 + o_custkey % 4 e, 1.0E0 f, 0.5E0 g, (o_custkey % 2) * 1.0E0 h, 9.0E0 i, o_orderkey % 10 + 1.0E0 y1, o_custkey % 10 + 2.0E0 y2, 3.0E0 y3 FROM orders),
d AS (SELECT *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) det FROM m) SELECT id, round((y1 * (e * i - f * h) - b * (y2 * i - f * y3) + c * (y2 * h - e * y3)) / det, 8) x, round((a * (y2 * i - f * y3) - y1 * (d * i - f * g) + c * (d * y3 - y2 * g)) / det, 8) y FROM d""")
def linear_equations(spark, sf_dir):
    m = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("double")
    k = lambda v: F.lit(float(v))
    a = F.array(F.array(m("id", 5) + 4, k(1), m("id", 3)), F.array(k(2), m("c", 4) + 7, k(1)), F.array(k(0.5), m("c", 2), k(9)))
    s = _orders(spark, sf_dir).select("id", a.alias("a"), F.array(m("id", 10) + 1, m("c", 10) + 2, k(3)).alias("y")).withColumn("s", mathx.solve3("a", "y"))
    return s.select("id", r(F.col("s")[0], 8).alias("x"), r(F.col("s")[1], 8).alias("y"))


@query("SELECT o_orderkey id, CAST(CASE WHEN k % 3 = 0 AND k < 300 THEN k // 3 ELSE -(least(100, (k + 2) // 3)) - 1 END AS BIGINT) place FROM (SELECT o_orderkey, o_orderkey % 350 k FROM orders)")
def sorted_array_search(spark, sf_dir):
    """Places of keys in a sorted array, or where they would go."""
    a = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: i * 3)
    return _orders(spark, sf_dir).select("id", mathx.binary_search(a, F.pmod("id", F.lit(350))).alias("place"))


@query("SELECT o_orderkey id, CAST(o_totalprice AS DOUBLE) total, 0.0E0 error, round(o_totalprice * 3, 6) product FROM orders")
def exact_sums(spark, sf_dir):
    """Sums and products with their rounding errors, which bring the exact value back."""
    o = _orders(spark, sf_dir)
    big = F.lit(1e17)
    s, p = mathx.two_sum(F.col("p"), big), mathx.two_product(F.col("p"), F.lit(3.0))
    back = (s["sum"] - big) + s["error"]
    return o.select("id", back.alias("total"), (back - F.col("p") + 0.0).alias("error"), r(p["product"] + p["error"]).alias("product"))


@query("SELECT o_orderkey id, round(o_totalprice, 4) p, o_orderkey % 9 + 0.0E0 q FROM orders")
def validated_values(spark, sf_dir):
    """Values that pass their checks; one that does not fails its row."""
    o = _orders(spark, sf_dir)
    return o.select("id", r(mathx.require_positive(mathx.require_finite("p")), 4).alias("p"), mathx.require_range(F.pmod("id", F.lit(9)).cast("double"), 0.0, 8.0).alias("q"))


@query(f"""SELECT o_orderkey id, round((o_orderkey % 360) * {lit(DEG)}, 9) deg, round((o_orderkey % 24) * {lit(15 * DEG)}, 9) AS "hour", round((o_orderkey % 1000) / 60.0E0 * {lit(DEG)}, 9) arcmin, round((CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 80 + (o_orderkey % 60) / 60.0E0 + (o_orderkey % 50) / 3600.0E0) * {lit(DEG)}, 9) + 0.0E0 dms,
round((o_orderkey % 24 + (o_orderkey % 60) / 60.0E0 + (o_orderkey % 50) / 3600.0E0) * {lit(15 * DEG)}, 9) hms FROM orders""")
def angle_constructors(spark, sf_dir):
    m = lambda n: F.pmod("id", F.lit(n)).cast("double")
    sign = F.when(F.pmod("id", F.lit(2)) == 0, F.lit(-1.0)).otherwise(1.0)
    d = angles.dms(m(80), m(60), m(50)) * sign
    return _orders(spark, sf_dir).select("id", r(angles.from_unit(m(360), "deg"), 9).alias("deg"), r(angles.from_unit(m(24), "hour"), 9).alias("hour"), r(angles.from_unit(m(1000), "arcmin"), 9).alias("arcmin"), r(d, 9).alias("dms"), r(angles.hms(m(24), m(60), m(50)), 9).alias("hms"))


def _imul(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) % 4294967296 AS BIGINT)"


@query(f"""WITH s AS (SELECT o_orderkey id, CAST((o_orderkey + CAST(3 AS HUGEINT) * 1831565813) % 4294967296 AS BIGINT) z, CAST((o_orderkey + CAST(3 AS HUGEINT) * 2654435769) % 4294967296 AS BIGINT) w, CASE WHEN o_orderkey = 0 THEN 1831565813 ELSE o_orderkey END x FROM orders),
a AS (SELECT *, {_imul('xor(z, z >> 15)', '(z | 1)')} z1, {_imul('xor(w, w >> 16)', '569420461')} w1, xor(x, (x << 13) & 4294967295) x1 FROM s),
b AS (SELECT *, xor(z1, (z1 + {_imul('xor(z1, z1 >> 7)', '(z1 | 61)')}) & 4294967295) z2, {_imul('xor(w1, w1 >> 15)', '1935289751')} w2, xor(x1, x1 >> 17) x2 FROM a)
SELECT id, round(xor(z2, z2 >> 14) / 4294967296.0E0, 9) mulberry, round(xor(w2, w2 >> 15) / 4294967296.0E0, 9) splitmix, round(xor(x2, (x2 << 5) & 4294967295) / 4294967296.0E0, 9) xorshift FROM b""")
def seeded_generators(spark, sf_dir):
    """The third number of two counting generators, and the first of a shifting one, for each seed."""
    o = _orders(spark, sf_dir)
    return o.select("id", r(random.mulberry32_at("id", F.lit(3)), 9).alias("mulberry"), r(random.splitmix32_at("id", F.lit(3)), 9).alias("splitmix"), r(random.draw("xorshift32", "id", 1)[0], 9).alias("xorshift"))


_U, _V = _unit_sql("o_orderkey", 7919, 10007), _unit_sql("o_orderkey", 104729, 9973)


@query(f"""SELECT id, round(-ln(1 - u) / 2, 6) + 0.0E0 exponential, round(1.5E0 * pow(-ln(1 - u), 1 / 2.5E0), 6) weibull, round(exp(-ln(1 - u) / 3), 6) pareto, round(2 * sqrt(-2 * ln(1 - u)), 6) rayleigh, 1 + floor(ln(1 - u) / ln(0.7E0)) geometric, CASE WHEN u < 0.3 THEN 1 ELSE 0 END bernoulli,
round(CASE WHEN u < 0.25 THEN 1 + sqrt(u * 4) ELSE 5 - sqrt((1 - u) * 12) END, 6) triangular, round(10 + 2 * sqrt(-2 * ln(u)) * cos({lit(2 * math.pi)} * v), 6) normal, round(tan((u - 0.5E0) * {lit(math.pi)}), 3) + 0.0E0 cauchy FROM (SELECT o_orderkey id, (((o_orderkey * 7919) % 10007) + 0.5E0) / 10007 u, {_V} v FROM orders)""")
def distributions(spark, sf_dir):
    u, v = (F.pmod(F.col("id") * 7919, F.lit(10007)) + 0.5) / 10007.0, _unit("id", 104729, 9973)
    o = _orders(spark, sf_dir).select("id", u.alias("u"), v.alias("v"))
    return o.select(
        "id", r(random.exponential("u", 2.0)).alias("exponential"), r(random.weibull("u", 1.5, 2.5)).alias("weibull"), r(random.pareto("u", 3.0)).alias("pareto"), r(random.rayleigh("u", 2.0)).alias("rayleigh"), random.geometric("u", 0.3).alias("geometric"), random.bernoulli("u", 0.3).alias("bernoulli"),
        r(random.triangular("u", 1.0, 5.0, 2.0)).alias("triangular"), r(random.normal("u", "v", 10.0, 2.0)).alias("normal"), r(random.cauchy("u"), 3).alias("cauchy"),
    )


@query("SELECT c AS cust, id, CAST(row_number() OVER (PARTITION BY c ORDER BY md5('7:' || id), id) AS INTEGER) place FROM (SELECT o_custkey c, o_orderkey id FROM orders)")
def seeded_shuffle(spark, sf_dir):
    """Each customer's orders in a seeded random order."""
    w = Window.partitionBy("c").orderBy(random.shuffle_key(7, "id"), "id")
    return _orders(spark, sf_dir).select(F.col("c").alias("cust"), "id", F.row_number().over(w).alias("place"))


def _constellations() -> list[tuple[str, str]]:
    return list(bodies.CONSTELLATIONS.items())


@query("WITH names(code, full_name) AS (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in bodies.CONSTELLATIONS.items()) + """), codes AS (SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS BIGINT) k FROM names) SELECT full_name, count(*) n FROM orders JOIN codes ON o_orderkey % 88 = k JOIN names USING (code) GROUP BY 1""")
def constellation_names(spark, sf_dir):
    dim = spark.createDataFrame(_constellations(), "code string, full_name string")
    codes = F.array(*map(F.lit, sorted(bodies.CONSTELLATIONS)))
    o = _orders(spark, sf_dir).select(F.get(codes, F.pmod("id", F.lit(88)).cast("int")).alias("code"))
    return o.join(F.broadcast(dim), "code").groupBy("full_name").agg(F.count("*").alias("n"))


# ---- bodies and places ----------------------------------------------------------------------------------------------

_DEGS = lit(180 / math.pi)


@query(f"""WITH b AS (SELECT o_orderkey id, 1 + {_U} rr, 0.5E0 + {_V} d, 1.0E0 e FROM orders), a AS (SELECT *, acos(greatest(-1, least(1, (rr * rr + d * d - e * e) / (2 * rr * d)))) ph FROM b)
SELECT id, round(ph, 6) phase, round((1 + cos(ph)) / 2, 6) lit, round(5 * log10(rr * d) - 1.52E0 + 0.016E0 * ph * {_DEGS}, 5) mars, round(5 * log10(rr * d) - 4.40E0 + ph * {_DEGS} * (0.0009E0 + ph * {_DEGS} * (0.000239E0 - 0.00000065E0 * ph * {_DEGS})), 5) venus FROM a""")
def planet_magnitudes(spark, sf_dir):
    o = _orders(spark, sf_dir).select("id", (_unit("id", 7919, 10007) + 1).alias("rr"), (_unit("id", 104729, 9973) + 0.5).alias("d"))
    o = o.withColumn("ph", bodies.phase_angle("rr", "d", F.lit(1.0)))
    return o.select("id", r("ph").alias("phase"), r(bodies.illuminated("ph")).alias("lit"), r(bodies.planet_magnitude("mars", "rr", "d", "ph"), 5).alias("mars"), r(bodies.planet_magnitude("venus", "rr", "d", "ph"), 5).alias("venus"))


@query(f"""WITH {SKY}, s AS (SELECT id, ra, decl, (id % 2000 - 1000) * {lit(bodies.MAS)} ma, (id % 1500 - 700) * {lit(bodies.MAS)} md, (id % 90 - 45) * (1 + id % 50) * {lit(bodies.MAS / bodies.AU_YEAR_KM_S)} mr, 1 + id % 50 p FROM sky),
v AS (SELECT *, cos(decl) * cos(ra) * (1 + 100 * mr) + 100 * (-sin(ra) * ma - sin(decl) * cos(ra) * md) x, cos(decl) * sin(ra) * (1 + 100 * mr) + 100 * (cos(ra) * ma - sin(decl) * sin(ra) * md) y, sin(decl) * (1 + 100 * mr) + 100 * cos(decl) * md z FROM s)
SELECT id, round(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + {lit(2 * math.pi)} ELSE atan2(y, x) END, 8) ra, round(atan2(z, sqrt(x * x + y * y)), 8) decl, round(p / sqrt(x * x + y * y + z * z), 7) parallax FROM v""")
def star_space_motion(spark, sf_dir):
    """Places and parallaxes a century on, by straight motion in space."""
    m = lambda n: F.pmod("id", F.lit(n))
    s = bodies.space_motion("ra", "decl", m(2000) - 1000, m(1500) - 700, m(50) + 1, m(90) - 45, F.lit(100.0))
    return sky(spark, sf_dir).select("id", s.alias("s")).select("id", r("s.ra", 8).alias("ra"), r("s.decl", 8).alias("decl"), r("s.parallax", 7).alias("parallax"))


_WCS = wcs.Tan(512.0, 384.0, 1.0, 0.3, (-2e-5, 1e-6, 1e-6, 2e-5))


@query(f"""WITH p AS (SELECT l_orderkey id, l_linenumber line, (l_partkey % 1024) * 1.0E0 x, (l_suppkey * 7 % 768) * 1.0E0 y FROM lineitem), w AS (SELECT *, (x - 512) * -2e-5 + (y - 384) * 1e-6 xi, (x - 512) * 1e-6 + (y - 384) * 2e-5 eta FROM p)
SELECT id, line, round(1 + atan2(xi, {lit(math.cos(0.3))} - eta * {lit(math.sin(0.3))}), 8) ra, round(atan2({lit(math.sin(0.3))} + eta * {lit(math.cos(0.3))}, sqrt(xi * xi + pow({lit(math.cos(0.3))} - eta * {lit(math.sin(0.3))}, 2))), 8) decl, round(x, 4) x, round(y, 4) y FROM w""")
def pixel_sky_pixel(spark, sf_dir):
    """Pixels to the sky by a tangent-plane header, and back."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.pmod("l_partkey", F.lit(1024)).cast("double").alias("x"), F.pmod(F.col("l_suppkey") * 7, F.lit(768)).cast("double").alias("y"))
    a, d = _WCS.to_sky("x", "y")
    p = p.withColumn("ra", a).withColumn("decl", d)
    u, v = _WCS.to_pixel("ra", "decl")
    return p.select("id", "line", r("ra", 8).alias("ra"), r("decl", 8).alias("decl"), r(u, 4).alias("x"), r(v, 4).alias("y"))


def _grid_sql() -> str:
    m, v = sphere.precession_matrix(2405889.25855), ("cos(decl) * cos(ra)", "cos(decl) * sin(ra)", "sin(decl)")
    x, y, z = (" + ".join(f"{v[j]} * {lit(row[j])}" for j in range(3)) for row in m)
    return f"""WITH {SKY}, q AS (SELECT id, atan2({y}, {x}) - floor(atan2({y}, {x}) / {lit(2 * math.pi)}) * {lit(2 * math.pi)} a, atan2({z}, sqrt(pow({x}, 2) + pow({y}, 2))) d FROM sky),
    b AS (SELECT i * 4 + j label, i * {lit(math.pi / 6)} lo, (i + 1) * {lit(math.pi / 6)} hi, j * {lit(math.pi / 4)} - {lit(math.pi / 2)} d0 FROM range(12) a(i), range(4) c(j))
    SELECT constellation, count(*) n FROM (SELECT id, CAST(max_by(label, d0) AS VARCHAR) constellation FROM q JOIN b ON a >= lo AND a < hi AND d >= d0 GROUP BY 1) GROUP BY 1"""


@query(_grid_sql())
def grid_range_lookup(spark, sf_dir):
    """Labels of a grid of boundaries in right ascension and declination, after precession to their epoch."""
    s = sky(spark, sf_dir)
    grid = spark.range(48).select((F.floor(F.col("id") / 4) * (math.pi / 6)).alias("ra_low"), ((F.floor(F.col("id") / 4) + 1) * (math.pi / 6)).alias("ra_high"), (F.pmod("id", F.lit(4)) * (math.pi / 4) - math.pi / 2).alias("dec_low"), F.col("id").cast("string").alias("label"))
    return bodies.constellation(s.select("id", "ra", "decl"), grid).groupBy("constellation").agg(F.count("*").alias("n"))


# ---- images ---------------------------------------------------------------------------------------------------------

_UNIQUE = "u AS (SELECT frame, x, y, c, avg(value) AS value FROM pixels GROUP BY ALL)"


def _unique(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("frame", "x", "y", "c").agg(F.avg("value").alias("value"))


@query(f"""WITH {PIXELS}, {_UNIQUE}, a AS (SELECT * FROM u WHERE frame = 7), b AS (SELECT * FROM u WHERE frame = 8)
SELECT x, y, c, round(a.value + b.value, 6) plus, round(a.value - b.value, 6) minus, round(a.value * b.value, 6) times, round(a.value / b.value, 6) AS over_ FROM a JOIN b USING (x, y, c) WHERE b.value <> 0""")
def image_arithmetic(spark, sf_dir):
    u = _unique(spark, sf_dir)
    a, b = (u.where(F.col("frame") == k).drop("frame") for k in (7, 8))
    out = stack.arithmetic(a, b, "over").where("value IS NOT NULL").withColumn("over_", r("value")).drop("value")
    for op in ("plus", "minus", "times"):
        out = out.join(stack.arithmetic(a, b, op).withColumn(op, r("value")).drop("value"), ["x", "y", "c"])
    return out


def _clip_sql(k: int) -> str:
    a = f"a{k} AS (SELECT frame, median(value) m FROM k{k - 1} GROUP BY 1), s{k} AS (SELECT k.frame, any_value(m) m, median(abs(value - m)) * 1.482602218505602E0 s FROM k{k - 1} k JOIN a{k} USING (frame) GROUP BY 1)"
    return f"{a}, k{k} AS (SELECT k.* FROM k{k - 1} k JOIN s{k} USING (frame) WHERE s = 0 OR value BETWEEN m - 2 * s AND m + 1.2E0 * s)"


_CLIP = f"WITH {PIXELS}, {_UNIQUE}, k0 AS (SELECT * FROM u), {', '.join(_clip_sql(k) for k in (1, 2, 3))}"


@query(f"{_CLIP} SELECT frame, count(*) kept, (SELECT count(*) FROM u WHERE u.frame = k3.frame) total FROM k3 GROUP BY 1")
def image_clip_mask(spark, sf_dir):
    """Pixels that three rounds of clipping by median and MAD leave."""
    m = stack.sigma_clip_mask(_unique(spark, sf_dir), low=2.0, high=1.2, iterations=3)
    return m.groupBy("frame").agg(F.count_if(~F.col("rejected")).alias("kept"), F.count("*").alias("total"))


@query(f"{_CLIP.replace('m - 2 * s', 'm - 1.5E0 * s').replace('m + 1.2E0 * s', 'm + 1.5E0 * s')} SELECT frame, round(median(value), 6) background FROM k3 GROUP BY 1")
def image_background(spark, sf_dir):
    return stack.background_level(_unique(spark, sf_dir), sigma=1.5, iterations=3).select("frame", r("background").alias("background"))


@query(f"""WITH {PIXELS}, h AS (SELECT frame, CAST(floor(least(greatest(value, 0), 1) * 65535) AS INTEGER) bin, count(*) n FROM pixels GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY bin) cum, sum(n) OVER (PARTITION BY frame) total FROM h),
m AS (SELECT frame, min_by((bin + (total * 0.5E0 - (cum - n)) / n) / 65536, bin) FILTER (cum >= total * 0.5E0) m FROM c GROUP BY 1), g AS (SELECT p.frame, CAST(floor(least(abs(value - m), 1) * 65535) AS INTEGER) bin, count(*) n FROM pixels p JOIN m USING (frame) GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY bin) cum, sum(n) OVER (PARTITION BY frame) total FROM g) SELECT frame, round(any_value(m), 6) median, round(min_by((bin + (total * 0.5E0 - (cum - n)) / n) / 65536, bin) FILTER (cum >= total * 0.5E0), 6) mad FROM e JOIN m USING (frame) GROUP BY 1""")
def image_median_mad(spark, sf_dir):
    """Median and MAD of frames from histograms of 2 ** 16 bins: two aggregates of partial counts."""
    p = pixels(spark, sf_dir)
    m = robust.histogram_quantile(robust.image_histogram(p, ["frame"]), ["frame"], 1 << 16, [0.5]).withColumnRenamed("q0", "median")
    away = p.join(m, "frame").withColumn("value", F.abs(F.col("value") - F.col("median")))
    mad = robust.histogram_quantile(robust.image_histogram(away, ["frame"]), ["frame"], 1 << 16, [0.5]).withColumnRenamed("q0", "mad")
    return m.join(mad, "frame").select("frame", r("median").alias("median"), r("mad").alias("mad"))


@query(f"""WITH {PIXELS}, w AS (SELECT frame, x, y, sum(value * CASE WHEN c = 0 THEN 0.6E0 ELSE 0.4E0 END) AS v FROM pixels WHERE x BETWEEN 5 AND 30 AND y BETWEEN 3 AND 20 AND weight >= 0.2 GROUP BY ALL)
SELECT frame, CAST(trunc(greatest(0, least(2, sqrt(v))) * 255) AS INTEGER) AS raw, count(*) n FROM w GROUP BY ALL""".replace("CAST(trunc(greatest(0, least(2, sqrt(v))) * 255) AS INTEGER) AS raw", "CAST(least(255, trunc(greatest(0, least(2, sqrt(v))) * 255)) AS INTEGER) bin"))
def image_histogram_weighted(spark, sf_dir):
    """A histogram of a weighted sum of channels, within a rectangle, unmasked, of a transformed value."""
    return robust.image_histogram(pixels(spark, sf_dir), ["frame"], 8, {0: 0.6, 1: 0.4}, (5, 3, 30, 20), F.col("weight") < 0.2, F.sqrt)


@query(f"""WITH {PIXELS}, u AS (SELECT frame, x, y, avg(value) AS value FROM pixels GROUP BY ALL), k AS (SELECT CAST(dx AS INTEGER) - 1 dx, CAST(dy AS INTEGER) - 1 dy FROM range(3) a(dx), range(3) b(dy)),
s AS (SELECT p.frame, p.x, p.y, any_value(p.value) - avg(n.value) v FROM u p, k, u n WHERE n.frame = p.frame AND n.x = p.x + dx AND n.y = p.y + dy GROUP BY ALL)
SELECT frame, CAST(x // 8 AS INTEGER) tx, CAST(y // 8 AS INTEGER) ty, count(*) n, round(avg(v), 6) mean, round(var_pop(v), 6) variance FROM s GROUP BY ALL""")
def tiled_moments(spark, sf_dir):
    u = pixels(spark, sf_dir).groupBy("frame", "x", "y").agg(F.avg("value").alias("value"))
    return stack.spatial_moments(u).select("frame", "tx", "ty", "n", r("mean").alias("mean"), r("variance").alias("variance"))


@query(f"""WITH {PIXELS}, p AS (SELECT frame, x // 8 sx, y // 8 sy, x * 1.0E0 x, y * 1.0E0 y, greatest(avg(value) - 0.05E0, 0) v FROM pixels GROUP BY frame, x, y), m AS (SELECT frame, CAST(sx AS INTEGER) sx, CAST(sy AS INTEGER) sy, sum(v) f, sum(v * x) / sum(v) cx, sum(v * y) / sum(v) cy, sum(v * x * x) / sum(v) xx, sum(v * y * y) / sum(v) yy, sum(v * x * y) / sum(v) xy FROM p GROUP BY ALL HAVING sum(v) > 0),
e AS (SELECT *, (xx - cx * cx + yy - cy * cy) / 2 h, sqrt(pow((xx - cx * cx - yy + cy * cy) / 2, 2) + pow(xy - cx * cy, 2)) g FROM m)
SELECT frame, sx, sy, round(f, 5) flux, round(cx, 5) cx, round(cy, 5) cy, round(sqrt(greatest(h, 0)) * {lit(2 * math.sqrt(2 * math.log(2)))}, 4) fwhm, round(CASE WHEN h + g > 1e-9 THEN sqrt(greatest(0, 1 - greatest(h - g, 0) / (h + g))) ELSE 0 END, 3) eccentricity FROM e""")
def star_moment_profiles(spark, sf_dir):
    """Flux, centre, width and shape of cut-outs from their moments."""
    p = pixels(spark, sf_dir).groupBy("frame", "x", "y").agg(F.avg("value").alias("value"))
    p = p.withColumn("sx", F.floor(F.col("x") / 8).cast("int")).withColumn("sy", F.floor(F.col("y") / 8).cast("int")).withColumn("bg", F.lit(0.05))
    s = stack.star_profiles(p, ["frame", "sx", "sy"], "bg")
    return s.select("frame", "sx", "sy", r("flux", 5).alias("flux"), r("cx", 5).alias("cx"), r("cy", 5).alias("cy"), r("fwhm", 4).alias("fwhm"), r("eccentricity", 3).alias("eccentricity"))


@query(f"""WITH {PIXELS}, u AS (SELECT frame, x, y, avg(value) AS value FROM pixels GROUP BY ALL), t AS (SELECT *, CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 'R' ELSE 'G' END ELSE CASE WHEN x % 2 = 0 THEN 'G' ELSE 'B' END END k FROM u),
d AS (SELECT CAST(dx AS INTEGER) - 1 dx, CAST(dy AS INTEGER) - 1 dy FROM range(3) a(dx), range(3) b(dy)) SELECT p.frame, p.x, p.y, round(CASE WHEN any_value(p.k) = 'R' THEN any_value(p.value) ELSE avg(n.value) FILTER (n.k = 'R') END, 6) r, round(CASE WHEN any_value(p.k) = 'G' THEN any_value(p.value) ELSE avg(n.value) FILTER (n.k = 'G') END, 6) g,
round(CASE WHEN any_value(p.k) = 'B' THEN any_value(p.value) ELSE avg(n.value) FILTER (n.k = 'B') END, 6) b FROM t p, d, t n WHERE n.frame = p.frame AND n.x = p.x + dx AND n.y = p.y + dy GROUP BY ALL""")
def debayered(spark, sf_dir):
    u = pixels(spark, sf_dir).groupBy("frame", "x", "y").agg(F.avg("value").alias("value"))
    return stack.debayer(u).select("frame", "x", "y", *(r(c).alias(c) for c in "rgb"))


@query(f"""WITH {PIXELS}, u AS (SELECT frame, x, y, c, avg(value) AS value FROM pixels GROUP BY ALL) SELECT a.frame, 39 - a.x x, 24 - a.y y, round(a.value * 0.2125E0 + b.value * 0.7154E0 + a.value * 0.0721E0, 6) grey, round(1 - a.value, 6) inverted, round(b.value * 0.3E0 + least(b.value, a.value) * 0.7E0, 6) green FROM u a JOIN u b USING (frame, x, y) WHERE a.c = 0 AND b.c = 1""")
def flipped_channels(spark, sf_dir):
    u = _unique(spark, sf_dir)
    both = u.where("c = 0").select("frame", "x", "y", F.col("value").alias("a")).join(u.where("c = 1").select("frame", "x", "y", F.col("value").alias("b")), ["frame", "x", "y"])
    f = stack.flip(stack.flip(both, width=40), height=25)
    a, b = F.col("a"), F.col("b")
    return f.select("frame", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), r(stack.luminance(a, b, a)).alias("grey"), r(F.lit(1.0) - a).alias("inverted"), r(stack.scnr(a, b, a, 0.7)).alias("green"))


# ---- matching by order ----------------------------------------------------------------------------------------------

_SHIFTED = "t AS (SELECT frame, idx, x + (idx % 7 - 3) / 3.0E0 u, y + (idx % 5 - 2) / 3.0E0 AS v FROM s)"


@query(f"""WITH RECURSIVE {STARS}, s AS (SELECT DISTINCT frame, idx, x, y, idx % 97 ord FROM stars), {_SHIFTED}, c AS (SELECT s.frame, s.idx, s.ord, t.idx r_idx, pow(s.x - u, 2) + pow(s.y - v, 2) d FROM s JOIN t ON s.frame = t.frame AND pow(s.x - u, 2) + pow(s.y - v, 2) <= 900),
g AS (SELECT frame, list({{'a': idx, 'b': r_idx}} ORDER BY ord, idx, d, r_idx) p FROM c GROUP BY 1), w AS (SELECT frame, p, CAST(1 AS BIGINT) i, [p[1].a] l, [p[1].b] q, [p[1]] k FROM g
UNION ALL SELECT frame, p, i + 1, CASE WHEN ok THEN list_append(l, p[i + 1].a) ELSE l END, CASE WHEN ok THEN list_append(q, p[i + 1].b) ELSE q END, CASE WHEN ok THEN list_append(k, p[i + 1]) ELSE k END FROM (SELECT *, NOT list_contains(l, p[i + 1].a) AND NOT list_contains(q, p[i + 1].b) ok FROM w WHERE i < len(p))),
m AS (SELECT frame, unnest(k) e FROM w WHERE i = len(p)) SELECT s.frame, s.idx, m.e.b r_idx FROM s LEFT JOIN m ON m.frame = s.frame AND m.e.a = s.idx""")
def match_in_order(spark, sf_dir):
    """Each star in turn takes the nearest shifted one that is left."""
    s = stars(spark, sf_dir).select("frame", "idx", "x", "y").distinct().withColumn("ord", F.pmod("idx", F.lit(97)))
    t = s.select("frame", "idx", (F.col("x") + (F.pmod("idx", F.lit(7)) - 3) / 3.0).alias("x"), (F.col("y") + (F.pmod("idx", F.lit(5)) - 2) / 3.0).alias("y"))
    return stack.assign_in_order(s, t, "frame", "idx", "ord", 30.0).select("frame", "idx", "r_idx")


@query(f"""WITH RECURSIVE {STARS}, s AS (SELECT frame, idx, any_value(x) x, any_value(y) y, max(flux) flux FROM stars GROUP BY ALL), g AS (SELECT frame, list({{'i': idx, 'x': x, 'y': y}} ORDER BY flux DESC, idx) p FROM s GROUP BY 1),
w AS (SELECT frame, p, CAST(1 AS BIGINT) i, [p[1]] k FROM g UNION ALL SELECT frame, p, i + 1, CASE WHEN len(list_filter(k, lambda e: pow(e.x - p[i + 1].x, 2) + pow(e.y - p[i + 1].y, 2) <= 3600)) = 0 THEN list_append(k, p[i + 1]) ELSE k END FROM w WHERE i < len(p))
SELECT frame, e.i idx FROM (SELECT frame, unnest(k) e FROM w WHERE i = len(p))""")
def thinned_stars(spark, sf_dir):
    """The brighter of stars closer than 60 pixels, brightest first."""
    s = stars(spark, sf_dir).groupBy("frame", "idx").agg(F.max("flux").alias("flux"), F.min("x").alias("x"), F.min("y").alias("y"))
    return stack.thin_out(s, "frame", "idx", ["flux"], 60.0).select("frame", "idx")


@query(f"""WITH {STARS}, s AS (SELECT DISTINCT frame, idx, x, y, flux FROM stars) SELECT frame, min_by(idx, (pow(x - 600, 2) + pow(y - 500, 2), idx)) nearest, min_by(idx, (-flux / (1 + pow(x - 600, 2) + pow(y - 500, 2)), idx)) best, count(*) n FROM s WHERE x BETWEEN 100 AND 1150 AND y BETWEEN 100 AND 1150 GROUP BY 1""")
def guide_star_choice(spark, sf_dir):
    """The star nearest to a point, and the best by a score, away from the edges."""
    s = stars(spark, sf_dir).select("frame", "idx", "x", "y", "flux").distinct().where("x BETWEEN 100 AND 1150 AND y BETWEEN 100 AND 1150")
    d = F.pow(F.col("x") - 600, 2) + F.pow(F.col("y") - 500, 2)
    return s.groupBy("frame").agg(F.min(F.struct(d, "idx"))["idx"].alias("nearest"), F.min(F.struct(-F.col("flux") / (d + 1), "idx"))["idx"].alias("best"), F.count("*").alias("n"))


@query(f"""WITH {STARS}, s AS (SELECT DISTINCT frame, idx, flux, idx % 13 + 1.0E0 snr, idx % 5 + 1.0E0 hfd FROM stars) SELECT frame, idx, CAST(row_number() OVER (PARTITION BY frame ORDER BY greatest(0.25E0, snr) * sqrt(greatest(1, flux)) / greatest(0.25E0, hfd) DESC, snr DESC, flux DESC, idx) AS INTEGER) rank FROM s""")
def ranked_by_quality(spark, sf_dir):
    s = stars(spark, sf_dir).select("frame", "idx", "flux").distinct().withColumn("snr", F.pmod("idx", F.lit(13)) + 1.0).withColumn("hfd", F.pmod("idx", F.lit(5)) + 1.0)
    q = F.greatest(F.lit(0.25), F.col("snr")) * F.sqrt(F.greatest(F.lit(1.0), F.col("flux"))) / F.greatest(F.lit(0.25), F.col("hfd"))
    return s.select("frame", "idx", F.row_number().over(Window.partitionBy("frame").orderBy(q.desc(), F.desc("snr"), F.desc("flux"), "idx")).alias("rank"))


# ---- fits -----------------------------------------------------------------------------------------------------------

_SMALL = "d AS (SELECT CAST(o_orderkey // 40 AS INTEGER) grp, CAST(o_orderkey % 40 AS DOUBLE) x, o_totalprice / 997.0E0 y FROM orders)"


def _small(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 40).cast("int").alias("grp"), F.pmod("o_orderkey", F.lit(40)).cast("double").alias("x"), (F.col("o_totalprice") / 997.0).alias("y"))


@query(f"""WITH {_SMALL}, s AS (SELECT grp, sum(x * x) s2, sum(x * x * x) s3, sum(pow(x, 4)) s4, sum(x * y) t1, sum(x * x * y) t2, count(DISTINCT x) k FROM d GROUP BY 1)
SELECT grp, round((t1 * s4 - t2 * s3) / (s2 * s4 - s3 * s3), 4) + 0.0E0 c1, round((t2 * s2 - t1 * s3) / (s2 * s4 - s3 * s3), 4) + 0.0E0 c2 FROM s WHERE k >= 8""")
def polynomial_through_zero(spark, sf_dir):
    d = _small(spark, sf_dir)
    big = d.groupBy("grp").agg(F.count_distinct("x").alias("k")).where("k >= 8")
    p = robust.polynomial(d.join(big, "grp", "left_semi"), ["grp"], "x", "y", 2, through_zero=True)
    return p.select("grp", r(F.col("coefficients")[1], 4).alias("c1"), r(F.col("coefficients")[2], 4).alias("c2"))


@query(f"""WITH {_SMALL}, m AS (SELECT *, avg(x) OVER (PARTITION BY grp) m FROM d), s AS (SELECT grp, any_value(m) m, count(*) s0, sum(x - m) s1, sum(pow(x - m, 2)) s2, sum(pow(x - m, 3)) s3, sum(pow(x - m, 4)) s4, sum(y) t0, sum(y * (x - m)) t1, sum(y * pow(x - m, 2)) t2 FROM m GROUP BY 1 HAVING count(DISTINCT x) >= 8),
c AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) det FROM s) SELECT grp, round((s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det, 4) + 0.0E0 c2 FROM c""")
def polynomial_fit(spark, sf_dir):
    d = _small(spark, sf_dir)
    big = d.groupBy("grp").agg(F.count_distinct("x").alias("k")).where("k >= 8")
    return robust.polynomial(d.join(big, "grp", "left_semi"), ["grp"], "x", "y", 2).select("grp", r(F.col("coefficients")[2], 4).alias("c2"))


@query(f"""WITH {STARS}, p AS (SELECT DISTINCT frame, idx, x, y, 0.9E0 * x - 0.2E0 * y + 5 + idx % 3 u, 0.3E0 * x + 1.1E0 * y - 3 + idx % 5 AS v FROM stars), m AS (SELECT *, avg(x) OVER w mx, avg(y) OVER w my, avg(u) OVER w mu, avg(v) OVER w mv FROM p WINDOW w AS (PARTITION BY frame)),
s AS (SELECT frame, count(*) n, any_value(mx) mx, any_value(my) my, any_value(mu) mu, any_value(mv) mv, sum((x - mx) * (x - mx)) xx, sum((x - mx) * (y - my)) xy, sum((y - my) * (y - my)) yy, sum((x - mx) * (u - mu)) xu, sum((y - my) * (u - mu)) yu, sum((x - mx) * (v - mv)) xv, sum((y - my) * (v - mv)) yv FROM m GROUP BY 1)
SELECT frame, round((xu * yy - yu * xy) / (xx * yy - xy * xy), 5) a, round((yu * xx - xu * xy) / (xx * yy - xy * xy), 5) b, round((xv * yy - yv * xy) / (xx * yy - xy * xy), 5) d, round((yv * xx - xv * xy) / (xx * yy - xy * xy), 5) e FROM s WHERE n >= 8""")
def affine_fit(spark, sf_dir):
    s = stars(spark, sf_dir).select("frame", "idx", "x", "y").distinct()
    d = s.select("frame", "x", "y", (F.col("x") * 0.9 - F.col("y") * 0.2 + 5 + F.pmod("idx", F.lit(3))).alias("u"), (F.col("x") * 0.3 + F.col("y") * 1.1 - 3 + F.pmod("idx", F.lit(5))).alias("v"))
    big = d.groupBy("frame").agg(F.count("*").alias("n")).where("n >= 8")
    return robust.affine(d.join(big, "frame", "left_semi"), ["frame"]).select("frame", *(r(k, 5).alias(k) for k in "abde"))


@query("""SELECT o_orderpriority grp, TRUE near FROM orders GROUP BY 1""")
def approximate_medians(spark, sf_dir):
    """Sketched medians whose rank is within a hundredth of the middle."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("v"))
    m = robust.approximate_median(o, ["grp"], "v")
    d = o.join(m, "grp")
    return d.groupBy("grp").agg((F.abs(F.avg(F.when(F.col("v") <= F.col("median"), 1.0).otherwise(0.0)) - 0.5) < 0.01).alias("near"))


@query("""WITH d AS (SELECT CAST(l_suppkey % 10 AS INTEGER) grp, l_extendedprice / 1000 mean, l_quantity * 2 + l_extendedprice / 1000 * 0.5E0 variance FROM lineitem) SELECT grp, round(regr_slope(variance, mean), 6) slope FROM d WHERE mean BETWEEN 10 AND 80 GROUP BY 1""")
def photon_transfer(spark, sf_dir):
    """The gain line of variances against means within a range of means."""
    l = table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(10)).cast("int").alias("grp"), (F.col("l_extendedprice") / 1000).alias("mean"), (F.col("l_quantity") * 2 + F.col("l_extendedprice") / 1000 * 0.5).alias("variance"))
    p = mount.photon_transfer(l, ["grp"], 10.0, 80.0)
    return p.select("grp", r(F.lit(1.0) / F.col("gain")).alias("slope"))


# ---- series and events ----------------------------------------------------------------------------------------------


@query(f"""WITH {SAMPLES}, p AS (SELECT * FROM samples) SELECT event_id, user_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) k FROM p) WHERE k <= 8""")
def ring_buffer_retention(spark, sf_dir):
    """The last eight samples of each series."""
    return series.last_rows(samples(spark, sf_dir), "user_id", ["ts", "event_id"], 8).select("event_id", "user_id", r("value", 4).alias("value"))


@query("""WITH b AS (SELECT CAST(k AS INTEGER) body, k + 2.0E0 a, 1.3E0 + k * 0.7E0 w FROM range(4) t(k)), s AS (SELECT i step, body, a * cos(w * i / 20.0E0) x, a * sin(w * i / 20.0E0) * 0.1E0 y FROM range(2000) g(i), b),
n AS (SELECT p.step, p.body a, q.body b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) gap FROM s p JOIN s q ON p.step = q.step AND p.body < q.body), h AS (SELECT * FROM n WHERE gap < 0.4), r AS (SELECT *, sum(CASE WHEN step - lag_ > 1 OR lag_ IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY step) run FROM (SELECT *, lag(step) OVER (PARTITION BY a, b ORDER BY step) lag_ FROM h))
SELECT a, b, min(step) AS "start", max(step) AS "end", count(*) n FROM r GROUP BY a, b, run""")
def mutual_events(spark, sf_dir):
    """Runs of times at which two of a planet's moons are in front of each other."""
    k = F.col("k")
    grid = spark.range(2000).select(F.col("id").alias("step"), F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("k"))
    a, w = k + 2.0, k * 0.7 + 1.3
    t = F.col("step") / 20.0
    s = grid.select("step", F.col("k").alias("body"), (a * F.cos(w * t)).alias("x"), (a * F.sin(w * t) * 0.1).alias("y"), F.lit(0.2).alias("reach"))
    return joins.overlap_events(joins.all_pairs_of_bodies(s, "step", "body", "x", "y", "reach"), ["a", "b"], "step", 1)


@query(f"""WITH {SKY}, m AS (SELECT id file, 0.5E0 + id % 40 low, 0.5E0 + id % 40 + 2 AS high, ra, decl, 0.05E0 + (id % 5) * 0.02E0 radius FROM sky) SELECT file FROM m WHERE low <= 20 AND high >= 12 AND 2 * asin(sqrt(least(1, pow(sin((decl - 0.2E0) / 2), 2) + cos(decl) * cos(0.2E0) * pow(sin((ra - 1) / 2), 2)))) <= radius + 0.3E0""")
def index_file_selection(spark, sf_dir):
    """Files of a manifest whose scales and discs meet the ones asked for."""
    k = F.pmod("id", F.lit(40))
    m = sky(spark, sf_dir).select(F.col("id").alias("file"), (k + 0.5).alias("low"), (k + 2.5).alias("high"), "ra", "decl", (F.pmod("id", F.lit(5)) * 0.02 + 0.05).alias("radius"))
    return joins.select_index_files(m, 12.0, 20.0, (1.0, 0.2, 0.3)).select("file")


@query("""WITH h AS (SELECT o_custkey % 20 AS k, CAST(o_orderkey % 400 AS DOUBLE) t, o_orderkey seq, o_totalprice / 997.0E0 AS v FROM orders), p AS (SELECT l_orderkey id, l_linenumber line, l_suppkey % 20 AS k, (l_partkey % 4400) / 10.0E0 - 20 t FROM lineitem),
q AS (SELECT DISTINCT k, t FROM p), a AS (SELECT q.k, q.t, max_by({'t': h.t, 'v': h.v}, (h.t, h.seq)) a FROM q LEFT JOIN h ON h.k = q.k AND h.t <= q.t GROUP BY 1, 2), b AS (SELECT q.k, q.t, min_by({'t': h.t, 'v': h.v}, (h.t, h.seq)) b FROM q LEFT JOIN h ON h.k = q.k AND h.t >= q.t GROUP BY 1, 2)
SELECT DISTINCT id, line, round(CASE WHEN a.a.t = t THEN a.a.v WHEN a.a IS NOT NULL AND b.b IS NOT NULL THEN a.a.v + (b.b.v - a.a.v) * (t - a.a.t) / (b.b.t - a.a.t) END, 5) AS v FROM p JOIN a USING (k, t) JOIN b USING (k, t)""")
def path_history(spark, sf_dir):
    """A recorded path's value at points in time, jumps kept, nothing beyond its ends."""
    h = _orders(spark, sf_dir).select(F.pmod("c", F.lit(20)).alias("k"), F.pmod("id", F.lit(400)).cast("double").alias("t"), F.col("id").alias("seq"), (F.col("p") / 997.0).alias("v"))
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.pmod("l_suppkey", F.lit(20)).alias("k"), (F.pmod("l_partkey", F.lit(4400)) / 10.0 - 20).alias("t"))
    return joins.history_at(p, h, "k", "t", ["v"], "seq").select("id", "line", r("v", 5).alias("v")).distinct()


@query("""WITH p AS (SELECT o_orderkey id, CAST(o_custkey % 5 AS INTEGER) k, CAST(o_orderkey % 1000 AS DOUBLE) x FROM orders), b AS (SELECT CAST(l_suppkey % 5 AS INTEGER) k, CAST(300 + l_partkey % 300 AS DOUBLE) x, avg(l_quantity) / 0.997E0 y FROM lineitem GROUP BY ALL), a AS (SELECT CAST(l_suppkey % 5 AS INTEGER) k, CAST(l_partkey % 800 AS DOUBLE) x, avg(l_extendedprice) / 997.0E0 y FROM lineitem GROUP BY ALL),
ib AS (SELECT p.id, max_by({'x': b.x, 'y': b.y}, b.x) FILTER (b.x <= p.x) lo, min_by({'x': b.x, 'y': b.y}, b.x) FILTER (b.x >= p.x) hi, any_value(p.x) x FROM p JOIN b USING (k) GROUP BY 1), ia AS (SELECT p.id, max_by({'x': a.x, 'y': a.y}, a.x) FILTER (a.x <= p.x) lo, min_by({'x': a.x, 'y': a.y}, a.x) FILTER (a.x >= p.x) hi, any_value(p.x) x FROM p JOIN a USING (k) GROUP BY 1),
vb AS (SELECT id, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN lo.x = hi.x THEN lo.y ELSE lo.y + (hi.y - lo.y) * (x - lo.x) / (hi.x - lo.x) END END v FROM ib), va AS (SELECT id, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN lo.x = hi.x THEN lo.y ELSE lo.y + (hi.y - lo.y) * (x - lo.x) / (hi.x - lo.x) END WHEN lo IS NULL THEN hi.y ELSE lo.y END v FROM ia)
SELECT id, round(coalesce(vb.v, va.v), 5) y FROM vb JOIN va USING (id)""")
def priority_interpolation(spark, sf_dir):
    """Values from the first table whose range holds the point, else from the last."""
    p = _orders(spark, sf_dir).select("id", F.pmod("c", F.lit(5)).cast("int").alias("k"), F.pmod("id", F.lit(1000)).cast("double").alias("x"))
    l = table(spark, sf_dir, "lineitem")
    k = F.pmod("l_suppkey", F.lit(5)).cast("int").alias("k")
    b = l.groupBy(k, (F.pmod("l_partkey", F.lit(300)) + 300).cast("double").alias("x")).agg((F.avg("l_quantity") / 0.997).alias("y"))
    a = l.groupBy(k, F.pmod("l_partkey", F.lit(800)).cast("double").alias("x")).agg((F.avg("l_extendedprice") / 997.0).alias("y"))
    return joins.asof_priority(p, [b, a], "k", "x", "y").select("id", r("y", 5).alias("y"))


_POLY = region.Polygon(((210 * DEG, -10 * DEG), (240 * DEG, -12 * DEG), (250 * DEG, 15 * DEG), (225 * DEG, 30 * DEG), (205 * DEG, 12 * DEG)), mode="spherical")
_HALF = " AND ".join(f"cos(decl) * cos(ra) * {lit(n[0])} + cos(decl) * sin(ra) * {lit(n[1])} + sin(decl) * {lit(n[2])} >= -1e-12" for n in _POLY._normals())


@query(f"WITH {SKY} SELECT 'polygon' AS shape, id FROM sky WHERE {_HALF} UNION ALL SELECT 'box' AS shape, id FROM sky WHERE (ra >= {lit(350 * DEG)} OR ra <= {lit(15 * DEG)}) AND decl BETWEEN {lit(-20 * DEG)} AND {lit(35 * DEG)}")
def cover_shapes(spark, sf_dir):
    """Boxes and polygons by pixels that may touch them, then exactly."""
    from vesperflow.functions import healpix

    s = healpix.with_nested_pixel(sky(spark, sf_dir), "hpx", 32)
    box = region.Box(350.0 * DEG, 15.0 * DEG, -20.0 * DEG, 35.0 * DEG)
    parts = (("polygon", _POLY, healpix.polygon_cover(_POLY._normals(), 32)), ("box", box, healpix.box_cover(box.parts(), 32)))
    found = [s.where(F.col("hpx").isin(cover)).where(shape.exact()).select(F.lit(name).alias("shape"), "id") for name, shape, cover in parts]
    return found[0].unionByName(found[1])


# ---- projections, frames, scales ------------------------------------------------------------------------------------

_LON = f"((ra - 2) - {lit(2 * math.pi)} * ceil((ra - 2 - {lit(math.pi)}) / {lit(2 * math.pi)}))"


def _cyl_sql(name: str) -> str:
    family, k = sphere._family(name, None)
    y = {"web": f"asinh(tan(greatest(-{lit(sphere.WEB_LIMIT)}, least({lit(sphere.WEB_LIMIT)}, decl))))", "central": "tan(decl)", "area": f"sin(decl) / {lit(k)}", "stereographic": f"tan(decl / 2) * {lit(1 + k)}", "miller": f"1.25E0 * ln(tan(0.4E0 * decl + {lit(math.pi / 4)}))"}[family]
    return f"round({_LON} * {lit(k)}, 6) + 0.0E0 {name}_x, round({y}, 5) + 0.0E0 {name}_y"


_CYL = ("web_mercator", "miller", "central", "lambert", "behrmann", "gall_peters", "hobo_dyer", "balthasart", "trystan_edwards", "braun", "gall")


@query(f"WITH {SKY} SELECT id, {', '.join(map(_cyl_sql, _CYL))} FROM sky WHERE abs(decl) < 1.4")
def cylindrical_projections(spark, sf_dir):
    s = sky(spark, sf_dir).where("abs(decl) < 1.4D")
    both = {n: sphere.cylindrical(n, "ra", "decl", 2.0) for n in _CYL}
    return s.select("id", *(r(xy[0]).alias(f"{n}_x") for n, xy in both.items()), *(r(xy[1], 5).alias(f"{n}_y") for n, xy in both.items()))


_ROUND = ("gnomonic", "stereographic", "orthographic", "azimuthal_equidistant", "azimuthal_equal_area")


@query(f"WITH {SKY} SELECT id, {', '.join(f'round(ra, 6) + 0.0E0 ra_{i}, round(decl, 6) + 0.0E0 decl_{i}' for i in range(8))} FROM sky WHERE sin(decl) * {lit(math.sin(0.4))} + cos(decl) * {lit(math.cos(0.4))} * cos(ra - 2) > 0.2 AND abs(decl) < 1.4 AND ra > 0.001")
def projection_round_trips(spark, sf_dir):
    """Projected and taken back: azimuthal ones, Mercator's, an equal-area one and Mercator's of an ellipsoid."""
    s = sky(spark, sf_dir).where((F.sin("decl") * math.sin(0.4) + F.cos("decl") * math.cos(0.4) * F.cos(F.col("ra") - 2.0) > 0.2) & (F.abs("decl") < 1.4) & (F.col("ra") > 0.001))
    back = [sphere.azimuthal_inverse(n, *sphere.PROJECTIONS[n]("ra", "decl", 2.0, 0.4), 2.0, 0.4) for n in _ROUND]
    for name, e in (("mercator", 0.0), ("gall_peters", 0.0), ("ellipsoidal", 0.0818191908)):
        x, y = sphere.cylindrical(name, "ra", "decl", 2.0, eccentricity=e)
        back.append(sphere.cylindrical_inverse(name, x, y, 2.0, eccentricity=e))
    return s.select("id", *(r(a).alias(f"ra_{i}") for i, (a, _) in enumerate(back)), *(r(d).alias(f"decl_{i}") for i, (_, d) in enumerate(back)))


_M0 = "datediff('day', DATE '1858-11-17', CAST(ts AS DATE)) - 60310.0E0 + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400e6"


@query(f"""WITH t AS (SELECT event_id, {_M0} u FROM events), a AS (SELECT *, u + 37 / 86400.0E0 tai, u + 69.184E0 / 86400 tt FROM t), g AS (SELECT *, (tt + 60310 - 51544.5E0) * {lit(0.98560028 * math.pi / 180)} + {lit(357.53 * math.pi / 180)} g FROM a)
SELECT event_id, round((tai - u) * 86400, 4) tai, round((tt - u) * 86400, 4) tt, round((0.001657E0 * sin(g) + 0.000022E0 * sin(2 * g)) * 1000, 2) + 0.0E0 tdb_ms, round(u, 6) back FROM g""")
def time_scales(spark, sf_dir):
    """UTC to TAI, TT and TDB, and back from TAI."""
    from vesperflow.functions import time as times

    e = table(spark, sf_dir, "events").withColumn("u", times.from_timestamp("ts"))
    e = e.withColumn("tai", times.utc_to_tai(F.col("u"))).withColumn("tt", times.tai_to_tt(F.col("tai"))).withColumn("tdb", times.tt_to_tdb(F.col("tt")))
    d = lambda a, b, k: times.difference(F.col(a), F.col(b)) * k
    return e.select("event_id", r(d("tai", "u", 86400.0), 4).alias("tai"), r(d("tt", "u", 86400.0), 4).alias("tt"), r(d("tdb", "tt", 86400e3), 2).alias("tdb_ms"), r(times.mjd(times.tai_to_utc(F.col("tai"))) - 60310.0, 6).alias("back"))


# ---- frames of a stack ----------------------------------------------------------------------------------------------


def _norm_sql(lo: float, hi: float) -> str:
    q = f"quantile_cont(u.value, {lo}) a1, quantile_cont(u.value, {hi}) a3, quantile_cont(r.value, {lo}) b1, quantile_cont(r.value, {hi}) b3"
    return f"WITH {PIXELS}, {_UNIQUE}, q AS (SELECT u.frame, u.c, {q} FROM u JOIN (SELECT * FROM u WHERE frame = 0) r USING (x, y, c) GROUP BY ALL)"


@query(f"{_norm_sql(0.1, 0.9)}, m AS (SELECT u.frame, median(r.value) / median(u.value) ratio FROM u JOIN (SELECT * FROM u WHERE frame = 0) r USING (x, y, c) GROUP BY 1) SELECT frame, c, round((b3 - b1) / (a3 - a1), 6) AS scale, round(b1 - (b3 - b1) / (a3 - a1) * a1, 6) + 0.0E0 AS \"offset\", round(ratio, 6) ratio FROM q JOIN m USING (frame) WHERE a3 > a1")
def frame_normalization_modes(spark, sf_dir):
    """Spans of tenths by channel, and ratios of medians."""
    u = _unique(spark, sf_dir)
    ref = u.where("frame = 0")
    ratio = stack.normalisation(u, ref, mode="scale").select("frame", r("scale").alias("ratio"))
    return stack.normalisation(u, ref, mode="percentile", channels=True).join(ratio, "frame").select("frame", "c", r("scale").alias("scale"), r("offset").alias("offset"), "ratio")


@query("""WITH f AS (SELECT CAST(o_custkey % 50 AS INTEGER) grp, o_custkey frame, count(*) n FROM orders GROUP BY ALL) SELECT grp, coalesce(min(frame) FILTER (n >= 12), min(frame)) AS "first", list_sort(list(frame))[4] AS fourth FROM f GROUP BY 1""")
def reference_frame_modes(spark, sf_dir):
    """The first frame with enough stars, and the one at a place."""
    f = table(spark, sf_dir, "orders").groupBy(F.pmod("o_custkey", F.lit(50)).cast("int").alias("grp"), F.col("o_custkey").alias("frame")).agg(F.count("*").alias("n"))
    first = stack.reference_frame(f, ["grp"], "first", least=12).withColumnRenamed("frame", "first")
    return first.join(stack.reference_frame(f, ["grp"], "index", index=3).withColumnRenamed("frame", "fourth"), "grp", "left")


@query(f"""WITH {PIXELS}, {_UNIQUE}, k AS (SELECT * FROM u WHERE frame > 4), b AS (SELECT * FROM u WHERE frame = 1), d AS (SELECT * FROM u WHERE frame = 2), f AS (SELECT x, y, c, value + 1 AS value FROM u WHERE frame = 3), e AS (SELECT * FROM u WHERE frame = 4),
l AS (SELECT f.c, f.x % 2 px, f.y % 2 py, avg(f.value - e.value) lev FROM f JOIN e USING (x, y, c) GROUP BY ALL) SELECT k.frame, k.x, k.y, k.c, round((k.value - b.value - (d.value - b.value) * 0.5E0) / (f.value - e.value) * lev, 6) + 0.0E0 AS value
FROM k JOIN b USING (x, y, c) JOIN d USING (x, y, c) JOIN f USING (x, y, c) JOIN e USING (x, y, c) JOIN l ON l.c = k.c AND l.px = k.x % 2 AND l.py = k.y % 2 WHERE f.value > e.value""")
def calibrate_by_phase(spark, sf_dir):
    """Calibration with the flats' own dark and means by place in the colour mosaic."""
    u = _unique(spark, sf_dir)
    one = lambda k: u.where(F.col("frame") == k)
    flat = one(3).withColumn("value", F.col("value") + 1)
    out = stack.calibrate(u.where("frame > 4"), one(1), one(2), flat, 0.5, dark_flat=one(4), phase=True)
    return out.where("value IS NOT NULL").select("frame", "x", "y", "c", r("value").alias("value"))


@query(f"""WITH {PIXELS}, {_UNIQUE}, m AS (SELECT frame, c, median(value) FILTER (value BETWEEN 0.05 AND 0.9) m FROM u GROUP BY ALL), t AS (SELECT u.frame, x, y, u.c, value - m AS v FROM u JOIN m ON m.frame = u.frame AND m.c = u.c), s AS (SELECT frame, min(v) lo, max(v) hi FROM t GROUP BY 1)
SELECT t.frame, x, y, c, round(least(1, greatest(0, v + 0.1E0)), 6) + 0.0E0 target, round((v - lo) / (hi - lo), 6) + 0.0E0 scaled FROM t JOIN s USING (frame)""")
def background_neutralised(spark, sf_dir):
    u = _unique(spark, sf_dir)
    a = stack.neutralise(u, target=0.1, low=0.05, high=0.9).withColumn("target", r("value")).drop("value")
    b = stack.neutralise(u, mode="rescale", low=0.05, high=0.9).withColumn("scaled", r("value")).drop("value")
    return a.join(b, ["frame", "x", "y", "c"]).select("frame", "x", "y", "c", "target", "scaled")


# ---- cross-match ----------------------------------------------------------------------------------------------------

_CRA, _CDEC, _CRAD, _CSCALE = 2.0, 0.2, 0.25, 1e-3
_XC = f"cos(decl) * sin(ra - {lit(_CRA)})"
_YC = f"(sin(decl) * {lit(math.cos(_CDEC))} - cos(decl) * {lit(math.sin(_CDEC))} * cos(ra - {lit(_CRA)}))"
_CC = f"(sin(decl) * {lit(math.sin(_CDEC))} + cos(decl) * {lit(math.cos(_CDEC))} * cos(ra - {lit(_CRA)}))"


@query(f"""WITH {SKY}, cone AS (SELECT id, mag, {_XC} / {_CC} / {lit(_CSCALE)} x, {_YC} / {_CC} / {lit(_CSCALE)} y FROM sky WHERE atan2(sqrt(pow({_XC}, 2) + pow({_YC}, 2)), {_CC}) <= {lit(_CRAD)}), t AS (SELECT id FROM cone ORDER BY mag, id LIMIT 120)
SELECT cone.id idx, t.id FROM cone LEFT JOIN t USING (id) WHERE cone.id % 5 <> 0 UNION ALL SELECT -cone.id - 1 idx, NULL id FROM cone WHERE cone.id % 9 = 0""")
def image_catalogue_match(spark, sf_dir):
    """Detections made of the stars of a cone, turned, scaled and moved, with false ones far from any: each is matched to its
    star if that is among the brightest, and to none if not."""
    from vesperflow.operators import crossmatch

    s = sky(spark, sf_dir)
    cat = crossmatch.project(s, _CRA, _CDEC, _CRAD, _CSCALE)
    turn, size = 0.4, 1.7
    x, y = ((F.col("x") * math.cos(turn) - F.col("y") * math.sin(turn)) * size + 500, (F.col("x") * math.sin(turn) + F.col("y") * math.cos(turn)) * size + 400)
    real = cat.where("id % 5 != 0").select(F.col("id").alias("idx"), x.alias("x"), y.alias("y"), F.pow(F.lit(10.0), F.col("mag") * -0.4).alias("flux"))
    false = cat.where("id % 9 = 0").select((-F.col("id") - 1).alias("idx"), (x + 5000).alias("x"), (y - 5000).alias("y"), F.lit(1e-9).alias("flux"))
    seen = real.unionByName(false)
    found = crossmatch.solve(seen, s, _CRA + 2e-3, _CDEC - 1e-3, _CRAD + 0.01, _CSCALE, (500.0, 400.0))
    # stars of the query's own cone only, as the moved centre's reaches a little farther
    inside = s.join(cat.select("id"), "id", "left_semi")
    return crossmatch.match(seen, inside, found, math.pi / 3, _CSCALE, within=0.05, top=120).select("idx", "id")


@query(f"""WITH d AS (SELECT CAST(l_suppkey % 10 AS INTEGER) grp, l_quantity x, l_extendedprice / 1000.0E0 y, l_discount + 0.01E0 w FROM lineitem), m AS (SELECT grp, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my FROM d GROUP BY 1)
SELECT grp, round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)), 6) slope, round(any_value(my) - sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) * any_value(mx), 5) intercept, count(*) n FROM d JOIN m USING (grp) GROUP BY 1""")
def weighted_model_fit(spark, sf_dir):
    """Least squares of a model's terms from sums of products, a group's few solved at the end."""
    l = table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(10)).cast("int").alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_discount") + 0.01).alias("w"))
    f = models.fit_sums(l, ["grp"], {"one": F.lit(1.0), "x": F.col("x")}, "y", "w")
    return f.select("grp", r(F.element_at("coefficients", "x")).alias("slope"), r(F.element_at("coefficients", "one"), 5).alias("intercept"), "n")


# ---- apparent places ------------------------------------------------------------------------------------------------


def _nutation_sql(t: str) -> tuple[str, str]:
    node, sun, moon = (f"(({lit(a)} + {lit(b)} * {t}) * {lit(DEG)})" for a, b in ((125.04452, -1934.136261), (280.4665, 36000.7698), (218.3165, 481267.8813)))
    arc = lit(math.pi / 648000)
    return f"((-17.20E0 * sin({node}) - 1.32E0 * sin(2 * {sun}) - 0.23E0 * sin(2 * {moon}) + 0.21E0 * sin(2 * {node})) * {arc})", f"((9.20E0 * cos({node}) + 0.57E0 * cos(2 * {sun}) + 0.10E0 * cos(2 * {moon}) - 0.09E0 * cos(2 * {node})) * {arc})"


@query(f"WITH t AS (SELECT event_id, (datediff('day', DATE '2000-01-01', CAST(ts AS DATE)) - 0.5E0 + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400e6) / 36525 t FROM events) SELECT event_id, round({_nutation_sql('t')[0]}, 10) + 0.0E0 longitude, round({_nutation_sql('t')[1]}, 10) + 0.0E0 obliquity FROM t")
def nutation_angles(spark, sf_dir):
    from vesperflow.functions import apparent
    from vesperflow.functions import time as times

    e = table(spark, sf_dir, "events").withColumn("n", apparent.nutation(apparent.centuries(times.from_timestamp("ts"))))
    return e.select("event_id", r("n.longitude", 10).alias("longitude"), r("n.obliquity", 10).alias("obliquity"))


_AT = 0.2318  # centuries from 2000


def _apparent_sql() -> str:
    t, arc = _AT, math.pi / 648000
    node, sun, moon = ((a + b * t) * DEG for a, b in ((125.04452, -1934.136261), (280.4665, 36000.7698), (218.3165, 481267.8813)))
    lon = (-17.20 * math.sin(node) - 1.32 * math.sin(2 * sun) - 0.23 * math.sin(2 * moon) + 0.21 * math.sin(2 * node)) * arc
    obl = (9.20 * math.cos(node) + 0.57 * math.cos(2 * sun) + 0.10 * math.cos(2 * moon) - 0.09 * math.cos(2 * node)) * arc
    m = (357.52911 + t * (35999.05029 - 0.0001537 * t)) * DEG
    s = (280.46646 + t * (36000.76983 + 0.0003032 * t) + (1.914602 - t * (0.004817 + 0.000014 * t)) * math.sin(m) + (0.019993 - 0.000101 * t) * math.sin(2 * m) + 0.000289 * math.sin(3 * m)) * DEG
    ecc, peri, k, e = 0.016708634 - t * (0.000042037 + 0.0000001267 * t), (102.93735 + t * (1.71946 + 0.00046 * t)) * DEG, 20.49552 * arc, 0.409
    ra = lambda x: f"(cos(ra) * {lit(math.cos(x) * math.cos(e))} + sin(ra) * {lit(math.sin(x))}) / cos(decl)"
    dec = lambda x: f"({lit(math.cos(x) * math.cos(e))} * ({lit(math.tan(e))} * cos(decl) - sin(ra) * sin(decl)) + cos(ra) * sin(decl) * {lit(math.sin(x))})"
    da = f"(({lit(math.cos(e))} + {lit(math.sin(e))} * sin(ra) * tan(decl)) * {lit(lon)} - cos(ra) * tan(decl) * {lit(obl)} - {lit(k)} * {ra(s)} + {lit(ecc * k)} * {ra(peri)})"
    dd = f"({lit(math.sin(e) * lon)} * cos(ra) + sin(ra) * {lit(obl)} - {lit(k)} * {dec(s)} + {lit(ecc * k)} * {dec(peri)})"
    return f"WITH {SKY} SELECT id, round({da}, 9) + 0.0E0 da, round({dd}, 9) + 0.0E0 dd FROM sky WHERE abs(decl) < 1.5 AND ra BETWEEN 0.01 AND 6.27"


@query(_apparent_sql())
def apparent_places(spark, sf_dir):
    """How nutation and aberration move the stars."""
    from vesperflow.functions import apparent

    s = sky(spark, sf_dir).where("abs(decl) < 1.5D AND ra BETWEEN 0.01D AND 6.27D")
    s = s.withColumn("p", apparent.apparent_place("ra", "decl", F.lit(_AT), F.lit(0.409)))
    return s.select("id", r(F.col("p.ra") - F.col("ra"), 9).alias("da"), r(F.col("p.decl") - F.col("decl"), 9).alias("dd"))


def _season_sql() -> str:
    from vesperflow.functions.apparent import SEASON_TERMS, SEASONS

    mean = " ".join(f"WHEN {k} THEN {' + '.join(f'{lit(c)} * pow(y, {i})' for i, c in enumerate(row))}" for k, row in enumerate(SEASONS))
    terms = " + ".join(f"{a} * cos(({lit(b)} + {lit(c)} * t) * {lit(DEG)})" for a, b, c in SEASON_TERMS)
    return f"""WITH g AS (SELECT CAST(1800 + a AS INTEGER) "year", CAST(b AS INTEGER) season, (a - 200) / 1000.0E0 y FROM range(400) i(a), range(4) j(b)), m AS (SELECT *, CASE season {mean} END j FROM g), t AS (SELECT *, (j - 2451545) / 36525 t FROM m)
    SELECT "year", season, round(j + 0.00001E0 * ({terms}) / (1 + 0.0334E0 * cos((35999.373E0 * t - 2.47E0) * {lit(DEG)}) + 0.0007E0 * cos(2 * (35999.373E0 * t - 2.47E0) * {lit(DEG)})), 5) jd FROM t"""


@query(_season_sql())
def seasons(spark, sf_dir):
    """The beginnings of the seasons of four centuries."""
    from vesperflow.functions.apparent import season_jd

    g = spark.range(1600).select((F.floor(F.col("id") / 4) + 1800).cast("int").alias("year"), F.pmod("id", F.lit(4)).cast("int").alias("season"))
    return g.select("year", "season", r(season_jd("year", "season"), 5).alias("jd"))


#: The eclipses of six years as the almanacs list them.
_ECLIPSES = {
    "sun": "2021-06-10 annular, 2021-12-04 total, 2022-04-30 partial, 2022-10-25 partial, 2023-04-20 hybrid, 2023-10-14 annular, 2024-04-08 total, 2024-10-02 annular, 2025-03-29 partial, 2025-09-21 partial, 2026-02-17 annular, 2026-08-12 total",
    "moon": "2021-05-26 total, 2021-11-19 partial, 2022-05-16 total, 2022-11-08 total, 2023-05-05 penumbral, 2023-10-28 partial, 2024-03-25 penumbral, 2024-09-18 partial, 2025-03-14 total, 2025-09-07 total, 2026-03-03 total, 2026-08-28 partial",
}


@query('SELECT * FROM (VALUES ' + ", ".join(f"('{x.split()[0]}', '{body}', '{x.split()[1]}')" for body, all_ in _ECLIPSES.items() for x in all_.split(", ")) + ') t("day", body, kind)')
def eclipses_of_six_years(spark, sf_dir):
    """Eclipses of the Sun and the Moon, against the almanacs' list."""
    from vesperflow.operators.eclipses import eclipse_table

    day = F.date_add(F.lit("2000-01-01").cast("date"), F.floor(F.col("jd") - 2451544.5).cast("int"))
    return eclipse_table(spark, 260, 333).select(day.cast("string").alias("day"), "body", "kind").where("day BETWEEN '2021-01-01' AND '2026-12-31'")


_TRANSITS = {"mercury": "2003-05-07 2006-11-08 2016-05-09 2019-11-11", "venus": "2004-06-08 2012-06-06"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{d}')" for p, days in _TRANSITS.items() for d in days.split()) + ') t(planet, "day")')
def transits_of_a_quarter_century(spark, sf_dir):
    """Passages of Mercury and Venus before the Sun, against the almanacs' list."""
    from vesperflow.operators import planets

    def run(batches):
        for b in batches:
            for p in b["planet"]:
                t = planets.transits(p, 2451545.0, 2461000.0)
                t.insert(0, "planet", p)
                yield t[["planet", "middle"]]

    found = spark.createDataFrame([(p,) for p in _TRANSITS], "planet string").mapInPandas(run, "planet string, middle double")
    return found.select("planet", F.date_add(F.lit("2000-01-01").cast("date"), F.floor(F.col("middle") - 2451544.5).cast("int")).cast("string").alias("day"))


# ---- planning formulas ----------------------------------------------------------------------------------------------

#: name: (column of a, b, d; the same in SQL); a is 50 to 450, b 1.3 to 9.3, d -1 to 1.
_ARCSEC = lit(f.ARCSEC)
_FORMULAS = {
    "magnification": (lambda a, b, d: f.magnification(a, b), "a / b"), "focal_length": (lambda a, b, d: f.focal_length(a, b), "a * b"), "focal_ratio": (lambda a, b, d: f.focal_ratio(a, b), "a / b"), "dawes": (lambda a, b, d: f.dawes_limit(a), "116 / a"), "rayleigh": (lambda a, b, d: f.rayleigh_limit(a), "138 / a"),
    "faintest": (lambda a, b, d: f.limiting_magnitude(a), "2.7E0 + 5 * log10(a)"), "grasp": (lambda a, b, d: f.light_grasp(a, b), "pow(a / b, 2)"), "pupil": (lambda a, b, d: f.exit_pupil(b, a), "b / a"), "view_field": (lambda a, b, d: f.eyepiece_view(a, F.lit(80.0), b, F.lit(60.0))["field"], "60 / (a / b)"), "view_pupil": (lambda a, b, d: f.eyepiece_view(a, F.lit(80.0), b, F.lit(60.0))["exit_pupil"], "80 / (a / b)"),
    "stop_field": (lambda a, b, d: f.field_stop_fov(b, a), f"b / a * {_DEGS}"), "plate": (lambda a, b, d: f.plate_scale(a), f"{_ARCSEC} / a"), "sampling": (lambda a, b, d: f.sampling_ratio(b, F.lit(1.3)), "b / 1.3E0"), "wanted_focal": (lambda a, b, d: f.recommended_focal_length(b, F.lit(2.0), F.lit(3.0)), f"b * 2 * {lit(f.ARCSEC / 1000)} / 3"), "airy": (lambda a, b, d: f.airy_disk(F.lit(0.55), b), "2.44E0 * 0.55E0 * b"),
    "airy_pixels": (lambda a, b, d: f.airy_disk_pixels(b, F.lit(3.76)), "b / 3.76E0"), "focus_zone": (lambda a, b, d: f.critical_focus_zone(F.lit(0.55), b), "4.88E0 * 0.55E0 * b * b"), "effective": (lambda a, b, d: f.effective_aperture(a, b), "sqrt(a * a - b * b)"), "obstruction": (lambda a, b, d: f.obstruction_ratio(a, b), "100 * b / a"), "diagonal": (lambda a, b, d: f.diagonal_fov(b, a), "2 * atan(b / (2 * a))"),
    "sensor": (lambda a, b, d: f.sensor_fov(b, a), f"b / a * {_DEGS}"), "panels": (lambda a, b, d: f.mosaic_panels(a, b, F.lit(0.25)).cast("double"), "ceil(a / (b * 0.75E0))"), "guide_error": (lambda a, b, d: f.error_pixels(b, F.lit(1.7)), "b / 1.7E0"), "trail": (lambda a, b, d: f.star_trail(d, b, F.lit(1.7)), f"cos(d) * {lit(f.SIDEREAL_RATE)} * b / 1.7E0"), "longest": (lambda a, b, d: f.max_exposure(b, F.lit(1.7), d), f"b * 1.7E0 / (cos(d) * {lit(f.SIDEREAL_RATE)})"),
    "snr_gain": (lambda a, b, d: f.stacking_snr_gain(a), "sqrt(a)"), "range": (lambda a, b, d: f.dynamic_range(a, b), "a / b"), "stops": (lambda a, b, d: f.dynamic_range_stops(a, b), "log2(a / b)"), "saturates": (lambda a, b, d: f.saturation_time(a, b), "a / b"), "sky_limited": (lambda a, b, d: f.sky_limited_exposure(b, a), "b * b * 10 / a"), "total": (lambda a, b, d: f.total_integration(a, b), "a * b"),
    "frames": (lambda a, b, d: f.subframes(a, b), "a / b"), "needed": (lambda a, b, d: f.required_subframes(a, b).cast("double"), "ceil(a / b)"), "dimming": (lambda a, b, d: f.extinction(F.lit(0.2), b), "0.2E0 * b"), "humidity": (lambda a, b, d: f.relative_humidity(b * 3, b), "exp(17.625E0 * b / (243.04E0 + b) - 17.625E0 * b * 3 / (243.04E0 + b * 3)) * 100"),
    "transit_altitude": (lambda a, b, d: f.altitude_at_transit(F.lit(0.4), d), f"{lit(math.pi / 2)} - abs(0.4E0 - d)"), "hour_angle": (lambda a, b, d: f.hour_angle_at(d, F.lit(0.4), F.lit(0.1)), f"acos((sin(0.1E0) - {lit(math.sin(0.4))} * sin(d)) / ({lit(math.cos(0.4))} * cos(d)))"), "apparent_size": (lambda a, b, d: f.angular_diameter(b, a), "2 * atan(b / (2 * a))"), "surface": (lambda a, b, d: f.surface_brightness(b, a), "b + 2.5E0 * log10(a)"),
    "comet": (lambda a, b, d: f.comet_magnitude(b, F.lit(1.4), b, F.lit(10.0)), "b + 5 * log10(1.4E0) + 10 * log10(b)"), "asteroid": (lambda a, b, d: f.asteroid_magnitude(b, b, F.lit(1.4), d), "b + 5 * log10(b * 1.4E0) + d"), "hg": (lambda a, b, d: f.hg_magnitude(b, F.lit(0.15), b, F.lit(1.4), F.abs(d)), "b + 5 * log10(b * 1.4E0) - 2.5E0 * log10(0.85E0 * exp(-3.33E0 * pow(tan(abs(d) / 2), 0.63E0)) + 0.15E0 * exp(-1.87E0 * pow(tan(abs(d) / 2), 1.22E0)))"),
}


_BASE = "WITH o AS (SELECT o_orderkey id, 50.137E0 + o_orderkey % 400 a, 1.3037E0 + (o_custkey % 800) / 101.0E0 b, ((o_orderkey * 7) % 1999 - 999) / 1003.0E0 d FROM orders)"


@query(f"{_BASE} SELECT id, {', '.join(f'round({sql}, 5) + 0.0E0 {name}' for name, (_, sql) in _FORMULAS.items())} FROM o")
def planning_formulas(spark, sf_dir):
    """Closed forms of telescopes, cameras, exposures, air and magnitudes."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), (F.pmod(k, F.lit(400)) + 50.137).alias("a"), (F.pmod("o_custkey", F.lit(800)) / 101.0 + 1.3037).alias("b"), ((F.pmod(k * 7, F.lit(1999)) - 999) / 1003.0).alias("d"))
    return o.select("id", *(r(make(F.col("a"), F.col("b"), F.col("d")), 5).alias(n) for n, (make, _) in _FORMULAS.items()))

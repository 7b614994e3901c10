"""As-of, range, nearest and similarity joins, and ordered-series operators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from vesperflow.operators import joins, robust, series, stack
from vesperflow.plans.common import SAMPLES, SKY, STARS, lit, query, r, samples, sky, stars
from vesperflow.session import materialize, table


@query("""WITH o AS (SELECT o_custkey % 150 user_id, o_orderkey, TIMESTAMP '2024-01-01' + to_seconds(CAST((o_orderkey * 7919) % 2592000 AS INTEGER)) ts FROM orders)
SELECT e.event_id, max_by(o.o_orderkey, (o.ts, o.o_orderkey)) latest FROM events e LEFT JOIN o ON o.user_id = e.user_id AND o.ts <= e.ts GROUP BY 1""")
def asof_latest_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(150)).alias("user_id"), F.col("o_orderkey").alias("latest"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(F.col("o_orderkey") * 7919, F.lit(2592000)).cast("decimal(18,6)"))).alias("ts"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return joins.asof(e, o, "user_id", "ts", ["latest"]).select("event_id", "latest")


@query("""WITH o AS (SELECT o_custkey % 150 user_id, o_orderkey, TIMESTAMP '2024-01-01' + to_seconds(CAST((o_orderkey * 7919) % 2592000 AS INTEGER)) ts FROM orders)
SELECT e.event_id, max_by(o.o_orderkey, (o.ts, o.o_orderkey)) latest FROM events e LEFT JOIN o ON o.user_id = e.user_id AND o.ts <= e.ts GROUP BY 1""")
def asof_hot_keys(spark, sf_dir):
    """The same lookup with keys split by day, so that a hot key is sorted by many tasks."""
    o = table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(150)).alias("user_id"), F.col("o_orderkey").alias("latest"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(F.col("o_orderkey") * 7919, F.lit(2592000)).cast("decimal(18,6)"))).alias("ts"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return joins.asof_bucketed(e, o, "user_id", "ts", ["latest"], 86400).select("event_id", "latest")


@query("""WITH p AS (SELECT o_orderkey id, CAST(o_custkey % 20 AS INTEGER) k, o_totalprice / 1000.0E0 x FROM orders), s AS (SELECT CAST(l_suppkey % 20 AS INTEGER) k, CAST(l_partkey % 500 AS DOUBLE) x, avg(l_extendedprice) / 997.0E0 y FROM lineitem GROUP BY ALL),
a AS (SELECT p.id, p.x, max(s.x) ax, max_by(s.y, s.x) ay FROM p LEFT JOIN s ON s.k = p.k AND s.x <= p.x GROUP BY ALL), b AS (SELECT p.id, min(s.x) bx, min_by(s.y, s.x) byv FROM p LEFT JOIN s ON s.k = p.k AND s.x >= p.x GROUP BY ALL)
SELECT id, round(CASE WHEN ax IS NULL THEN byv WHEN bx IS NULL OR bx = ax THEN ay ELSE ay + (byv - ay) * (x - ax) / (bx - ax) END, 5) y FROM a JOIN b USING (id)""")
def asof_linear_interp(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(20)).cast("int").alias("k"), (F.col("o_totalprice") / 1000.0).alias("x"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.pmod("l_suppkey", F.lit(20)).cast("int").alias("k"), F.pmod("l_partkey", F.lit(500)).cast("double").alias("x")).agg((F.avg("l_extendedprice") / 997.0).alias("y"))
    return joins.interpolate(p, s, "k", "x", "y").select("id", r("y", 5).alias("y"))


@query("""WITH s AS (SELECT CAST(k AS INTEGER) seg, k * 9000.0E0 - 500 lo, k * 9000.0E0 + 14000 hi FROM range(60) t(k)) SELECT o_orderkey id, min(seg) seg, count(*) n FROM orders JOIN s ON o_totalprice BETWEEN lo AND hi GROUP BY 1""")
def segment_range_join(spark, sf_dir):
    s = spark.range(60).select(F.col("id").cast("int").alias("seg"), (F.col("id") * 9000.0 - 500).alias("lo"), (F.col("id") * 9000.0 + 14000).alias("hi"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    return joins.range_join(o, s, "x", "lo", "hi", 10000.0).groupBy("id").agg(F.min("seg").alias("seg"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT CAST(k AS INTEGER) seg, k * 9000.0E0 - 500 lo, k * 9000.0E0 + 14000 hi, (k * 7) % 60 prio FROM range(60) t(k)) SELECT o_orderkey id, min_by(seg, prio) seg FROM orders JOIN s ON o_totalprice BETWEEN lo AND hi GROUP BY 1""")
def segment_priority_join(spark, sf_dir):
    s = spark.range(60).select(F.col("id").cast("int").alias("seg"), (F.col("id") * 9000.0 - 500).alias("lo"), (F.col("id") * 9000.0 + 14000).alias("hi"), F.pmod(F.col("id") * 7, F.lit(60)).alias("prio"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    return joins.range_join(o, s, "x", "lo", "hi", 10000.0, "prio").select("id", "seg")


@query(f"""WITH {STARS}, u AS (SELECT DISTINCT frame, idx, x, y FROM stars), d AS (SELECT a.frame, a.idx, b.idx r_idx, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) d2 FROM u a JOIN u b ON a.frame = b.frame AND a.idx <> b.idx)
SELECT frame, idx, r_idx, round(d2, 4) d2, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY frame, idx ORDER BY d2, r_idx) rank FROM d) WHERE rank <= 3""")
def knn_planar(spark, sf_dir):
    s = stars(spark, sf_dir).select("frame", "idx", "x", "y").distinct()
    return joins.nearest(s, 3, "frame").select("frame", "idx", "r_idx", r("d2", 4).alias("d2"), "rank")


def _sep_sql(a: str, b: str) -> str:
    x, y = f"cos({b}.decl) * sin({b}.ra - {a}.ra)", f"(cos({a}.decl) * sin({b}.decl) - sin({a}.decl) * cos({b}.decl) * cos({b}.ra - {a}.ra))"
    return f"atan2(sqrt({x} * {x} + {y} * {y}), sin({a}.decl) * sin({b}.decl) + cos({a}.decl) * cos({b}.decl) * cos({b}.ra - {a}.ra))"


@query(f"""WITH {SKY}, s AS (SELECT *, CAST(id % 50 AS INTEGER) side FROM sky),
n AS (SELECT q.id, s.mag, {_sep_sql("q", "s")} sep, row_number() OVER (PARTITION BY q.id ORDER BY {_sep_sql("q", "s")}, s.id) k FROM s q JOIN s ON q.side = s.side AND q.id <> s.id),
w AS (SELECT *, max(sep) OVER (PARTITION BY id) h FROM n WHERE k <= 8) SELECT id, round(sum(mag * pow(1 - pow(sep / (h * 1.000001E0), 3), 3)) / sum(pow(1 - pow(sep / (h * 1.000001E0), 3), 3)), 4) local FROM w GROUP BY 1""")
def knn_spherical_by_class(spark, sf_dir):
    """A tricube-weighted mean over the eight nearest neighbours of the same class, bandwidth the farthest of them."""
    s = sky(spark, sf_dir).withColumn("side", F.pmod("id", F.lit(50)).cast("int"))
    n = joins.nearest_on_sphere(s, 8, "side").join(s.select(F.col("id").alias("r_id"), "mag").hint("merge"), "r_id")
    n = n.withColumn("h", F.max("sep").over(Window.partitionBy("id")) * 1.000001)
    w = F.pow(F.lit(1.0) - F.pow(F.col("sep") / F.col("h"), 3), 3)
    return n.groupBy("id").agg(r(F.sum(F.col("mag") * w) / F.sum(w), 4).alias("local"))


_JIT = "jit AS (SELECT id + 1000000 id, ra + ((id * 31) % 101 - 50) * 2e-5 ra, greatest(-1.57E0, least(1.57E0, decl + ((id * 17) % 103 - 51) * 2e-5)) decl FROM sky WHERE id % 2 = 0)"


def _jittered(s):
    j = s.where("id % 2 = 0")
    ra = F.col("ra") + (F.pmod(F.col("id") * 31, F.lit(101)) - 50) * 2e-5
    dec = F.greatest(F.lit(-1.57), F.least(F.lit(1.57), F.col("decl") + (F.pmod(F.col("id") * 17, F.lit(103)) - 51) * 2e-5))
    return j.select((F.col("id") + 1000000).alias("id"), ra.alias("ra"), dec.alias("decl"))


@query(f"WITH {SKY}, {_JIT} SELECT s.id, j.id r_id, round({_sep_sql('s', 'j')}, 8) sep FROM sky s JOIN jit j ON {_sep_sql('s', 'j')} <= 0.003E0 AND abs(s.decl - j.decl) <= 0.0031E0")
def cell_crossmatch_radius(spark, sf_dir):
    s = sky(spark, sf_dir)
    return joins.sky_join(s.select("id", "ra", "decl"), _jittered(s), 0.003).select("id", "r_id", r("sep", 8).alias("sep"))


@query(f"""WITH {SKY}, {_JIT}, m AS (SELECT s.id, count(j.id) n, min_by(j.id, ({_sep_sql('s', 'j')}, j.id)) best, min({_sep_sql('s', 'j')}) sep FROM sky s LEFT JOIN jit j ON {_sep_sql('s', 'j')} <= 0.003E0 AND abs(s.decl - j.decl) <= 0.0031E0 GROUP BY 1)
SELECT id, n > 0 matched, best, round(sep, 8) sep FROM m""")
def left_outer_match_records(spark, sf_dir):
    s = sky(spark, sf_dir)
    best = joins.sky_join(s.select("id", "ra", "decl"), _jittered(s), 0.003).groupBy("id").agg(F.min(F.struct("sep", F.col("r_id"))).alias("b"))
    return s.select("id").join(best, "id", "left").select("id", F.col("b").isNotNull().alias("matched"), F.col("b.r_id").alias("best"), r("b.sep", 8).alias("sep"))


@query(f"""WITH {SKY}, {_JIT}, m AS (SELECT {_sep_sql('s', 'j')} sep FROM sky s JOIN jit j ON {_sep_sql('s', 'j')} <= 0.003E0 AND abs(s.decl - j.decl) <= 0.0031E0)
SELECT count(*) matches, round(avg(sep), 9) mean_sep, round(median(sep), 9) median_sep, round(sqrt(avg(sep * sep)), 9) rms_sep FROM m""")
def crossmatch_summary(spark, sf_dir):
    """The pairs' separations are stored, so that the exact median, which takes several passes, does not join anew."""
    s = sky(spark, sf_dir)
    m = materialize(joins.sky_join(s.select("ra", "decl"), _jittered(s).select("ra", "decl"), 0.003).select("sep"), "separations")
    median = robust.quantiles(m, [], "sep", [0.5]).select("p0").scalar()
    out = m.agg(F.count("*").alias("matches"), r(F.avg("sep"), 9).alias("mean_sep"), r(F.sqrt(F.avg(F.col("sep") * F.col("sep"))), 9).alias("rms_sep"))
    return out.select("matches", "mean_sep", r(median, 9).alias("median_sep"), "rms_sep")


@query(f"WITH {SKY}, {_JIT} SELECT s.id FROM sky s WHERE NOT EXISTS (SELECT 1 FROM jit j WHERE {_sep_sql('s', 'j')} <= 0.003E0 AND abs(s.decl - j.decl) <= 0.0031E0)")
def self_anti_exclude(spark, sf_dir):
    s = sky(spark, sf_dir)
    near = joins.sky_join(s.select("id", "ra", "decl"), _jittered(s), 0.003).select("id").distinct()
    return s.select("id").join(near, "id", "left_anti")


@query(f"""WITH {STARS}, p AS (SELECT frame, idx, x, y, x + (idx % 7 - 3) / 3.0E0 u, y + (idx % 5 - 2) / 3.0E0 AS v FROM stars)
SELECT a.frame, count(*) pairs, round(min(pow(a.x - b.u, 2) + pow(a.y - b.v, 2)), 4) least FROM p a JOIN p b ON a.frame = b.frame AND pow(a.x - b.u, 2) + pow(a.y - b.v, 2) <= 400 GROUP BY 1""")
def radius_join_frames(spark, sf_dir):
    s = stars(spark, sf_dir).select("frame", "idx", "x", "y")
    t = s.select("frame", "idx", (F.col("x") + (F.pmod("idx", F.lit(7)) - 3) / 3.0).alias("x"), (F.col("y") + (F.pmod("idx", F.lit(5)) - 2) / 3.0).alias("y"))
    return joins.radius_join(s, t, 20.0, frame="frame").groupBy("frame").agg(F.count("*").alias("pairs"), r(F.min("d2"), 4).alias("least"))


@query(f"""WITH RECURSIVE {STARS}, u AS (SELECT DISTINCT frame, idx, x, y FROM stars), c AS (SELECT a.frame, a.idx, b.idx r_idx, pow(a.x - (b.x + (b.idx % 7 - 3) / 3.0E0), 2) + pow(a.y - (b.y + (b.idx % 5 - 2) / 3.0E0), 2) d2 FROM u a JOIN u b ON a.frame = b.frame
  AND pow(a.x - (b.x + (b.idx % 7 - 3) / 3.0E0), 2) + pow(a.y - (b.y + (b.idx % 5 - 2) / 3.0E0), 2) <= 400),
g AS (SELECT frame, list({{'a': idx, 'b': r_idx, 'd': d2}} ORDER BY d2, idx, r_idx) p FROM c GROUP BY 1),
w AS (SELECT frame, p, CAST(1 AS BIGINT) i, [p[1].a] l, [p[1].b] r, [p[1]] k FROM g
  UNION ALL SELECT frame, p, i + 1, CASE WHEN ok THEN list_append(l, p[i + 1].a) ELSE l END, CASE WHEN ok THEN list_append(r, p[i + 1].b) ELSE r END, CASE WHEN ok THEN list_append(k, p[i + 1]) ELSE k END
  FROM (SELECT *, NOT list_contains(l, p[i + 1].a) AND NOT list_contains(r, p[i + 1].b) ok FROM w WHERE i < len(p)))
SELECT frame, e.a idx, e.b r_idx, round(e.d, 6) d2 FROM (SELECT frame, unnest(k) e FROM w WHERE i = len(p))""")
def greedy_one_to_one(spark, sf_dir):
    """One-to-one pairs of two star lists by rising distance: a pair is kept if neither side is taken yet."""
    s = stars(spark, sf_dir).select("frame", "idx", "x", "y").distinct()
    t = s.select("frame", "idx", (F.col("x") + (F.pmod("idx", F.lit(7)) - 3) / 3.0).alias("x"), (F.col("y") + (F.pmod("idx", F.lit(5)) - 2) / 3.0).alias("y"))
    pairs = joins.radius_join(s, t, 20.0, frame="frame").select("frame", "idx", "r_idx", "d2")
    return stack.greedy_pairs(pairs, "frame", "idx", "r_idx", "d2").withColumn("d2", r("d2"))


_EMB = "e AS (SELECT vec_id id, label, CAST(embedding[1] AS DOUBLE) a, CAST(embedding[2] AS DOUBLE) b, CAST(embedding[3] AS DOUBLE) c FROM embeddings)"


@query(f"""WITH {_EMB}, p AS (SELECT x.id, y.label, y.id r_id, pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) d2 FROM e x JOIN e y ON x.id % 2 = 0 AND y.id % 2 = 1 AND pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) <= 0.01E0),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, r_id) k FROM p) SELECT id, r_id, count(*) votes FROM t WHERE k <= 3 GROUP BY ALL""")
def descriptor_bucket_votes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("abc")))
    return joins.descriptor_votes(e.where("id % 2 = 0"), e.where("id % 2 = 1"), ["a", "b", "c"], 0.1)


@query("""WITH d AS (SELECT unnest(['click', 'view', 'error', 'purchase']) code, unnest([1, 1, 2, 3]) class) SELECT class, count(*) n FROM events JOIN d ON event_type = code GROUP BY 1""")
def dim_lookup_codes(spark, sf_dir):
    """A dimension whose rows list several codes each."""
    dim = spark.createDataFrame([(1, ["click", "view"]), (2, ["error"]), (3, ["purchase"])], "class int, codes array<string>")
    codes = dim.select("class", F.explode("codes").alias("event_type"))
    return table(spark, sf_dir, "events").join(F.broadcast(codes), "event_type").groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT c.c_custkey, n.n_name FROM (SELECT c_custkey, 'NATION_' || (c_nationkey * 10 + c_custkey % 3) AS code FROM customer) c JOIN nation n ON starts_with(c.code, n.n_name)")
def prefix_group_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey") * 10 + F.pmod("c_custkey", F.lit(3))).alias("code"))
    return joins.prefix_join(c, table(spark, sf_dir, "nation").select("n_name"), "code", "n_name").select("c_custkey", "n_name")


@query(f"""WITH {SKY}, t AS (SELECT CAST(id // 30 AS INTEGER) obj, CAST(id % 30 AS INTEGER) step, ra, decl FROM sky), h AS (SELECT (max(obj) + 1) // 2 half FROM t)
SELECT a.obj, round(min({_sep_sql('a', 'b')}), 8) sep, min_by(a.step, ({_sep_sql('a', 'b')}, a.step)) step FROM t a JOIN h ON a.obj < half JOIN t b ON b.obj = a.obj + half AND a.step = b.step GROUP BY 1""")
def conjunction_min_separation(spark, sf_dir):
    """The closest approach of two tracks on a common time grid: each of the first half's with one of the second's."""
    from vesperflow.functions.sphere import separation

    t = sky(spark, sf_dir).select(F.floor(F.col("id") / 30).cast("int").alias("obj"), F.pmod("id", F.lit(30)).cast("int").alias("step"), "ra", "decl")
    half = t.agg(F.floor((F.max("obj") + 1) / 2).cast("int").alias("h")).scalar()
    b = t.select((F.col("obj") - half).alias("obj"), "step", F.col("ra").alias("u"), F.col("decl").alias("v")).where("obj >= 0")
    j = t.join(b, ["obj", "step"]).where(F.col("obj") < half).withColumn("sep", separation("ra", "decl", "u", "v"))
    return j.groupBy("obj").agg(r(F.min("sep"), 8).alias("sep"), F.min(F.struct("sep", "step"))["step"].alias("step"))


# ---- series ---------------------------------------------------------------------------------------------------------


@query(f"WITH {SAMPLES} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) header FROM samples")
def ffill_section_header(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("h", F.when(F.col("event_type") == "purchase", F.col("value")))
    return series.forward_fill(s, "user_id", ["ts", "event_id"], "h", "header").select("event_id", "header")


@query(f"""WITH {SAMPLES}, a AS (SELECT *, (value * 37) % 6.283185307179586E0 ang FROM samples), d AS (SELECT *, ang - lag(ang) OVER w step FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(ang + {lit(2 * math.pi)} * sum(CASE WHEN step > {lit(math.pi)} THEN -1 WHEN step < {lit(-math.pi)} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 5) unwrapped FROM d""")
def unwrap_phase(spark, sf_dir):
    a = samples(spark, sf_dir).withColumn("ang", (F.col("value") * 37) % F.lit(6.283185307179586))
    return series.unwrap(a, "user_id", ["ts", "event_id"], "ang", "u").select("event_id", r("u", 5).alias("unwrapped"))


@query("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def ordered_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return series.last_of_equal(e, ["user_id", "event_type"], "event_id").drop("event_id")


@query(f"""WITH {SAMPLES}, d AS (SELECT user_id, s, value - 20 f, lag(s) OVER w s0, lag(value - 20) OVER w f0 FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT user_id, round(CASE WHEN f = 0 THEN s ELSE s0 - f0 * (s - s0) / (f - f0) END, 3) root FROM d WHERE f = 0 OR f0 * f < 0""")
def sign_change_roots(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("f", F.col("value") - 20)
    return series.sign_changes(s, "user_id", "s", "f").select("user_id", r("root", 3).alias("root"))


@query(f"""WITH {SAMPLES}, d AS (SELECT user_id, event_id, value b, lag(value) OVER w a, lead(value) OVER w c FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT user_id, sum(CASE WHEN b > a AND b > c THEN 1 ELSE 0 END)::BIGINT maxima, sum(CASE WHEN b < a AND b < c THEN 1 ELSE 0 END)::BIGINT minima FROM d GROUP BY 1 HAVING sum(CASE WHEN (b > a AND b > c) OR (b < a AND b < c) THEN 1 ELSE 0 END) > 0""")
def local_extrema(spark, sf_dir):
    e = series.local_extrema(samples(spark, sf_dir), "user_id", "s", "value")
    return e.groupBy("user_id").agg(F.count_if(F.col("kind") == "max").alias("maxima"), F.count_if(F.col("kind") == "min").alias("minima"))


@query(f"""WITH {SAMPLES}, d AS (SELECT user_id, value, s - lag(s) OVER w dt, abs(value - lag(value) OVER w) dv, first_value(value) OVER (PARTITION BY user_id ORDER BY s) f FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT user_id, round(max(CASE WHEN dt > 0 THEN dv / dt END), 4) max_rate, round(max(abs(value - f)), 6) peak, round(max(value) - min(value), 6) peak_to_peak FROM d GROUP BY 1""")
def adjacent_rate(spark, sf_dir):
    d = series.rates(samples(spark, sf_dir), "user_id", "ts", "value")
    return d.select("user_id", r("max_rate", 4).alias("max_rate"), r("peak").alias("peak"), r("peak_to_peak").alias("peak_to_peak"))


_W, _STEP = 259200.0, 86400.0


@query(f"""WITH {SAMPLES}, e AS (SELECT user_id, s - min(s) OVER (PARTITION BY user_id) e, value AS v FROM samples), w AS (SELECT user_id, k, e, v FROM e, unnest(range(CAST(greatest(0, ceil((e - {_W}) / {_STEP})) AS BIGINT), CAST(floor(e / {_STEP}) AS BIGINT) + 1)) u(k)),
f AS (SELECT user_id, k, count(*) n, max(e) - min(e) span, sqrt(greatest(0, regr_syy(v, e) - regr_slope(v, e) * regr_sxy(v, e)) / count(*)) rms FROM w GROUP BY ALL)
SELECT user_id, round(min(rms), 4) best FROM f WHERE n >= 4 AND span >= {0.8 * _W} GROUP BY 1""")
def sliding_regression_min(spark, sf_dir):
    return series.sliding_rms(samples(spark, sf_dir), "user_id", "ts", "value", _W, _STEP).select("user_id", r("best", 4).alias("best"))


@query(f"""WITH {SAMPLES}, d AS (SELECT user_id, s, value v, lead(s) OVER w s1, lead(value) OVER w v1 FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT user_id, CAST(k * 21600.0E0 AS DOUBLE) s, round(v + (v1 - v) * (k * 21600.0E0 - s) / (s1 - s), 4) AS value FROM d, unnest(range(CAST(ceil(s / 21600) AS BIGINT), CAST(ceil(s1 / 21600) AS BIGINT))) u(k) WHERE s1 IS NOT NULL""")
def resample_linear(spark, sf_dir):
    return series.resample(samples(spark, sf_dir), "user_id", "ts", "value", 21600.0).select("user_id", "s", r("value", 4).alias("value"))


@query(f"""WITH {SKY}, t AS (SELECT CAST(id // 30 AS INTEGER) obj, id, ra, decl FROM sky), d AS (SELECT a.obj, coalesce({_sep_sql('a', 'b')}, 0) d FROM t a LEFT JOIN t b ON b.obj = a.obj AND b.id = a.id - 1) SELECT obj, round(sum(d), 6) length FROM d GROUP BY 1""")
def path_length(spark, sf_dir):
    t = sky(spark, sf_dir).withColumn("obj", F.floor(F.col("id") / 30).cast("int"))
    return series.path_length(t, "obj", "id", "ra", "decl").select("obj", r("length").alias("length"))


@query(f"""WITH {STARS}, k AS (SELECT frame, idx id, flux, row_number() OVER (PARTITION BY frame ORDER BY flux DESC, idx) r FROM (SELECT frame, idx, max(flux) flux FROM stars GROUP BY ALL)), d AS (SELECT *, lag(flux) OVER (PARTITION BY frame ORDER BY flux DESC, id) / flux drop_ FROM k WHERE r <= 128),
c AS (SELECT frame, min_by(r, (-drop_, r)) cut FROM d WHERE r > 3 AND drop_ > 1.2 GROUP BY 1) SELECT frame, count(*) kept FROM d LEFT JOIN c USING (frame) WHERE cut IS NULL OR r < cut GROUP BY 1""")
def score_gap_cut(spark, sf_dir):
    s = stars(spark, sf_dir).groupBy("frame", F.col("idx").alias("id")).agg(F.max("flux").alias("flux"))
    return stack.score_gap_cut(s, "frame", "flux", ratio=1.2).groupBy("frame").agg(F.count("*").alias("kept"))


@query("SELECT user_id, round(regr_slope(value, s), 9) slope, round(sqrt(greatest(0, regr_syy(value, s) - regr_slope(value, s) * regr_sxy(value, s)) / count(*)), 4) rms FROM (SELECT user_id, value, epoch_us(ts) / 1e6 - 1704067200 s FROM events) GROUP BY 1")
def linear_drift(spark, sf_dir):
    from vesperflow.operators.robust import linear

    s = samples(spark, sf_dir).withColumn("s", F.col("s") - 1704067200)
    return linear(s, ["user_id"], "s", "value").select("user_id", r("slope", 9).alias("slope"), r("rmsd", 4).alias("rms"))


@query("""WITH d AS (SELECT CAST(o_orderkey // 40 AS INTEGER) grp, CAST(o_orderkey % 40 AS DOUBLE) x, o_totalprice / 1000.0E0 y FROM orders), s AS (SELECT grp, x, y, (lead(y) OVER w - y) / (lead(x) OVER w - x) d1, (y - lag(y) OVER w) / (x - lag(x) OVER w) d0, lead(x) OVER w - x h1, x - lag(x) OVER w h0 FROM d WINDOW w AS (PARTITION BY grp ORDER BY x))
SELECT grp, x, round(CASE WHEN d0 * d1 <= 0 THEN 0 ELSE (3 * h1 + 3 * h0) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) END, 4) slope FROM s WHERE d0 IS NOT NULL AND d1 IS NOT NULL""")
def pchip_slopes(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 40).cast("int").alias("grp"), F.pmod("o_orderkey", F.lit(40)).cast("double").alias("x"), (F.col("o_totalprice") / 1000.0).alias("y"))
    s = series.pchip_slopes(d, "grp", "x", "y")
    ends = d.groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return s.join(ends, "grp").where("x > lo AND x < hi").select("grp", "x", r("slope", 4).alias("slope"))




@query("""WITH g AS (SELECT l_suppkey % 10 gx, l_partkey % 8 gy, avg(l_extendedprice) / 997.0E0 AS v FROM lineitem GROUP BY ALL), p AS (SELECT o_orderkey id, (o_orderkey % 89) / 10.0E0 x, (o_custkey % 67) / 10.0E0 y FROM orders)
SELECT id, round(sum((CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * v), 5) AS v FROM p, range(2) a(i), range(2) b(j), g WHERE g.gx = floor(x) + i AND g.gy = floor(y) + j GROUP BY 1""")
def grid_interpolation(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.pmod("l_suppkey", F.lit(10)).alias("gx"), F.pmod("l_partkey", F.lit(8)).alias("gy")).agg((F.avg("l_extendedprice") / 997.0).alias("v"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.pmod("o_orderkey", F.lit(89)) / 10.0).alias("x"), (F.pmod("o_custkey", F.lit(67)) / 10.0).alias("y"))
    return joins.grid_interpolate(p, g, "x", "y", "v", "id").select("id", r("v", 5).alias("v"))


@query("""SELECT o_orderkey id, CASE WHEN greatest(a0, b0) <= least(a1, b1) AND greatest(c0, d0) <= least(c1, d1) THEN greatest(a0, b0) END l, CASE WHEN greatest(a0, b0) <= least(a1, b1) AND greatest(c0, d0) <= least(c1, d1) THEN least(c1, d1) END b
FROM (SELECT o_orderkey, o_orderkey % 50 a0, o_orderkey % 50 + 30 a1, o_custkey % 70 b0, o_custkey % 70 + 20 b1, o_orderkey % 31 c0, o_orderkey % 31 + 9 c1, o_custkey % 41 d0, o_custkey % 41 + 12 d1 FROM orders)""")
def rectangle_overlap(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = lambda v, n, d=0: F.pmod(v, F.lit(n)) + d
    o = joins.rectangle_overlap([m(k, 50), m(k, 31), m(k, 50, 30), m(k, 31, 9)], [m(c, 70), m(c, 41), m(c, 70, 20), m(c, 41, 12)])
    return table(spark, sf_dir, "orders").select(k.alias("id"), o[0].alias("l"), o[3].alias("b"))


@query(f"""WITH {SKY} SELECT CAST(floor((decl + {lit(math.pi / 2)}) / {lit(math.pi / 900)}) AS INTEGER) + 1 AS zone, count(*) n FROM sky WHERE ra < 0.5 AND decl BETWEEN -0.3 AND 0.4 GROUP BY 1""")
def touched_zones(spark, sf_dir):
    """The zones of a fifth of a degree that a box touches, with their rows."""
    s = sky(spark, sf_dir).where("ra < 0.5D AND decl BETWEEN -0.3D AND 0.4D")
    return s.groupBy((F.floor((F.col("decl") + math.pi / 2) / (math.pi / 900)) + 1).cast("int").alias("zone")).agg(F.count("*").alias("n"))

"""Robust aggregates, histograms, regressions and stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vesperflow.operators import robust, stack
from vesperflow.plans.common import PIXELS, STARS, pixels, query, r, stars
from vesperflow.session import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))


@query("""SELECT o_orderpriority grp, count(*) n, min(o_totalprice) AS min, min_by(o_orderkey, (o_totalprice, o_orderkey)) min_key, max(o_totalprice) AS max, min_by(o_orderkey, (-o_totalprice, o_orderkey)) max_key,
round(avg(o_totalprice), 4) mean, round(median(o_totalprice), 4) median, round(stddev_pop(o_totalprice), 4) AS stddev, round(sqrt(avg(o_totalprice * o_totalprice)), 4) rms FROM orders GROUP BY 1""")
def robust_summary(spark, sf_dir):
    s = robust.summary(_orders(spark, sf_dir), ["grp"], "v", "k")
    return s.select("grp", "n", "min", "min_key", "max", "max_key", *(r(c, 4).alias(c) for c in ("mean", "median", "stddev", "rms")))


@query("""WITH m AS (SELECT o_orderpriority grp, median(o_totalprice) m FROM orders GROUP BY 1)
SELECT grp, round(any_value(m), 4) median, round(median(abs(o_totalprice - m)) * 1.482602218505602E0, 4) mad FROM orders JOIN m ON grp = o_orderpriority GROUP BY 1""")
def robust_mad(spark, sf_dir):
    return robust.mad(_orders(spark, sf_dir), ["grp"], "v", normalized=True, large=True).select("grp", r("median", 4).alias("median"), r("mad", 4).alias("mad"))


@query("SELECT o_orderpriority grp, round(quantile_cont(o_totalprice, 0.1), 4) p0, round(quantile_cont(o_totalprice, 0.5), 4) p1, round(quantile_cont(o_totalprice, 0.9), 4) p2 FROM orders GROUP BY 1")
def robust_percentile(spark, sf_dir):
    return robust.quantiles(_orders(spark, sf_dir), ["grp"], "v", [0.1, 0.5, 0.9]).select("grp", *(r(f"p{i}", 4).alias(f"p{i}") for i in range(3)))


@query("SELECT event_type grp, round(median(CASE WHEN value >= 5 AND event_id % 7 <> 0 THEN value END), 6) median, count(CASE WHEN value >= 5 AND event_id % 7 <> 0 THEN 1 END) n FROM events GROUP BY 1")
def robust_median_finite(spark, sf_dir):
    """Medians of finite values above a minimum; NaN stands for a missing measurement."""
    from vesperflow.functions.mathx import finite

    v = finite(F.when(F.pmod("event_id", F.lit(7)) == 0, float("nan")).otherwise(F.col("value")))
    v = F.when(v >= 5, v)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp")).agg(r(F.median(v)).alias("median"), F.count(v).alias("n"))


def _hist(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_extendedprice") / 90000.0).alias("v"))
    return robust.histogram(l, ["grp"], "v", 256)


_HIST = "hist AS (SELECT l_returnflag grp, CAST(greatest(0, least(255, CAST(trunc(least(l_extendedprice / 90000.0E0, 2) * 255) AS BIGINT))) AS INTEGER) bin, count(*) n FROM lineitem GROUP BY ALL)"


@query(f"WITH {_HIST} SELECT * FROM hist")
def hist_build(spark, sf_dir):
    return _hist(spark, sf_dir)


@query(f"""WITH {_HIST}, f AS (SELECT grp, sum(n) cnt, min_by(bin, (-n, bin)) mode_bin, min(bin) min_bin, max(bin) max_bin, sum(bin / 255.0E0 * n) / sum(n) mean FROM hist GROUP BY 1),
m AS (SELECT grp, any_value(cnt) cnt, any_value(mode_bin) mode_bin, any_value(min_bin) min_bin, any_value(max_bin) max_bin, any_value(mean) mean, sum(pow(bin / 255.0E0 - mean, 2) * n) / sum(n) v, sum(pow(bin / 255.0E0 - mean, 3) * n) / sum(n) m3,
  sum(pow(bin / 255.0E0 - mean, 4) * n) / sum(n) m4, -sum(n / cnt * log2(n / cnt)) entropy FROM hist JOIN f USING (grp) GROUP BY 1)
SELECT grp, CAST(cnt AS BIGINT) AS count, mode_bin, min_bin, max_bin, round(mean, 6) mean, round(v, 6) variance, round(sqrt(v), 6) AS stddev, round(m3 / pow(v, 1.5), 6) AS skewness, round(m4 / (v * v) - 3, 6) AS kurtosis, round(entropy, 6) AS entropy FROM m""")
def hist_moments(spark, sf_dir):
    m = robust.histogram_moments(_hist(spark, sf_dir), ["grp"], 256)
    return m.select("grp", "count", "mode_bin", "min_bin", "max_bin", *(r(c).alias(c) for c in ("mean", "variance", "stddev", "skewness", "kurtosis", "entropy")))


@query(f"""WITH {_HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY bin) cum, sum(n) OVER (PARTITION BY grp) total FROM hist)
SELECT grp, round(min_by((bin + (total * 0.25E0 - (cum - n)) / n) / 256, bin) FILTER (cum >= total * 0.25E0), 6) q0, round(min_by((bin + (total * 0.5E0 - (cum - n)) / n) / 256, bin) FILTER (cum >= total * 0.5E0), 6) q1,
  round(min_by((bin + (total * 0.99E0 - (cum - n)) / n) / 256, bin) FILTER (cum >= total * 0.99E0), 6) q2 FROM c GROUP BY 1""")
def hist_quantile_cdf(spark, sf_dir):
    q = robust.histogram_quantile(_hist(spark, sf_dir), ["grp"], 256, [0.25, 0.5, 0.99])
    return q.select("grp", *(r(f"q{i}").alias(f"q{i}") for i in range(3)))


@query("""WITH d AS (SELECT l_returnflag grp, l_extendedprice / 90000.0E0 AS v FROM lineitem), m AS (SELECT grp, median(v) m FROM d GROUP BY 1),
s AS (SELECT grp, any_value(m) m, median(abs(v - m)) * 1.482602218505602E0 AS s FROM d JOIN m USING (grp) GROUP BY 1), l AS (SELECT *, CASE WHEN s > 0 THEN least(1, greatest(0, m - 2.8E0 * s)) ELSE 0 END lo FROM s)
SELECT grp, round(CASE WHEN m - lo = 0 THEN 0 ELSE -0.75E0 * (m - lo) / (-0.5E0 * (m - lo) - 0.25E0) END, 6) midtone, round(lo, 6) shadow, 1.0E0 highlight FROM l""")
def stretch_parameters(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_extendedprice") / 90000.0).alias("v"))
    return robust.stretch_parameters(l, ["grp"], "v").select("grp", r("midtone").alias("midtone"), r("shadow").alias("shadow"), "highlight")


def _xy(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(10)).cast("int").alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_discount") + 0.01).alias("w"))


_XY = "d AS (SELECT CAST(l_suppkey % 10 AS INTEGER) grp, l_quantity x, l_extendedprice / 1000.0E0 y, l_discount + 0.01E0 w FROM lineitem)"


@query(f"""WITH {_XY} SELECT grp, count(*) n, round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 6) intercept, round(corr(y, x), 6) r, round(regr_r2(y, x), 6) r2,
round(sqrt(greatest(0, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*)), 6) rmsd FROM d GROUP BY 1""")
def regr_ols(spark, sf_dir):
    return robust.linear(_xy(spark, sf_dir), ["grp"], "x", "y").select("grp", "n", *(r(c).alias(c) for c in ("slope", "intercept", "r", "r2", "rmsd")))


@query(f"""WITH {_XY}, m AS (SELECT grp, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my FROM d GROUP BY 1),
s AS (SELECT grp, count(*) n, any_value(mx) mx, any_value(my) my, sum(w) sw, sum(w * (x - mx) * (x - mx)) xx, sum(w * (x - mx) * (y - my)) xy, sum(w * (y - my) * (y - my)) yy FROM d JOIN m USING (grp) GROUP BY 1)
SELECT grp, n, round(xy / xx, 6) slope, round(my - xy / xx * mx, 6) intercept, round(sqrt((yy - xy * xy / xx) / (n - 2) / xx), 6) slope_error, round(sqrt((yy - xy * xy / xx) / (n - 2) * (1 / sw + mx * mx / xx)), 6) intercept_error FROM s""")
def regr_weighted(spark, sf_dir):
    return robust.weighted_linear(_xy(spark, sf_dir), ["grp"], "x", "y", "w").select("grp", "n", *(r(c).alias(c) for c in ("slope", "intercept", "slope_error", "intercept_error")))


def _small(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select((F.floor(F.col("o_orderkey") / 40)).cast("int").alias("grp"), F.col("o_orderkey").alias("k"), F.pmod("o_orderkey", F.lit(40)).cast("double").alias("x"), (F.col("o_totalprice") / 997.0).alias("y"))


_SMALL = "d AS (SELECT CAST(o_orderkey // 40 AS INTEGER) grp, o_orderkey k, CAST(o_orderkey % 40 AS DOUBLE) x, o_totalprice / 997.0E0 y FROM orders)"


@query(f"""WITH {_SMALL}, s AS (SELECT a.grp, median((b.y - a.y) / (b.x - a.x)) slope FROM d a JOIN d b ON a.grp = b.grp AND a.k < b.k AND a.x <> b.x GROUP BY 1)
SELECT grp, round(any_value(slope), 6) slope, round(median(y - slope * x), 6) intercept FROM d JOIN s USING (grp) GROUP BY 1""")
def regr_theilsen(spark, sf_dir):
    return robust.theil_sen(_small(spark, sf_dir), ["grp"], "x", "y", "k").select("grp", r("slope").alias("slope"), r("intercept").alias("intercept"))


@query(f"""WITH {_SMALL}, lo AS (SELECT grp, min_by(x, (y, x)) xlow FROM d GROUP BY 1),
f AS (SELECT grp, regr_slope(y, CASE WHEN x <= xlow THEN x END) ls, regr_intercept(y, CASE WHEN x <= xlow THEN x END) li, regr_slope(y, CASE WHEN x >= xlow THEN x END) rs, regr_intercept(y, CASE WHEN x >= xlow THEN x END) ri FROM d JOIN lo USING (grp) GROUP BY 1)
SELECT grp, round(ls, 4) left_slope, round(rs, 4) right_slope, round(CASE WHEN ls <> rs THEN (ri - li) / (ls - rs) END, 4) cross_x FROM f WHERE ls IS NOT NULL AND rs IS NOT NULL AND NOT isnan(ls) AND NOT isnan(rs) AND abs(ls - rs) > 0.001""")
def regr_vcurve(spark, sf_dir):
    v = robust.v_curve(_small(spark, sf_dir), ["grp"], "x", "y").where("left_slope IS NOT NULL AND right_slope IS NOT NULL AND abs(left_slope - right_slope) > 0.001")
    return v.where(~F.isnan("left_slope") & ~F.isnan("right_slope")).select("grp", r("left_slope", 4).alias("left_slope"), r("right_slope", 4).alias("right_slope"), r("cross_x", 4).alias("cross_x"))


@query(f"""WITH {_SMALL}, m AS (SELECT *, avg(x) OVER (PARTITION BY grp) m FROM d), s AS (SELECT grp, any_value(m) m, count(*) s0, sum(x - m) s1, sum(pow(x - m, 2)) s2, sum(pow(x - m, 3)) s3, sum(pow(x - m, 4)) s4, sum(y) t0, sum(y * (x - m)) t1, sum(y * pow(x - m, 2)) t2 FROM m GROUP BY 1),
c AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) det FROM s)
SELECT grp, round((s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det, 5) a, round((s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2)) / det - 2 * m * (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det, 5) b FROM c""")
def regr_quadratic(spark, sf_dir):
    return robust.quadratic(_small(spark, sf_dir), ["grp"], "x", "y").select("grp", r("a", 5).alias("a"), r("b", 5).alias("b"))


@query(f"WITH {_XY} SELECT grp, round(exp(regr_intercept(ln(y), x)), 6) exp_a, round(regr_slope(ln(y), x), 6) exp_b, round(exp(regr_intercept(ln(y), ln(x))), 6) pow_a, round(regr_slope(ln(y), ln(x)), 6) pow_b FROM d WHERE y > 0 AND x > 0 GROUP BY 1")
def regr_exponential_power(spark, sf_dir):
    d = _xy(spark, sf_dir)
    e, p = robust.exponential(d, ["grp"], "x", "y"), robust.power_law(d, ["grp"], "x", "y")
    return e.select("grp", r("a").alias("exp_a"), r("b").alias("exp_b")).join(p.select("grp", r("a").alias("pow_a"), r("b").alias("pow_b")), "grp")


@query(f"""WITH {STARS}, m AS (SELECT *, avg(x) OVER w mx, avg(y) OVER w my, avg(0.9E0 * x - 0.2E0 * y + 5 + idx % 3) OVER w mu, avg(0.2E0 * x + 0.9E0 * y - 3 + idx % 5) OVER w mv, 0.9E0 * x - 0.2E0 * y + 5 + idx % 3 u, 0.2E0 * x + 0.9E0 * y - 3 + idx % 5 AS v FROM stars WINDOW w AS (PARTITION BY frame)),
s AS (SELECT frame, any_value(mx) mx, any_value(my) my, any_value(mu) mu, any_value(mv) mv, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) b, sum(pow(x - mx, 2) + pow(y - my, 2)) n FROM m GROUP BY 1)
SELECT frame, round(sqrt(a * a + b * b) / n, 5) AS scale, round(atan2(b, a), 5) rotation, round(mu - a / n * mx + b / n * my, 5) tx, round(mv - b / n * mx - a / n * my, 5) ty FROM s WHERE n > 0""")
def similarity_fit(spark, sf_dir):
    s = stars(spark, sf_dir)
    d = s.select("frame", "x", "y", (F.col("x") * 0.9 - F.col("y") * 0.2 + 5 + F.pmod("idx", F.lit(3))).alias("u"), (F.col("x") * 0.2 + F.col("y") * 0.9 - 3 + F.pmod("idx", F.lit(5))).alias("v"))
    return robust.similarity(d, ["frame"]).where("scale IS NOT NULL AND NOT isnan(scale)").select("frame", *(r(c, 5).alias(c) for c in ("scale", "rotation", "tx", "ty")))


@query(f"""WITH {STARS}, m AS (SELECT *, median(x) OVER w mx, median(y) OVER w my, count(*) OVER w n FROM stars WINDOW w AS (PARTITION BY frame)), d AS (SELECT *, sqrt(pow(x - mx, 2) + pow(y - my, 2)) d FROM m),
dm AS (SELECT frame, median(d) dm FROM d GROUP BY 1), ds AS (SELECT frame, any_value(dm) dm, median(abs(d - dm)) * 1.482602218505602E0 ds FROM d JOIN dm USING (frame) GROUP BY 1)
SELECT frame, round(sum(x * greatest(flux, 1e-6)) / sum(greatest(flux, 1e-6)), 5) x, round(sum(y * greatest(flux, 1e-6)) / sum(greatest(flux, 1e-6)), 5) y, count(*) used FROM d JOIN ds USING (frame) WHERE n < 3 OR d <= dm + 1.5 * ds GROUP BY 1""")
def robust_weighted_mean(spark, sf_dir):
    return robust.robust_mean(stars(spark, sf_dir), ["frame"], ["x", "y"], "flux", 1.5).select("frame", r("x", 5).alias("x"), r("y", 5).alias("y"), "used")


@query(f"""WITH {STARS}, p AS (SELECT frame, idx, x / 100 AS e FROM stars), m AS (SELECT frame, median(e) m FROM p GROUP BY 1), s AS (SELECT frame, any_value(m) m, median(abs(e - m)) * 1.482602218505602E0 s FROM p JOIN m USING (frame) GROUP BY 1)
SELECT frame, count(*) n, round(max(e), 6) worst FROM p JOIN s USING (frame) WHERE e <= least(9, 8, greatest(m + 3 * s, 3.2E0)) GROUP BY 1""")
def residual_clip(spark, sf_dir):
    p = stars(spark, sf_dir).select("frame", "idx", (F.col("x") / 100).alias("e"))
    return robust.residual_clip(p, ["frame"], "e", 9.0, 8.0).groupBy("frame").agg(F.count("*").alias("n"), r(F.max("e")).alias("worst"))


_ONE = "x, y, c"


@query(f"WITH {PIXELS} SELECT {_ONE}, count(*) n, round(sum(value), 6) AS sum, round(avg(value), 6) average, round(sum(value * weight) / sum(weight), 6) weighted_average FROM pixels GROUP BY ALL")
def stack_sum_avg_weighted(spark, sf_dir):
    s = stack.algebraic(pixels(spark, sf_dir), weight="weight")
    return s.select("x", "y", "c", "n", *(r(k).alias(k) for k in ("sum", "average", "weighted_average")))


@query(f"WITH {PIXELS} SELECT {_ONE}, round(median(value), 6) AS value FROM pixels GROUP BY ALL")
def stack_median(spark, sf_dir):
    return stack.median(pixels(spark, sf_dir)).withColumn("value", r("value"))


@query(f"WITH {PIXELS}, s AS (SELECT {_ONE}, list_sort(list(value)) v FROM pixels GROUP BY ALL) SELECT {_ONE}, round(list_avg(CASE WHEN len(v) > 3 THEN v[2:len(v) - 2] ELSE v END), 6) AS value FROM s")
def stack_minmax(spark, sf_dir):
    return stack.min_max(pixels(spark, sf_dir), 1, 2).withColumn("value", r("value"))


_LIM = f"s AS (SELECT {_ONE}, quantile_cont(value, 0.1) lo, quantile_cont(value, 0.9) hi, list(value) v FROM pixels GROUP BY ALL)"


@query(f"WITH {PIXELS}, {_LIM} SELECT {_ONE}, round(CASE WHEN len(v) <= 2 THEN list_avg(v) ELSE list_avg([least(greatest(e, lo), hi) for e in v]) END, 6) AS value FROM s")
def stack_winsor(spark, sf_dir):
    return stack.winsorized(pixels(spark, sf_dir)).withColumn("value", r("value"))


@query(f"WITH {PIXELS}, {_LIM} SELECT {_ONE}, round(coalesce(list_avg([e for e in v if e >= lo and e <= hi]), list_avg(v)), 6) AS value FROM s")
def stack_pclip(spark, sf_dir):
    return stack.percentile_clip(pixels(spark, sf_dir)).withColumn("value", r("value"))


def _round(k: int) -> str:
    return f"""r{k} AS (SELECT p.x, p.y, p.c, p.value, m, s FROM r{k - 1} p JOIN (SELECT {_ONE}, median(value) m, stddev_pop(value) s FROM r{k - 1} GROUP BY ALL) q USING ({_ONE}) WHERE s = 0 OR p.value BETWEEN m - 1.5 * s AND m + 1.5 * s)""".replace("p.value, m, s", "p.value")


@query(f"WITH {PIXELS}, r0 AS (SELECT {_ONE}, value FROM pixels), {', '.join(_round(k) for k in (1, 2))} SELECT {_ONE}, round(avg(value), 6) AS value FROM r2 GROUP BY ALL")
def stack_sigma_clip(spark, sf_dir):
    return stack.sigma_clip(pixels(spark, sf_dir), 1.5, 1.5, 2).withColumn("value", r("value"))


@query(f"WITH {PIXELS}, c AS (SELECT {_ONE}, count(DISTINCT frame) frames FROM pixels GROUP BY ALL) SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM c WHERE frames >= 14")
def coverage_crop_bounds(spark, sf_dir):
    return stack.crop_bounds(stack.coverage(pixels(spark, sf_dir)), 14)


_UNIQUE = f"u AS (SELECT frame, {_ONE}, avg(value) AS value FROM pixels GROUP BY ALL)"


@query(f"""WITH {PIXELS}, {_UNIQUE}, q AS (SELECT u.frame, quantile_cont(u.value, 0.25) a1, quantile_cont(u.value, 0.75) a3, quantile_cont(r.value, 0.25) b1, quantile_cont(r.value, 0.75) b3 FROM u JOIN (SELECT * FROM u WHERE frame = 0) r USING ({_ONE}) GROUP BY 1)
SELECT frame, round((b3 - b1) / (a3 - a1), 6) AS scale, round(b1 - (b3 - b1) / (a3 - a1) * a1, 6) AS offset FROM q WHERE a3 > a1""".replace("AS offset", 'AS "offset"'))
def frame_normalization(spark, sf_dir):
    u = pixels(spark, sf_dir).groupBy("frame", "x", "y", "c").agg(F.avg("value").alias("value"))
    return stack.normalisation(u, u.where("frame = 0")).select("frame", r("scale").alias("scale"), r("offset").alias("offset"))


@query("""WITH f AS (SELECT CAST(o_custkey % 50 AS INTEGER) grp, o_custkey frame, count(*) n, median(o_totalprice) / 1e4 AS snr, 1 + median(o_orderkey % 97) / 20.0E0 AS hfd, avg(o_totalprice) / 1e5 AS background FROM orders GROUP BY ALL),
q AS (SELECT *, least(greatest(sqrt(n) * greatest(snr, 1) / greatest(hfd, 0.5), 0), 1e6) quality FROM f)
SELECT grp, min_by(frame, (-(quality * CASE WHEN n < 3 THEN 0.25E0 ELSE 1 END - background), frame)) frame, round(sum(1 / hfd) / count(*), 6) mean_weight FROM q GROUP BY 1""")
def frame_weight_reference(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = o.groupBy(F.pmod("o_custkey", F.lit(50)).cast("int").alias("grp"), F.col("o_custkey").alias("frame")).agg(F.count("*").alias("n"), (F.median("o_totalprice") / 1e4).alias("snr"), (F.median(F.pmod("o_orderkey", F.lit(97))) / 20.0 + 1).alias("hfd"), (F.avg("o_totalprice") / 1e5).alias("background"))
    f = f.withColumn("quality", stack.quality())
    weights = f.groupBy("grp").agg(r(F.avg(stack.frame_weight("inverse-hfd"))).alias("mean_weight"))
    return stack.reference_frame(f, ["grp"]).join(weights, "grp")


@query(f"""WITH {PIXELS}, {_UNIQUE}, k AS (SELECT * FROM u WHERE frame > 3), b AS (SELECT * FROM u WHERE frame = 1), d AS (SELECT * FROM u WHERE frame = 2), f AS (SELECT {_ONE}, value + 1 AS value FROM u WHERE frame = 3),
l AS (SELECT f.c, avg(f.value - b.value) lev FROM f JOIN b USING ({_ONE}) GROUP BY 1)
SELECT k.frame, k.x, k.y, k.c, round(CASE WHEN f.value - b.value > 0 THEN (k.value - b.value - (d.value - b.value) * 0.5E0) / (f.value - b.value) * lev END, 6) AS value FROM k JOIN b USING ({_ONE}) JOIN d USING ({_ONE}) JOIN f USING ({_ONE}) JOIN l USING (c)""")
def calibrate_join(spark, sf_dir):
    u = pixels(spark, sf_dir).groupBy("frame", "x", "y", "c").agg(F.avg("value").alias("value"))
    flat = u.where("frame = 3").withColumn("value", F.col("value") + 1)
    return stack.calibrate(u.where("frame > 3"), u.where("frame = 1"), u.where("frame = 2"), flat, 0.5).select("frame", "x", "y", "c", r("value").alias("value"))


@query(f"""WITH {PIXELS}, u AS (SELECT frame, x, y, avg(value) AS value FROM pixels GROUP BY ALL), k AS (SELECT CAST(dx AS INTEGER) - 1 dx, CAST(dy AS INTEGER) - 1 dy, CASE WHEN dx = 1 AND dy = 1 THEN 4 WHEN dx = 1 OR dy = 1 THEN 2 ELSE 1 END w FROM range(3) a(dx), range(3) b(dy))
SELECT p.frame, p.x, p.y, round(sum(n.value * w) / sum(w), 6) AS value FROM u p, k, u n WHERE n.frame = p.frame AND n.x = p.x + dx AND n.y = p.y + dy GROUP BY ALL""")
def convolve_3x3(spark, sf_dir):
    u = pixels(spark, sf_dir).groupBy("frame", "x", "y").agg(F.avg("value").alias("value"))
    return stack.convolve(u, [[1, 2, 1], [2, 4, 2], [1, 2, 1]], ["frame"]).select("frame", "x", "y", r("value").alias("value"))


@query(f"""WITH {PIXELS} SELECT frame, x, y, c, round(CASE WHEN z = 0 THEN 0 WHEN z = 1 THEN 1 ELSE z * -0.75E0 / (z * -0.5E0 - 0.25E0) END, 6) stf, round(least(asinh(value * 10) / asinh(10), 1), 6) arc, round(pow(value, 1 / 2.2E0), 6) gam FROM (SELECT *, least(greatest((value - 0.05E0) / 0.9E0, 0), 1) z FROM pixels)""")
def point_transforms(spark, sf_dir):
    v = F.col("value")
    return pixels(spark, sf_dir).select("frame", "x", "y", "c", r(stack.stf(v, 0.25, 0.05, 0.95)).alias("stf"), r(stack.arcsinh(v, 10.0)).alias("arc"), r(stack.gamma(v, 2.2)).alias("gam"))


@query(f"""WITH {PIXELS}, {_UNIQUE} SELECT a.c, count(*) n, round(var_pop(a.value - b.value) / 2, 6) variance, round(avg((a.value + b.value) / 2), 6) mean FROM u a JOIN u b USING ({_ONE}) WHERE a.frame = 5 AND b.frame = 6 GROUP BY 1""")
def sensor_pair_variance(spark, sf_dir):
    """Temporal noise of a sensor from the difference of two frames, pixel by pixel."""
    u = pixels(spark, sf_dir).groupBy("frame", "x", "y", "c").agg(F.avg("value").alias("value"))
    both = u.where("frame = 5").select("x", "y", "c", "value").join(u.where("frame = 6").select("x", "y", "c", F.col("value").alias("b")), ["x", "y", "c"])
    return both.groupBy("c").agg(F.count("*").alias("n"), r(F.var_pop(F.col("value") - F.col("b")) / 2).alias("variance"), r(F.avg((F.col("value") + F.col("b")) / 2)).alias("mean"))

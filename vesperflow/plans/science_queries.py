"""Orbits, events, models and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vesperflow.functions import healpix
from vesperflow.operators import events, models, orbits
from vesperflow.plans.common import PIXELS, SKY, lit, query, r, sky
from vesperflow.plans.region_queries import _nested_sql
from vesperflow.session import table
from vesperflow.streaming import frames


def _unit(c, n: int, m: int):
    return F.pmod(F.col(c) * n, F.lit(m)) / float(m)


@query()
def kepler_propagate(spark, sf_dir):
    """Heliocentric states of derived elements; an iterative solver, so rows only, tests hold it against known orbits."""
    k = "o_orderkey"
    s = orbits.kepler_state(_unit(k, 7919, 1009) * 2 + 0.3, _unit(k, 104729, 997) * 1.2, _unit(k, 31, 101) * 1.5, _unit(k, 37, 103) * 6.28, _unit(k, 41, 107) * 6.28, _unit(k, 43, 109) * 400)
    return table(spark, sf_dir, "orders").select(F.col(k).alias("id"), s.alias("s")).select("id", *(r(f"s.{c}", 8).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))


def _kepler_sql() -> str:
    """Ellipses by Newton's steps of Kepler's equation, turned by the three angles."""
    u = lambda c, n, m: f"((({c} * {n}) % {m}) / {m}.0E0)"
    k = "o_orderkey"
    step = "ea - (ea - e * sin(ea) - m) / (1 - e * cos(ea))"
    newton = ", ".join(f"n{i} AS (SELECT * REPLACE ({step} AS ea) FROM n{i - 1})" for i in range(1, 13))
    return f"""WITH o AS (SELECT {k} id, {u(k, 7919, 1009)} * 2 + 0.3E0 q, {u(k, 104729, 997)} * 0.8E0 e, {u(k, 31, 101)} * 1.5E0 i, {u(k, 37, 103)} * 6.28E0 node, {u(k, 41, 107)} * 6.28E0 arg, {u(k, 43, 109)} * 400 t FROM orders),
    a AS (SELECT *, q / (1 - e) a, {lit(math.sqrt(orbits.SUN))} / pow(q / (1 - e), 1.5E0) n FROM o), n0 AS (SELECT *, (n * t) - {lit(2 * math.pi)} * floor((n * t + pi()) / {lit(2 * math.pi)}) m, (n * t) - {lit(2 * math.pi)} * floor((n * t + pi()) / {lit(2 * math.pi)}) + e * sin(n * t) ea FROM a), {newton},
    p AS (SELECT *, a * (cos(ea) - e) x0, a * sqrt(1 - e * e) * sin(ea) y0, -n * a * sin(ea) / (1 - e * cos(ea)) u0, n * a * sqrt(1 - e * e) * cos(ea) / (1 - e * cos(ea)) v0 FROM n12),
    f AS (SELECT *, cos(node) * cos(arg) - sin(node) * sin(arg) * cos(i) px, sin(node) * cos(arg) + cos(node) * sin(arg) * cos(i) py, sin(arg) * sin(i) pz, -cos(node) * sin(arg) - sin(node) * cos(arg) * cos(i) qx, -sin(node) * sin(arg) + cos(node) * cos(arg) * cos(i) qy, cos(arg) * sin(i) qz FROM p)
    SELECT id, round(x0 * px + y0 * qx, 6) + 0.0E0 x, round(x0 * py + y0 * qy, 6) + 0.0E0 y, round(x0 * pz + y0 * qz, 6) + 0.0E0 z, round(u0 * px + v0 * qx, 7) + 0.0E0 vx, round(u0 * pz + v0 * qz, 7) + 0.0E0 vz FROM f"""


@query(_kepler_sql())
def kepler_ellipses(spark, sf_dir):
    """States of derived elliptic elements, against Kepler's equation."""
    k = "o_orderkey"
    s = orbits.kepler_state(_unit(k, 7919, 1009) * 2 + 0.3, _unit(k, 104729, 997) * 0.8, _unit(k, 31, 101) * 1.5, _unit(k, 37, 103) * 6.28, _unit(k, 41, 107) * 6.28, _unit(k, 43, 109) * 400)
    return table(spark, sf_dir, "orders").select(F.col(k).alias("id"), s.alias("s")).select("id", *(r(f"s.{c}").alias(c) for c in ("x", "y", "z")), *(r(f"s.{c}", 7).alias(c) for c in ("vx", "vz")))


@query()
def sgp4_states(spark, sf_dir):
    k = "o_orderkey"
    s = orbits.sgp4_state(_unit(k, 7919, 1009) * 1440, _unit(k, 31, 101) * 0.01 + 0.055, _unit(k, 37, 103) * 0.01 + 0.0005, _unit(k, 41, 107) * 1.7, _unit(k, 43, 109) * 6.28, _unit(k, 47, 113) * 6.28, _unit(k, 53, 127) * 6.28, _unit(k, 59, 131) * 1e-4)
    return table(spark, sf_dir, "orders").select(F.col(k).alias("id"), s.alias("s")).select("id", *(r(f"s.{c}", 5).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))


def _sites(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), (F.lit(2460310.5) + F.pmod("c_custkey", F.lit(366))).alias("jd"), ((_unit("c_custkey", 7919, 997) - 0.5) * 2.9).alias("latitude"), ((_unit("c_custkey", 31, 101) - 0.5) * 6.28).alias("longitude"))


@query()
def sun_rise_transit_set(spark, sf_dir):
    return events.sun_events(_sites(spark, sf_dir))


@query("""SELECT c_custkey site, -0.0145E0 at_rise, -0.0145E0 at_set, TRUE highest, TRUE in_order FROM customer WHERE abs((((c_custkey * 7919) % 997) / 997.0E0 - 0.5E0) * 2.9E0) < 1.1""")
def sun_event_altitudes(spark, sf_dir):
    """Away from the poles the Sun is on the horizon at its rise and set, and highest at the transit between them."""
    s = _sites(spark, sf_dir).where("abs(latitude) < 1.1D")
    e = events.sun_events(s, nearest=True).join(s, "site")
    h = lambda t: events.sun_altitude(t, F.col("latitude"), F.col("longitude"))
    near = [h(F.col("transit") + d) for d in (-0.01, 0.01)]
    e = e.select("site", r(h(F.col("rise")), 4).alias("at_rise"), r(h(F.col("set")), 4).alias("at_set"), ((h(F.col("transit")) > near[0]) & (h(F.col("transit")) > near[1])).alias("highest"), ((F.col("rise") < F.col("transit")) & (F.col("transit") < F.col("set"))).alias("in_order"))
    return e


def _phases_sql() -> str:
    d = "pi() / 180"
    full, quarter = "q = 2", "q % 2 = 1"
    pick = lambda a, b: f"CASE WHEN {full} THEN {a} ELSE {b} END"
    new = (
        f"{pick(-0.40614, -0.40720)} * sin(mp) + {pick(0.17302, 0.17241)} * e * sin(m) + {pick(0.01614, 0.01608)} * sin(2 * mp) + {pick(0.01043, 0.01039)} * sin(2 * f) + {pick(0.00734, 0.00739)} * e * sin(mp - m)"
        f" - {pick(0.00515, 0.00514)} * e * sin(mp + m) + {pick(0.00209, 0.00208)} * e * e * sin(2 * m) - 0.00111 * sin(mp - 2 * f) - 0.00017 * sin(om)"
    )
    half = "-0.62801 * sin(mp) + 0.17172 * e * sin(m) - 0.01183 * e * sin(mp + m) + 0.00862 * sin(2 * mp) + 0.00804 * sin(2 * f) + 0.00454 * e * sin(mp - m) + 0.00204 * e * e * sin(2 * m) - 0.00180 * sin(mp - 2 * f) - 0.00017 * sin(om)"
    w = "0.00306 - 0.00038 * e * cos(m) + 0.00026 * cos(mp) - 0.00002 * cos(mp - m) + 0.00002 * cos(mp + m) + 0.00002 * cos(2 * f)"
    return f"""WITH a AS (SELECT CAST(i AS INTEGER) id, i / 4.0E0 k, i % 4 q, i / 4.0E0 / 1236.85E0 t FROM range(400) r(i)),
    b AS (SELECT *, 1 - 0.002516E0 * t - 0.0000074E0 * t * t e, (2.5534E0 + 29.10535670E0 * k - 0.0000014E0 * t * t) * {d} m, (201.5643E0 + 385.81693528E0 * k + 0.0107582E0 * t * t) * {d} mp, (160.7108E0 + 390.67050284E0 * k - 0.0016118E0 * t * t) * {d} f,
      (124.7746E0 - 1.56375588E0 * k + 0.0020672E0 * t * t) * {d} om, 2451550.09766E0 + 29.530588861E0 * k + t * t * (0.00015437E0 - t * (0.00000015E0 - 0.00000000073E0 * t)) jd FROM a)
    SELECT id k, round(jd + CASE WHEN {quarter} THEN {half} + CASE WHEN q = 1 THEN 1 ELSE -1 END * ({w}) ELSE {new} END, 6) jd FROM b"""


@query(_phases_sql())
def moon_phases(spark, sf_dir):
    return spark.range(0, 400).select(F.col("id").cast("int").alias("k"), r(events.moon_phase_jd(F.col("id") / 4.0), 6).alias("jd"))


@query()
def pointing_model_fit(spark, sf_dir):
    """Robust fits of a mount's terms to synthetic pointing errors with outliers."""
    s = sky(spark, sf_dir).where("abs(decl) < 1.2").withColumn("ha", F.col("ra") - math.pi).withColumn("mount", F.pmod("id", F.lit(20)).cast("int"))
    t = models.pointing_terms(latitude=0.6)
    true = {"IH": 0.01, "CH": -0.004, "NP": 0.002, "MA": 0.003, "ME": -0.001, "TF": 0.0005}
    e = sum((c * true[n] for n, c in t.items()), F.lit(0.0)) + F.when(F.pmod("id", F.lit(37)) == 0, 0.2).otherwise(0.0)
    f = models.fit_robust_sums(s.withColumn("err", e), ["mount"], t, "err")
    return f.select("mount", *(r(F.element_at("coefficients", n), 6).alias(n.lower()) for n in t), "n")


@query(f"WITH {SKY}, p AS ({_nested_sql(4)}) SELECT pixel AS cell, count(*) n, round(median(mag), 6) median FROM p GROUP BY 1")
def healpix_flagship(spark, sf_dir):
    """Robust statistics of the sky's cells."""
    s = healpix.with_nested_pixel(sky(spark, sf_dir), "cell", 4)
    return s.groupBy("cell").agg(F.count("*").alias("n"), r(F.median("mag")).alias("median"))


def _stream(spark, sf_dir: str, name: str):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(f"WITH {PIXELS} SELECT x, y, c, count(*) n, round(sum(value), 6) AS sum, round(avg(value), 6) average, round(sum(value * weight) / sum(weight), 6) weighted_average FROM pixels GROUP BY ALL")
def live_stack_stream(spark, sf_dir):
    """The running stack of a stream of pixels, after all of it: equal to the batch stack."""
    l = _stream(spark, sf_dir, "lineitem").select(
        F.pmod("l_orderkey", F.lit(40)).cast("int").alias("x"), F.pmod("l_partkey", F.lit(25)).cast("int").alias("y"), F.pmod("l_linenumber", F.lit(2)).cast("int").alias("c"), (F.col("l_extendedprice") / 99991.0).alias("value"), (F.col("l_quantity") / 50.0).alias("weight"))
    s = frames.settle(frames.live_stack(l, ["x", "y", "c"], weight="weight"), "complete", "stack")
    return s.select("x", "y", "c", "n", *(r(k).alias(k) for k in ("sum", "average", "weighted_average")))


@query("SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, max_by(props, (ts, event_id)) props, count(*) updates FROM events GROUP BY ALL")
def property_latest_stream(spark, sf_dir):
    return frames.settle(frames.latest(_stream(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "props"]), "complete", "latest")


@query("""SELECT time_bucket(INTERVAL 6 HOURS, ts) AS "start", event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 6 HOURS, any_value(ts)) + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def windowed_stream(spark, sf_dir):
    """Closed windows of a stream: those that end before the newest row less the lateness."""
    w = frames.windowed(_stream(spark, sf_dir, "events"), "ts", "6 hours", "10 minutes", ["event_type"], "value")
    return frames.settle(w, "append", "windows").withColumn("total", r("total", 4))


@query("""WITH f AS (SELECT user_id, epoch_us(ts) / 1e6 t, CAST(value AS DOUBLE) e FROM events), s AS (SELECT *, count(*) OVER (PARTITION BY user_id) n, row_number() OVER w i, t - lag(t) OVER w gap FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, e))
SELECT user_id, count(*) n, CAST(coalesce(sum(CASE WHEN gap > 3600 THEN floor(gap / 3600) END), 0) AS BIGINT) dropped, round(sum(0.9E0 * 0.7E0 * e * pow(0.1E0, n - i)), 6) output FROM s GROUP BY 1""")
def guiding_stream(spark, sf_dir):
    """A correction mixed with the one before is a sum of errors by falling powers of the mixture."""
    s = frames.settle(frames.guide(_stream(spark, sf_dir, "events"), "user_id", "ts", "value", gap=3600.0), "update", "guide", ["user_id"])
    return s.select("user_id", "n", "dropped", r("output").alias("output"))


@query("""WITH e AS (SELECT event_type, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 MINUTES THEN 0 ELSE 1 END new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM e)
SELECT min(ts) AS "start", max(ts) + INTERVAL 3 MINUTES AS "end", event_type, count(*) n, round(sum(value), 4) total FROM s GROUP BY event_type, k HAVING max(ts) + INTERVAL 3 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def session_stream(spark, sf_dir):
    """Closed runs of events of a type with less than three minutes between them."""
    w = frames.sessions(_stream(spark, sf_dir, "events"), "ts", "3 minutes", "10 minutes", ["event_type"], "value")
    return frames.settle(w, "append", "sessions").withColumn("total", r("total", 4))


@query("""SELECT user_id, count(*) n, round(max(abs(value - f)), 6) peak, round(max(value) - min(value), 6) peak_to_peak, round(regr_slope(value, s), 9) drift FROM (SELECT user_id, value, epoch_us(ts) / 1e6 - 1704067200 s, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) f FROM events) GROUP BY 1""")
def collector_stream(spark, sf_dir):
    """Samples gathered from a stream, and the snapshot of all of them after the last batch."""

    def snapshot(df):
        d = df.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200)
        first = d.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("f"))
        return d.join(first, "user_id").groupBy("user_id").agg(F.count("*").alias("n"), r(F.max(F.abs(F.col("value") - F.col("f")))).alias("peak"), r(F.max("value") - F.min("value")).alias("peak_to_peak"), r(F.regr_slope("value", "s"), 9).alias("drift"))

    return frames.collect(_stream(spark, sf_dir, "events"), snapshot)


@query("""SELECT event_type, count(*) n, round(max(value), 6) largest FROM events GROUP BY 1""")
def handler_stream(spark, sf_dir):
    """Two handlers of every batch: one counts, one keeps the largest."""
    by = frames.fan_out(_stream(spark, sf_dir, "events"), {"counts": lambda d: d.groupBy("event_type").count(), "largest": lambda d: d.groupBy("event_type").agg(F.max("value").alias("m"))})
    n = by["counts"].groupBy("event_type").agg(F.sum("count").alias("n"))
    return n.join(by["largest"].groupBy("event_type").agg(r(F.max("m")).alias("largest")), "event_type")


_RUNS = "s AS (SELECT user_id, event_id, value, row_number() OVER w i, value > lag(value) OVER w AND lag(value) OVER w > lag(value, 2) OVER w AND lag(value, 2) OVER w > lag(value, 3) OVER w stop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"""WITH {_RUNS}, e AS (SELECT user_id, min(i) FILTER (stop) at FROM s GROUP BY 1) SELECT s.user_id, round(min(value), 6) best, min_by(event_id, (value, i)) place, count(*) taken, any_value(e.at) IS NOT NULL done FROM s JOIN e USING (user_id) WHERE e.at IS NULL OR i <= e.at GROUP BY 1""".replace("FILTER (stop) at", "FILTER (stop) AS last_").replace("e.at", "e.last_"))
def autofocus_stream(spark, sf_dir):
    """Focus runs that end at the third rise in a row: the best size and its place."""
    f = frames.machine(_stream(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "value"], frames.FOCUS_START, frames.focus_step(), frames.FOCUS)
    return frames.settle(f, "update", "focus", ["user_id"]).select("user_id", r("best").alias("best"), "place", "taken", "done")


@query("""WITH s AS (SELECT user_id, value, row_number() OVER w - 1 i, abs(value - first_value(value) OVER w) way FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), e AS (SELECT user_id, coalesce(min(i) FILTER (i > 0 AND (way >= 40 OR i >= 12)), max(i)) AS last_, count(*) FILTER (i > 0 AND (way >= 40 OR i >= 12)) > 0 done FROM s GROUP BY 1)
SELECT user_id, CAST(i AS BIGINT) pulses, round(CASE WHEN i > 0 THEN way / i ELSE 0 END, 6) + 0.0E0 rate, done FROM s JOIN e USING (user_id) WHERE i = last_""")
def calibration_stream(spark, sf_dir):
    """Pulses until a star has moved far enough, and its rate."""
    f = frames.machine(_stream(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["value"], frames.CALIBRATION_START, frames.calibration_step(40.0, 12), frames.CALIBRATION)
    return frames.settle(f, "update", "calibration", ["user_id"]).select("user_id", "pulses", r("rate").alias("rate"), "done")


@query("""SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (k <= 8) ids, count(*) seen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) k FROM events) GROUP BY 1""")
def ring_buffer_stream(spark, sf_dir):
    """The last eight events of each user, kept as they come."""
    f = frames.machine(_stream(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id"], {"values": [], "seen": 0}, frames.ring(8), "values array<bigint>, seen long")
    s = frames.settle(f, "update", "ring", ["user_id"])
    return s.select("user_id", F.concat_ws(",", F.transform("values", lambda x: x.cast("string"))).alias("ids"), "seen")

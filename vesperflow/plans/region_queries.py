"""Region queries, covers and set operations over the sky table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vesperflow.functions import healpix
from vesperflow.operators import region, robust, stack
from vesperflow.plans.common import DEG, SKY, layout, lit, query, r, sky
from vesperflow.session import table

CONE = region.Cone(83.0 * DEG, -5.0 * DEG, 12.0 * DEG)
BOX = region.Box(350.0 * DEG, 15.0 * DEG, -20.0 * DEG, 35.0 * DEG)
TRIANGLE = region.Triangle((100 * DEG, 5 * DEG), (130 * DEG, 8 * DEG), (110 * DEG, 40 * DEG))
POLYGON = region.Polygon(((210 * DEG, -10 * DEG), (240 * DEG, -12 * DEG), (250 * DEG, 15 * DEG), (225 * DEG, 30 * DEG), (205 * DEG, 12 * DEG)))
SPHERICAL = region.Polygon(POLYGON.vertices, mode="spherical")
SQUARE = region.Square(300.0 * DEG, 40.0 * DEG, 9.0 * DEG)


def _sep(a: float, d: float, ra: str = "ra", dec: str = "decl") -> str:
    x = f"cos({dec}) * sin({ra} - {lit(a)})"
    y = f"{lit(math.cos(d))} * sin({dec}) - {lit(math.sin(d))} * cos({dec}) * cos({ra} - {lit(a)})"
    z = f"{lit(math.sin(d))} * sin({dec}) + {lit(math.cos(d))} * cos({dec}) * cos({ra} - {lit(a)})"
    return f"atan2(sqrt(({x}) * ({x}) + ({y}) * ({y})), {z})"


@query(f"WITH {SKY} SELECT id, round(mag, 6) mag FROM sky WHERE {_sep(CONE.ra, CONE.dec)} <= {lit(CONE.radius)}")
def region_cone(spark, sf_dir):
    return region.within(sky(spark, sf_dir), CONE).select("id", r("mag").alias("mag"))


@query(f"WITH {SKY} SELECT id, round(mag, 6) mag FROM sky WHERE (ra >= {lit(350 * DEG)} OR ra <= {lit(15 * DEG)}) AND decl BETWEEN {lit(-20 * DEG)} AND {lit(35 * DEG)}")
def region_box_wrap(spark, sf_dir):
    return region.within(sky(spark, sf_dir), BOX).select("id", r("mag").alias("mag"))


def _planar(p: region.Polygon) -> str:
    a0, d0 = p.centre
    x = f"((ra - {lit(a0)}) - {lit(2 * math.pi)} * ceil((ra - {lit(a0)} - {lit(math.pi)}) / {lit(2 * math.pi)})) * {lit(math.cos(d0))}"
    y = f"(decl - {lit(d0)})"
    ring = p.flat()
    terms = [f"CASE WHEN ({lit(y1)} > {y}) <> ({lit(y2)} > {y}) AND {x} < ({y} - {lit(y1)}) * {lit((x2 - x1) / (y2 - y1))} + {lit(x1)} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True) if y1 != y2]
    return f"({' + '.join(terms)}) % 2 = 1"


@query(f"WITH {SKY} SELECT id FROM sky WHERE {_planar(TRIANGLE)}")
def region_triangle(spark, sf_dir):
    return region.within(sky(spark, sf_dir), TRIANGLE).select("id")


@query(f"WITH {SKY} SELECT id FROM sky WHERE {_planar(POLYGON)}")
def region_polygon_planar(spark, sf_dir):
    return region.within(sky(spark, sf_dir), POLYGON).select("id")


_HALF = " AND ".join(f"cos(decl) * cos(ra) * {lit(n[0])} + cos(decl) * sin(ra) * {lit(n[1])} + sin(decl) * {lit(n[2])} >= -1e-12" for n in SPHERICAL._normals())


@query(f"WITH {SKY} SELECT id FROM sky WHERE {_HALF}")
def region_polygon_spherical(spark, sf_dir):
    return region.within(sky(spark, sf_dir), SPHERICAL).select("id")


_DRA = f"((ra - {lit(SQUARE.ra)}) - {lit(2 * math.pi)} * ceil((ra - {lit(SQUARE.ra)} - {lit(math.pi)}) / {lit(2 * math.pi)}))"


@query(f"WITH {SKY} SELECT id FROM sky WHERE abs({_DRA} * {lit(math.cos(SQUARE.dec))}) < {lit(SQUARE.half)} AND abs(decl - {lit(SQUARE.dec)}) < {lit(SQUARE.half)}")
def region_square(spark, sf_dir):
    return region.within(sky(spark, sf_dir), SQUARE).select("id")


@query(f"WITH {SKY} SELECT id, round(mag, 6) mag FROM sky WHERE {_sep(CONE.ra, CONE.dec)} <= {lit(2 * CONE.radius)} AND mag BETWEEN 2.0 AND 12.0 ORDER BY sky.mag, id LIMIT 20")
def region_mag_limit_topn(spark, sf_dir):
    found = region.magnitude_range(region.within(sky(spark, sf_dir), region.Cone(CONE.ra, CONE.dec, 2 * CONE.radius)), 2.0, 12.0)
    return found.orderBy(F.col("mag"), "id").limit(20).select("id", r("mag").alias("mag"))


@query(f"WITH {SKY} SELECT id FROM sky WHERE {_sep(CONE.ra, CONE.dec)} <= {lit(CONE.radius)} OR (abs({_DRA} * {lit(math.cos(SQUARE.dec))}) < {lit(SQUARE.half)} AND abs(decl - {lit(SQUARE.dec)}) < {lit(SQUARE.half)})")
def region_any_of(spark, sf_dir):
    return region.any_of(sky(spark, sf_dir), [CONE, SQUARE]).select("id")


def _ring_sql(n: int) -> str:
    t = f"(ra * {lit(2 / math.pi)} - 4 * floor(ra * {lit(2 / math.pi)} / 4))"
    return f"""SELECT *, CAST(CASE WHEN abs(z) <= 2.0E0 / 3 THEN
      2 * {n} * ({n} - 1) + (jp - jm + {n}) * 4 * {n} + ((floor((jp + jm - {n} + (1 - (((jp - jm + {n + 1}) % 2 + 2) % 2)) + 1) / 2) % {4 * n}) + {4 * n}) % {4 * n}
      ELSE CASE WHEN z > 0 THEN 2 * ring * (ring - 1) + floor(t * ring) % (4 * ring) ELSE {12 * n * n} - 2 * ring * (ring + 1) + floor(t * ring) % (4 * ring) END END AS BIGINT) pixel
    FROM (SELECT *, floor((t - floor(t)) * {n} * sqrt(3 * (1 - abs(z)))) + floor((1 - (t - floor(t))) * {n} * sqrt(3 * (1 - abs(z)))) + 1 ring
          FROM (SELECT *, sin(decl) z, {t} t, floor(({t} + 0.5E0) * {n} - sin(decl) * {lit(0.75 * n)}) jp, floor(({t} + 0.5E0) * {n} + sin(decl) * {lit(0.75 * n)}) jm FROM sky))"""


@query(f"WITH {SKY}, p AS ({_ring_sql(16)}) SELECT pixel, count(*) n, round(min(mag), 6) brightest FROM p GROUP BY pixel")
def healpix_ring_count(spark, sf_dir):
    return healpix.with_ring_pixel(sky(spark, sf_dir), "pixel", 16).groupBy("pixel").agg(F.count("*").alias("n"), r(F.min("mag")).alias("brightest"))


def _nested_sql(n: int) -> str:
    bits = n.bit_length() - 1
    t = f"(ra * {lit(2 / math.pi)} - 4 * floor(ra * {lit(2 / math.pi)} / 4))"
    spread = lambda v, s: " + ".join(f"((CAST({v} AS BIGINT) >> {b}) & 1) * {1 << (2 * b + s)}" for b in range(bits))
    w = f"{n} * sqrt(3 * (1 - abs(z)))"
    return f"""SELECT *, CAST(face AS BIGINT) * {n * n} + {spread("ix", 0)} + {spread("iy", 1)} pixel FROM (
      SELECT *, CASE WHEN abs(z) <= 2.0E0 / 3 THEN CASE WHEN fp = fm THEN fp % 4 + 4 WHEN fp < fm THEN fp % 4 ELSE fm % 4 + 8 END ELSE CASE WHEN z > 0 THEN q ELSE q + 8 END END face,
        CASE WHEN abs(z) <= 2.0E0 / 3 THEN jm % {n} ELSE CASE WHEN z > 0 THEN {n - 1} - um ELSE up END END ix,
        CASE WHEN abs(z) <= 2.0E0 / 3 THEN {n - 1} - jp % {n} ELSE CASE WHEN z > 0 THEN {n - 1} - up ELSE um END END iy
      FROM (SELECT *, floor(jp / {n}) fp, floor(jm / {n}) fm, least(floor(t), 3) q,
              least(floor((t - least(floor(t), 3)) * {w}), {n - 1}) up, least(floor((1 - (t - least(floor(t), 3))) * {w}), {n - 1}) um
            FROM (SELECT *, sin(decl) z, {t} t, floor(({t} + 0.5E0) * {n} - sin(decl) * {lit(0.75 * n)}) jp, floor(({t} + 0.5E0) * {n} + sin(decl) * {lit(0.75 * n)}) jm FROM sky)))"""


@query(f"WITH {SKY}, p AS ({_nested_sql(16)}) SELECT pixel, pixel >> 4 AS coarse, count(*) n FROM p GROUP BY ALL")
def healpix_nested_count(spark, sf_dir):
    p = healpix.with_nested_pixel(sky(spark, sf_dir), "pixel", 16)
    return p.groupBy("pixel", healpix.parent("pixel", 2).alias("coarse")).agg(F.count("*").alias("n"))


@query(f"WITH {SKY} SELECT id, round(mag, 6) mag FROM sky WHERE {_sep(CONE.ra, CONE.dec)} <= {lit(CONE.radius)}")
def healpix_cover_semijoin(spark, sf_dir):
    """The sky is stored once by its pixel, so the cover's list prunes the scans of all that ask."""
    s = layout(spark, sf_dir, "sky-by-pixel", lambda path: healpix.with_nested_pixel(sky(spark, sf_dir), "hpx", 64).repartitionByRange("hpx").sortWithinPartitions("hpx").write.parquet(path))
    return region.by_cover(s, CONE, 64).select("id", r("mag").alias("mag"))


@query(f"WITH {SKY}, p AS ({_nested_sql(16)}) SELECT DISTINCT pixel FROM p WHERE {_sep(CONE.ra, CONE.dec)} <= {lit(CONE.radius)} OR {_sep(SQUARE.ra, SQUARE.dec)} <= {lit(SQUARE.half)}")
def cover_union_distinct(spark, sf_dir):
    s = healpix.with_nested_pixel(sky(spark, sf_dir), "pixel", 16)
    return region.within(s, CONE).select("pixel").union(region.within(s, region.Cone(SQUARE.ra, SQUARE.dec, SQUARE.half)).select("pixel")).distinct()


@query(f"""WITH {SKY}, tiles AS (SELECT band, CAST(k AS INTEGER) k FROM (SELECT unnest(range(12)) band), unnest(range(24)) u(k)),
hit AS (SELECT CAST(band AS INTEGER) band, k FROM tiles WHERE -90 + 15 * band <= 35 AND -75 + 15 * band >= -20 AND (15 * (k + 1) >= 350 OR 15 * k <= 15)),
s AS (SELECT *, CAST(least(floor((decl + {lit(math.pi / 2)}) / {lit(15 * DEG)}), 11) AS INTEGER) band, CAST(floor(ra / {lit(15 * DEG)}) AS INTEGER) k FROM sky)
SELECT band, k, count(*) n FROM s JOIN hit USING (band, k) WHERE (ra >= {lit(350 * DEG)} OR ra <= {lit(15 * DEG)}) AND decl BETWEEN {lit(-20 * DEG)} AND {lit(35 * DEG)} GROUP BY ALL""")
def tile_pruned_scan(spark, sf_dir):
    """A box over a sky stored in tiles: only the folders of tiles whose bounds meet it are scanned."""
    tiles = sky(spark, sf_dir).withColumn("band", F.least(F.floor((F.col("decl") + math.pi / 2) / (15 * DEG)), F.lit(11)).cast("int")).withColumn("k", F.floor(F.col("ra") / (15 * DEG)).cast("int"))
    s = layout(spark, sf_dir, "sky-in-tiles", lambda path: tiles.withColumn("tile", F.col("band") * 24 + F.col("k")).repartition("tile").write.partitionBy("tile").parquet(path))
    hit = [24 * b + k for b in range(12) for k in range(24) if -90 + 15 * b <= 35 and -75 + 15 * b >= -20 and (15 * (k + 1) >= 350 or 15 * k <= 15)]
    return region.within(s.where(F.col("tile").isin(hit)), BOX).groupBy("band", "k").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT o_custkey frame, count(*) n, median(o_totalprice) / 10000.0E0 snr, median(o_orderkey % 97) / 10.0E0 hfd, avg(o_totalprice) / 1e5 AS background FROM orders GROUP BY 1)
SELECT frame, concat_ws(',', CASE WHEN n < 8 THEN 'stars' END, CASE WHEN snr < 20 THEN 'snr' END, CASE WHEN hfd > 5 THEN 'hfd' END, CASE WHEN background > 3 THEN 'background' END) reasons,
  round(least(greatest(sqrt(n) * greatest(snr, 1) / greatest(hfd, 0.5), 0), 1e6), 6) quality FROM f""")
def subframe_select_reasons(spark, sf_dir):
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("frame")).agg(
        F.count("*").alias("n"), (F.median("o_totalprice") / 10000.0).alias("snr"), (F.median(F.pmod("o_orderkey", F.lit(97))) / 10.0).alias("hfd"), (F.avg("o_totalprice") / 1e5).alias("background"))
    reasons = robust.reject_reasons({"stars": F.col("n") < 8, "snr": F.col("snr") < 20, "hfd": F.col("hfd") > 5, "background": F.col("background") > 3})
    return f.select("frame", F.concat_ws(",", reasons).alias("reasons"), r(stack.quality()).alias("quality"))


@query("""SELECT o_orderpriority frame, CASE WHEN o_totalprice > 450000 THEN 'saturated' WHEN o_orderkey % 50 < 3 THEN 'edge' WHEN o_totalprice < 20000 THEN 'faint' ELSE 'kept' END reason, count(*) n FROM orders GROUP BY ALL""")
def star_filter_reasons(spark, sf_dir):
    why = robust.first_reason({"saturated": F.col("o_totalprice") > 450000, "edge": F.pmod("o_orderkey", F.lit(50)) < 3, "faint": F.col("o_totalprice") < 20000})
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("frame"), F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_id, trim(json_extract_string(props, '$.k')) k, CASE event_type WHEN 'error' THEN 'NaN' WHEN 'click' THEN ' 1.5 ' WHEN 'view' THEN 'n/a' ELSE '-2' END v FROM events)
SELECT event_id, CAST(k AS BIGINT) k, round(x, 6) x FROM (SELECT *, CASE WHEN isfinite(TRY_CAST(trim(v) AS DOUBLE)) THEN TRY_CAST(trim(v) AS DOUBLE) END x FROM t) WHERE x IS NOT NULL AND k IS NOT NULL""")
def clean_numbers(spark, sf_dir):
    """Text cast to numbers: trimmed, non-finite as null, rows without one dropped."""
    from vesperflow.functions.mathx import finite

    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_type") == "error", "NaN").when(F.col("event_type") == "click", " 1.5 ").when(F.col("event_type") == "view", "n/a").otherwise("-2")
    k = F.trim(F.get_json_object("props", "$.k")).try_cast("long")
    return e.select("event_id", k.alias("k"), r(finite(F.trim(v).try_cast("double"))).alias("x")).dropna(subset=["k", "x"])


@query(f"WITH {SKY} SELECT CAST(id % 25 AS INTEGER) grp, round(atan2(sum(sin(ra)), sum(cos(ra))), 6) mean_ra, count(*) n FROM sky GROUP BY 1")
def circular_mean_ra(spark, sf_dir):
    return sky(spark, sf_dir).groupBy(F.pmod("id", F.lit(25)).cast("int").alias("grp")).agg(r(robust.circular_mean("ra")).alias("mean_ra"), F.count("*").alias("n"))


@query("""WITH i AS (SELECT CAST(o_custkey % 200 AS INTEGER) grp, o_orderkey * 3 a, o_orderkey * 3 + o_custkey % 11 + o_orderkey % 40 b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY grp ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY a, b ROWS UNBOUNDED PRECEDING) k FROM m)
SELECT grp, min(a) AS "start", max(b) AS "end", count(*) n FROM g GROUP BY grp, k""")
def interval_union(spark, sf_dir):
    from vesperflow.operators.series import merge_intervals

    k = F.col("o_orderkey")
    i = table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(200)).cast("int").alias("grp"), (k * 3).alias("a"), (k * 3 + F.pmod("o_custkey", F.lit(11)) + F.pmod(k, F.lit(40))).alias("b"))
    return merge_intervals(i, "grp", "a", "b")


@query(f"""WITH {SKY} SELECT pixel, id, round(mag, 6) mag, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pixel ORDER BY mag, id) AS INTEGER) rank FROM (SELECT id, mag, CAST(floor((decl + {lit(math.pi / 2)}) * 10) AS INTEGER) pixel FROM sky)) WHERE rank <= 5""")
def topk_per_group(spark, sf_dir):
    from pyspark.sql import Window

    s = sky(spark, sf_dir).withColumn("pixel", F.floor((F.col("decl") + math.pi / 2) * 10).cast("int"))
    w = Window.partitionBy("pixel").orderBy("mag", "id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("pixel", "id", r("mag").alias("mag"), "rank")


@query(f"WITH {SKY} SELECT id, round(v, 6) v FROM (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE mag END v FROM sky) ORDER BY sky_sort.v NULLS LAST, id LIMIT 50".replace("sky_sort.v", "v"))
def sort_missing_last_topn(spark, sf_dir):
    s = sky(spark, sf_dir).select("id", F.when(F.pmod("id", F.lit(3)) != 0, F.col("mag")).alias("v"))
    return s.orderBy(F.col("v").asc_nulls_last(), "id").limit(50).select("id", r("v").alias("v"))

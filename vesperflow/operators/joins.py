"""Joins that have no equality of their own, rewritten with one: cells, buckets and ordered unions.

None is a cross join. Ranges and radii become equalities on cells of about their width, with the exact condition as a
residual; as-of lookups sort the union of both sides by key and time in one exchange.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperflow.functions.sphere import separation
from vesperflow.operators.groups import map_groups
from vesperflow.session import materialize


def asof(left: DataFrame, right: DataFrame, by: str, time: str, values: list[str], direction: str = "backward") -> DataFrame:
    """`left` with the `values` of the last row of `right` at or before its time (or first at or after), within `by`.

    Both sides go through one exchange on `by` and one sort; equal times of `right` take the last by its values.
    Keys without a match get nulls. A key's rows are sorted, with spill, in one task: split `by` further (for example
    with a day) where one key may be hot and carry the boundary with `asof_bucketed`.
    """
    v = F.struct(*(F.col(c) for c in values))
    a = left.select(F.struct(*left.columns).alias("_l"), F.col(by).alias("_k"), F.col(time).alias("_t"), F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType).alias("_v"), F.lit(1).alias("_o"))
    b = right.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(by).alias("_k"), F.col(time).alias("_t"), v.alias("_v"), F.lit(0).alias("_o"))
    # a running frame both ways: looking forward is looking back in falling time
    order = ["_t", "_o", F.col("_v").asc_nulls_last()] if direction == "backward" else [F.desc("_t"), "_o", F.col("_v").desc_nulls_last()]
    found = F.last("_v", ignorenulls=True).over(Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("_f", found).where(F.col("_l").isNotNull())
    return both.select("_l.*", *(F.col(f"_f.{c}").alias(c) for c in values))


def asof_bucketed(left: DataFrame, right: DataFrame, by: str, time: str, values: list[str], seconds: int) -> DataFrame:
    """Backward as-of for hot keys: keys are split by time bucket, and each bucket starts from the last row before it.

    The last row of every (key, bucket) of `right`, one in each bucket, is carried forward to the next buckets that
    `left` or `right` have, so buckets can be sorted by different tasks.
    """
    bucket = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    v = F.struct(F.col(time).alias("_at"), *(F.col(c) for c in values))
    r, l = right.withColumn("_b", bucket), left.withColumn("_b", bucket)
    last = r.groupBy(by, "_b").agg(F.max(v).alias("_last"))
    marks = l.select(by, "_b").distinct().join(last, [by, "_b"], "full")
    w = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_before", F.last("_last", ignorenulls=True).over(w)).where("_before IS NOT NULL")
    start = carried.select(F.concat_ws("|", F.col(by).cast("string"), F.col("_b").cast("string")).alias("_kb"), F.col("_before._at").alias(time), *(F.col(f"_before.{c}").alias(c) for c in values))
    key = F.concat_ws("|", F.col(by).cast("string"), F.col("_b").cast("string"))
    own = r.select(key.alias("_kb"), time, *values).unionByName(start)
    return asof(l.withColumn("_kb", key).drop("_b"), own, "_kb", time, values).drop("_kb")


def brackets(points: DataFrame, series: DataFrame, by: str, x: str, values: list[str]) -> DataFrame:
    """`points` with `_a` and `_b`, structs of x and the values of the last row of `series` at or before and the first at
    or after their x, within `by`; null where there is none.

    Both sides go through one exchange on `by` and are sorted there twice, once for each direction.
    """
    v = F.struct(F.col(x).alias("x"), *(F.col(c) for c in values))
    kind = series.select(v.alias("v")).schema["v"].dataType
    left = points.select(F.struct(*points.columns).alias("_l"), F.col(by).alias("_k"), F.col(x).alias("_t"), F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_o"))
    right = series.select(F.lit(None).cast(left.schema["_l"].dataType).alias("_l"), F.col(by).alias("_k"), F.col(x).alias("_t"), v.alias("_v"), F.lit(0).alias("_o"))
    up = Window.partitionBy("_k").orderBy("_t", "_o", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_k").orderBy(F.desc("_t"), "_o", F.col("_v").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_a", F.last("_v", ignorenulls=True).over(up)).withColumn("_b", F.last("_v", ignorenulls=True).over(down))
    return both.where(F.col("_l").isNotNull()).select("_l.*", "_a", "_b")


def interpolate(points: DataFrame, series: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """`points` with y of `series` at their x, linear between the bracketing rows, held beyond the ends, within `by`."""
    both = brackets(points, series, by, x, [y])
    a, b = F.col("_a"), F.col("_b")
    value = F.when(a.isNull(), b[y]).when(b.isNull() | (b["x"] == a["x"]), a[y]).otherwise(a[y] + (b[y] - a[y]) * (F.col(x) - a["x"]) / (b["x"] - a["x"]))
    return both.withColumn(y, value).drop("_a", "_b")


def range_join(points: DataFrame, segments: DataFrame, x: str, start: str, end: str, width: float, priority: str | None = None) -> DataFrame:
    """Each point with the segments whose [start, end] holds it; with `priority`, with the one of least priority.

    Segments are spread over the buckets of `width` that they touch, points fall into one: choose a width near the
    usual segment's length.
    """
    s = segments.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_b", F.floor(F.col(x) / width))
    out = p.join(s, "_b").where(F.col(x).between(F.col(start), F.col(end))).drop("_b")
    if priority is None:
        return out
    keys = points.columns
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*segments.columns), priority).alias("_s"))
    return best.select(*keys, "_s.*")


def _cell(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("long")


def radius_join(left: DataFrame, right: DataFrame, radius: float, xy: tuple[str, str] = ("x", "y"), frame: str | None = None) -> DataFrame:
    """All pairs at most `radius` apart in the plane (within `frame`): columns of both, right ones prefixed r_, and d2.

    Cells have the radius' width; the right side is sent to its cell and the eight around it.
    """
    x, y = xy
    r = right.toDF(*(f"r_{c}" for c in right.columns))
    near = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    r = r.withColumn("_cx", F.explode(F.transform(near, lambda d: _cell(F.col(f"r_{x}"), radius) + d))).withColumn("_cy", F.explode(F.transform(near, lambda d: _cell(F.col(f"r_{y}"), radius) + d)))
    l = left.withColumn("_cx", _cell(F.col(x), radius)).withColumn("_cy", _cell(F.col(y), radius))
    on = [l._cx == r._cx, l._cy == r._cy] + ([l[frame] == r[f"r_{frame}"]] if frame else [])
    d2 = F.pow(F.col(x) - F.col(f"r_{x}"), 2) + F.pow(F.col(y) - F.col(f"r_{y}"), 2)
    return l.join(r, on).drop("_cx", "_cy").withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def sky_join(left: DataFrame, right: DataFrame, radius: float, ra: str = "ra", dec: str = "decl", by: str | None = None) -> DataFrame:
    """All pairs at most `radius` apart on the sphere (of equal `by`): columns of both, right ones prefixed r_, and sep.

    The sphere is cut into declination bands of the radius' width and each band into cells that are at least as wide
    on the sky, so partners lie in neighbouring cells of the same or a neighbouring band; the right side is sent to
    those. Cells at the poles and over RA 0 close up by themselves.
    """
    bands = max(1, math.floor(math.pi / radius))

    def band(d: Column) -> Column:
        return F.least(F.floor((d + math.pi / 2) / (math.pi / bands)), F.lit(bands - 1)).cast("int")

    def cells(b: Column) -> Column:  # by the band's widest usable parallel: its edge nearer the pole, one radius on
        edge = F.greatest(F.abs(b * (math.pi / bands) - math.pi / 2), F.abs((b + 1) * (math.pi / bands) - math.pi / 2)) + 2 * radius
        return F.when(edge >= math.pi / 2, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.cos(edge) * 2 * math.pi / radius).cast("int")))

    def cell(a: Column, n: Column) -> Column:
        return F.least(F.floor(F.pmod(a, F.lit(2 * math.pi)) / (2 * math.pi) * n), n - 1).cast("int")

    r = right.toDF(*(f"r_{c}" for c in right.columns))
    r = r.withColumn("_b", F.explode(F.filter(F.array(*(band(F.col(f"r_{dec}")) + d for d in (-1, 0, 1))), lambda b: (b >= 0) & (b < bands))))
    n = cells(F.col("_b"))
    r = r.withColumn("_c", F.explode(F.array_distinct(F.array(*(F.pmod(cell(F.col(f"r_{ra}"), n) + d, n) for d in (-1, 0, 1))))))
    l = left.withColumn("_b", band(F.col(dec)))
    l = l.withColumn("_c", cell(F.col(ra), cells(F.col("_b"))))
    on = [l._b == r._b, l._c == r._c] + ([l[by] == r[f"r_{by}"]] if by else [])
    # the optimizer's sizes are of files and know nothing of the copies made here: a broadcast may not fit the driver
    pairs = l.join(r.hint("merge"), on).drop("_b", "_c")
    return pairs.withColumn("sep", separation(F.col(ra), F.col(dec), F.col(f"r_{ra}"), F.col(f"r_{dec}"))).where(F.col("sep") <= radius)


def _growing(left: DataFrame, group: str, key: str, k: int, first: Column, pairs) -> DataFrame:
    """(group, key, r_key, dist, rank) of the k nearest by `pairs(rows, all_)`, which gives rows' partners within each
    row's `_r`, or all of the group's with `all_`.

    A row with k partners within its radius is done, as no nearer one can lie beyond; the others go on with twice the
    radius. Groups with no more than k others are joined whole at once. Each round is stored, so rounds are not redone.
    """
    size = left.groupBy(group).agg(F.count("*").alias("_n"))
    rows = materialize(left.join(size, group).withColumn("_r", first), "rows")
    small, todo = rows.where(F.col("_n") <= k + 1), rows.where(F.col("_n") > k + 1)
    w = Window.partitionBy(group, key).orderBy("dist", f"r_{key}")

    def ranked(df: DataFrame) -> DataFrame:
        return df.select(group, key, f"r_{key}", "dist").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    found = [ranked(pairs(small, True))]
    while not todo.isEmpty():
        near = ranked(pairs(todo, False))
        got = materialize(near.withColumn("_m", F.max("rank").over(Window.partitionBy(group, key))).where(F.col("_m") == k).drop("_m"), "near")
        found.append(got)
        todo = materialize(todo.join(got.where("rank = 1").select(group, key).hint("merge"), [group, key], "left_anti").withColumn("_r", F.col("_r") * 2), "todo")
    return reduce(DataFrame.unionByName, found)


#: Rows of a frame up to which all its distances are made at once.
WHOLE = 2048


def nearest(left: DataFrame, k: int, frame: str, xy: tuple[str, str] = ("x", "y"), key: str = "idx") -> DataFrame:
    """For each row the k nearest other rows of its frame by squared distance, ties by key: (frame, key, r_key, d2, rank).

    Keys are distinct within a frame. Frames of up to WHOLE rows, an image's stars, are done one after another in
    batches. Rows of larger ones meet in cells of their frame, at first of a width that has some k rows if they lie
    evenly, so a frame of any size is spread over tasks and none compares all its pairs.
    """
    x, y = xy
    rows = left.select(frame, key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    kinds = dict(rows.dtypes)
    big = rows.groupBy(frame).agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE).select(frame)

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(key, kind="stable")
        ids, px, py = p[key].to_numpy(), p["_x"].to_numpy(float), p["_y"].to_numpy(float)
        d2 = (px[:, None] - px) ** 2 + (py[:, None] - py) ** 2
        np.fill_diagonal(d2, np.inf)
        n = min(k, len(ids) - 1)
        near = np.argsort(d2, axis=1, kind="stable")[:, :n]  # stable over rising keys: ties by key
        row = np.repeat(np.arange(len(ids)), n)
        return pd.DataFrame({frame: p[frame].iloc[0], key: ids[row], f"r_{key}": ids[near.ravel()], "d2": d2[row, near.ravel()], "rank": np.tile(np.arange(1, n + 1, dtype=np.int32), len(ids))})

    some = not big.isEmpty()
    small = rows.join(big, frame, "left_anti") if some else rows
    found = map_groups(small, [frame], whole, f"{frame} {kinds[frame]}, {key} {kinds[key]}, r_{key} {kinds[key]}, d2 double, rank int")
    if not some:
        return found
    rows = rows.join(big, frame, "left_semi")
    span = rows.groupBy(frame).agg((F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y"), F.lit(1e-12)) * F.sqrt(F.lit(2.0 * k) / math.pi / F.count("*"))).alias("_w"))
    rows = rows.join(span, frame)
    other = rows.select(F.col(frame).alias("_f"), F.col(key).alias(f"r_{key}"), F.col("_x").alias("_u"), F.col("_y").alias("_v"))

    def pairs(some: DataFrame, all_: bool) -> DataFrame:
        d2 = F.pow(F.col("_x") - F.col("_u"), 2) + F.pow(F.col("_y") - F.col("_v"), 2)
        if all_:
            return some.join(other, some[frame] == other._f).where(F.col(key) != F.col(f"r_{key}")).withColumn("dist", d2)
        # every row of the frame goes to the cell it lies in; a searching row to its own cell and those around it
        width = some.groupBy(frame).agg(F.max("_r").alias("_c"))
        near = F.array(*(F.lit(d) for d in (-1, 0, 1)))
        cell = lambda v: F.floor(F.col(v) / F.col("_c")).cast("long")
        l = some.join(width, frame).withColumn("_cx", F.explode(F.transform(near, lambda d: cell("_x") + d))).withColumn("_cy", F.explode(F.transform(near, lambda d: cell("_y") + d)))
        o = other.join(width.withColumnRenamed(frame, "_f"), "_f").withColumn("_ox", cell("_u")).withColumn("_oy", cell("_v")).drop("_c")
        both = l.join(o, (l[frame] == o._f) & (l._cx == o._ox) & (l._cy == o._oy)).where(F.col(key) != F.col(f"r_{key}"))
        return both.withColumn("dist", d2).where(F.col("dist") <= F.col("_r") * F.col("_r"))

    return found.unionByName(_growing(rows, frame, key, k, F.col("_w"), pairs).withColumnRenamed("dist", "d2"))


def nearest_on_sphere(left: DataFrame, k: int, by: str, ra: str = "ra", dec: str = "decl", key: str = "id") -> DataFrame:
    """For each row the k nearest other rows of the same class by separation, ties by key: (by, key, r_key, sep, rank).

    As `nearest`, by cells of the sphere. Radii are the least power of two that holds some k rows of an even sky.
    """
    rows = left.select(by, key, F.col(ra).alias("_ra"), F.col(dec).alias("_dec"))
    even = F.acos(F.greatest(F.lit(-1.0), F.lit(1.0) - F.lit(4.0 * k) / F.col("_n")))
    first = F.least(F.lit(math.pi), F.pow(F.lit(2.0), F.ceil(F.log2(even))))

    def pairs(some: DataFrame, all_: bool) -> DataFrame:
        if all_:
            o = rows.toDF(*(f"r_{c}" for c in rows.columns))
            both = some.join(o.hint("merge"), some[by] == o[f"r_{by}"]).withColumn("sep", separation(F.col("_ra"), F.col("_dec"), F.col("r__ra"), F.col("r__dec")))
        else:  # classes have few different radii: powers of two
            radii = sorted(x[0] for x in some.select("_r").distinct().collect())
            parts = [sky_join(some.where(F.col("_r") == v), rows, min(v, math.pi), "_ra", "_dec", by) for v in radii]
            both = reduce(DataFrame.unionByName, parts)
        return both.where(F.col(key) != F.col(f"r_{key}")).withColumn("dist", F.col("sep"))

    return _growing(rows, by, key, k, first, pairs).withColumnRenamed("dist", "sep")


def descriptor_votes(current: DataFrame, reference: DataFrame, dims: list[str], tolerance: float, k: int = 3, key: str = "id", frame: str | None = None) -> DataFrame:
    """(key, r_key, votes): how often a current and a reference key share similar descriptors.

    Descriptors are quantised to cells of the tolerance; the reference goes to its cell and the neighbours in every
    dimension, an equality join meets it, the exact distance filters and each current descriptor votes for its k
    nearest.
    """
    c = current
    r = reference.toDF(*(f"r_{x}" for x in reference.columns))
    for d in dims:
        c = c.withColumn(f"_{d}", _cell(F.col(d), tolerance))
        r = r.withColumn(f"_{d}", F.explode(F.array(*(_cell(F.col(f"r_{d}"), tolerance) + i for i in (-1, 0, 1)))))
    if frame:
        r = r.withColumnRenamed(f"r_{frame}", frame)
    pairs = c.join(r, [*(f"_{d}" for d in dims), *([frame] if frame else [])])
    d2 = sum((F.pow(F.col(d) - F.col(f"r_{d}"), 2) for d in dims), F.lit(0.0))
    pairs = pairs.withColumn("d2", d2).where(F.col("d2") <= tolerance * tolerance)
    w = Window.partitionBy(*([frame] if frame else []), key, *dims).orderBy("d2", f"r_{key}")
    top = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(*([frame] if frame else []), key, f"r_{key}").agg(F.count("*").alias("votes"))


def prefix_join(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Pairs in which the child's text begins with the parent's: an equality join for each length that parents have."""
    p = parents.withColumn("_n", F.char_length(parent))
    lengths = p.select("_n").distinct().agg(F.array_sort(F.collect_set("_n")).alias("_l")).scalar()  # the lengths that occur
    c = children.withColumn("_l", lengths).withColumn("_n", F.explode(F.filter("_l", lambda n: n <= F.char_length(child)))).drop("_l")
    c = c.withColumn("_p", F.left(child, "_n"))
    return c.join(p, (c._n == p._n) & (c._p == p[parent])).drop("_n", "_p")


def grid_interpolate(points: DataFrame, grid: DataFrame, x: str, y: str, value: str, key: str) -> DataFrame:
    """(key, value): bilinear values of a grid (gx, gy whole numbers, value) at points; null where a corner is missing.

    Each point meets the four corners of its cell by equality and their weighted values are summed.
    """
    corners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    p = points.select(key, fx.alias("_fx"), fy.alias("_fy"), F.floor(x).alias("_cx"), F.floor(y).alias("_cy"), F.explode(corners).alias("_k"))
    w = F.when(F.col("_k.i") == 1, F.col("_fx")).otherwise(F.lit(1.0) - F.col("_fx")) * F.when(F.col("_k.j") == 1, F.col("_fy")).otherwise(F.lit(1.0) - F.col("_fy"))
    p = p.select(key, (F.col("_cx") + F.col("_k.i")).cast("long").alias("gx"), (F.col("_cy") + F.col("_k.j")).cast("long").alias("gy"), w.alias("_w")).where("_w > 0")
    g = grid.select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), F.col(value).alias("_v"))
    s = p.join(g, ["gx", "gy"], "left").groupBy(key).agg(F.sum(F.col("_w") * F.col("_v")).alias(value), F.max(F.col("_v").isNull()).alias("_gap"))
    return s.select(key, F.when(~F.col("_gap"), F.col(value)).alias(value))


def asof_priority(points: DataFrame, tables: list[DataFrame], by: str, x: str, y: str) -> DataFrame:
    """`points` with y interpolated from the first table whose range at `by` holds x, else from the last one that has any."""
    out = points
    for i, t in enumerate(tables):
        ends = t.groupBy(by).agg(F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}"))
        out = interpolate(out, t.select(by, x, F.col(y).alias(f"_y{i}")), by, x, f"_y{i}").join(ends, by, "left")
    inside = [F.when(F.col(x).between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.col(f"_y{i}")) for i in range(len(tables))]
    value = F.coalesce(*inside, *(F.col(f"_y{i}") for i in reversed(range(len(tables)))))
    return out.select(*points.columns, value.alias(y))


def rectangle_overlap(a: list, b: list) -> tuple:
    """(left, top, right, bottom) columns of the overlap of two rectangles, null where they do not meet."""
    left, top, right, bottom = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    meets = (left <= right) & (top <= bottom)
    return tuple(F.when(meets, c) for c in (left, top, right, bottom))


def all_pairs_of_bodies(states: DataFrame, time: str, body: str, x: str, y: str, reach: str) -> DataFrame:
    """(time, a, b, gap): at each time all pairs of a few bodies, a before b, whose distance is less than both reaches.

    Bodies are a system's few moons, so a time has few pairs; they meet by an equality of time.
    """
    a = states.select(time, F.col(body).alias("a"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(reach).alias("_r"))
    b = states.select(time, F.col(body).alias("b"), F.col(x).alias("_u"), F.col(y).alias("_v"), F.col(reach).alias("_q"))
    gap = F.sqrt(F.pow(F.col("_x") - F.col("_u"), 2) + F.pow(F.col("_y") - F.col("_v"), 2))
    return a.join(b, time).where("a < b").withColumn("gap", gap).where(F.col("gap") < F.col("_r") + F.col("_q")).select(time, "a", "b", "gap")


def overlap_events(near: DataFrame, keys: list[str], time: str, step) -> DataFrame:
    """(keys, start, end, n): runs of times one step apart, as events."""
    w = Window.partitionBy(*keys).orderBy(time)
    new = (F.col(time) - F.lag(time).over(w) > step) | F.lag(time).over(w).isNull()
    runs = near.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).drop("_run")


def select_index_files(files: DataFrame, scale_low: float, scale_high: float, disc: tuple[float, float, float] | None = None) -> DataFrame:
    """Rows (file, low, high, ra, decl, radius) of a manifest whose scales overlap and whose disc meets the one asked for."""
    out = files.where((F.col("low") <= scale_high) & (F.col("high") >= scale_low))
    return out if disc is None else out.where(separation("ra", "decl", F.lit(disc[0]), F.lit(disc[1])) <= F.col("radius") + disc[2])


def history_at(points: DataFrame, history: DataFrame, by: str, time: str, values: list[str], seq: str) -> DataFrame:
    """`points` with values of a recorded path at their time, linear between the records around it; before the first and
    after the last null. Records of one time keep a jump: the last of them holds at and after it, the first before it."""
    both = brackets(points, history, by, time, [seq, *values])
    a, b, t = F.col("_a"), F.col("_b"), F.col(time)
    exact = a.isNotNull() & (a["x"] == t)
    share = (t - a["x"]) / (b["x"] - a["x"])
    return both.select(*points.columns, *(F.when(exact, a[v]).when(a.isNotNull() & b.isNotNull(), a[v] + (b[v] - a[v]) * share).alias(v) for v in values))

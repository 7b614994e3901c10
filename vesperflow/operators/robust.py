"""Robust statistics, histograms and regressions over groups. Deviations are population ones; NaN counts as missing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperflow.functions.mathx import col, count_below, finite
from vesperflow.operators.groups import map_groups
from vesperflow.session import materialize

#: Scales a median absolute deviation to a normal standard deviation.
MAD_SCALE = 1.482602218505602


def summary(df: DataFrame, by: list[str], x: str, key: str) -> DataFrame:
    """n, min and max with the key of their first row, mean, median, population deviation and RMS of finite values.

    All but the median are partial sums; the median is by `quantiles`.
    """
    v = finite(F.col(x))
    at = F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(key).alias("k")))
    down = F.when(v.isNotNull(), F.struct((-v).alias("v"), F.col(key).alias("k")))
    out = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(at)["v"].alias("min"), F.min(at)["k"].alias("min_key"), (-F.min(down)["v"]).alias("max"), F.min(down)["k"].alias("max_key"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.sqrt(F.avg(v * v)).alias("rms"),
    )
    median = quantiles(df, by, x, [0.5]).withColumnRenamed("p0", "median")
    return out.join(median, by, "left") if by else out.withColumn("median", median.select("median").scalar())


def mad(df: DataFrame, by: list[str], x: str, normalized: bool = False, large: bool = False) -> DataFrame:
    """median and mad of each group: a second aggregate over deviations from the first's median.

    A group's values meet in one task, as suits frames of stars; `large` groups are cut into intervals by `quantiles`.
    """
    d = df.withColumn("_v", finite(F.col(x)))
    if large:
        centre = materialize(quantiles(d, by, "_v", [0.5]).withColumnRenamed("p0", "median"), "medians")
        away = _attach(d, centre, by).withColumn("_d", F.abs(F.col("_v") - F.col("median")))
        spread = quantiles(away, by, "_d", [0.5]).withColumnRenamed("p0", "mad")
        out = _attach(centre, spread, by)
        return out.withColumn("mad", F.col("mad") * MAD_SCALE) if normalized else out
    centre = d.groupBy(*by).agg(F.median("_v").alias("median"))
    out = _attach(d, centre, by).groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col("_v") - F.col("median"))).alias("mad"))
    return out.withColumn("mad", F.col("mad") * MAD_SCALE) if normalized else out


def percentiles(df: DataFrame, by: list[str], x: str, ps: list[float]) -> DataFrame:
    """p0, p1, ..: linear percentiles of each group, whose values meet in one task; `quantiles` is for large groups."""
    q = F.percentile(finite(F.col(x)), F.array(*map(F.lit, ps)))
    return df.groupBy(*by).agg(q.alias("_q")).select(*by, *(F.col("_q")[i].alias(f"p{i}") for i in range(len(ps))))


def _attach(df: DataFrame, figures: DataFrame, by: list[str]) -> DataFrame:
    """`df` with each group's figures; without groups they are scalar subqueries."""
    return df.join(figures, by) if by else df.withColumns({c: figures.select(c).scalar() for c in figures.columns})


def histogram(df: DataFrame, by: list[str], x: str, bins: int) -> DataFrame:
    """(by, bin, n): values in 0..1 fall into bins 0 to bins - 1 by truncating v (bins - 1); outliers into the ends."""
    top = bins - 1
    v = F.col(x)
    b = F.when(v.isNull(), None).when(F.isnan(v), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(top), (F.least(F.greatest(v, F.lit(-1.0)), F.lit(2.0)) * top).cast("long"))))
    return df.select(*by, b.cast("int").alias("bin")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def histogram_moments(hist: DataFrame, by: list[str], bins: int) -> DataFrame:
    """count, mode, min, max, mean, variance, stddev, skewness, kurtosis and entropy (bits) of a histogram's 0..1 values."""
    top = float(bins - 1)
    v, n = F.col("bin") / top, F.col("n")
    first = hist.groupBy(*by).agg(F.sum("n").alias("count"), (F.max(F.struct(n.alias("n"), (-F.col("bin")).alias("b")))["b"] * -1).alias("mode_bin"), F.min("bin").alias("min_bin"), F.max("bin").alias("max_bin"), (F.sum(v * n) / F.sum("n")).alias("mean"))
    d = v - F.col("mean")
    p = n / F.col("count")
    keep = ["count", "mode_bin", "min_bin", "max_bin", "mean"]
    both = _attach(hist, first, by)
    out = both.groupBy(*by).agg(*(F.first(c).alias(c) for c in keep), (F.sum(d * d * n) / F.sum("n")).alias("variance"), (F.sum(d * d * d * n) / F.sum("n")).alias("_m3"), (F.sum(d * d * d * d * n) / F.sum("n")).alias("_m4"), (-F.sum(p * F.log2(p))).alias("entropy"))
    var = F.col("variance")
    out = out.withColumn("stddev", F.sqrt(var)).withColumn("skewness", F.when(var > 0, F.col("_m3") / F.pow(var, 1.5)).otherwise(0.0)).withColumn("kurtosis", F.when(var > 0, F.col("_m4") / (var * var) - 3).otherwise(0.0))
    return out.drop("_m3", "_m4")


def histogram_quantile(hist: DataFrame, by: list[str], bins: int, ps: list[float]) -> DataFrame:
    """q0, q1, ..: the 0..1 values below which a share of the counts lies, linear within the bin that holds it."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most `bins` rows a group
    c = hist.withColumn("_cum", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    before = F.col("_cum") - F.col("n")
    outs = []
    for i, p in enumerate(ps):
        target = F.col("_all") * p
        here = F.when(F.col("_cum") >= target, F.struct("bin", ((F.col("bin") + (target - before) / F.col("n")) / bins).alias("q")))
        outs.append(F.min(here)["q"].alias(f"q{i}"))
    return c.groupBy(*by).agg(*outs)


def stretch_parameters(df: DataFrame, by: list[str], x: str, target: float = 0.25, shadows: float = -2.8) -> DataFrame:
    """(midtone, shadow, highlight) of a screen stretch that brings the median to a target, from median and MAD."""
    s = mad(df, by, x, normalized=True, large=True)
    low = F.when(F.col("mad") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("median") + F.col("mad") * shadows))).otherwise(0.0)
    m = F.col("median") - low
    mid = F.when(m == 0, 0.0).when(m == target, 0.5).when(m == 1, 1.0).otherwise((target - 1) * m / ((2 * target - 1) * m - target))
    return s.select(*by, mid.alias("midtone"), low.alias("shadow"), F.lit(1.0).alias("highlight"))


# ---- regressions ----------------------------------------------------------------------------------------------------


def linear(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r, r2, rss, rmsd of ordinary least squares."""
    a, b = F.col(x), F.col(y)
    s = df.groupBy(*by).agg(F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.corr(b, a).alias("r"), F.regr_r2(b, a).alias("r2"), F.regr_syy(b, a).alias("_yy"), F.regr_sxy(b, a).alias("_xy"))
    rss = F.greatest(F.lit(0.0), F.col("_yy") - F.col("slope") * F.col("_xy"))
    return s.withColumn("rss", rss).withColumn("rmsd", F.sqrt(F.col("rss") / F.col("n"))).drop("_yy", "_xy")


def weighted_linear(df: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """slope, intercept and their standard errors of weighted least squares; rows need positive weights."""
    a, b, w = F.col(x), F.col(y), F.col(weight)
    d = df.where((w > 0) & a.isNotNull() & b.isNotNull())
    mean = d.groupBy(*by).agg((F.sum(w * a) / F.sum(w)).alias("_mx"), (F.sum(w * b) / F.sum(w)).alias("_my"))
    c = _attach(d, mean, by).withColumn("_dx", a - F.col("_mx")).withColumn("_dy", b - F.col("_my"))
    s = c.groupBy(*by).agg(F.count("*").alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.sum(w).alias("_w"), F.sum(w * F.col("_dx") * F.col("_dx")).alias("_xx"), F.sum(w * F.col("_dx") * F.col("_dy")).alias("_xy"), F.sum(w * F.col("_dy") * F.col("_dy")).alias("_yy"))
    slope = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx"))
    chi = F.greatest(F.lit(0.0), F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx"))
    s2 = F.when(F.col("n") > 2, chi / (F.col("n") - 2))
    return s.select(*by, "n", slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"), F.sqrt(s2 / F.col("_xx")).alias("slope_error"), F.sqrt(s2 * (1 / F.col("_w") + F.col("_mx") * F.col("_mx") / F.col("_xx"))).alias("intercept_error"))


#: Pairs of a group whose slopes are made at once; in larger groups the middle slopes are found by counting.
PAIRS = 1 << 21


def _slopes_below(x: np.ndarray, y: np.ndarray, m: float) -> int:
    """Pairs of different x, sorted by x, whose slope is less than m: inversions of y - m x, counted by merging."""
    z = y - m * x
    z = z[np.lexsort((z, x))]  # pairs of one x do not count
    n, rank = len(z), np.empty(len(z), np.int64)
    rank[np.argsort(z, kind="stable")] = np.arange(n)
    same = np.unique(z, return_inverse=True)[1]
    total, size = 0, 1
    while size < n:
        block = np.arange(n) // (2 * size)
        order = np.lexsort((np.arange(n), same, block))  # in each block by value, equal ones in their order
        left = (order // size) % 2 == 0
        # for each element of a right half, how many of its block's left half are greater
        before = np.cumsum(left)
        starts = np.r_[True, block[order][1:] != block[order][:-1]]
        base = np.maximum.accumulate(np.where(starts, before - left, 0))
        lefts = np.bincount(block[order], weights=left, minlength=int(block[-1]) + 1).astype(np.int64)
        total += int((lefts[block[order]] - (before - base))[~left].sum())
        size *= 2
    return total


def _median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """The median of the slopes of all pairs of different x; NaN without any."""
    by = np.argsort(x, kind="stable")
    x, y = x[by], y[by]
    n = len(x)
    if n * (n - 1) // 2 <= PAIRS:
        i, j = np.triu_indices(n, 1)
        ok = x[i] != x[j]
        return float(np.median((y[j] - y[i])[ok] / (x[j] - x[i])[ok])) if ok.any() else float("nan")
    pairs = (n * n - int((np.unique(x, return_counts=True)[1].astype(np.int64) ** 2).sum())) // 2
    if not pairs:
        return float("nan")
    gap = np.diff(np.unique(x)).min()
    out = []
    for k in {(pairs - 1) // 2, pairs // 2}:  # the slope with so many below it, by halving an interval
        lo, hi = -(np.ptp(y) / gap) - 1, np.ptp(y) / gap + 1
        while True:
            mid = (lo + hi) / 2
            if not lo < mid < hi:
                break
            lo, hi = (lo, mid) if _slopes_below(x, y, mid) > k else (mid, hi)
        out.append(lo)
    return float(np.mean(out))


def theil_sen(df: DataFrame, by: list[str], x: str, y: str, key: str) -> DataFrame:
    """slope (median of the slopes of all pairs of different x) and intercept (median of y - slope x) of each group.

    A group's points meet in one task, its pairs do not: beyond some million the middle slope is found by halving an
    interval and counting the slopes below, to a double's last places, so time is n log n a step and memory n.
    """
    def fit(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p["_x"].to_numpy(float), p["_y"].to_numpy(float)
        slope = _median_slope(a, b)
        return pd.DataFrame({**{c: [p[c].iloc[0]] for c in by}, "slope": [slope], "intercept": [float(np.median(b - slope * a))]})

    points = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    kinds = ", ".join(f"{c} {t}" for c, t in points.dtypes if c in by)
    return map_groups(points, by, fit, f"{kinds}, slope double, intercept double").where(~F.isnan("slope"))


def v_curve(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Two lines, left and right of the least y (which belongs to both), and where they cross."""
    low = df.groupBy(*by).agg(F.min(F.struct(F.col(y).alias("y"), F.col(x).alias("x")))["x"].alias("_at"))
    d = _attach(df, low, by)
    side = {s: F.when((F.col(x) <= F.col("_at")) if s == "left" else (F.col(x) >= F.col("_at")), F.col(x)) for s in ("left", "right")}
    out = d.groupBy(*by).agg(*(f(F.col(y), side[s]).alias(f"{s}_{n}") for s in side for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))))
    cross = F.when(F.col("left_slope") != F.col("right_slope"), (F.col("right_intercept") - F.col("left_intercept")) / (F.col("left_slope") - F.col("right_slope")))
    return out.withColumn("cross_x", cross).withColumn("cross_y", F.col("left_slope") * F.col("cross_x") + F.col("left_intercept"))


def quadratic(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """a, b, c of y = a x2 + b x + c by power sums about the group's mean x, and the vertex."""
    mean = df.groupBy(*by).agg(F.avg(x).alias("_m"))
    d = _attach(df, mean, by).withColumn("_u", F.col(x) - F.col("_m"))
    u, v = F.col("_u"), F.col(y)
    sums = {f"_s{k}": reduce(lambda p, _: p * u, range(k), F.lit(1.0)) for k in range(5)} | {f"_t{k}": reduce(lambda p, _: p * u, range(k), v) for k in range(3)}
    s = d.groupBy(*by).agg(F.first("_m").alias("_m"), *(F.sum(e).alias(n) for n, e in sums.items()))
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(n) for n in ("_s0", "_s1", "_s2", "_s3", "_s4", "_t0", "_t1", "_t2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    c = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det
    b = (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2)) / det
    a = (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det
    m = F.col("_m")
    return s.select(*by, a.alias("a"), (b - a * m * 2).alias("b"), (c - b * m + a * m * m).alias("c"), (m - b / (a * 2)).alias("vertex"))


def exponential(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """a, b of y = a exp(b x), by the line through log y; rows need positive y."""
    s = df.where(F.col(y) > 0).groupBy(*by).agg(F.regr_slope(F.log(y), F.col(x)).alias("b"), F.regr_intercept(F.log(y), F.col(x)).alias("_i"))
    return s.select(*by, F.exp("_i").alias("a"), "b")


def power_law(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """a, b of y = a x ** b, by the line through the logs; rows need positive x and y."""
    s = df.where((F.col(y) > 0) & (F.col(x) > 0)).groupBy(*by).agg(F.regr_slope(F.log(y), F.log(x)).alias("b"), F.regr_intercept(F.log(y), F.log(x)).alias("_i"))
    return s.select(*by, F.exp("_i").alias("a"), "b")


def similarity(df: DataFrame, by: list[str], weight: Column | None = None, mirrored: bool = False) -> DataFrame:
    """scale, rotation, tx, ty that take points (x, y) to (u, v) best, from weighted centred moments."""
    w = F.lit(1.0) if weight is None else weight
    y = F.col("y") * (-1 if mirrored else 1)
    d = df.select(*by, w.alias("_w"), F.col("x"), y.alias("y"), "u", "v")
    m = d.groupBy(*by).agg(*((F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"_m{c}") for c in "xyuv"))
    c = d.join(m, by)
    dx, dy, du, dv = (F.col(k) - F.col(f"_m{k}") for k in "xyuv")
    s = c.groupBy(*by).agg(*(F.first(f"_m{k}").alias(f"_m{k}") for k in "xyuv"), F.sum(F.col("_w") * (dx * du + dy * dv)).alias("_a"), F.sum(F.col("_w") * (dx * dv - dy * du)).alias("_b"), F.sum(F.col("_w") * (dx * dx + dy * dy)).alias("_n"))
    p, q = F.col("_a") / F.col("_n"), F.col("_b") / F.col("_n")
    return s.select(*by, F.sqrt(p * p + q * q).alias("scale"), F.atan2(q, p).alias("rotation"), (F.col("_mu") - p * F.col("_mx") + q * F.col("_my")).alias("tx"), (F.col("_mv") - q * F.col("_mx") - p * F.col("_my")).alias("ty"))


def robust_mean(df: DataFrame, by: list[str], xs: list[str], weight: str, sigma: float = 3.0) -> DataFrame:
    """Weighted means of `xs` without rows farther from the medians than sigma scaled MADs of the distance.

    Weights are at least 1e-6; groups of fewer than three rows reject none.
    """
    med = df.groupBy(*by).agg(*(F.median(x).alias(f"_m_{x}") for x in xs), F.count("*").alias("_n"))
    d = df.join(med, by).withColumn("_d", F.sqrt(sum(((F.col(x) - F.col(f"_m_{x}")) ** 2 for x in xs), F.lit(0.0))))
    spread = mad(d.select(*by, "_d"), by, "_d", normalized=True).select(*by, F.col("median").alias("_dm"), F.col("mad").alias("_ds"))
    keep = (F.col("_n") < 3) | (F.col("_d") <= F.col("_dm") + F.col("_ds") * sigma)
    w = F.greatest(F.col(weight), F.lit(1e-6))
    return d.join(spread, by).where(keep).groupBy(*by).agg(*((F.sum(F.col(x) * w) / F.sum(w)).alias(x) for x in xs), F.count("*").alias("used"))


def residual_clip(pairs: DataFrame, by: list[str], residual: str, radius: float, most: float) -> DataFrame:
    """Pairs whose residual is at most min(radius, most, max(median + 3 sigma, 0.4 most)), sigma from the MAD."""
    s = mad(pairs, by, residual, normalized=True).select(*by, F.least(F.lit(radius), F.lit(most), F.greatest(F.col("median") + F.col("mad") * 3, F.lit(0.4 * most))).alias("_cut"))
    return pairs.join(s, by).where(F.col(residual) <= F.col("_cut")).drop("_cut")


def reject_reasons(rules: dict[str, Column]) -> Column:
    """The names of all rules that hold, in the order given; empty if the row is accepted."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    (n, c), *rest = rules.items()
    return reduce(lambda w, r: w.when(r[1], F.lit(r[0])), rest, F.when(c, F.lit(n)))


def circular_mean(by_column) -> Column:
    """An aggregate: the mean direction of angles, in (-pi, pi]."""
    a = col(by_column)
    return F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))


#: Rows of a group up to which one task orders its values.
WHOLE = 1 << 20


def quantiles(df: DataFrame, by: list[str], x: str, ps: list[float], cuts: int = 64, whole: int | None = None) -> DataFrame:
    """(by, p0, p1, ..): exact linear percentiles of groups of any size, without bringing a large group into one task.

    The groups are counted first; with none of more than `whole` rows it is `percentiles`, which gives the same.
    Approximate quantiles cut each group into some intervals; interval counts say which of them hold the ranks that are
    asked for, and only their distinct values, counted, are put in order, an interval in one task.
    """
    keys = by or ["_all"]
    d = (df if by else df.withColumn("_all", F.lit(0))).select(*keys, finite(F.col(x)).alias("_v")).where("_v IS NOT NULL")
    if (d.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= (WHOLE if whole is None else whole):
        return percentiles(d, keys, "_v", ps).select(*by, *(f"p{i}" for i in range(len(ps))))
    few = (lambda x: x) if by else F.broadcast  # the one group's figures: joining by its one key would deal all rows to one task
    edges = d.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", [i / cuts for i in range(1, cuts)], 10 * cuts)).alias("_e"))
    d = d.join(few(edges), keys).withColumn("_b", count_below("_e", "_v", cuts.bit_length())).drop("_e")
    sizes = d.groupBy(*keys, "_b").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*keys)  # at most `cuts` rows a group
    sizes = sizes.withColumn("_before", F.sum("_m").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).withColumn("_total", F.sum("_m").over(w))
    ranks = F.array(*(r for p in ps for h in (F.col("_total") - 1,) for r in (F.floor(h * p), F.ceil(h * p))))
    held = sizes.withColumn("_ranks", F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))).where(F.size("_ranks") > 0)
    # of the values only those in intervals that hold a rank go on, counted
    some = d.join(few(held.select(*keys, "_b")), [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_n")).join(few(held), [*keys, "_b"])
    order = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("_last", F.col("_before") + F.sum("_n").over(order))
    hit = some.withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r < F.col("_last")) & (r >= F.col("_last") - F.col("_n")))))
    at = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"), F.first("_total").alias("_total"))  # two entries a percentile

    def value(p: float) -> Column:
        h = (F.col("_total") - 1) * p
        lo, hi = F.element_at("_at", F.floor(h)), F.element_at("_at", F.ceil(h))
        return lo + (hi - lo) * (h - F.floor(h))

    return at.select(*by, *(value(p).alias(f"p{i}") for i, p in enumerate(ps)))


def approximate_median(df: DataFrame, by: list[str], x: str, error: float = 0.001) -> DataFrame:
    """(by, median, sigma): median and scaled MAD within `error` of the ranks, from sketches of bounded size."""
    accuracy = max(100, int(1 / error))
    d = df.withColumn("_v", finite(F.col(x)))
    m = d.groupBy(*by).agg(F.percentile_approx("_v", 0.5, accuracy).alias("median"))
    s = _attach(d, m, by).groupBy(*by).agg(F.first("median").alias("median"), (F.percentile_approx(F.abs(F.col("_v") - F.col("median")), 0.5, accuracy) * MAD_SCALE).alias("sigma"))
    return s


def polynomial(df: DataFrame, by: list[str], x: str, y: str, degree: int, through_zero: bool = False) -> DataFrame:
    """(by, coefficients): y = c0 + c1 x + .. by least squares, lowest power first, from power sums about the mean x
    (about 0 without c0). Sums go through the exchange; a group's few are solved in Arrow batches."""
    mean = df.groupBy(*by).agg(F.avg(x).alias("_m"))
    d = _attach(df, mean, by).withColumn("_u", F.col(x) - (F.lit(0.0) if through_zero else F.col("_m")))
    s = d.groupBy(*by).agg(F.first("_m").alias("_m"), F.array(*(F.sum(F.pow("_u", F.lit(float(k)))) for k in range(2 * degree + 1))).alias("_s"), F.array(*(F.sum(F.col(y) * F.pow("_u", F.lit(float(k)))) for k in range(degree + 1))).alias("_t"))
    first = 1 if through_zero else 0

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series, sums: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for centre, a, b in zip(m, sums, t, strict=True):
            a, b = np.asarray(a, float), np.asarray(b, float)
            c = np.zeros(degree + 1)
            c[first:] = np.linalg.lstsq(np.array([[a[i + j] for j in range(first, degree + 1)] for i in range(first, degree + 1)]), b[first:], rcond=None)[0]
            if not through_zero:  # from powers about the mean to powers of x
                shifted = np.polynomial.Polynomial(c)(np.polynomial.Polynomial([-centre, 1.0])).coef
                c = np.concatenate([shifted, np.zeros(degree + 1 - len(shifted))])
            out.append(c.tolist())
        return pd.Series(out)

    return s.select(*by, solve("_m", "_s", "_t").alias("coefficients"))


def affine(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, c, d, e, f): u = a x + b y + c, v = d x + e y + f of points (x, y, u, v) by least squares, from moments."""
    m = df.groupBy(*by).agg(*(F.avg(c).alias(f"_m{c}") for c in "xyuv"))
    c = _attach(df, m, by)
    g = {k: F.col(k) - F.col(f"_m{k}") for k in "xyuv"}
    s = c.groupBy(*by).agg(*(F.first(f"_m{k}").alias(f"_m{k}") for k in "xyuv"), *(F.sum(g[p] * g[q]).alias(f"_{p}{q}") for p, q in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")))
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    a, b = ((F.col("_xu") * F.col("_yy") - F.col("_yu") * F.col("_xy")) / det, (F.col("_yu") * F.col("_xx") - F.col("_xu") * F.col("_xy")) / det)
    d, e = ((F.col("_xv") * F.col("_yy") - F.col("_yv") * F.col("_xy")) / det, (F.col("_yv") * F.col("_xx") - F.col("_xv") * F.col("_xy")) / det)
    return s.where(det != 0).select(*by, a.alias("a"), b.alias("b"), (F.col("_mu") - a * F.col("_mx") - b * F.col("_my")).alias("c"), d.alias("d"), e.alias("e"), (F.col("_mv") - d * F.col("_mx") - e * F.col("_my")).alias("f"))


def image_histogram(pixels: DataFrame, by: list[str], bits: int = 16, weights: dict[int, float] | None = None, roi: tuple[int, int, int, int] | None = None, mask: Column | None = None, transform=None) -> DataFrame:
    """(by, bin, n): histogram of 2 ** bits bins of pixels (by, x, y, c, value) within a region and not masked.

    weights: of the channels whose sum is a pixel's one value; transform: of that value, a function of a Column.
    """
    p = pixels if mask is None else pixels.where(~mask)
    if roi:
        p = p.where(F.col("x").between(roi[0], roi[2]) & F.col("y").between(roi[1], roi[3]))
    if weights:
        w = reduce(lambda e, k: e.when(F.col("c") == k, F.lit(weights[k])), list(weights)[1:], F.when(F.col("c") == list(weights)[0], F.lit(weights[list(weights)[0]])))
        p = p.where(w.isNotNull()).groupBy(*by, "x", "y").agg(F.sum(F.col("value") * w).alias("value"))
    return histogram(p.withColumn("value", transform(F.col("value")) if transform else F.col("value")), by, "value", 1 << bits)

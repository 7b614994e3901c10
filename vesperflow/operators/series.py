"""Ordered-series operators as windows over a series key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperflow.functions.mathx import TAU


def seconds(t: str) -> Column:
    return F.unix_micros(F.col(t).cast("timestamp")) / F.lit(1e6)


def forward_fill(df: DataFrame, by: str, order: list[str], value: str, out: str) -> DataFrame:
    """The last value that was not null so far, as section headers carry to the rows below."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def unwrap(df: DataFrame, by: str, order: list[str], angle: str, out: str) -> DataFrame:
    """Angles without jumps: a turn is taken off or added wherever a step exceeds half a turn."""
    w = Window.partitionBy(by).orderBy(*order)
    step = F.col(angle) - F.lag(angle).over(w)
    turn = F.when(step > math.pi, -1).when(step < -math.pi, 1).otherwise(0)
    return df.withColumn("_turn", turn).withColumn(out, F.col(angle) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.lit(TAU)).drop("_turn")


def last_of_equal(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row for each key: the last by `order`."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sign_changes(df: DataFrame, by: str, t: str, f: str) -> DataFrame:
    """(by, root): where f crosses zero, linear between samples; a sample that is exactly zero counts once."""
    w = Window.partitionBy(by).orderBy(t)
    d = df.select(by, t, f, F.lag(t).over(w).alias("_t0"), F.lag(f).over(w).alias("_f0"))
    root = F.when(F.col(f) == 0, F.col(t)).when(F.col("_f0") * F.col(f) < 0, F.col("_t0") - F.col("_f0") * (F.col(t) - F.col("_t0")) / (F.col(f) - F.col("_f0")))
    return d.select(by, root.alias("root")).where("root IS NOT NULL")


def local_extrema(df: DataFrame, by: str, t: str, f: str) -> DataFrame:
    """(by, t, f, kind): samples strictly above ("max") or below ("min") both neighbours; ends are none."""
    w = Window.partitionBy(by).orderBy(t)
    a, b, c = F.lag(f).over(w), F.col(f), F.lead(f).over(w)
    kind = F.when((b > a) & (b > c), "max").when((b < a) & (b < c), "min")
    return df.select(by, t, f, kind.alias("kind")).where("kind IS NOT NULL")


def rates(df: DataFrame, by: str, t: str, x: str) -> DataFrame:
    """(by, max_rate, peak, peak_to_peak): the largest |dx|/dt of neighbours, |x - first x|, and max less min."""
    w = Window.partitionBy(by).orderBy(t, x)
    dt = seconds(t) - F.lag(seconds(t)).over(w)
    d = df.select(by, F.col(x).alias("_x"), F.when(dt > 0, F.abs(F.col(x) - F.lag(x).over(w)) / dt).alias("_r"), F.first(x).over(w).alias("_f"))
    return d.groupBy(by).agg(F.max("_r").alias("max_rate"), F.max(F.abs(F.col("_x") - F.col("_f"))).alias("peak"), (F.max("_x") - F.min("_x")).alias("peak_to_peak"))


def sliding_rms(df: DataFrame, by: str, t: str, x: str, width: float, step: float, least: int = 4, span: float = 0.8) -> DataFrame:
    """(by, best): the least residual RMS of a line in windows of `width` every `step` seconds from the first sample.

    Windows are closed at both ends and anchored at the series' start. A row is sent to each window that holds it,
    width / step of them, and summed there. Windows need `least` samples over `span` of their width.
    """
    first = df.groupBy(by).agg(F.min(seconds(t)).alias("_t0"))
    d = df.join(first, by).withColumn("_e", seconds(t) - F.col("_t0"))
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_e") - width) / step))
    d = d.withColumn("_w", F.explode(F.sequence(lo, F.floor(F.col("_e") / step))))
    s = d.groupBy(by, "_w").agg(F.count("*").alias("_n"), (F.max("_e") - F.min("_e")).alias("_span"), F.regr_syy(F.col(x), F.col("_e")).alias("_yy"), F.regr_sxy(F.col(x), F.col("_e")).alias("_xy"), F.regr_slope(F.col(x), F.col("_e")).alias("_b"))
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("_yy") - F.col("_b") * F.col("_xy")) / F.col("_n"))
    return s.where((F.col("_n") >= least) & (F.col("_span") >= span * width)).groupBy(by).agg(F.min(rms).alias("best"))


def resample(df: DataFrame, by: str, t: str, x: str, step: float) -> DataFrame:
    """(by, s, x): x at every whole `step` of seconds between a series' first and last sample, linear in between.

    Each pair of neighbours yields the steps in its own interval, so nothing is joined back.
    """
    w = Window.partitionBy(by).orderBy("_s")
    d = df.groupBy(by, seconds(t).alias("_s")).agg(F.max(x).alias("_x"))
    d = d.select(by, "_s", "_x", F.lead("_s").over(w).alias("_s1"), F.lead("_x").over(w).alias("_x1")).where("_s1 IS NOT NULL")
    first, last = F.ceil(F.col("_s") / step), F.ceil(F.col("_s1") / step) - 1
    d = d.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    s = F.col("_k") * step
    return d.select(by, s.cast("double").alias("s"), (F.col("_x") + (F.col("_x1") - F.col("_x")) * (s - F.col("_s")) / (F.col("_s1") - F.col("_s"))).alias(x))


def merge_intervals(df: DataFrame, by: str, start: str, end: str, touch: int = 1) -> DataFrame:
    """(by, start, end, n): the union of intervals of whole numbers; those at most `touch` apart become one."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + touch), 1).otherwise(0))
    d = d.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(by, "_g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_g")


def path_length(df: DataFrame, by: str, order: str, ra: str, dec: str) -> DataFrame:
    """(by, length): the summed separations of neighbours."""
    from vesperflow.functions.sphere import separation

    w = Window.partitionBy(by).orderBy(order)
    d = df.select(by, separation(F.lag(ra).over(w), F.lag(dec).over(w), F.col(ra), F.col(dec)).alias("_d"))
    return d.groupBy(by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def pchip_slopes(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, x, y, slope): shape-preserving slopes, the weighted harmonic mean of both sides' or 0 at a turn.

    Ends take the one-sided three-point rule, limited so that the curve does not overshoot.
    """
    w = Window.partitionBy(by).orderBy(x)
    h = F.lead(x).over(w) - F.col(x)
    d = df.select(by, x, y, h.alias("_h"), ((F.lead(y).over(w) - F.col(y)) / h).alias("_d"))
    d = d.select("*", F.lag("_h").over(w).alias("_h0"), F.lag("_d").over(w).alias("_d0"), F.lead("_h").over(w).alias("_h1"), F.lead("_d").over(w).alias("_d1"), F.lag("_h", 2).over(w).alias("_g"), F.lag("_d", 2).over(w).alias("_e"))

    def end(h1: Column, h2: Column, d1: Column, d2: Column) -> Column:
        s = (d1 * (h1 * 2 + h2) - d2 * h1) / (h1 + h2)
        return F.when(d2.isNull(), d1).when(s * d1 <= 0, 0.0).when((d1 * d2 <= 0) & (F.abs(s) > F.abs(d1) * 3), d1 * 3).otherwise(s)

    h0, h1, d0, d1 = (F.col(c) for c in ("_h0", "_h", "_d0", "_d"))
    w1, w2 = h1 * 2 + h0, h1 + h0 * 2
    inner = F.when(d0 * d1 <= 0, 0.0).otherwise((w1 + w2) / (w1 / d0 + w2 / d1))
    slope = F.when(d0.isNull() & d1.isNull(), 0.0).when(d0.isNull(), end(h1, F.col("_h1"), d1, F.col("_d1"))).when(d1.isNull(), end(h0, F.col("_g"), d0, F.col("_e"))).otherwise(inner)
    return d.select(by, x, y, slope.alias("slope"))


def last_rows(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each series: what a ring buffer of that size keeps."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")

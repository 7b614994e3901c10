"""Frame stacking over pixel tables (frame, x, y, c, value[, weight]): one group for each pixel and channel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["x", "y", "c"]


def algebraic(pixels: DataFrame, by: list[str] = PIXEL, value: str = "value", weight: str | None = None) -> DataFrame:
    """sum, average and weighted average with n: partial aggregates combine, so frames may come in any order or batches."""
    w = F.col(weight) if weight else F.lit(1.0)
    return pixels.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("average"), (F.sum(F.col(value) * w) / F.sum(w)).alias("weighted_average"))


def median(pixels: DataFrame, by: list[str] = PIXEL, value: str = "value") -> DataFrame:
    return pixels.groupBy(*by).agg(F.median(value).alias("value"))


def _sorted(value: str) -> Column:
    return F.array_sort(F.collect_list(value))  # a pixel's values: as many as frames


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def min_max(pixels: DataFrame, low: int = 1, high: int = 1, by: list[str] = PIXEL, value: str = "value") -> DataFrame:
    """The mean without the `low` least and `high` greatest values; the plain mean if none would be left."""
    s = pixels.groupBy(*by).agg(_sorted(value).alias("_v"))
    n = F.size("_v")
    kept = F.when(n > low + high, F.slice("_v", F.lit(low + 1), F.greatest(n - low - high, F.lit(1)))).otherwise(F.col("_v"))
    return s.select(*by, _mean(kept).alias("value"))


def _limits(low: float, high: float, value: str) -> list[Column]:
    return [F.percentile(F.col(value), F.lit(low)).alias("_lo"), F.percentile(F.col(value), F.lit(high)).alias("_hi"), F.collect_list(value).alias("_v")]


def winsorized(pixels: DataFrame, low: float = 0.1, high: float = 0.9, by: list[str] = PIXEL, value: str = "value") -> DataFrame:
    """The mean of values brought within the group's percentiles; the plain mean of up to two values."""
    s = pixels.groupBy(*by).agg(*_limits(low, high, value))
    near = F.transform("_v", lambda v: F.least(F.greatest(v, F.col("_lo")), F.col("_hi")))
    return s.select(*by, F.when(F.size("_v") <= 2, _mean(F.col("_v"))).otherwise(_mean(near)).alias("value"))


def percentile_clip(pixels: DataFrame, low: float = 0.1, high: float = 0.9, by: list[str] = PIXEL, value: str = "value") -> DataFrame:
    """The mean of values within the group's percentiles; the plain mean if none is."""
    s = pixels.groupBy(*by).agg(*_limits(low, high, value))
    kept = F.filter("_v", lambda v: (v >= F.col("_lo")) & (v <= F.col("_hi")))
    return s.select(*by, F.when(F.size(kept) > 0, _mean(kept)).otherwise(_mean(F.col("_v"))).alias("value"))


def clipped_mean(values: np.ndarray, low: float, high: float, iterations: int, centre: str = "median") -> float:
    """The mean of what is within low and high deviations of the centre, again until nothing goes."""
    v = values[np.isfinite(values)]
    if not len(v):
        return float("nan")
    for _ in range(iterations):
        m = float(np.median(v) if centre == "median" else v.mean())
        s = float(v.std())
        if s == 0:
            return m
        kept = v[(v >= m - low * s) & (v <= m + high * s)]
        if not len(kept):
            return m
        if len(kept) == len(v):
            break
        v = kept
    return float(v.mean())


def sigma_clip(pixels: DataFrame, low: float = 3.0, high: float = 3.0, iterations: int = 5, by: list[str] = PIXEL, value: str = "value") -> DataFrame:
    """The sigma-clipped mean of each pixel: its values are gathered on the JVM side and clipped in Arrow batches."""
    s = pixels.groupBy(*by).agg(_sorted(value).alias("_v"))

    @F.pandas_udf("double")
    def clip(v: pd.Series) -> pd.Series:
        return v.map(lambda x: clipped_mean(np.asarray(x, float), low, high, iterations))

    return s.select(*by, clip("_v").alias("value"))


METHODS = {"median": median, "min-max": min_max, "winsorized": winsorized, "percentile-clip": percentile_clip, "sigma-clip": sigma_clip}


def coverage(pixels: DataFrame, by: list[str] = PIXEL) -> DataFrame:
    return pixels.groupBy(*by).agg(F.count_distinct("frame").alias("frames"))


def crop_bounds(cover: DataFrame, least: int) -> DataFrame:
    """The smallest rectangle that holds all pixels covered by at least so many frames."""
    return cover.where(F.col("frames") >= least).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def quality() -> Column:
    """A frame's score from its stars' count n, median snr and hfd: clamp(sqrt n * max(snr, 1) / max(hfd, 0.5), 0, 1e6)."""
    return F.least(F.greatest(F.sqrt("n") * F.greatest(F.col("snr"), F.lit(1.0)) / F.greatest(F.col("hfd"), F.lit(0.5)), F.lit(0.0)), F.lit(1e6))


def frame_weight(method: str) -> Column:
    """A frame's weight by its own snr, hfd, n or quality."""
    return {"none": F.lit(1.0), "snr": F.greatest(F.col("snr"), F.lit(1e-6)), "inverse-hfd": F.lit(1.0) / F.greatest(F.col("hfd"), F.lit(1e-6)), "stars": F.greatest(F.col("n").cast("double"), F.lit(1e-6)), "quality": F.greatest(F.col("quality"), F.lit(1e-6))}[method]


def reference_frame(frames: DataFrame, by: list[str], mode: str = "best", index: int = 0, least: int = 3) -> DataFrame:
    """(by, frame): best: the frame of the best quality, a quarter of it for frames of fewer than `least` stars, less the
    background; first: the first with so many stars, else the first; index: the one at a place in the order of frames."""
    if mode == "index":
        w = Window.partitionBy(*by).orderBy("frame")
        return frames.withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") == index).select(*by, "frame")
    if mode == "first":
        return frames.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("frame"))), F.min("frame")).alias("frame"))
    score = F.col("quality") * F.when(F.col("n") < least, 0.25).otherwise(1.0) - F.col("background")
    return frames.groupBy(*by).agg(F.max(F.struct(score.alias("s"), (-F.col("frame")).alias("f")))["f"].alias("_f")).select(*by, (-F.col("_f")).alias("frame"))


def normalisation(pixels: DataFrame, reference: DataFrame, by: str = "frame", mode: str = "background-scale", channels: bool = False) -> DataFrame:
    """(frame, scale, offset), by channel too if asked, that bring a frame to the reference over common pixels.

    scale: the ratio of medians; background-scale: the spans and levels of quartiles; percentile: of tenths.
    """
    keys = [by, "c"] if channels else [by]
    r = reference.select(*PIXEL, F.col("value").alias("_r"))
    ps = {"scale": (0.5, 0.5), "background-scale": (0.25, 0.75), "percentile": (0.1, 0.9)}[mode]
    q = pixels.join(r, PIXEL).groupBy(*keys).agg(F.percentile("value", F.array(*map(F.lit, ps))).alias("_a"), F.percentile("_r", F.array(*map(F.lit, ps))).alias("_b"))
    if mode == "scale":
        return q.select(*keys, F.when(F.abs(F.col("_a")[0]) > 1e-12, F.col("_b")[0] / F.col("_a")[0]).otherwise(1.0).alias("scale"), F.lit(0.0).alias("offset"))
    span = F.col("_a")[1] - F.col("_a")[0]
    scale = F.when(span > 0, (F.col("_b")[1] - F.col("_b")[0]) / span).otherwise(1.0)
    return q.select(*keys, scale.alias("scale"), (F.col("_b")[0] - scale * F.col("_a")[0]).alias("offset"))


# ---- calibration and point transforms --------------------------------------------------------------------------------


def calibrate(light: DataFrame, bias: DataFrame, dark: DataFrame, flat: DataFrame, exposure_ratio: float, dark_flat: DataFrame | None = None, phase: bool = False, strict: bool = False) -> DataFrame:
    """value = (light - bias - ratio (dark - bias)) / (flat - base) * mean(flat - base), the mean by channel.

    Masters are pixel tables (x, y, c, value) of one frame. base is the flats' own dark where given, else the bias. With
    `phase` means are by place in the colour mosaic's 2 x 2 too. A flat that is not above its base gives null, or, if
    strict, an error.
    """
    base = bias if dark_flat is None else dark_flat
    m = light
    for name, t in (("bias", bias), ("dark", dark), ("flat", flat), ("base", base)):
        m = m.join(t.select(*PIXEL, F.col("value").alias(f"_{name}")), PIXEL)
    groups = {"c": F.col("c")} | ({"_px": F.pmod("x", F.lit(2)), "_py": F.pmod("y", F.lit(2))} if phase else {})
    net_flat = flat.join(base.select(*PIXEL, F.col("value").alias("_b")), PIXEL).withColumns(groups)
    level = net_flat.groupBy(*groups).agg(F.avg(F.col("value") - F.col("_b")).alias("_level"))
    net = F.col("value") - F.col("_bias") - (F.col("_dark") - F.col("_bias")) * exposure_ratio
    gain = F.col("_flat") - F.col("_base")
    value = F.when(gain > 0, net / gain * F.col("_level"))
    if strict:
        value = value.otherwise(F.raise_error(F.lit("a flat is not above its dark")).cast("double"))
    return m.withColumns(groups).join(level, list(groups)).withColumn("value", value).drop("_bias", "_dark", "_flat", "_base", "_level", "_px", "_py")


def neutralise(pixels: DataFrame, by: str = "frame", mode: str = "target", target: float = 0.001, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Channels moved so that their background medians, of values within low and high, are equal.

    target: medians at `target`, values cut to 0..1; truncate: medians at 0, cut; rescale: medians at 0, the frame's range
    made 0..1; as-needed: rescaled only if it left 0..1.
    """
    m = pixels.groupBy(by, "c").agg(F.median(F.when(F.col("value").between(low, high), F.col("value"))).alias("_m"))
    moved = pixels.join(m, [by, "c"]).withColumn("value", F.col("value") - F.col("_m") + (target if mode == "target" else 0.0)).drop("_m")
    cut = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value")))
    if mode in ("target", "truncate"):
        return moved.withColumn("value", cut)
    span = moved.groupBy(by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(cut)
    needed = F.lit(True) if mode == "rescale" else (F.col("_lo") < 0) | (F.col("_hi") > 1)
    return moved.join(span, by).withColumn("value", F.when(needed, scaled).otherwise(F.col("value"))).drop("_lo", "_hi")


def convolve(pixels: DataFrame, kernel: list[list[float]], by: list[str]) -> DataFrame:
    """Each pixel's kernel-weighted mean of its neighbours (within `by`, x, y), over the weights inside the frame.

    Pixels are sent to the places that they touch and summed there: one exchange with partial sums, no join.
    """
    h, w = len(kernel), len(kernel[0])
    taps = F.array(*(F.struct(F.lit(dx - w // 2).alias("dx"), F.lit(dy - h // 2).alias("dy"), F.lit(float(kernel[dy][dx])).alias("k")) for dy in range(h) for dx in range(w) if kernel[dy][dx]))
    sent = pixels.withColumn("_t", F.explode(taps)).select(*by, (F.col("x") - F.col("_t.dx")).alias("x"), (F.col("y") - F.col("_t.dy")).alias("y"), (F.col("value") * F.col("_t.k")).alias("_v"), F.col("_t.k").alias("_k"), ((F.col("_t.dx") == 0) & (F.col("_t.dy") == 0)).alias("_own"))
    s = sent.groupBy(*by, "x", "y").agg(F.sum("_v").alias("_v"), F.sum("_k").alias("_k"), F.max("_own").alias("_own"))
    return s.where("_own").select(*by, "x", "y", F.when(F.col("_k") != 0, F.col("_v") / F.col("_k")).alias("value"))


def stf(v: Column, midtone: float = 0.5, shadow: float = 0.0, highlight: float = 1.0) -> Column:
    """Screen transfer: shadows and highlights clipped, the rest through the midtone curve."""
    x = F.least(F.greatest((v - shadow) / (highlight - shadow), F.lit(0.0)), F.lit(1.0))
    return F.when(x == 0, 0.0).when(x == 1, 1.0).otherwise((x * (midtone - 1)) / (x * (2 * midtone - 1) - midtone))


def arcsinh(v: Column, stretch: float, black: float = 0.0) -> Column:
    x = F.greatest((v - black) / (1 - black), F.lit(0.0))
    return F.least(F.asinh(x * stretch) / F.asinh(F.lit(stretch)), F.lit(1.0))


def gamma(v: Column, g: float) -> Column:
    return F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / g))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2125 + g * 0.7154 + b * 0.0721


def scnr(r: Column, g: Column, b: Column, amount: float = 1.0) -> Column:
    """The green channel with at most the mean of the others, mixed in by an amount."""
    return g * (1 - amount) + F.least(g, (r + b) / 2) * amount


def flip(pixels: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Mirrored left to right (width given) or top to bottom (height given)."""
    x = F.lit(width - 1) - F.col("x") if width else F.col("x")
    y = F.lit(height - 1) - F.col("y") if height else F.col("y")
    return pixels.withColumn("_x", x).withColumn("_y", y).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})


def debayer(mosaic: DataFrame, pattern: str = "RGGB", by: str = "frame") -> DataFrame:
    """(frame, x, y, r, g, b) of a colour mosaic (frame, x, y, value): each channel the mean of its samples in the 3 x 3 around."""
    at = F.element_at(F.array(*(F.lit(p) for p in pattern)), (F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2)) + 1).cast("int"))
    near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    sent = mosaic.withColumn("_c", at).withColumn("_d", F.explode(near)).select(by, (F.col("x") + F.col("_d.dx")).alias("x"), (F.col("y") + F.col("_d.dy")).alias("y"), "value", "_c", ((F.col("_d.dx") == 0) & (F.col("_d.dy") == 0)).alias("_own"))
    out = sent.groupBy(by, "x", "y").agg(F.max("_own").alias("_own"), *(F.avg(F.when(F.col("_c") == c, F.coalesce(F.when(F.col("_own"), F.col("value")), F.col("value")))).alias(c.lower()) for c in "RGB"), *(F.max(F.when(F.col("_own") & (F.col("_c") == c), F.col("value"))).alias(f"_{c}") for c in "RGB"))
    return out.where("_own").select(by, "x", "y", *(F.coalesce(f"_{c}", c.lower()).alias(c.lower()) for c in "RGB"))


def cosmetic(pixels: DataFrame, sigma: float = 5.0, by: str = "frame") -> DataFrame:
    """Pixels farther from their eight neighbours' median than sigma deviations of the frame take that median."""
    near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    sent = pixels.withColumn("_d", F.explode(near)).select(by, (F.col("x") + F.col("_d.dx")).alias("x"), (F.col("y") + F.col("_d.dy")).alias("y"), F.col("value").alias("_v"), ((F.col("_d.dx") == 0) & (F.col("_d.dy") == 0)).alias("_own"))
    s = sent.groupBy(by, "x", "y").agg(F.max(F.when(F.col("_own"), F.col("_v"))).alias("value"), F.median(F.when(~F.col("_own"), F.col("_v"))).alias("_m"))
    s = s.where("value IS NOT NULL").withColumn("_e", F.col("value") - F.col("_m"))
    spread = s.groupBy(by).agg((F.median(F.abs("_e")) * 1.482602218505602).alias("_s"))
    bad = (F.col("_s") > 0) & (F.abs("_e") > F.col("_s") * sigma)
    return s.join(spread, by).select(by, "x", "y", F.when(bad, F.col("_m")).otherwise(F.col("value")).alias("value"), F.coalesce(bad, F.lit(False)).alias("repaired"))


def greedy_pairs(pairs: DataFrame, frame: str, left: str, right: str, cost: str) -> DataFrame:
    """One-to-one pairs of each frame by rising cost: a pair is kept if neither side is taken yet.

    The order decides, so a frame's candidate pairs (those within a radius) are walked in one task.
    """
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (frame, left, right, cost)}

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([cost, left, right], kind="stable")
        taken_l, taken_r, keep = set(), set(), []
        for a, b in zip(p[left], p[right], strict=True):
            ok = a not in taken_l and b not in taken_r
            keep.append(ok)
            if ok:
                taken_l.add(a)
                taken_r.add(b)
        return p[keep]

    return pairs.select(*kinds).groupBy(frame).applyInPandas(walk, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def score_gap_cut(stars: DataFrame, by: str, score: str, most: int = 128, least: int = 3, ratio: float = 2.0) -> DataFrame:
    """Stars above the largest drop between neighbouring scores, if that exceeds a ratio; at least `least` stay."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.col("id"))
    s = stars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).withColumn("_drop", F.lag(score).over(w) / F.when(F.col(score) > 0, F.col(score)))
    cut = s.where((F.col("_r") > least) & (F.col("_drop") > ratio)).groupBy(by).agg(F.max(F.struct("_drop", (-F.col("_r")).alias("r")))["r"].alias("_cut"))
    return s.join(cut, by, "left").where(F.col("_cut").isNull() | (F.col("_r") < -F.col("_cut"))).drop("_r", "_drop", "_cut")


def assign_in_order(references: DataFrame, stars: DataFrame, frame: str, key: str, order: str, radius: float) -> DataFrame:
    """(frame, key, r_key, d2): each reference in turn takes the nearest star of its frame, within the radius, that none
    before it took; references without one have null.

    The order decides, so a frame's candidates, pairs within the radius, are walked in one task.
    """
    from vesperflow.operators.joins import radius_join

    near = radius_join(references.select(frame, key, order, "x", "y"), stars.select(frame, key, "x", "y"), radius, frame=frame)
    kinds = {c: references.schema[c].dataType.simpleString() for c in (frame, key)}

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([order, key, "d2", f"r_{key}"], kind="stable")
        taken, done, keep = set(), set(), []
        for a, b in zip(p[key], p[f"r_{key}"], strict=True):
            ok = a not in done and b not in taken
            keep.append(ok)
            if ok:
                done.add(a)
                taken.add(b)
        return p.loc[keep, [frame, key, f"r_{key}", "d2"]]

    got = near.groupBy(frame).applyInPandas(walk, f"{frame} {kinds[frame]}, {key} {kinds[key]}, r_{key} {kinds[key]}, d2 double")
    return references.select(frame, key).join(got, [frame, key], "left")


def thin_out(stars: DataFrame, frame: str, key: str, rank: list[str], distance: float) -> DataFrame:
    """Stars none of which lies within the distance of a better one that stays: by falling `rank` columns, ties by key.

    The order decides. Only stars with a neighbour within the distance are walked, a frame in one task; all others stay.
    """
    from vesperflow.operators.joins import radius_join

    own = stars.select(frame, key, *rank, "x", "y")
    near = radius_join(own, own.select(frame, key, "x", "y"), distance, frame=frame).where(F.col(key) != F.col(f"r_{key}"))
    links = near.select(frame, key, *rank, F.col(f"r_{key}").alias("_o"))
    kinds = {c: stars.schema[c].dataType.simpleString() for c in (frame, key)}

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([*rank, key], ascending=[False] * len(rank) + [True], kind="stable")
        kept, gone = set(), []
        for k, others in p.groupby(key, sort=False)["_o"]:
            if kept.isdisjoint(others):
                kept.add(k)
            else:
                gone.append(k)
        return pd.DataFrame({frame: [p[frame].iloc[0]] * len(gone), key: gone})

    gone = links.groupBy(frame).applyInPandas(walk, f"{frame} {kinds[frame]}, {key} {kinds[key]}")
    return stars.join(gone, [frame, key], "left_anti")


def arithmetic(a: DataFrame, b: DataFrame, op: str, by: list[str] = PIXEL) -> DataFrame:
    """Pixels of two images combined by plus, minus, times or over; they are to cover the same places, a quotient by 0 is null."""
    x, y = F.col("value"), F.col("_b")
    value = {"plus": x + y, "minus": x - y, "times": x * y, "over": F.when(y != 0, x / y)}[op]
    return a.join(b.select(*by, F.col("value").alias("_b")), by).select(*by, value.alias("value"))


def sigma_clip_mask(pixels: DataFrame, by: str = "frame", low: float = 3.0, high: float = 3.0, iterations: int = 5, centre: str = "median", spread: str = "mad") -> DataFrame:
    """`pixels` with `rejected`: outside centre - low s to centre + high s of the frame's pixels not rejected before, again
    and again until none is or for so many rounds. centre: mean or median; spread: std or mad, scaled.

    Each round is two aggregates over bounded figures; rounds are planned at once, as there are few.
    """
    p = pixels.withColumn("rejected", F.lit(False))
    for _ in range(iterations):
        live = F.when(~F.col("rejected"), F.col("value"))
        m = p.groupBy(by).agg((F.avg(live) if centre == "mean" else F.median(live)).alias("_m"), F.median(live).alias("_d0"), F.stddev_pop(live).alias("_s"))
        q = p.join(m, by)
        if spread == "mad":
            d = q.groupBy(by).agg((F.median(F.when(~F.col("rejected"), F.abs(F.col("value") - F.col("_d0")))) * 1.482602218505602).alias("_s"))
            q = q.drop("_s").join(d, by)
        out = (F.col("_s") > 0) & ((F.col("value") < F.col("_m") - F.col("_s") * low) | (F.col("value") > F.col("_m") + F.col("_s") * high))
        p = q.withColumn("rejected", F.col("rejected") | F.coalesce(out, F.lit(False))).drop("_m", "_d0", "_s")
    return p


def background_level(pixels: DataFrame, by: str = "frame", sigma: float = 3.0, iterations: int = 5) -> DataFrame:
    """(by, background): the median of each frame's pixels that a clip by median and MAD leaves."""
    p = sigma_clip_mask(pixels, by, sigma, sigma, iterations)
    return p.groupBy(by).agg(F.median(F.when(~F.col("rejected"), F.col("value"))).alias("background"))


def spatial_moments(pixels: DataFrame, by: str = "frame", tile: int = 8) -> DataFrame:
    """(by, tx, ty, n, mean, variance) of each tile of frames after a high pass: a pixel less the mean of the 3 x 3 around
    it, which reaches into the tiles beside."""
    smooth = convolve(pixels, [[1, 1, 1]] * 3, [by]).select(by, "x", "y", F.col("value").alias("_s"))
    d = pixels.join(smooth, [by, "x", "y"]).withColumn("_v", F.col("value") - F.col("_s"))
    return d.groupBy(by, F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty")).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("variance"))


def star_profiles(pixels: DataFrame, by: list[str], background: str | None = None) -> DataFrame:
    """(by, flux, cx, cy, fwhm, eccentricity) of stars' pixels (by, x, y, value) above the background, from their moments.

    Sums of value, place and products alone, so partial sums go through the exchange.
    """
    v = F.greatest(F.col("value") - (F.col(background) if background else F.lit(0.0)), F.lit(0.0))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = pixels.groupBy(*by).agg(F.sum(v).alias("flux"), *(F.sum(v * e).alias(n) for n, e in (("_x", x), ("_y", y), ("_xx", x * x), ("_yy", y * y), ("_xy", x * y))))
    m = m.where("flux > 0").withColumn("cx", F.col("_x") / F.col("flux")).withColumn("cy", F.col("_y") / F.col("flux"))
    m = m.withColumns({"_sx": F.col("_xx") / F.col("flux") - F.col("cx") * F.col("cx"), "_sy": F.col("_yy") / F.col("flux") - F.col("cy") * F.col("cy"), "_sxy": F.col("_xy") / F.col("flux") - F.col("cx") * F.col("cy")})
    half, gap = (F.col("_sx") + F.col("_sy")) / 2, F.sqrt(F.pow((F.col("_sx") - F.col("_sy")) / 2, 2) + F.col("_sxy") * F.col("_sxy"))
    major, minor = half + gap, F.greatest(half - gap, F.lit(0.0))
    return m.select(*by, "flux", "cx", "cy", (F.sqrt(F.greatest(half, F.lit(0.0))) * (2 * math.sqrt(2 * math.log(2)))).alias("fwhm"), F.when(major > 1e-9, F.sqrt(F.greatest(F.lit(1.0) - minor / major, F.lit(0.0)))).otherwise(0.0).alias("eccentricity"))

"""Star pattern matching: triangles voted into star pairs, a similarity fitted to them, pairs taken within a radius.

Lists of a frame are matched by one task; lists are images' detections, some hundred stars. The relational pieces for
larger tables are `joins.descriptor_votes`, `robust.similarity` and `stack.greedy_pairs`.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triangles(p: np.ndarray, neighbours: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, descriptors): triangles of each star with pairs of its nearest, as side ratios; vertices by opposite side.

    Descriptors are the middle and the short side over the long one, the same in any scale, rotation or mirror image.
    """
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : neighbours + 1]
    sets = {tuple(sorted((i, int(a), int(b)))) for i in range(len(p)) for a, b in combinations(near[i], 2)}
    v = np.array(sorted(sets), int).reshape(-1, 3)
    sides = np.stack([d[v[:, 1], v[:, 2]], d[v[:, 0], v[:, 2]], d[v[:, 0], v[:, 1]]], 1)
    order = np.argsort(-sides, axis=1, kind="stable")
    v, sides = np.take_along_axis(v, order, 1), np.take_along_axis(sides, order, 1)
    ok = (sides[:, 2] > 0) & (sides[:, 1] < sides[:, 0] * 0.999) & (sides[:, 2] < sides[:, 1] * 0.999)
    return v[ok], sides[ok][:, 1:] / sides[ok][:, :1]


def triangle_table(stars: DataFrame, frame: str, key: str = "idx", neighbours: int = 6) -> DataFrame:
    """(frame, a, b, c, long, middle, short): triangles of each star with pairs of its nearest, each set of three once,
    vertices by rising key, sides by falling length; sides of 0 are left out.

    Neighbours come by cells (`joins.nearest`), pairs of them within a row, so nothing is compared with all the rest.
    """
    from vesperflow.operators.joins import nearest

    near = nearest(stars, neighbours, frame, key=key).join(stars.select(frame, F.col(key).alias(f"r_{key}"), F.col("x").alias("_u"), F.col("y").alias("_v")), [frame, f"r_{key}"])
    own = near.groupBy(frame, key).agg(F.array_sort(F.collect_list(F.struct(f"r_{key}", "_u", "_v"))).alias("_n"))  # at most `neighbours`
    pairs = F.flatten(F.transform("_n", lambda p, i: F.transform(F.slice("_n", i + 2, F.size("_n")), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    t = own.join(stars.select(frame, key, "x", "y"), [frame, key]).select(frame, F.struct(F.col(key).alias("k"), F.col("x").alias("x"), F.col("y").alias("y")).alias("_o"), F.explode(pairs).alias("_t"))
    point = lambda c: F.struct(F.col(c)[f"r_{key}"].alias("k"), F.col(c)["_u"].alias("x"), F.col(c)["_v"].alias("y"))
    t = t.select(frame, F.array_sort(F.array("_o", point("_t.p"), point("_t.q"))).alias("_p")).distinct()
    side = lambda i, j: F.sqrt(F.pow(F.col("_p")[i]["x"] - F.col("_p")[j]["x"], 2) + F.pow(F.col("_p")[i]["y"] - F.col("_p")[j]["y"], 2))
    t = t.withColumn("_s", F.sort_array(F.array(side(0, 1), side(0, 2), side(1, 2)), asc=False))
    return t.where(F.col("_s")[2] > 0).select(frame, *(F.col("_p")[i]["k"].alias(n) for i, n in enumerate("abc")), *(F.col("_s")[i].alias(n) for i, n in enumerate(("long", "middle", "short"))))


def fit_similarity(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """(2 x 3 matrix, RMS) that takes points a to b best, mirrored if that is better."""
    best = None
    for mirror in (1.0, -1.0):
        q = a * [1.0, mirror]
        z, w = q[:, 0] + 1j * q[:, 1], b[:, 0] + 1j * b[:, 1]
        zc, wc = z - z.mean(), w - w.mean()
        k = (np.conj(zc) @ wc) / max((np.abs(zc) ** 2).sum(), 1e-300)
        t = w.mean() - k * z.mean()
        m = np.array([[k.real, -k.imag * mirror, t.real], [k.imag, k.real * mirror, t.imag]])
        rms = float(np.sqrt((np.abs(k * z + t - w) ** 2).mean()))
        if best is None or rms < best[1]:
            best = (m, rms)
    return best


def match(reference: np.ndarray, current: np.ndarray, radius: float = 3.0, tolerance: float = 0.01, neighbours: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, pairs): the similarity from current to reference points and matched (current, reference) indices.

    Similar triangles vote for star pairs; the most voted pairs propose similarities in threes; the one with most
    points within the radius is refitted to its inliers. Without a match the matrix is NaN and there are no pairs.
    """
    none = np.full((2, 3), np.nan), np.zeros((0, 2), int)
    if min(len(reference), len(current)) < 3:
        return none
    (va, da), (vb, db) = triangles(current, neighbours), triangles(reference, neighbours)
    cells: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(map(tuple, np.floor(db / tolerance).astype(int))):
        cells.setdefault(key, []).append(i)
    votes: Counter = Counter()
    for i, (x, y) in enumerate(np.floor(da / tolerance).astype(int)):
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for j in cells.get((x + dx, y + dy), ()):
                    if np.abs(da[i] - db[j]).max() <= tolerance:
                        votes.update(zip(va[i].tolist(), vb[j].tolist(), strict=True))
    top = [p for p, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0]))[:24]]
    best: tuple = (0, None)
    for three in combinations(top, 3):
        c, r = ([p[k] for p in three] for k in (0, 1))
        if len(set(c)) < 3 or len(set(r)) < 3:
            continue
        m, rms = fit_similarity(current[c], reference[r])
        if rms > radius:
            continue
        moved = current @ m[:, :2].T + m[:, 2]
        n = int((np.hypot(*(moved[:, None] - reference[None]).transpose(2, 0, 1)).min(1) <= radius).sum())
        if n > best[0]:
            best = (n, m)
    if best[0] < 3:
        return none
    m, pairs = best[1], none[1]
    for _ in range(5):
        moved = current @ m[:, :2].T + m[:, 2]
        d = np.hypot(*(moved[:, None] - reference[None]).transpose(2, 0, 1))
        i, j = np.nonzero(d <= radius)
        new, ti, tj = [], set(), set()
        for k in np.argsort(d[i, j], kind="stable"):
            if i[k] not in ti and j[k] not in tj:
                ti.add(i[k])
                tj.add(j[k])
                new.append((int(i[k]), int(j[k])))
        new = np.array(sorted(new), int).reshape(-1, 2)
        if len(new) < 3:
            return none
        m, _ = fit_similarity(current[new[:, 0]], reference[new[:, 1]])
        if np.array_equal(new, pairs):
            break
        pairs = new
    return m, pairs


def match_frames(detections: DataFrame, reference: DataFrame, frame: str = "frame", key: str = "idx", radius: float = 3.0, brightest: int = 120) -> DataFrame:
    """(frame, key, r_key, residual): every detection of every frame, with its reference star or null.

    Both tables have (frame, key, x, y, flux). The brightest stars of both lists find the transform; all are matched.
    """
    kinds = {c: detections.schema[c].dataType.simpleString() for c in (frame, key)}

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(["flux", key], ascending=[False, True]), b.sort_values(["_flux", "_key"], ascending=[False, True])
        p, q = a[["x", "y"]].to_numpy(float), b[["_x", "_y"]].to_numpy(float)
        m, _ = match(q[:brightest], p[:brightest], radius)
        found, dist = np.full(len(a), -1), np.full(len(a), np.nan)
        if len(q) and np.isfinite(m).all():
            d = np.hypot(*((p @ m[:, :2].T + m[:, 2])[:, None] - q[None]).transpose(2, 0, 1))
            i, j = np.nonzero(d <= radius)
            taken: set = set()
            for k in np.argsort(d[i, j], kind="stable"):
                if found[i[k]] < 0 and j[k] not in taken:
                    found[i[k]], dist[i[k]] = j[k], d[i[k], j[k]]
                    taken.add(j[k])
        keys = b["_key"].tolist()
        return pd.DataFrame({frame: a[frame].to_numpy(), key: a[key].to_numpy(), f"r_{key}": pd.array([keys[k] if k >= 0 else None for k in found], dtype="Int64"), "residual": [None if k < 0 else float(d) for k, d in zip(found, dist, strict=True)]})

    other = reference.toDF(*(f"_{c}" for c in reference.columns)).withColumnsRenamed({f"_{frame}": "_frame", f"_{key}": "_key"})
    g = detections.select(frame, key, "x", "y", "flux").groupBy(frame).cogroup(other.select("_frame", "_key", "_x", "_y", "_flux").groupBy("_frame"))
    return g.applyInPandas(run, f"{frame} {kinds[frame]}, {key} {kinds[key]}, r_{key} long, residual double")

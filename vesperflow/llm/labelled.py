"""Bounded, repeatable samples of labelled documents, and calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperflow.session import materialize, pick


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(n)).cast("int")


def sample_labels(labels: DataFrame, label: str, folds: int, held_out: int, bound: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y): at most `bound` ids with label 0 or 1 whose fold is not `held_out`, the first by a hash of the id.

    Rows with a null id or label are passed over; an id with several labels takes the smallest.
    """
    rows = pick(labels, [id_col, label]).toDF("id", "y").where(F.col("y").isin(0, 1) & (fold("id", folds) != held_out))
    rows = rows.groupBy("id").agg(F.min("y").cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(bound)


def join_sample(docs: DataFrame, sample: DataFrame, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of the sampled documents, one an id (the least text of repeated ones), stored as it is read again.

    The sample is broadcast: its own limit bounds it. Of its texts the first by a hash of the id are taken, up to
    `most_bytes` in all, so very long texts bound the sample too.
    """
    rows = pick(docs, [id_col, text_col]).toDF("id", "text").join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = materialize(rows.withColumn("h", F.xxhash64("id")), "labelled")
    left, last = most_bytes, None
    for r in rows.select("h", F.octet_length("text").alias("n")).orderBy("h", "id").collect():  # a number a sampled row
        left -= r.n or 0
        if left < 0:
            break
        last = r.h
    return rows.where(F.col("h") <= F.lit(last)).drop("h")


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the sigmoid 1 / (1 + exp(a m + b)) with smoothed targets, by Newton steps with halving."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((neg + 1) / (pos + 1)))

    def loss(a: float, b: float) -> float:
        f = a * margins + b
        return float((t * f + np.logaddexp(0, -f)).sum())

    now = loss(a, b)
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(a * margins + b, -500, 500)))
        d, w = t - p, np.maximum(p * (1 - p), 1e-12)
        g = np.array([(margins * d).sum(), d.sum()])
        h = np.array([[(margins * margins * w).sum() + 1e-9, (margins * w).sum()], [(margins * w).sum(), w.sum() + 1e-9]])
        step = -np.linalg.solve(h, g)
        rate = 1.0
        while rate > 1e-8 and loss(a + rate * step[0], b + rate * step[1]) > now:
            rate /= 2
        a, b = a + rate * step[0], b + rate * step[1]
        new = loss(a, b)
        if now - new < 1e-9 * max(1.0, abs(now)):
            break
        now = new
    return float(a), float(b)


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(xs, ps): a rising step curve by pooling adjacent violators, each block's rate smoothed towards its middle."""
    by = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest and highest score
    for s, v in zip(scores[by], y[by], strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v1, n1, _, hi = blocks.pop()
            blocks[-1][0] += v1
            blocks[-1][1] += n1
            blocks[-1][3] = hi
    xs, ps = [], []
    for v, n, lo, hi in blocks:
        p = (v + 0.5) / (n + 1)
        xs += [lo, hi] if hi > lo else [lo]
        ps += [p, p] if hi > lo else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ps))

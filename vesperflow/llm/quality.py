"""Quality classifier: Naive Bayes support vectors over word n-grams.

Indicators of hashed n-grams (words, punctuation runs, letter case, word pairs, repeats) are scaled by the classes'
log-count ratios; a linear hinge-loss model is fitted to them by dual coordinate descent, and its out-of-fold margins
calibrate a sigmoid. Only the fit uses a bounded sample of labelled rows; every row's whole text is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vesperflow.llm._common import Words, map_batches, map_rows, sums
from vesperflow.llm.labelled import fold, join_sample, platt, sample_labels
from vesperflow.session import pick

FOLDS, HELD_OUT = 3, 1
#: The fit takes at most so many labelled rows and bytes of text.
SAMPLE, SAMPLE_BYTES = 8000, 64 << 20
BITS = 20
THRESHOLD = 0.5
_SPLIT = re.compile(r"(\W*)(.*?)(\W*)", re.DOTALL)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


_UPPER, _DIGIT, _REPEAT, _THRICE = map(_hash, ("upper", "digit", "repeat", "thrice"))


def _word_features(word: str) -> tuple[int, list[int]]:
    """The hash of the word itself, and those of its other features: punctuation around it, letter case, digits."""
    if word.isalpha():
        if word.islower():
            return _hash("w:" + word), []
        return _hash("w:" + word.lower()), [_UPPER] if len(word) > 1 and word.isupper() else []
    lead, core, trail = _SPLIT.fullmatch(word).groups()
    out = [_hash("p:" + p) for p in {lead, trail} if p and core]
    if len(core) > 1 and core.isupper():
        out.append(_UPPER)
    if not core.isalpha() and any(map(str.isdigit, core)):
        out.append(_DIGIT)
    return _hash("w:" + (core.lower() or lead)), out


def indicators(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), sorted and distinct: which hashed n-grams each text has."""
    w = Words(texts)
    n = len(texts)
    assert n < 1 << (62 - bits)
    if not len(w.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, more = np.empty(len(w.uniq), np.uint64), {}
    for i, x in enumerate(w.uniq):
        own[i], rest = _word_features(x)
        if rest:
            more[i] = rest
    rows, h = w.rows, own[w.codes]
    next_ = rows[1:] == rows[:-1]
    pair = (h[:-1] * _MIX) ^ (h[1:] >> np.uint64(1))
    same = (h[:-1] == h[1:]) & next_
    pair[same] = _REPEAT
    thrice = np.flatnonzero(same[1:] & same[:-1])
    # other features of words that have some: word by word of the batch, few of them
    size = np.zeros(len(w.uniq), np.int64)
    size[list(more)] = [len(f) for f in more.values()]
    flat, start = np.array([x for f in more.values() for x in f], np.uint64), np.cumsum(size) - size
    spots = np.flatnonzero(size[w.codes])
    k = size[w.codes[spots]]
    at = np.repeat(start[w.codes[spots]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
    all_rows = np.concatenate([rows, rows[1:][next_], rows[thrice], np.repeat(rows[spots], k)])
    all_ = np.concatenate([h, pair[next_], np.full(len(thrice), _THRICE, np.uint64), flat[at]])
    both = np.sort((all_rows << bits) | ((all_ * _MIX) >> np.uint64(64 - bits)).astype(np.int64))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both >> bits, both & ((1 << bits) - 1)


def log_count_ratio(docs: list[np.ndarray], y: np.ndarray, dims: int, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each feature in class 1 against class 0."""
    p, q = np.full(dims, alpha), np.full(dims, alpha)
    for x, v in zip(docs, y, strict=True):
        (p if v > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(docs: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of the hinge-loss model of unit-length rows by dual coordinate descent; classes weigh alike."""
    s = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y <= 0).sum())))
    values = [v / max(1e-9, np.sqrt(v @ v)) for v in (scale[x] for x in docs)]
    q = np.array([v @ v + 1.0 for v in values])
    w, b, a = np.zeros(len(scale)), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            g = s[i] * (w[docs[i]] @ values[i] + b) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost[i])
            if new != a[i]:
                step = (new - a[i]) * s[i]
                w[docs[i]] += step * values[i]
                b += step
                most = max(most, abs(g))
                a[i] = new
        if most < 1e-3:
            break
    return w, b


@dataclass
class Model:
    """weights: of each feature, its scale included; squares: of the features' scales, for a row's length."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    a: float = 0.0
    b: float = 0.0
    bits: int = BITS

    def margins(self, row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(sums(row, n, self.squares[x].astype(np.float64)))
        return sums(row, n, self.weights[x].astype(np.float64)) / np.maximum(length, 1e-9) + self.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        m = self.margins(*indicators(texts, self.bits), len(texts))
        return 1 / (1 + np.exp(np.clip(self.a * m + self.b, -500, 500)))


def _fit_margins(docs: list[np.ndarray], y: np.ndarray, bits: int, least: int) -> Model:
    """A model without its sigmoid, over the features that `least` rows have."""
    dims = 1 << bits
    known = np.bincount(np.concatenate(docs), minlength=dims) >= least
    own = [x[known[x]] for x in docs]
    r = log_count_ratio(own, y, dims)
    w, b = dual_descent(own, y, r)
    return Model((w * r).astype(np.float32), np.where(known, r * r, 0).astype(np.float32), float(b), bits=bits)


def fit_arrays(docs: list[np.ndarray], y: np.ndarray, bits: int = BITS, parts: int = 3, least: int = 3) -> Model:
    """The model of all rows, its sigmoid fitted on margins of rows that the margin's model has not seen."""
    if min((y > 0).sum(), (y <= 0).sum()) < parts:  # too few of a class: the classes' share, smoothed, for every text
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 0.0, 0.0, float(np.log((1 - p) / p)), bits)
    margins = np.zeros(len(y))
    part = np.zeros(len(y), np.int64)
    for v in (y > 0, y <= 0):
        part[v] = np.arange(v.sum()) % parts
    for k in range(parts):
        here, there = np.flatnonzero(part != k), np.flatnonzero(part == k)
        m = _fit_margins([docs[i] for i in here], y[here], bits, least)
        own = [docs[i] for i in there]
        margins[there] = m.margins(np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own), len(own))
    m = _fit_margins(docs, y, bits, least)
    m.a, m.b = platt(margins, y)
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on at most `sample` labelled rows outside the held-out fold; without any the score is 0.5 throughout."""
    rows = join_sample(docs, sample_labels(labels, label, FOLDS, HELD_OUT, sample), SAMPLE_BYTES, id_col, text_col)

    def make():
        def f(b: pa.RecordBatch) -> dict:
            row, x = indicators(b.column(2), bits)
            cut = np.searchsorted(row, np.arange(1, b.num_rows))
            return {"id": b.column(0), "y": b.column(1), "x": [p.astype("<i4").tobytes() for p in np.split(x, cut)]}

        return f

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])
    found = sorted(map_batches(rows, make, schema).collect(), key=lambda r: str(r.id))
    return fit_arrays([np.frombuffer(r.x, "<i4") for r in found], np.array([r.y for r in found], np.int64), bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of `docs`.

    Null texts count as empty; a text without words gets the bias' score. held_out is null for a null id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    rows = pick(docs, [id_col, text_col]).toDF("id", "text").select("id", (fold("id", FOLDS) == HELD_OUT).alias("h"), "text")

    def make():
        m = shared.value

        def f(b: pa.RecordBatch) -> dict:
            s = m.score(b.column(2))
            return {"doc_id": b.column(0), "held_out": b.column(1), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

        return f

    return map_batches(rows, make, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, that the model does not reject."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(shared.value.score(b.column(at)) >= THRESHOLD))

    return map_rows(docs, run)

"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are densities: of words of learned lexicons (whole words and word beginnings that toxic training texts have
more often than others), of lexicon words near a second-person word, of capitals, punctuation, and of obfuscated words
(digits or signs within a word, drawn-out letters). Lexicons, trees and calibration each learn from labelled rows
outside the held-out fold only, within a bounded sample; every row's whole text is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesperflow.llm._common import Words, map_batches, sums
from vesperflow.llm.labelled import fold, isotonic, join_sample, sample_labels
from vesperflow.session import pick

FOLDS, HELD_OUT = 4, 2
#: The fit takes at most so many labelled rows and bytes of text, which bound the lexicon too.
SAMPLE, SAMPLE_BYTES = 16000, 128 << 20
THRESHOLD = 0.3
#: Lengths of the word beginnings that may enter the lexicon; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6)
SECOND_PERSON = frozenset("you your yours u ur yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú vos tus".split())
FEATURES = ("strong", "weak", "strong_count", "near_you", "capitals", "upper_words", "punctuation", "exclamations", "obfuscated", "drawn_out", "log_words", "word_length")
REACH = 4
_LETTERS = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_DRAWN = re.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    """The letters of a word, lowered, signs and digits that stand for letters read as such."""
    inner = word.strip("\"'.,;:!?()[]{}<>|*&%#-_/\\").lower()
    if not inner.isalpha():
        inner = "".join(_LETTERS.findall(inner.translate(_LEET)))
    return _DRAWN.sub(r"\1", inner)


def entries(word: str) -> list[str]:
    """Lexicon entries that a plain word can match: itself, and its beginnings marked by a star."""
    return [word if not n else f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]


@dataclass
class Lexicon:
    strong: frozenset = frozenset()
    weak: frozenset = frozenset()

    def __post_init__(self):
        #: How entries begin: a word that begins otherwise matches none.
        self.heads = {e.rstrip("*")[:4] for e in self.strong | self.weak}

    def level(self, plain_word: str) -> int:
        if plain_word[:4] not in self.heads:
            return 0
        found = entries(plain_word)
        return 2 if any(e in self.strong for e in found) else 1 if any(e in self.weak for e in found) else 0


_ENDS = "\"'.,;:!?()[]{}<>|*&%#-_/\\"


def word_traits(x: str, lexicon: Lexicon) -> tuple:
    """(lexicon level, second person, capitals, all capitals, signs, exclamation marks, obfuscated, drawn out, length)."""
    if x.isalpha() and x.islower():  # most words
        drawn = _DRAWN.search(x) is not None
        return (lexicon.level(plain(x) if drawn else x), x in SECOND_PERSON, 0, False, 0, 0, False, drawn, len(x))
    inner = x.strip(_ENDS)
    mixed = bool(inner) and not inner.isalnum() or any(map(str.isdigit, inner)) and any(map(str.isalpha, inner))
    return (
        lexicon.level(plain(x)), x.strip("\"'.,;:!?()").lower() in SECOND_PERSON, sum(map(str.isupper, x)), len(inner) > 1 and inner.isupper(), sum(not c.isalnum() for c in x), x.count("!"), mixed, _DRAWN.search(inner) is not None, len(x),
    )


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text; all 0 for a text without words."""
    w, n = Words(texts), len(texts)
    if not len(w.codes):
        return np.zeros((n, len(FEATURES)))
    traits = np.array([word_traits(x, lexicon) for x in w.uniq], np.float64)
    level, you, per_word = traits[:, 0].astype(np.int64), traits[:, 1] > 0, traits[:, 2:]
    rows = w.rows
    own = sums(rows, n)
    count = np.maximum(own, 1)
    lv, near = level[w.codes], np.zeros(len(rows))
    spots = np.flatnonzero(you[w.codes])
    for d in range(-REACH, REACH + 1):
        at = spots + d
        ok = (at >= 0) & (at < len(rows))
        at, of = at[ok], spots[ok]
        at = at[rows[at] == rows[of]]
        near[at[lv[at] > 0]] = 1
    total = np.stack([sums(rows, n, per_word[w.codes, k]) for k in range(7)], 1)
    strong, weak = sums(rows, n, (lv == 2).astype(float)), sums(rows, n, (lv == 1).astype(float))
    chars = np.maximum(total[:, 6], 1)
    return np.stack([strong / count, weak / count, strong, sums(rows, n, near) / count, total[:, 0] / chars, total[:, 1] / count, total[:, 2] / chars, total[:, 3] / count, total[:, 4] / count, total[:, 5] / count, np.log1p(own), total[:, 6] / count], 1)


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on binned features, logistic loss."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                f = np.maximum(feature[node], 0)
                node = np.where(inner, 2 * node + 1 + (b[np.arange(len(x)), f] > cut[node]), node)
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: int = 5) -> Trees:
    """Fit by histograms: at each level every node takes its best split of the summed gradients."""
    t = Trees()
    for k in range(x.shape[1]):
        t.edges.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])))
        positive = x[:, k][x[:, k] > 0]
        if len(positive):  # sparse densities: also cut among the values that are not zero
            t.edges[-1] = np.unique(np.concatenate([t.edges[-1], [np.nextafter(0, 1)], np.quantile(positive, np.linspace(0, 1, 9))]))
    p = (y.sum() + 1) / (len(y) + 2)
    t.base = float(np.log(p / (1 - p)))
    b, m = t.bins(x), np.full(len(y), t.base)
    width = max(len(e) for e in t.edges) + 1
    size = 2 ** (depth + 1) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            live = node >= first
            local = np.where(live, node - first, 0)
            best = np.full(many, 1e-4)
            for k in range(x.shape[1]):
                at = (local * width + b[:, k])[live]
                gs, hs, ns = (np.bincount(at, weights=v[live] if v is not None else None, minlength=many * width).reshape(many, width) for v in (g, h, None))
                gl, hl, nl = gs.cumsum(1), hs.cumsum(1), ns.cumsum(1)
                ga, ha, na = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(nl < least) | (na - nl < least)] = 0
                c = gain.argmax(1)
                better = gain[np.arange(many), c] > best
                best = np.where(better, gain[np.arange(many), c], best)
                feature[first : first + many] = np.where(better, k, feature[first : first + many])
                cut[first : first + many] = np.where(better, c, cut[first : first + many])
            split = live & (feature[node] >= 0)
            node = np.where(split, 2 * node + 1 + (b[np.arange(len(y)), np.maximum(feature[node], 0)] > cut[node]), node)
        gs, hs = np.bincount(node, weights=g, minlength=size), np.bincount(node, weights=h, minlength=size)
        value = np.where(feature < 0, rate * gs / (hs + l2), 0)
        t.trees.append((feature, cut, value))
        m = m + value[node]
    return t


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    xs: np.ndarray
    ps: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.interp(self.trees.margins(features(texts, self.lexicon)), self.xs, self.ps)


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Entries that texts with label 1 have far more often than others, from rows (id, y, text).

    A text with label 1 counts for an entry only as far as the entry's neighbours differ from text to text, so the
    words of a passage with many copies do not pass for a lexicon.
    """
    na, nb = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not na or not nb:
        return Lexicon()

    def spots():
        def f(b: pa.RecordBatch) -> dict:
            w = Words(b.column(1))
            own = [entries(plain(x)) for x in w.uniq]
            h = np.array([xxhash.xxh32_intdigest(x) for x in w.uniq], np.int64)[w.codes] if w.uniq else np.zeros(0, np.int64)
            before, after = np.concatenate([[0], h[:-1]])[: len(h)], np.concatenate([h[1:], [0]])[: len(h)]
            some = np.diff(w.first) > 0  # neighbours end with the text
            before[w.first[:-1][some]] = after[w.first[1:][some] - 1] = 0
            around = before * 31 + h * 7 + after
            out: dict[str, list] = {"e": [], "text": [], "around": []}
            rows = np.asarray(b.column(0))[w.rows]
            for c, r, k in zip(w.codes.tolist(), rows.tolist(), around.tolist(), strict=True):
                for e in own[c]:
                    out["e"].append(e)
                    out["text"].append(r)
                    out["around"].append(k)
            return out

        return f

    def others():
        def f(b: pa.RecordBatch) -> dict:
            w = Words(b.column(0))
            ids: dict[str, int] = {}
            own = [[ids.setdefault(e, len(ids)) for e in entries(plain(x))] for x in w.uniq]
            n = np.zeros(len(ids), np.int64)
            for at, to in zip(w.first[:-1], w.first[1:], strict=True):
                n[list({e for c in set(w.codes[at:to].tolist()) for e in own[c]})] += 1
            return {"e": list(ids), "b": n}

        return f

    e = T.StructField("e", T.StringType())
    toxic = map_batches(rows.where("y = 1").select(F.xxhash64("id"), "text"), spots, T.StructType([e, T.StructField("text", T.LongType()), T.StructField("around", T.LongType())]))
    toxic = toxic.groupBy("e").agg(F.least(F.count_distinct("text"), F.count_distinct("around")).alias("a")).where("a >= 3")
    clean = map_batches(rows.where("y = 0").select("text"), others, T.StructType([e, T.StructField("b", T.LongType())])).groupBy("e").agg(F.sum("b").alias("b"))
    both = toxic.join(clean, "e", "left").select("e", "a", F.coalesce("b", F.lit(0)).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (na + 1.0)) - F.log((F.col("b") + 0.5) / (nb + 1.0))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = both.withColumn("z", z).where((odds > 1.5) & (F.col("z") > 2.2)).collect()
    strong = frozenset(r.e for r in top if r.z > 3 and r.a >= max(5, 0.01 * na) and r.b <= 0.02 * r.a)
    return Lexicon(strong, frozenset(r.e for r in top if r.a >= max(4, 0.004 * na)) - strong)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE, parts: int = 5) -> Model:
    """Fit on at most `sample` labelled rows outside the held-out fold.

    The calibration's margins come from trees that have not seen the row: `parts` parts by hash of the id. With too
    few rows of a label every text scores the labelled share of label 1, smoothed.
    """
    rows = join_sample(docs, sample_labels(labels, label, FOLDS, HELD_OUT, sample), SAMPLE_BYTES, id_col, text_col)
    lexicon = learn_lexicon(rows)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        def f(b: pa.RecordBatch) -> dict:
            return {"id": b.column(0), "y": b.column(1), "x": list(features(b.column(2), shared.value))}

        return f

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = map_batches(rows, make, schema).collect()
    found.sort(key=lambda r: xxhash.xxh32_intdigest(str(r.id)))
    x, y = np.array([r.x for r in found], np.float64).reshape(-1, len(FEATURES)), np.array([r.y for r in found], np.float64)
    if min(y.sum(), len(y) - y.sum()) < 2 * parts:
        return Model(Lexicon(), Trees([np.zeros(0)] * len(FEATURES)), np.zeros(1), np.array([(y.sum() + 1) / (len(y) + 2)]))
    part, margins = np.zeros(len(y), np.int64), np.zeros(len(y))
    for v in (y > 0, y == 0):
        part[v] = np.arange(v.sum()) % parts
    for k in range(parts):
        margins[part == k] = boost(x[part != k], y[part != k]).margins(x[part == k])
    return Model(lexicon, boost(x, y), *isotonic(margins, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of `docs`.

    Null texts count as empty; texts without words have all features 0 and are scored like any. held_out is null for
    a null id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    rows = pick(docs, [id_col, text_col]).toDF("id", "text").select("id", (fold("id", FOLDS) == HELD_OUT).alias("h"), "text")

    def make():
        def f(b: pa.RecordBatch) -> dict:
            s = shared.value.score(b.column(2))
            return {"doc_id": b.column(0), "held_out": b.column(1), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

        return f

    return map_batches(rows, make, schema)

"""Cross-entropy difference scores: a target and a background bigram model over one shared vocabulary.

Counts are taken over all documents (background) and over all that are marked as target; both models smooth alike
(Witten-Bell bigrams over add-one unigrams). `score_whole` has every word of the corpus in its models, whose counts stay
distributed. `fit` and `score` make small models that fit into memory: frequent words, and for every other word one of
a fixed set of shape classes (length, digits, capitals, punctuation), in dense tables of VOCABULARY ** 2 cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesperflow.llm._common import Words, bound_arrow, map_batches, sums
from vesperflow.session import materialize, pick

#: Ids of the model: words, then shape classes, then the start of a text. The tables are dense in its square.
VOCABULARY = 1024
_SHAPES = 5 * 2 * 2 * 3
_MARKS = "\"'.,;:!?()[]{}<>|*&%$#-_/\\«»“”„…"


def core(word: str) -> str:
    """A token's word: lowered, punctuation at its ends taken off unless it is all there is."""
    return (word.strip(_MARKS) or word).lower()


def shape(word: str) -> int:
    """The class of a word outside the vocabulary."""
    own = word.strip(_MARKS)
    n = min(4, len(own) // 4)
    kind = 0 if own == word else 1 if own else 2
    return ((n * 2 + any(c.isdigit() for c in own)) * 2 + (len(own) > 1 and own.isupper())) * 3 + kind


def top_words(docs: DataFrame, text_col: str = "text", vocabulary: int = VOCABULARY) -> list[str]:
    """The corpus' most frequent words, ties by the word: what fits besides the shape classes and the start."""

    def make():
        def f(b: pa.RecordBatch) -> dict:
            w = Words(b.column(0))
            n = np.bincount(w.codes, minlength=len(w.uniq))
            return {"w": [core(x) for x in w.uniq], "n": n}

        return f

    schema = T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.LongType())])
    counts = map_batches(pick(docs, [text_col]), make, schema).groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in counts.where("n > 0").orderBy(F.desc("n"), "w").limit(vocabulary - _SHAPES - 1).collect()]


class Tokens:
    """Model ids of texts: the start id before each text, then one id a word."""

    def __init__(self, words: list[str], vocabulary: int = VOCABULARY):
        self.ids = {w: i for i, w in enumerate(words)}
        self.size, self.start, self.shapes = vocabulary, vocabulary - 1, vocabulary - 1 - _SHAPES

    def bigrams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, previous id * vocabulary + id) of every token."""
        w = Words(texts)
        own = np.array([self.ids.get(core(x), -1) for x in w.uniq], np.int64)
        out = np.flatnonzero(own < 0)
        own[out] = [self.shapes + shape(w.uniq[i]) for i in out]
        ids, rows = own[w.codes], w.rows
        before = np.concatenate([[self.start], ids[:-1]])[: len(ids)]
        firsts = w.first[:-1][np.diff(w.first) > 0]
        before[firsts] = self.start
        return rows, before * self.size + ids


def count_bigrams(docs: DataFrame, words: list[str], text_col: str, target_col: str, vocabulary: int = VOCABULARY) -> DataFrame:
    """(code, target, background): how often each bigram occurs in target texts and in all."""
    bound_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        t, cells = Tokens(shared.value, vocabulary), vocabulary * vocabulary
        counts = np.zeros((2, cells), np.int64)
        for b in batches:
            if b.num_rows:
                rows, codes = t.bigrams(b.column(0))
                aim = np.array([bool(x) for x in b.column(1).to_pylist()])[rows]
                counts[1] += np.bincount(codes, minlength=cells)
                counts[0] += np.bincount(codes[aim], minlength=cells)
        at = np.flatnonzero(counts[1])
        for i in range(0, len(at), 1 << 16):
            k = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[0][k]), pa.array(counts[1][k])], names=["code", "target", "background"])

    found = docs.select(F.col(text_col), F.col(target_col)).mapInArrow(run, "code long, target long, background long")
    return found.groupBy("code").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def bits(counts: np.ndarray) -> np.ndarray:
    """-log2 P(id | previous id) of every cell, Witten-Bell interpolated with add-one unigrams."""
    n = counts.sum(1, keepdims=True)
    kinds = (counts > 0).sum(1, keepdims=True)
    one = counts.sum(0) + 1.0
    one /= one.sum()
    seen = np.maximum(n + kinds, 1)
    back = np.where(n > 0, kinds / seen, 1.0)
    return (-np.log2(counts / seen + back * one[None, :])).astype(np.float32)


@dataclass
class Models:
    words: list[str]
    target: np.ndarray
    background: np.ndarray

    def losses(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, target bits, background bits) of each text."""
        rows, codes = Tokens(self.words, len(self.target)).bigrams(texts)
        n = len(texts)
        return sums(rows, n), sums(rows, n, self.target.ravel()[codes]), sums(rows, n, self.background.ravel()[codes])


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY) -> Models:
    """Both models from all of `docs`; the target is the rows whose id is in `target_ids` (one column).

    What reaches the driver is one row for each bigram that occurs, vocabulary ** 2 at most.
    """
    words = top_words(docs, text_col, vocabulary)
    ids = target_ids.toDF("_id").where("_id IS NOT NULL").distinct().withColumn("_target", F.lit(True))
    # sort-merge at every size: the ids are as unbounded as the documents, and skewed keys can be split
    rows = pick(docs, [id_col, text_col]).toDF("_id", "_text").join(ids.hint("merge"), "_id", "left")
    got = count_bigrams(rows, words, "_text", "_target", vocabulary).toPandas()
    counts = np.zeros((2, vocabulary * vocabulary))
    counts[0][got["code"]], counts[1][got["code"]] = got["target"], got["background"]
    t, b = (bits(c.reshape(vocabulary, vocabulary)) for c in counts)
    return Models(words, t, b)


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_bits, background_bits, score), one row for each row of `docs`.

    Bits are means over a text's tokens and score their difference, target less background: lower is more like the
    target. Null texts and texts without words have no tokens and all three are 0. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_bits", "background_bits", "score"))])

    def make():
        def f(b: pa.RecordBatch) -> dict:
            n, t, g = shared.value.losses(b.column(1))
            t, g = t / np.maximum(n, 1), g / np.maximum(n, 1)
            return {"doc_id": b.column(0), "n_tokens": n, "target_bits": t, "background_bits": g, "score": t - g}

        return f

    return map_batches(pick(docs, [id_col, text_col]), make, schema)


# ---- the whole vocabulary -------------------------------------------------------------------------------------------
#
# Every word of the corpus is a word of the model. Nothing of the corpus' size reaches the driver or is broadcast:
# documents lie in blocks; a block counts its bigrams and deals them to buckets by the hash of their context; a bucket
# adds up what all blocks sent and answers each block with the totals, in the order of what it sent.

#: Bytes of text in a block, which one task holds, and bytes of text for each bucket beyond BUCKETS.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
BUCKETS = 64
#: Rows of one id up to which they lie in one block; those of an id with more are dealt by themselves.
ID_ROWS = 1000
#: Contexts of more than this share of a sample's words are dealt by the word that follows. This evens the buckets only.
HOT = 1 / 500
_START = np.uint64(0x5EED5EED5EED5EED)
_CHUNK = "bucket int, block int, words binary, ones binary, runs binary, pairs binary, counts binary"


def hashes(words: list[str]) -> np.ndarray:
    from pandas.util import hash_array

    return hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest takes: all lowest bytes first, then the next, which are mostly zero
    and vanish when the exchange is compressed."""
    t = np.min_scalar_type(int(x.max()) if x.size else 0)
    return bytes([t.itemsize]) + np.ascontiguousarray(x.astype(t).reshape(-1, 1)).view(np.uint8).T.tobytes()


def unpack(b: bytes, *shape: int) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").astype(np.int64).reshape(shape)


def pack_hashes(h: np.ndarray) -> bytes:
    """The upper six bytes of hashes that tell apart what follows one word."""
    return np.ascontiguousarray(h.reshape(-1, 1).view(np.uint8)[:, 2:]).tobytes()


def unpack_hashes(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Layout:
    """The words and distinct bigrams of a block's texts, in the order of the buckets.

    words: the hashes; codes, pair: the word and the bigram of each token; ctx, tok: the words of each bigram, ctx
    being len(words) at the start of a text; heat: the place of ctx among the hot contexts, -1 if it is not one.
    """

    def __init__(self, texts: pa.Array, hot: np.ndarray, buckets: int):
        w = Words(texts)
        h = hashes([core(x) for x in w.uniq])
        u = np.unique(h[np.bincount(w.codes, minlength=len(h)) > 0])  # uniq may have the empty word, which no text has
        inverse = np.searchsorted(u, h)
        own = (u % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((u, own))
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        self.words, own, self.rows, self.codes = u[order], own[order], w.rows.astype(np.int32), rank[inverse[w.codes]]
        m = len(u)
        before = np.concatenate([[m], self.codes[:-1]])[: len(self.codes)]
        before[w.first[:-1][np.diff(w.first) > 0]] = m
        code, self.pair = np.unique(before * max(m, 1) + self.codes, return_inverse=True)
        del w, before, h, inverse
        ctx, tok = np.divmod(code, max(m, 1))
        known = np.append(self.words, _START)
        at = np.minimum(np.searchsorted(hot, known), len(hot) - 1)
        self.word_heat = np.where(hot[at] == known, at, -1)
        heat = self.word_heat[ctx]
        to = np.where(heat >= 0, own[tok], np.append(own, 0)[ctx])
        order = np.argsort(to * (len(hot) + 1) + heat + 1, kind="stable")
        rank = np.empty(len(code), np.int64)
        rank[order] = np.arange(len(code))
        self.pair = rank[self.pair]
        self.ctx, self.tok, self.heat = ctx[order], tok[order], heat[order]
        self.word_cuts = np.searchsorted(own, np.arange(buckets + 1))
        self.pair_cuts = np.searchsorted(to[order], np.arange(buckets + 1))


def counted(lay: Layout, aim: np.ndarray, block: int, hot: int) -> pa.Table:
    """What a block sends to each bucket; aim marks the target texts."""
    mine = aim[lay.rows]
    ones = np.stack([np.bincount(lay.codes[mine], minlength=len(lay.words)), np.bincount(lay.codes, minlength=len(lay.words))])
    counts = np.stack([np.bincount(lay.pair[mine], minlength=len(lay.ctx)), np.bincount(lay.pair, minlength=len(lay.ctx))])
    out = {c.split()[0]: [] for c in _CHUNK.split(", ")}
    for j in range(len(lay.word_cuts) - 1):
        w, p = slice(*lay.word_cuts[j : j + 2]), slice(*lay.pair_cuts[j : j + 2])
        n = w.stop - w.start
        slot = np.where(lay.heat[p] >= 0, n + lay.heat[p], lay.ctx[p] - w.start)
        row = (j, block, lay.words[w].tobytes(), pack(ones[:, w]), pack(np.bincount(slot, minlength=n + hot)), pack_hashes(lay.words[lay.tok[p]]), pack(counts[:, p]))
        for c, v in zip(out.values(), row, strict=True):
            c.append(v)
    return pa.table({k: pa.array(v, pa.int32() if k in ("bucket", "block") else pa.binary()) for k, v in out.items()})


def totalled(chunks: pa.Table, hot: int) -> pa.Table:
    """A bucket's answer to each block: totals of its words (as a token, as a context, kinds that follow; target and
    all), of its bigrams, of the hot contexts in this bucket, and of the bucket."""
    rows = chunks.to_pylist()
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    pairs = [unpack_hashes(r["pairs"]) for r in rows]
    u, at = np.unique(np.concatenate(words), return_inverse=True)
    m, cuts = len(u), np.cumsum([0, *map(len, words)])
    at = [at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    stats = np.zeros((6, m + hot), np.int64)
    for r, a in zip(rows, at, strict=True):
        stats[:2, a] += unpack(r["ones"], 2, len(a))
    ctx = np.concatenate([np.repeat(np.append(a, m + np.arange(hot)), unpack(r["runs"], -1)) for r, a in zip(rows, at, strict=True)])
    key = np.concatenate(pairs)
    order = np.lexsort((key, ctx))
    ctx, key = ctx[order], key[order]
    first = np.append(True, (ctx[1:] != ctx[:-1]) | (key[1:] != key[:-1]))[: len(key)]
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(first) - 1
    counts = np.concatenate([unpack(r["counts"], 2, len(p)) for r, p in zip(rows, pairs, strict=True)], axis=1)
    sums_ = np.stack([np.bincount(group, weights=c).astype(np.int64) for c in counts])
    for i in (0, 1):
        stats[2 + i] = np.bincount(ctx[first], weights=sums_[i], minlength=m + hot)
        stats[4 + i] = np.bincount(ctx[first][sums_[i] > 0], minlength=m + hot)
    heads = pack(np.append(stats[2:, m:].ravel(), [m, *stats[:2, :m].sum(1)]))
    cuts = np.cumsum([0, *map(len, pairs)])
    return pa.table({
        "bucket": chunks.column("bucket"), "block": chunks.column("block"), "words": pa.array([pack(stats[:, a]) for a in at], pa.binary()),
        "counts": pa.array([pack(sums_[:, group[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), "heads": pa.array([heads] * len(rows), pa.binary()),
    })


def losses(lay: Layout, answers: pa.Table, texts: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, target bits, background bits) of each text of a block."""
    m = len(lay.words)
    stats, counts, heads = np.zeros((6, m + 1), np.int64), np.zeros((2, len(lay.ctx)), np.int64), np.zeros(4 * hot + 3, np.int64)
    for r in answers.to_pylist():
        j = r["bucket"]
        w, p = slice(*lay.word_cuts[j : j + 2]), slice(*lay.pair_cuts[j : j + 2])
        stats[:, w] = unpack(r["words"], 6, w.stop - w.start)
        counts[:, p] = unpack(r["counts"], 2, p.stop - p.start)
        heads += unpack(r["heads"], -1)
    warm = np.flatnonzero(lay.word_heat >= 0)
    stats[2:, warm] = heads[: 4 * hot].reshape(4, hot)[:, lay.word_heat[warm]]
    kinds, *tokens = heads[4 * hot :]
    out = [sums(lay.rows, texts)]
    for i in (0, 1):
        one = (stats[i, lay.tok] + 1) / (tokens[i] + kinds)
        n, k = stats[2 + i, lay.ctx], stats[4 + i, lay.ctx]
        seen = np.maximum(n + k, 1)
        bits_ = -np.log2(counts[i] / seen + np.where(n > 0, k / seen, 1.0) * one)
        out.append(sums(lay.rows, texts, bits_[lay.pair]))
    return tuple(out)


def hot_contexts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Sorted hashes of words that are frequent in the beginnings of some documents, and of the start of a text."""
    some = docs.select(F.substring(F.col(text_col), 1, 4096).alias("t")).limit(1000).toPandas()["t"]
    w = Words(pa.array(some, pa.string()))
    u, inverse = np.unique(hashes([core(x) for x in w.uniq]), return_inverse=True)
    n = np.bincount(inverse[w.codes], minlength=len(u))
    return np.unique(np.append(u[n > max(5, HOT * n.sum())], _START))


def score_whole(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_bits, background_bits, score) of each row of `docs` by models with every word of `docs`.

    As `fit` and `score`, with no word left to a class: unigrams are add-one over all distinct words. Rows of one id lie
    in one block with the mark that it is a target; rows without an id, and those of an id with over ID_ROWS rows, are
    dealt one by one, and such an id's mark goes to every block.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    rows = pick(docs, [id_col, text_col]).toDF("_id", "_text")
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks, buckets = 1 + total // BLOCK_BYTES, BUCKETS + total // BUCKET_BYTES
    hot = hot_contexts(rows, "_text")
    kind = rows.schema["_id"].dataType
    ids = target_ids.toDF("_id").where("_id IS NOT NULL").select(F.col("_id").cast(kind).alias("_id"), F.lit(None).cast("string").alias("_text"))

    def dealt_by(*of) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(blocks)).cast("int")

    often = rows.where("_id IS NOT NULL").groupBy("_id").agg(F.count("*").alias("_n")).where(F.col("_n") > ID_ROWS).select("_id")
    alone = F.col("_id").isNull()
    if not often.isEmpty():  # repeated ids, of which the rows hold few
        often = materialize(often, "often").withColumn("_often", F.lit(True))
        rows, ids = (df.join(often, "_id", "left") for df in (rows, ids.distinct()))
        alone = alone | F.col("_often").isNotNull()
        everywhere = F.when(alone, F.sequence(F.lit(0), F.lit(blocks - 1).cast("int"))).otherwise(F.array(dealt_by("_id")))
        ids = ids.select("_id", "_text", F.explode(everywhere).alias("_block"))
    else:
        ids = ids.withColumn("_block", dealt_by("_id"))
    # by the place in the scan: the same whenever a task runs again
    rows = rows.withColumn("_block", F.when(alone, dealt_by(F.monotonically_increasing_id())).otherwise(dealt_by("_id"))).select("_id", "_text", "_block")
    dealt = rows.withColumn("_aim", F.lit(False)).union(ids.withColumn("_aim", F.lit(True))).select("_id", "_text", "_aim", "_block").repartition(blocks, "_block")

    def texts(t: pa.Table) -> pa.Table:
        return t.filter(pc.invert(t.column("_aim"))).combine_chunks()

    def text_of(t: pa.Table) -> pa.Array:
        c = t.column("_text").combine_chunks()
        return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)

    def count(t: pa.Table) -> pa.Table:
        own = texts(t)
        aims = t.filter(t.column("_aim")).column("_id").combine_chunks()
        aim = pc.is_in(own.column("_id"), value_set=aims).to_numpy(zero_copy_only=False).astype(bool)
        if not own.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.int32() if c.endswith("int") else pa.binary()) for c in _CHUNK.split(", ")})
        return counted(Layout(text_of(own), hot, buckets), aim, t.column("_block")[0].as_py(), len(hot))

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        own = texts(t)
        n, a, b = losses(Layout(text_of(own), hot, buckets), answers, own.num_rows, len(hot)) if own.num_rows else [np.zeros(0)] * 3
        a, b = a / np.maximum(n, 1), b / np.maximum(n, 1)
        return pa.table({"doc_id": own.column("_id"), "n_tokens": pa.array(n.astype(np.int64)), "target_bits": pa.array(a), "background_bits": pa.array(b), "score": pa.array(a - b)})

    chunks = dealt.groupBy("_block").applyInArrow(count, _CHUNK)
    answers = chunks.groupBy("bucket").applyInArrow(lambda t: totalled(t, len(hot)), "bucket int, block int, words binary, counts binary, heads binary")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_bits", "background_bits", "score"))])
    return dealt.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)

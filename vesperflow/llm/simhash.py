"""SimHash fingerprints and near-duplicate groups through a Gray-order hierarchical index.

A fingerprint summarises the XXH64 hashes of a text's three-word shingles. Equal fingerprints are folded first, so
the search works on distinct fingerprints. The 64 bits fall into six blocks; two fingerprints that differ in at most
two bits agree in four blocks at least, so each distinct fingerprint is sent under the 15 choices of four blocks.
Each choice's fingerprints are brought, in that choice's bit order, into a Gray-order hierarchical index (`GrayIndex`)
that finds all links between those that agree in the chosen blocks. A task emits a star for each group it finds, not
the pairs; stars are then joined to whole components by alternating large-star and small-star rounds, each written
to the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesperflow.llm._common import bound_arrow, map_batches
from vesperflow.session import materialize, pick

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Widths of the blocks from the highest bit down; RADIUS of them may differ.
BLOCKS = (11, 11, 11, 11, 10, 10)
CHUNK = 1 << 17
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PART = 1 << 16


def simhash(text: str | None, k: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text; null counts as empty, and a text without words gives 0.

    A-Z are lowered; words are what stands between white space (space, tab to carriage return). Fewer than k words
    make one shingle. A bit is 1 if it is set in over half of the shingles' hashes, repeats included.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return h(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: 1 - k].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), _PART):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i : i + _PART], ends[i : i + _PART], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, as a signed long of the same bits."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def make():
        def f(b: pa.RecordBatch) -> dict:
            fps = np.fromiter((simhash(t, k) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            return {"doc_id": b.column(0), "fp": fps.view(np.int64)}

        return f

    return map_batches(pick(docs, [id_col, text_col]), make, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray sequence."""
    b = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        b = b ^ (b >> np.uint64(s))
    return b


class GrayIndex:
    """Codes in Gray order; every `fan` neighbours share an upper node that holds the bits they agree in.

    A node's own mask leaves out what its parent's mask has, so differences add up along a path and none counts
    twice. A search goes down level by level and leaves a node, with all codes below it, as soon as the differences so
    far exceed the radius or touch a bit that must be equal.
    """

    def __init__(self, codes: np.ndarray, fan: int = 8):
        self.fan = fan
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order].astype(np.uint64)
        both, any_ = [self.codes], [self.codes]
        while len(both[-1]) > fan:
            at = np.arange(0, len(both[-1]), fan)
            both.append(np.bitwise_and.reduceat(both[-1], at))
            any_.append(np.bitwise_or.reduceat(any_[-1], at))
        masks = [~(a ^ o) for a, o in zip(both, any_, strict=True)]
        #: From the root's level to the codes: the bits that all codes below agree in, and which bits are new there.
        self.levels = []
        for i in reversed(range(len(both))):
            own = masks[i] if i + 1 == len(masks) else masks[i] & ~np.repeat(masks[i + 1], fan)[: len(masks[i])]
            self.levels.append((both[i], own))

    def search(self, queries: np.ndarray, radius: int, equal: int = 0, step: int = 2048):
        """Yield (query, place in `codes`) arrays of all within `radius` that agree in all bits of `equal`."""
        equal = np.uint64(equal)
        for at in range(0, len(queries), step):
            part = queries[at : at + step].astype(np.uint64)
            top = len(self.levels[0][0])
            q, node = np.repeat(np.arange(len(part)), top), np.tile(np.arange(top), len(part))
            gone = np.zeros(len(q), np.uint8)
            for depth, (pattern, own) in enumerate(self.levels):
                if depth:
                    q, gone = np.repeat(q, self.fan), np.repeat(gone, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    there = node < len(pattern)
                    q, gone, node = q[there], gone[there], node[there]
                diff = (part[q] ^ pattern[node]) & own[node]
                gone = gone + np.bitwise_count(diff)
                keep = (gone <= radius) & ((diff & equal) == 0)
                q, gone, node = q[keep], gone[keep], node[keep]
            yield q + at, node


def _permute(codes: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    ends = np.cumsum(BLOCKS)
    out = np.zeros_like(codes)
    for b in order:
        block = (codes >> np.uint64(64 - ends[b])) & np.uint64((1 << BLOCKS[b]) - 1)
        out = (out << np.uint64(BLOCKS[b])) | block
    return out


def _choices() -> list[tuple[tuple[int, ...], int, int]]:
    """For each choice of blocks that must agree: the bit order that puts them first, their mask there and in place."""
    ends, out = np.cumsum(BLOCKS), []
    for same in combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS):
        width = sum(BLOCKS[b] for b in same)
        rest = tuple(b for b in range(len(BLOCKS)) if b not in same)
        in_place = sum(((1 << BLOCKS[b]) - 1) << (64 - int(ends[b])) for b in same)
        out.append((same + rest, ((1 << width) - 1) << (64 - width), in_place))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(codes: np.ndarray, order: tuple[int, ...], equal: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member) of each group of linked codes, the first itself left out."""
    index = GrayIndex(_permute(codes, order))
    label = np.arange(len(codes))

    def roots(x: np.ndarray) -> np.ndarray:
        r = label[x]
        while len(moved := np.flatnonzero(label[r] != r)):
            r[moved] = label[r[moved]]
        label[x] = r
        return r

    for q, at in index.search(index.codes, RADIUS, equal):  # folded step by step: pairs are not kept
        u, v = roots(q[at > q]), roots(at[at > q])
        while len(u):
            low, high = np.minimum(u, v), np.maximum(u, v)
            apart = low < high
            low, high = low[apart], high[apart]
            np.minimum.at(label, high, low)  # a root joins the smallest it is linked to; its other links go on from there
            u, v = roots(low), roots(high)
            u, v = u[u != v], v[u != v]
    label = roots(np.arange(len(codes)))
    own = codes[index.order]
    moved = label != np.arange(len(codes))
    return own[moved], own[label[moved]]


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(u, v): stars that join all distinct fingerprints within RADIUS bits, found choice by choice of equal blocks."""
    bound_arrow(distinct.sparkSession)
    choices = _choices()
    keyed = distinct.select(
        F.col(fp).alias("fp"),
        F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(fp).bitwiseAND(F.lit(_signed(m))).alias("same")) for i, (_, _, m) in enumerate(choices)))).alias("key"),
    ).select(F.col("key.i").alias("i"), F.col("key.same").alias("same"), "fp")

    def run(batches):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def found(i: np.ndarray, fps: np.ndarray):
            cut = np.flatnonzero(np.diff(i)) + 1
            for own, part in zip(np.split(i, cut), np.split(fps, cut), strict=True):
                if len(own) > 1:
                    u, v = _stars(part.view(np.uint64), choices[own[0]][0], choices[own[0]][1])
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        held = [np.zeros(0, t) for t in (np.int32, np.int64, np.int64)]
        for b in batches:
            held = [np.concatenate([x, np.asarray(c)]) for x, c in zip(held, b.columns, strict=True)]
            if len(held[0]) > CHUNK:  # whole keys only; one key has at most 2 ** 22 fingerprints
                at = np.flatnonzero((np.diff(held[1]) != 0) | (np.diff(held[0]) != 0))
                if len(at):
                    n = at[-1] + 1
                    yield from found(held[0][:n], held[2][:n])
                    held = [x[n:] for x in held]
        if len(held[0]):
            yield from found(held[0], held[2])

    return keyed.repartition("i", "same").sortWithinPartitions("i", "same", "fp").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected `edges` (u, v): root is the smallest node of its component.

    Alternating large-star and small-star rounds; each round's edges are written to the shared folder, and only
    their number and checksum reach the driver.
    """

    def down(df: DataFrame) -> DataFrame:
        return df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = materialize(down(edges), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = down(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = materialize(down(small), "edges")
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of `docs`: the groups of fingerprints linked within 2 bits.

    component_id is the smallest id that is reachable, the row's own included; rows with a null id take part and are
    passed over in that minimum (null if no row of the group has an id). Null and empty texts share fingerprint 0.
    Repeated rows stay; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts)).select(F.col("node").alias("fp"), "root")
    rooted = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its near-duplicate group, with all their columns.

    Rows with a null id cannot be told apart and stay, as do repeated rows of the kept id.
    """
    rows = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))  # names that differ in case only would clash
    own = f"_c{docs.columns.index(id_col)}"
    first = near_duplicates(docs, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    kept = rows.join(first, F.col(own) == F.col("_kept"), "left_semi").unionByName(rows.where(F.col(own).isNull()))
    return kept.toDF(*docs.columns)

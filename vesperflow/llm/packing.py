"""Conflict-constrained best-fit packing of documents into training sequences of fixed capacity.

Documents are dealt evenly (round robin, so no source or group of copies gathers in a task) into as many tasks as the
session's exchanges have, and within a task into windows of WINDOW rows of ids and lengths; texts stay where they are.
Within a window pieces go by falling length into the tightest bin that holds no piece of the same source and none of
the same duplicate cluster.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperflow.llm._common import bound_arrow
from vesperflow.session import pick

CAPACITY = 2048
#: Rows that are packed together (up to twice as many at a task's end); bins never span windows, so memory and time of
#: a window are bounded. The README has what that costs in bins.
WINDOW = 8192


class Bins:
    """Open bins ordered by residual, each with a bitmap of its sources and one of its duplicate clusters.

    The order is kept in short blocks. A block also has the sources that all its bins have, so the search for the
    tightest compatible bin steps over blocks in which no bin can take a source.
    """

    def __init__(self, block: int = 64):
        self.size = block
        self.blocks: list[list[tuple[int, int]]] = []
        self.common: list[int] = []
        self.tops: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def new(self) -> int:
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.sources) - 1

    def _renew(self, k: int) -> None:
        block = self.blocks[k]
        if not block:
            del self.blocks[k], self.common[k], self.tops[k]
            return
        all_ = -1
        for _, b in block:
            all_ &= self.sources[b]
        self.common[k], self.tops[k] = all_, block[-1][0]

    def put(self, residual: int, b: int) -> None:
        """Enter a bin under its residual."""
        if not self.blocks:
            self.blocks, self.common, self.tops = [[(residual, b)]], [self.sources[b]], [residual]
            return
        k = min(bisect_left(self.tops, residual), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, (residual, b))
        if len(block) > 2 * self.size:
            self.blocks[k : k + 1] = [block[: self.size], block[self.size :]]
            self.common[k : k + 1], self.tops[k : k + 1] = [0, 0], [0, 0]
            self._renew(k + 1)
            self._renew(k)
        else:
            self.common[k] &= self.sources[b]
            self.tops[k] = block[-1][0]

    def take(self, need: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Remove and return (residual, bin) of the tightest bin with room and without the two bits; None if none."""
        for k in range(bisect_left(self.tops, need), len(self.blocks)):
            if self.common[k] & source:
                continue
            block = self.blocks[k]
            for i in range(bisect_left(block, (need, -1)), len(block)):
                b = block[i][1]
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    found = block.pop(i)
                    self._renew(k)
                    return found
        return None


def pack(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, start, length, bin, place in the bin) of every piece of every row.

    A row longer than the capacity is cut into pieces of the capacity and a rest; its pieces share its source and
    cluster and so lie in different bins. Null sources and clusters conflict with nothing but the row's own pieces.
    """
    pieces = []
    for row, n in enumerate(lengths):
        for piece, start in enumerate(range(0, max(n, 1), capacity)):
            pieces.append((-min(capacity, n - start), row, piece, start))
    pieces.sort()
    kinds = {s: i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    twice: dict = {}
    for c in clusters:
        if c is not None:
            twice[c] = twice.get(c, 0) + 1
    groups = {c: i for i, c in enumerate(c for c, k in twice.items() if k > 1)}  # others conflict with none
    bins, used, out = Bins(), {}, []
    for size, row, piece, start in pieces:
        need = -size
        source = 1 << kinds[sources[row]] if sources[row] is not None else 0
        cluster = 1 << groups[clusters[row]] if clusters[row] in groups else 0
        found = bins.take(need, source, cluster) if need < capacity else None
        residual, b = found if found else (capacity, bins.new())
        bins.sources[b] |= source
        bins.clusters[b] |= cluster
        out.append((row, piece, start, need, b, used.get(b, 0)))
        used[b] = used.get(b, 0) + need
        if residual > need:
            bins.put(residual - need, b)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, length: Column | None = None, window: int = WINDOW) -> DataFrame:
    """(bin_id, slot, doc_id, piece, start, length, bin_offset, source): one row for each piece of each row of `docs`.

    Every row is packed, whole: pieces of a document cover 0 to its length without overlap. No bin holds more than
    `capacity`, two pieces of one source, or two of one duplicate cluster (by default: of the same text, case and
    white space aside). Length is in words and an end mark unless given. Null and empty texts have length 1; null
    sources and clusters conflict with nothing; rows with equal or null ids are packed each by itself.
    """
    words = F.split(F.lower(F.trim(F.coalesce(F.col("t"), F.lit("")))), r"\s+")
    if length is None or cluster is None:
        rows = pick(docs, [id_col, source_col, text_col]).toDF("i", "s", "t").withColumn("w", words)
        rows = rows.select("i", "s", (F.when(F.element_at("w", 1) == "", F.lit(0)).otherwise(F.size("w")) + 1).cast("long").alias("n"), F.when(F.col("t").isNotNull(), F.xxhash64("w")).alias("c"))
    else:
        rows = docs.select(F.col(id_col).alias("i"), F.col(source_col).alias("s"), length.cast("long").alias("n"), cluster.alias("c"))
    bound_arrow(docs.sparkSession)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type, source_type = (docs.schema[c].dataType.simpleString() for c in (id_col, source_col))
    dealt = rows.repartition(min(tasks, max(1, math.ceil(docs.count() / window))))

    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def packed(t: pa.Table) -> pa.RecordBatch:
            nonlocal first
            placed = pack(t["n"].to_pylist(), t["s"].to_pylist(), t["c"].to_pylist(), capacity)
            row, piece, start, n, b, at = (np.array(x, np.int64) for x in zip(*placed, strict=True))
            by = np.lexsort((at, b))
            row, piece, start, n, b, at = (x[by] for x in (row, piece, start, n, b, at))
            head = np.concatenate([[True], b[1:] != b[:-1]])
            slot = np.arange(len(b)) - np.maximum.accumulate(np.where(head, np.arange(len(b)), 0))
            ids, sources = (t[c].combine_chunks().take(pa.array(row)) for c in ("i", "s"))
            first, base = first + int(b.max()) + 1, first
            return pa.RecordBatch.from_arrays([pa.array((part << 33) + base + b), pa.array(slot), ids, *map(pa.array, (piece, start, n, at)), sources], names=["bin_id", "slot", "doc_id", "piece", "start", "length", "bin_offset", "source"])

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= 2 * window:
                t = pa.Table.from_batches(held)
                yield packed(t.slice(0, window))
                held = t.slice(window).to_batches()
        if any(x.num_rows for x in held):
            yield packed(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, f"bin_id long, slot long, doc_id {id_type}, piece long, start long, length long, bin_offset long, source {source_type}")

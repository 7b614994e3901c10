"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, texts scanned once.

Texts are normalised bytewise (A-Z lowered, all ASCII but letters and digits turned into blanks), which keeps every
byte's place, so a match's words map back to places in the original text. The automaton holds each item cut into
pieces of about half a window: any window of an item has a whole piece in it, so where no piece occurs no window does,
and the automaton is as large as the items and not as all their windows. Around an occurrence the windows of the text
are looked up among the digests of the items' windows.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesperflow.llm._common import bound_arrow, map_rows
from vesperflow.session import pick

WINDOW = 10
#: An automaton is built from at most so many bytes of items, which take some 50 times that in memory. The automata of
#: a larger benchmark are built one after the other, each for CHUNK_BYTES of a task's rows.
MAX_ITEM_BYTES = 8 << 20
CHUNK_BYTES = 64 << 20
_NORMAL = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    """The text's UTF-8 bytes, letters A-Z lowered and other ASCII but a-z and 0-9 blanked: as long as before."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)


class Automaton:
    """Windows of `window` consecutive item words (a shorter item is one window), with the items they come from."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, self.piece = window, (window + 1) // 2
        self.names: list[str] = []
        known: dict[str, int] = {}
        short: dict[bytes, set[int]] = {}
        pieces: set[bytes] = set()
        digests, owners = bytearray(), array("I")
        for item_id, text in items:
            words = normalise(text).split()
            if not words:
                continue
            own = known.setdefault(str(item_id), len(known))
            if len(words) < window:
                short.setdefault(b" ".join(words), set()).add(own)
                continue
            pieces.update(b" ".join(words[i : i + self.piece]) for i in range(0, len(words) - self.piece + 1, self.piece))
            for i in range(len(words) - window + 1):
                digests += xxhash.xxh3_128_digest(b" ".join(words[i : i + window]))
                owners.append(own)
        self.names = list(known)
        # windows in the order of their digests, each with its items
        both = np.frombuffer(bytes(digests), "<u8").reshape(-1, 2)
        own = np.frombuffer(owners, np.uint32) if len(owners) else np.zeros(0, np.uint32)
        order = np.lexsort((own, both[:, 1], both[:, 0]))
        both, own = both[order], own[order]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(1)
        fresh = new.copy()
        fresh[1:] |= own[1:] != own[:-1]  # an item with a window twice owns it once
        self.digests, self.own = both[new], own[fresh]
        self.first = np.append(np.cumsum(fresh)[new] - 1, fresh.sum())
        self.tree = ahocorasick.Automaton()
        for k in pieces | short.keys():
            self.tree.add_word(f" {k.decode('utf-8', 'surrogatepass')} ", (k.count(b" ") + 1, k in pieces, tuple(short.get(k, ()))))
        self.empty = not (pieces or short)
        if not self.empty:
            self.tree.make_automaton()

    def _windows(self, words: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """(those of the starts at which an item's window stands, the items that have them)."""
        d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(words[i : i + self.window])) for i in starts.tolist()), "<u8").reshape(-1, 2)
        at = np.searchsorted(self.digests[:, 0], d[:, 0])
        found = np.full(len(d), -1)
        live = np.arange(len(d))
        while len(live):  # among equal first halves, of which there is one but for chance
            live = live[at[live] < len(self.digests)]
            live = live[self.digests[at[live], 0] == d[live, 0]]
            right = self.digests[at[live], 1] == d[live, 1]
            found[live[right]] = at[live[right]]
            live = live[~right]
            at[live] += 1
        hit = np.unique(found[found >= 0])
        return starts[found >= 0], {int(o) for k in hit for o in self.own[self.first[k] : self.first[k + 1]]}

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """(words in the text, for each word whether an item's window covers it, the items found)."""
        words = normalise(text).split()
        if self.empty or not words:
            return len(words), np.zeros(len(words), bool), set()
        line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        found = list(self.tree.iter(line))
        if not found:
            return len(words), np.zeros(len(words), bool), set()
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        start = np.searchsorted(blanks, [end for end, _ in found]) - np.array([n for _, (n, _, _) in found])
        change = np.zeros(len(words) + 1, np.int64)
        items: set[int] = set()
        whole = [i for i, (_, (_, _, own)) in enumerate(found) if own]
        for own in {found[i][1][2] for i in whole}:
            items.update(own)
        np.add.at(change, start[whole], 1)
        np.add.at(change, start[whole] + np.array([found[i][1][0] for i in whole], np.int64), -1)
        near = start[[piece for _, (_, piece, _) in found]]
        near = np.unique(near[:, None] - np.arange(self.window - self.piece + 1))
        near = near[(near >= 0) & (near <= len(words) - self.window)]
        if len(near):
            at, own = self._windows(words, near)
            items |= own
            np.add.at(change, at, 1)
            np.add.at(change, at + self.window, -1)
        return len(words), np.cumsum(change)[:-1] > 0, {self.names[o] for o in items}

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """The stretches of hit words as (start, end) code points of the original text."""
        _, hit, _ = self.scan(text)
        if not hit.any():
            return []
        raw = normalise(text)
        solid = np.frombuffer(raw, np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate([[0], solid.astype(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in zip(runs[::2], runs[1::2], strict=True)]


def broadcast_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = MAX_ITEM_BYTES) -> list:
    """Broadcasts of the distinct benchmark items that have an id, each of about `limit` bytes of text at most.

    The size is measured first. A benchmark below the limit, the usual case, is one part and so one automaton; a
    larger one is split by hash, and only one part at a time is on the driver.
    """
    items = pick(benchmark, [id_col, text_col]).toDF("i", "t").where("i IS NOT NULL AND t IS NOT NULL").distinct()
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / limit))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]) for k in range(n)]


def scanned(batches: Iterator[pa.RecordBatch], parts: list, window: int, at: int, chunk: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch that has rows, with what every text in column `at` has by `Automaton.scan` over all parts.

    With one part its automaton is built once a task. With more, `chunk` bytes of batches are held and each part's
    automaton is built once for them, so a task holds one automaton and one chunk at a time.
    """

    def joined(a: tuple | None, b: tuple) -> tuple:
        return b if a is None else (b[0], a[1] | b[1], a[2] | b[2])

    def through(held: list[pa.RecordBatch], tree: Callable[[int], Automaton]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        got: list[list] = [[None] * b.num_rows for b in held]
        for k in range(len(parts)):
            own = tree(k)
            for b, rows in zip(held, got, strict=True):
                for i, t in enumerate(b.column(at)):
                    rows[i] = joined(rows[i], own.scan(t.as_py()))
        yield from zip(held, got, strict=True)

    def build(k: int) -> Automaton:
        tree = Automaton(parts[k].value, window)
        if len(parts) > 1 and hasattr(parts[k], "_value"):
            del parts[k]._value  # the worker would keep every part it has seen
        return tree

    only, held, size = None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if len(parts) == 1:
            only = only or build(0)
            yield b, [only.scan(t) for t in b.column(at).to_pylist()]
            continue
        held.append(b)
        size += b.nbytes
        if size >= chunk:
            yield from through(held, build)
            held, size = [], 0
    if held:
        yield from through(held, build)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, limit: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of `docs`.

    A document word inside any occurrence of an item's window is hit. Null and empty texts have no words; items
    without words or with a null id match nothing; equal items count as one. An empty benchmark hits nothing.
    A benchmark of over `limit` bytes is scanned by one automaton after another over the same chunk of texts.
    """
    bound_arrow(docs.sparkSession)
    parts = broadcast_items(benchmark, limit=limit)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in scanned(batches, parts, window, 1):
            n_hit = [int(hit.sum()) for _, hit, _ in found]
            digests = [hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for _, _, items in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in ([n for n, _, _ in found], n_hit, [len(items) for _, _, items in found])), pa.array(digests), pa.array([n > 0 for n in n_hit])], names=schema.names,
            )

    return pick(docs, [id_col, text_col]).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, limit: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of `docs`, all columns as they are, in whose text no item's window occurs."""
    parts = broadcast_items(benchmark, limit=limit)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in scanned(batches, parts, window, at):
            yield b.filter(pa.array([not hit.any() for _, hit, _ in found], pa.bool_()))

    return map_rows(docs, run)

"""Token ids in a bit-packed binary format with random access.

A shard file holds whole documents in ascending id order: each id in the fewest bits that the vocabulary needs, in
blocks of BLOCK ids whose places an offset table gives, so that any id range is unpacked by numpy without reading the
rest. Documents are dealt to shards by range of their id; file names sort like the ranges.

    header   8 bytes magic, u32 bits, u32 block
    blocks   packed ids, each block padded to whole bytes
    index    u64 offset of each block, then i64 id, u8 id known and u64 first token of each document
    footer   u64 blocks, u64 documents, u64 tokens, u64 place of the index, 8 bytes magic
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesperflow.llm._common import Words, bound_arrow
from vesperflow.session import pick, scratch_path

MAGIC = b"VFTOKEN1"
BLOCK = 1 << 16
END_ID = 1
#: A task begins another file after so many ids.
SHARD_IDS = 1 << 26
_FOOT = struct.Struct("<QQQQ8s")
#: Distinct words whose ids a worker keeps; a cache only, what is not in it is encoded again.
CACHE = 3 << 17
#: The one pattern of matches that is known to part at words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """The ids, `bits` each, least significant bit first."""
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]).tobytes()
    own = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(own.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first n ids of a packed block."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        own = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
        packed = np.packbits(own, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
    return out.view("<u4").ravel()


class Writer:
    """Writes one shard; ids may come in any portions, and only a block of them is held."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.offsets: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self.n = 0
        self.held: list[np.ndarray] = []
        self.waiting = 0
        out.write(MAGIC + struct.pack("<II", bits, block))
        self.at = 16

    def document(self, doc_id: int | None) -> None:
        self.docs.append((doc_id, self.n))

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.waiting += len(ids)
        self.held.append(ids)
        if self.waiting >= self.block:
            joined = np.concatenate(self.held)
            whole = len(joined) - len(joined) % self.block
            for i in range(0, whole, self.block):
                self._put(joined[i : i + self.block])
            self.held = [joined[whole:].copy()]
            self.waiting = len(joined) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        if len(rest):
            self._put(rest)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is not None for d, _ in self.docs], "u1").tobytes())
        self.out.write(np.array([s for _, s in self.docs], "<u8").tobytes())
        self.out.write(_FOOT.pack(len(self.offsets), len(self.docs), self.n, self.at, MAGIC))


class Reader:
    """Random access to a shard's bytes (a buffer, or a memory map)."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        blocks, docs, self.n, at, magic = _FOOT.unpack(self.data[-_FOOT.size :])
        if magic != MAGIC or bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block = struct.unpack("<II", self.data[8:16])
        self.end = at
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at)
        at += blocks * 8
        self.doc_ids = np.frombuffer(self.data, "<i8", docs, at)
        self.known = np.frombuffer(self.data, "u1", docs, at + docs * 8).astype(bool)
        self.starts = np.append(np.frombuffer(self.data, "<u8", docs, at + docs * 9), self.n).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; reads only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        out = []
        for k in range(first, last + 1):
            size = min(self.block, self.n - k * self.block)
            begin = int(self.offsets[k])
            out.append(unpack_bits(self.data[begin : begin + (size * self.bits + 7) // 8], self.bits, size))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _steps(part: dict | None, inner: str) -> list[dict]:
    """The normaliser's or pre-tokenizer's steps, sequences opened."""
    return [] if part is None else [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def parts_at_words(vocabulary: bytes) -> bool:
    """Whether a tokenizer's ids of a text are those of its white-space separated words, one after another, and those
    of a word of letters with a tail of punctuation the letters' and the tail's: it lowers, it keeps only matches of a
    pattern that has no white space and parts letters from other signs, and its merges end with the match.

    What is not known to do so does not: then whole texts are encoded.
    """
    try:
        j = json.loads(vocabulary)
        norm, pre = _steps(j.get("normalizer"), "normalizers"), _steps(j.get("pre_tokenizer"), "pretokenizers")
        return (
            j["model"]["type"] == "BPE" and j["model"].get("end_of_word_suffix") == "</w>" and not j["model"].get("dropout")
            and [x["type"] for x in norm] in (["NFC", "Replace", "Lowercase"], ["NFC", "Lowercase"], ["Lowercase"]) and all(x["pattern"] == {"Regex": r"\s+"} for x in norm if x["type"] == "Replace")
            and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": _PATTERN} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
            and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in j["added_tokens"])
        )
    except (ValueError, KeyError, TypeError):
        return False


class WordEncoder:
    """Ids of texts, as the tokenizer gives for each whole text.

    For tokenizers of which `parts_at_words` holds, each distinct part is encoded once, plain letters many at a time in
    one string that is cut after the ids of word ends; other words go to the library one by one. Of other tokenizers,
    and with by_word off, whole texts do.
    """

    def __init__(self, vocabulary: bytes, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads; more would take memory
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(vocabulary)
        self.by_word = by_word and parts_at_words(vocabulary)
        ends = {i for t, i in self.tok.get_vocab(with_added_tokens=True).items() if t.endswith("</w>")}
        self.ends = np.zeros(max(ends, default=0) + 1, bool)
        self.ends[list(ends)] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, plain: list[str], other: list[str]) -> None:
        """Encode parts that are not known yet; the ids of all known ones lie end to end in `flat`."""
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)] & (ids < len(self.ends)))
            if len(cut) != len(part) or cut[-1] != len(ids) - 1:  # a vocabulary without word ends
                other = part + other
                continue
            for w in part:
                self.known[w] = len(self.known)
            found.append(ids)
            sizes.append(np.diff(cut, prepend=-1))
        for w, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[w] = len(self.known)
            found.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        self.flat, self.size = np.concatenate([self.flat, *found]), np.concatenate([self.size, *sizes])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text); null counts as empty."""
        if not self.by_word:
            lists = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([*lists, np.zeros(0, np.uint32)]), np.array([len(x) for x in lists], np.int64)
        w = Words(texts)
        if len(self.known) > CACHE:
            self.clear()
        known, plain, other, heads, tails = self.known, {}, {}, [], []
        for x in w.uniq:
            m = _PLAIN.fullmatch(x.lower())
            if m:
                head, tail = m.groups()
                if head not in known:
                    plain[head] = None
                if tail not in known:
                    other[tail] = None
            else:
                head, tail = x, ""
                if x not in known:
                    other[x] = None
            heads.append(head)
            tails.append(tail)
        self._learn(list(plain), list(other))
        which = np.stack([np.fromiter(map(known.__getitem__, p), np.int64, len(p)) for p in (heads, tails)], 1)
        size = self.size[which]
        own = _spans((np.cumsum(self.size) - self.size)[which].ravel(), size.ravel())  # each distinct word's ids, end to end
        size = size.sum(1)
        k = size[w.codes]
        ids = self.flat[own[_spans((np.cumsum(size) - size)[w.codes], k)]]
        return ids, np.diff(np.concatenate([[0], np.cumsum(k)])[w.first])


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each size, end to end."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


_ENCODERS: dict[tuple, WordEncoder] = {}


def _encoder(vocabulary: bytes, by_word: bool) -> WordEncoder:
    """A worker's encoder, kept from task to task with what it knows."""
    key = (zlib.crc32(vocabulary), len(vocabulary), by_word)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(vocabulary, by_word)
    return _ENCODERS[key]


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, by_word: bool = True, shard_ids: int = SHARD_IDS) -> list[tuple]:
    """Tokenise every row's whole text, append `end_id`, and write shard files below `path`, a URI all executors share.

    Returns (file name, documents, ids) of the shards in id order (null ids first; equal ids by their text). A task
    writes under a name of its attempt and renames when whole, and its content depends on its rows only, so a lost
    executor's task can run again. Ids are whole numbers (the format has 64 bits for them); others raise a TypeError.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids are to be whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    base, blob = path.rstrip("/"), Path(tokenizer).read_bytes()
    bits = bits_for(max(WordEncoder(blob).tok.get_vocab_size(with_added_tokens=True), end_id + 1))
    shared = docs.sparkSession.sparkContext.broadcast(blob)  # the vocabulary, a few MB whatever the corpus
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, by_word)
        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done: list[tuple] = []
        out = w = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, counts = enc.encode(b.column(1))
            at = 0
            for doc_id, n in zip(b.column(0).to_pylist(), counts.tolist(), strict=True):
                if w is None:
                    name = f"tokens-{part:06d}-{len(done):04d}.bin"
                    out = store.open_output_stream(f"{root}/.{name}.{attempt}")
                    w = Writer(out, bits)
                w.document(doc_id)
                w.add(ids[at : at + n])
                w.add(np.array([end_id], np.uint32))
                at += n
                if w.n >= shard_ids:
                    done.append(_finish(store, root, name, attempt, out, w))
                    w = None
        if w is not None:
            done.append(_finish(store, root, name, attempt, out, w))
        names, n_docs, n_ids = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())], names=["file", "docs", "ids"])

    rows = pick(docs, [id_col, text_col]).toDF("i", "t")
    # ranges of id and a text's beginning, so that rows of one id can be parted; beginnings are in the order of the texts
    ordered = rows.repartitionByRange(F.col("i"), F.substring("t", 1, 16)).sortWithinPartitions("i", "t")
    return sorted(tuple(r) for r in ordered.mapInArrow(run, "file string, docs long, ids long").collect())


def _finish(store, root: str, name: str, attempt: int, out, w: Writer) -> tuple:
    w.close()
    out.close()
    store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
    return name, len(w.docs), w.n


def read_shards(spark: SparkSession, path: str, manifest: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards: start counts all ids before it."""
    first, n = {}, 0
    for name, _, ids in manifest:
        first[name] = n
        n += ids
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    if not manifest:
        return spark.createDataFrame([], schema)
    starts = spark.sparkContext.broadcast(first)  # one entry a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                r = Reader(data.as_buffer())
                base = starts.value[name.as_py().rsplit("/", 1)[-1]]
                crc = _crcs(r)
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, pa.int64(), mask=~r.known), pa.array(base + r.starts[:-1]), pa.array(np.diff(r.starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def _crcs(r: Reader, step: int = 64) -> list[int]:
    """crc32 of every document's ids, unpacking some blocks at a time."""
    out = [0] * len(r.doc_ids)
    reach = r.block * step
    for at in range(0, r.n, reach):
        ids = r.ids(at, min(at + reach, r.n)).tobytes()
        i = int(np.searchsorted(r.starts, at, "right")) - 1
        while i < len(out) and r.starts[i] < at + reach:
            a, b = max(int(r.starts[i]), at), min(int(r.starts[i + 1]), at + reach)
            out[i] = zlib.crc32(ids[(a - at) * 4 : (b - at) * 4], out[i])
            i += 1
    return out


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, by_word: bool = True) -> DataFrame:
    """Write the token shards of `docs` and return what reading them back gives, one row for each row of `docs`.

    Null texts count as empty and keep the end id alone; repeated rows stay; an empty table writes no file.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    return read_shards(docs.sparkSession, path, write_shards(docs, path, tokenizer, by_word=by_word))

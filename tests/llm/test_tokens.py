import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import LONG, ODD
from tokenizers import Tokenizer
from vesperflow.llm import tokens as t

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 32])
def test_packing_round_trips(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = t.pack_bits(ids, bits)
        assert len(data) == (n * bits + 7) // 8
        assert (t.unpack_bits(data, bits, n) == ids).all()


@pytest.mark.parametrize("block", [1, 5, 64])
def test_shard_random_access(block):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50000, n).astype(np.uint32) for n in (0, 3, 0, 200, 1)]
    out = io.BytesIO()
    w = t.Writer(out, t.bits_for(50000), block)
    for i, d in enumerate(docs):
        w.document(None if i == 1 else i * 10)
        w.add(d)
    w.close()
    r = t.Reader(out.getvalue())
    assert r.bits == 16 and [len(x) for x in docs] == np.diff(r.starts).tolist()
    assert all((r.document(i) == d).all() for i, d in enumerate(docs))
    assert r.known.tolist() == [True, False, True, True, True]
    assert (r.ids(2, 150) == np.concatenate(docs)[2:150]).all()
    assert t._crcs(r, 3) == [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]


def test_words_give_the_ids_of_whole_texts():
    import pyarrow as pa

    tok = Tokenizer.from_file(PATH)
    texts = ["Don't  stop it", "<|endoftext|>", "a <|startoftext|>b", "café ́x", " wide　x", "İI ΣΑΣ ς", "1234 !!\n\tx", "\x1c\x85y", "漢字かな", "\U0001f600\U0001f600", "", "  ", "#$%<|end", LONG[:5000]]
    for by_word in (True, False):
        ids, n = t.WordEncoder(open(PATH, "rb").read(), by_word).encode(pa.array([*texts, None]))
        parts = np.split(ids, np.cumsum(n)[:-1])
        for x, p in zip([*texts, ""], parts, strict=True):
            assert p.tolist() == tok.encode(x, add_special_tokens=False).ids, x


def test_query_rows(odd, none):
    tok = Tokenizer.from_file(PATH)
    want, start = [], 0
    for i, x, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in t.round_trip(odd, PATH).collect()), key=lambda r: r[1])
    assert got == want
    assert t.round_trip(none, PATH).count() == 0


def test_many_small_shards(spark, tmp_path):
    from conftest import docs_of

    rows = [(i, f"text {i} " * (i % 7), "s") for i in range(200)]
    path = f"file://{tmp_path}/shards"
    made = t.write_shards(docs_of(spark, rows), path, PATH, shard_ids=50)
    assert len(made) > 10 and not [p for p in (tmp_path / "shards").iterdir() if p.name.startswith(".tokens")]
    got = sorted(t.read_shards(spark, path, made).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == list(range(200))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa

    assert t.parts_at_words(open(PATH, "rb").read())
    other = public_tokenizers.path("byte_bpe_50k.json")
    blob, tok = open(other, "rb").read(), Tokenizer.from_file(other)
    enc = t.WordEncoder(blob)
    assert not enc.by_word and not t.parts_at_words(b"{}") and not t.parts_at_words(b"no json")
    texts = ["Two  words here", " x", "", "don't!!"]
    ids, n = enc.encode(pa.array(texts))
    for x, p in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert p.tolist() == tok.encode(x, add_special_tokens=False).ids


def test_ids_that_are_no_numbers_raise(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        t.round_trip(spark.createDataFrame([("x1", "a")], "doc_id string, text string"), PATH)


def test_rows_of_one_id_are_parted_in_order(spark, tmp_path):
    import random

    rng = random.Random(2)
    tok = Tokenizer.from_file(PATH)
    rows = [(5, " ".join(rng.choices(["ab", "c", "dé", "zz"], k=rng.randrange(0, 9)))) for _ in range(400)] + [(5, None), (None, "x"), (None, "y"), (1, "a"), (9, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = t.write_shards(df, f"file://{tmp_path}/s", PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) > 1 and max(n for _, n, _ in made) < 300
    want, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in t.read_shards(spark, f"file://{tmp_path}/s", made).collect()), key=lambda r: r[1]) == want

import hashlib
import random
import re
import struct

import xxhash
from conftest import ODD, docs_of
from pyspark.sql import functions as F
from vesperflow.llm import order_minhash as o

MASK = (1 << 64) - 1


def hash_longs(*xs, width="<q"):
    seed = 42
    for x in xs:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack(width, x), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_sketch(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    h = [hash_longs(w) for w in words]
    if not h:
        return []
    kmers = [hash_longs(*h[i : i + o.K]) for i in range(max(1, len(h) - o.K + 1))]
    seen, items = {}, []
    for i, k in enumerate(kmers):
        n = seen[k >> o.PLACE] = seen.get(k >> o.PLACE, -1) + 1
        seed = xxhash.xxh64_intdigest(struct.pack("<q", k >> o.PLACE), 42)
        g = xxhash.xxh64_intdigest(struct.pack("<i", n), seed)
        items.append((g >> o.PLACE, i))
    out = []
    for b in range(o.BINS):
        own = sorted((g - (1 << 36) if g >> 35 else g, i) for g, i in items if g >> 30 == b)[: o.TUPLE]
        if own:
            own.sort(key=lambda x: x[1])
            out.append((b << 16) + hash_longs(*(g for g, _ in own)) % 65535 + 1)
    return out


def test_sketch_matches_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "c", f"w{i}", "é"], k=n)) for i in range(6) for n in (0, 1, 2, 3, 50, 900)] + [None, " \n", "x " * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", o.sketch(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_sketch(t), (i, t and t[:50])


def brute(docs):
    known = sorted(((i, t or "") for i, t in docs if i is not None), key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1], 42) >> 11, r[1]))
    out = []
    for k, (i, t) in enumerate(known):
        nx = known[(k + 1) % len(known)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nx[:half]
        out.append((i, t, e, nx))
    return out + [(None, t or "", (t or "")[: len(t or "") - len(t or "") // 2], None) for i, t in docs if i is None]


def near(a, b):
    bins = {x >> 16 for x in a} | {x >> 16 for x in b}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


def check(df, docs):
    want = []
    for i, t, e, nx in brute(docs):
        a, b = plain_sketch(t), plain_sketch(e)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{x:06x}" for x in a), "".join(f"{x:06x}" for x in b), near(a, b), None if nx is None else near(a, plain_sketch(nx))))
    assert sorted(map(str, (tuple(r) for r in o.edit_likeness(df).collect()))) == sorted(map(str, want))


def test_odd_rows(spark, odd, none):
    check(odd, [(i, t) for i, t, _ in ODD])
    assert o.edit_likeness(none).count() == 0
    check(docs_of(spark, [(9, "only one row here", "s")]), [(9, "only one row here")])


def test_next_document_across_many_runs(spark, monkeypatch):
    monkeypatch.setattr(o, "RUN", 3)
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 150) + [-(1 << 62), 1 << 62, 5, 5]
    docs = [(i, " ".join(rng.choices(["one", "two", "three", "four"], k=rng.randrange(0, 30)))) for i in ids]
    check(docs_of(spark, [(i, t, "s") for i, t in docs]), docs)


def test_likeness_falls_with_edits_and_reordering(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    few = words.copy()
    few[7], few[200] = "x", "y"
    blocks = [words[i : i + 40] for i in range(0, 400, 40)]
    rng.shuffle(blocks)
    texts = [" ".join(w) for w in (words, few, [w for b in blocks for w in b], [f"v{i}" for i in range(400)])]
    df = spark.createDataFrame([(t,) for t in texts[1:]], "t string").select(o.likeness(o.sketch(F.lit(texts[0])), o.sketch(F.col("t"))).alias("l"))
    a, b, c = (r.l for r in df.collect())
    assert a > 0.85 and a > b > c == 0


def filled_sketch(text):
    """As plain_sketch, each bin taking its TUPLE k-mers from itself and the bins that follow."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    h = [hash_longs(w) for w in words]
    kmers = [hash_longs(*h[i : i + o.K]) for i in range(max(1, len(h) - o.K + 1))] if h else []
    seen, items = {}, []
    for i, k in enumerate(kmers):
        n = seen[k >> o.PLACE] = seen.get(k >> o.PLACE, -1) + 1
        g = xxhash.xxh64_intdigest(struct.pack("<i", n), xxhash.xxh64_intdigest(struct.pack("<q", k >> o.PLACE), 42)) >> o.PLACE
        items.append((g >> 30, g - (1 << 36) if g >> 35 else g, i))
    out = []
    for b in range(o.BINS if items else 0):
        own = sorted(items, key=lambda x: ((x[0] - b) % o.BINS, x[1]))[: o.TUPLE]
        out.append((b << 16) + hash_longs(*(g for _, g, _ in sorted(own, key=lambda x: x[2]))) % 65535 + 1)
    return out


def test_filled_sketch_matches_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "c", f"w{i}", "é"], k=n)) for i in range(4) for n in (0, 1, 2, 3, 4, 20, 50, 300)] + [None, " \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", o.sketch(F.col("t"), fill=True).alias("s")).collect():
        assert r.s == filled_sketch(texts[r.i]), texts[r.i]


def test_query_sees_swapped_halves_of_short_texts(spark, tmp_path):
    from vesperflow.llm.queries import op3_order_minhash

    docs = []
    for i in range(20):
        w = [f"w{i}x{j}" for j in range(50)]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[25:] + w[:25]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    near = [r.near_next for r in op3_order_minhash(spark, str(tmp_path)).collect() if r.doc_id % 2 == 0]
    assert 0.3 < sum(near) / len(near) < 0.6


def independent(text, n=64):
    """Order MinHash with n hash functions over the whole text: what the dealt bins stand in for."""
    h = [hash_longs(w) for w in text.split()]
    kmers = [hash_longs(*h[i : i + o.K]) for i in range(max(1, len(h) - o.K + 1))]
    out = []
    for seed in range(n):
        own = sorted((xxhash.xxh64_intdigest(struct.pack("<qi", k, kmers[:i].count(k)), seed), i) for i, k in enumerate(kmers))[: o.TUPLE]
        out.append((seed, tuple(x for x, _ in sorted(own, key=lambda x: x[1]))))
    return out


def test_short_texts_are_as_likely_as_by_independent_hash_functions():
    rng = random.Random(1)
    for n in (10, 20, 40, 80):
        for edit in (lambda w, n=n: w[n // 2 :] + w[: n // 2], lambda w, n=n: [*w[: n // 3], "x", *w[n // 3 + 1 :]]):
            a = b = 0.0
            for _ in range(20):
                w = [f"w{rng.random()}" for _ in range(n)]
                x, y = " ".join(w), " ".join(edit(w))
                a += near(filled_sketch(x), filled_sketch(y)) / 20
                b += sum(p == q for p, q in zip(independent(x), independent(y), strict=True)) / 64 / 20
            assert abs(a - b) < 0.1, (n, a, b)


def shares(df):
    """The rows of each run."""
    return sorted((r["n"] for r in o._dealt(df).groupBy("run").agg(F.count("*").alias("n")).collect()), reverse=True)


def test_uneven_and_repeated_ids_spread_over_runs(spark, monkeypatch):
    monkeypatch.setattr(o, "RUN", 20)
    monkeypatch.setattr(o, "CUTS", 16)
    rng = random.Random(6)
    uneven = [(2**60 - i if i % 3 else i, f"text {i}") for i in range(3000)]
    one = [(7, f"text {i}") for i in range(3000)]
    same = [(7, "same text")] * 2000 + [(i, f"text {i}") for i in range(1000)]
    for rows in (uneven, one, same):
        rng.shuffle(rows)
        got = shares(spark.createDataFrame(rows, "id long, text string").repartition(8))
        assert sum(got) == 3000 and got[0] < 150, got[:5]


def test_next_document_among_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(o, "RUN", 4)
    monkeypatch.setattr(o, "CUTS", 8)
    rng = random.Random(7)
    docs = [(rng.choice([3, 3, 3, 3, 9, 12, i]), " ".join(rng.choices(["one", "two", "three", "four"], k=rng.randrange(0, 6)))) for i in range(160)]
    docs += [(3, "one two three")] * 60
    check(docs_of(spark, [(i, t, "s") for i, t in docs]), docs)


def test_ids_that_are_no_numbers_raise(spark):
    import pytest

    with pytest.raises(TypeError, match="ids are to be numbers"):
        o.edit_likeness(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    assert o.edit_likeness(spark.createDataFrame([(1, "x y z")], "doc_id int, text string")).count() == 1

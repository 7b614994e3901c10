import random

from conftest import ODD
from vesperflow.llm import packing as p


def brute(lengths, sources, clusters, capacity):
    pieces = sorted((-min(capacity, n - s), r, k, s) for r, n in enumerate(lengths) for k, s in enumerate(range(0, max(n, 1), capacity)))
    bins, out = [], []  # [residual, sources, clusters, order]
    for size, r, k, s in pieces:
        fit = [b for b in bins if b[0] >= -size and b[0] > 0 and (sources[r] is None or sources[r] not in b[1]) and (clusters[r] is None or clusters[r] not in b[2])]
        b = min(fit, key=lambda b: (b[0], b[3]), default=None)
        if b is None:
            bins.append(b := [capacity, set(), set(), len(bins)])
        out.append((r, k, s, -size, b[3], capacity - b[0]))
        b[0] += size
        b[1].add(sources[r])
        b[2].add(clusters[r])
    return out


def test_best_fit_matches_brute_force():
    rng = random.Random(6)
    for capacity in (1, 10, 100):
        for n in (0, 1, 300):
            lengths = [rng.randrange(1, 250) for _ in range(n)]
            sources = [rng.choice(["hot", "hot", "a", "b", None]) for _ in range(n)]
            clusters = [rng.choice([1, 2, None, *range(3, 400)]) for _ in range(n)]
            assert p.pack(lengths, sources, clusters, capacity) == brute(lengths, sources, clusters, capacity)


def check(rows, docs, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.bin_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) <= capacity
        assert [r.bin_offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        named = [r.source for r in own if r.source is not None]
        assert len(named) == len(set(named))
    total = sum(r.length for r in rows)
    assert total == sum(len((t or "").split()) + 1 for _, t, _ in docs)


def test_query_rows(spark, odd, none):
    rows = p.pack_documents(odd).collect()
    check(rows, ODD, p.CAPACITY)
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 5)
    assert [x[0] for x in long] == list(range(len(long))) and [x[1] for x in long] == [i * p.CAPACITY for i in range(len(long))]
    assert p.pack_documents(none).count() == 0


def test_windows_keep_every_row(spark):
    from conftest import docs_of

    rows = [(i, "same text here", "hot" if i % 3 else f"s{i}") for i in range(500)]
    got = p.pack_documents(docs_of(spark, rows), capacity=16, window=64).collect()
    check(got, rows, 16)
    assert sorted(r.doc_id for r in got) == list(range(500))
    assert len({r.bin_id for r in got}) == 500  # copies never share a bin


def test_tasks_do_not_grow_with_rows_and_windows_follow_each_other(spark):
    from conftest import docs_of

    rows = [(i, "some words " * (i % 7), f"s{i % 11}") for i in range(900)]
    got = p.pack_documents(docs_of(spark, rows), capacity=64, window=32)
    assert got.rdd.getNumPartitions() <= 4
    rows_ = got.collect()
    check(rows_, rows, 64)
    assert sorted((r.doc_id, r.piece) for r in rows_) == sorted({(r.doc_id, r.piece) for r in rows_}) and {r.doc_id for r in rows_} == set(range(900))


def test_sources_of_any_type(spark):
    df = spark.createDataFrame([(1, "a b", 7), (2, "c", 7), (3, "d", None)], "doc_id int, text string, source int")
    got = p.pack_documents(df).collect()
    assert {(r.doc_id, r.source) for r in got} == {(1, 7), (2, 7), (3, None)} and len({r.bin_id for r in got}) == 2

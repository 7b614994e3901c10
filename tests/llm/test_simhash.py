import random
from itertools import combinations

import numpy as np
import xxhash
from conftest import ODD, docs_of
from vesperflow.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows):
    at = {}
    for i, t in rows:
        at.setdefault(plain_fingerprint(t), []).append(i)
    root = {f: f for f in at}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(at, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for f, ids in at.items():
        known = [i for i in ids if i is not None]
        least.setdefault(find(f), []).extend(known)
    return sorted(((i, f, min(least[find(f)], default=None)) for f, ids in at.items() for i in ids), key=str)


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        t = " \n".join(rng.choice(["The", "a", "É", "oak", "RAN"]) for _ in range(n))
        assert simhash.simhash(t) == plain_fingerprint(t)
    assert simhash.simhash(None) == simhash.simhash(" \t") == 0


def test_gray_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(a) | 1 << int(b)) for a, b in rng.integers(0, 64, (8, 2)))]))
    index = simhash.GrayIndex(codes)
    found = {(int(codes_q), int(index.codes[n])) for q, at in index.search(codes, 2) for codes_q, n in zip(codes[q], at, strict=True)}
    assert found == {(int(a), int(b)) for a in codes for b in codes if (int(a) ^ int(b)).bit_count() <= 2}


def test_gray_ranks_are_a_sequence_of_one_bit_steps():
    codes = np.arange(256, dtype=np.uint64)
    by = codes[np.argsort(simhash.gray_rank(codes))]
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(by, by[1:], strict=False))


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([5, 60, 300]))) for _ in range(25)]
    rows = []
    for t in texts:
        rows.append(t)
        for _ in range(rng.randrange(6)):
            w = t.split()
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
            rows.append(t)
    rows = list(enumerate([*rows, *texts[:9], None, "", " "]))
    rng.shuffle(rows)
    got = simhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == plain_components(rows)


def test_chains_and_stars_are_joined(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (105, 100), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


def test_odd_rows_and_empty_tables(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == plain_components([(i, t) for i, t, _ in ODD])
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted([1, 1, 2, 5, 6, 7, None, None], key=str)
    assert simhash.keep_one(none).count() == 0

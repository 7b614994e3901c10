import hashlib
import random
import re

import pytest
from conftest import ODD
from vesperflow.llm import decontaminate as d


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(t, items):
    w, hit, own = words_of(t), set(), set()
    for item, text in items:
        x = words_of(text)
        for i in range(max(1, len(x) - 9) if x and item is not None else 0):
            k = x[i : i + 10]
            for j in range(len(w) - len(k) + 1):
                if w[j : j + len(k)] == k:
                    hit.update(range(j, j + len(k)))
                    own.add(str(item))
    return len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)


def items_and_texts():
    rng = random.Random(2)
    vocabulary = ["the", "Oak", "é", "x9", "fox"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 9, 10, 12])))) for i in range(12)] + [(3, "zz yy"), (13, None), (14, " ,"), (None, "the")]
    items = [x for x in items if x[1] is None or len(words_of(x[1])) != 1 or x[0] is None]
    texts = [", ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30]))) for _ in range(30)] + [f"{t}--{t}" for _, t in items if t]
    return items, texts


def test_scan_matches_brute_force():
    items, texts = items_and_texts()
    a = d.Automaton([x for x in items if x[0] is not None])
    for t in [*texts, None, ""]:
        n, hit, own = a.scan(t)
        assert (n, int(hit.sum()), len(own)) == brute(t, items)[:3]


def test_spans_are_of_the_original():
    a = d.Automaton([(1, "one two three")])
    t = "É One,  TWO-three. one two"
    assert [t[x:y] for x, y in a.spans(t)] == ["One,  TWO-three"]


@pytest.mark.parametrize("limit", [d.MAX_ITEM_BYTES, 40])
def test_query_rows(spark, odd, none, limit):
    items, _ = items_and_texts()
    items += [(20, "quick brown FOX jumps"), (20, "quick brown FOX jumps"), (21, "word5 x5 word6 x6")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, TEXT2 string")
    got = d.contamination(odd, bench, limit=limit).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *brute(t, items))) for i, t, _ in ODD)
    assert d.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in d.contamination(odd, bench.limit(0)).collect())
    kept = d.drop_contaminated(odd, bench, limit=limit)
    assert kept.columns == odd.columns and kept.count() == sum(not brute(t, items)[4] for _, t, _ in ODD)


def test_pieces_find_every_window():
    rng = random.Random(5)
    for window in (1, 2, 3, 5, 10):
        for _ in range(60):
            vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 40]))]
            items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(4)]
            text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 50)) + items[0][1].split()[3:] + rng.choices(vocabulary, k=5))
            w, hit, own = text.split(), set(), set()
            for item, x in ((i, t.split()) for i, t in items):
                for k in [x[i : i + window] for i in range(max(1, len(x) - window + 1))]:
                    for j in range(len(w) - len(k) + 1):
                        if w[j : j + len(k)] == k:
                            hit.update(range(j, j + len(k)))
                            own.add(str(item))
            _, got, items_found = d.Automaton(items, window).scan(text)
            assert set(map(int, got.nonzero()[0])) == hit and items_found == own


def test_parts_are_built_once_a_chunk(monkeypatch):
    import pyarrow as pa

    built = []

    class Counted(d.Automaton):
        def __init__(self, *a):
            built.append(1)
            super().__init__(*a)

    class Part:
        def __init__(self, value):
            self.value = value

    monkeypatch.setattr(d, "Automaton", Counted)
    parts = [Part([(1, "a b c")]), Part([(2, "c d")]), Part([])]
    batches = [pa.RecordBatch.from_pydict({"t": ["x a b c d", None]}) for _ in range(6)] + [pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})]
    got = list(d.scanned(iter(batches), parts, 10, 0, chunk=3 * batches[0].nbytes))
    assert len(got) == 6 and len(built) == 6  # two chunks of three batches, three parts
    for _, ((n, hit, items), (none, _, nothing)) in got:
        assert n == 5 and hit.tolist() == [False, True, True, True, True] and items == {"1", "2"} and none == 0 and nothing == set()


def test_automaton_is_as_large_as_the_items():
    import resource

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(20000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    a = d.Automaton([(i, " ".join(rng.choices(words, k=100))) for i in range(1000)])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 120_000 and len(a.digests) == 91_000

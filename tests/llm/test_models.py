import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import ODD, docs_of
from vesperflow.llm import labelled, lm_score, quality, toxicity

RNG = random.Random(8)
WORDS = ["".join(RNG.choices("aeinrst", k=RNG.randrange(2, 8))) for _ in range(500)]


def corpus(n, toxic=0.0):
    docs, labels = [], []
    for i in range(n):
        w = RNG.choices(WORDS, k=RNG.randrange(8, 120))
        good, bad = int(RNG.random() > 0.3), int(RNG.random() < toxic)
        if not good:
            w = [x + RNG.choice(["***", "%%%"]) for x in w] if RNG.random() < 0.5 else [x for x in w[:9] for _ in range(9)]
        for _ in range(3 * bad):
            w.insert(RNG.randrange(len(w)), RNG.choice(["moron", "vilekor", "vilepan", "vilestu", "scum"]))
        docs.append((i, " ".join(w), "s"))
        labels.append((i, good, bad))
    return docs, labels


def accuracy(rows, truth, threshold):
    held = [r for r in rows if r.held_out]
    assert all(r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(900)
    rows = docs_of(spark, docs)
    model = quality.fit(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality.score(rows, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert accuracy(got, {i: q for i, q, _ in labels}, 0.5) > 0.97
    kept = {r[0] for r in quality.keep_good(rows, model).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(300, 0.3)
    rows = docs_of(spark, docs)
    for module, n, k in ((quality, 3, 1), (toxicity, 4, 2)):
        flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % n == k else (i, q, t) for i, q, t in labels]
        a, b = (sorted(map(tuple, module.score(rows, module.fit(rows, spark.createDataFrame(x, "doc_id long, quality int, toxic int"))).collect())) for x in (labels, flipped))
        assert a == b


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(900, 0.3)
    rows = docs_of(spark, docs)
    model = toxicity.fit(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {"moron", "vile*"} <= model.lexicon.strong
    assert accuracy(toxicity.score(rows, model).collect(), {i: t for i, _, t in labels}, 0.3) > 0.97


def test_copies_do_not_make_a_lexicon(spark):
    docs, labels = corpus(300, 0.2)
    own = [f"{c}qpassage" for c in "abcdefghij"]
    passage = " ".join(own)
    docs += [(1000 + i, passage, "s") for i in range(60)]
    labels += [(1000 + i, 1, 1) for i in range(60)]
    model = toxicity.fit(docs_of(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert not {e for e in model.lexicon.strong | model.lexicon.weak if any(w.startswith(e.rstrip("*")) for w in own)}


def test_classifiers_take_odd_rows(spark, odd, none):
    few = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 0, 0), (None, 1, 1), (5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for labels in (few, few.limit(0)):
            got = module.score(odd, module.fit(odd, labels)).collect()
            assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _, _ in ODD), key=str)
            assert all(r.held_out is None for r in got if r.doc_id is None)
        assert module.score(none, module.fit(none, few)).count() == 0


def test_dual_descent_separates_and_calibrates():
    docs = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 10
    y = np.array([1, 1, 0, 0] * 10)
    r = quality.log_count_ratio(docs, y, 4)
    assert r[0] > 0 > r[1] and abs(r[2]) < 1e-9
    w, b = quality.dual_descent(docs, y, r)
    assert all(((w[d] * r[d]).sum() + b > 0) == v for d, v in zip(docs, y, strict=True))
    xs, ps = labelled.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all() and 0 < ps[0] < ps[-1] < 1


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = toxicity.boost(x, y).margins(x)
    assert ((m > 0) == (y > 0)).mean() > 0.95


def plain_bits(texts, target, words):
    ids = {w: i for i, w in enumerate(words)}
    v = lm_score.VOCABULARY
    tok = [[ids.get(lm_score.core(w), v - 1 - lm_score._SHAPES + lm_score.shape(w)) for w in (t or "").split()] for t in texts]
    out = []
    for aim in (True, False):
        pair, one = Counter(), Counter()
        for x, y in zip(tok, target, strict=True):
            if y or not aim:
                for a, b in zip([v - 1, *x], x, strict=False):
                    pair[a, b] += 1
                    one[b] += 1
        n, kinds = Counter(), Counter()
        for (a, _), c in pair.items():
            n[a] += c
            kinds[a] += 1
        total = sum(one.values()) + v

        def p(a, b, pair=pair, one=one, n=n, kinds=kinds, total=total):
            u = (one[b] + 1) / total
            return (pair[a, b] + kinds[a] * u) / (n[a] + kinds[a]) if n[a] else u

        out.append([sum(-math.log2(p(a, b)) for a, b in zip([v - 1, *x], x, strict=False)) / max(1, len(x)) for x in tok])
    return out


def test_lm_scores_match_brute_force(spark):
    docs, labels = corpus(120)
    docs += [(200, None, "s"), (201, "", "s"), (3, "a repeated id", "s"), (202, "ODD1 (x) !!! 99", "s")]
    rows = docs_of(spark, docs)
    good = {i for i, q, _ in labels if q}
    models = lm_score.fit(rows, spark.createDataFrame([(i,) for i in good] + [(None,), (min(good),)], "doc_id long"))
    got = sorted(lm_score.score(rows, models).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    docs = sorted(docs, key=lambda d: (d[0], len((d[1] or "").split())))
    t, b = plain_bits([d[1] for d in docs], [d[0] in good for d in docs], models.words)
    assert np.allclose([r.target_bits for r in got], t, atol=1e-4) and np.allclose([r.background_bits for r in got], b, atol=1e-4)
    counts = Counter(lm_score.core(w) for d in docs for w in (d[1] or "").split())
    assert models.words == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][: lm_score.VOCABULARY - 1 - lm_score._SHAPES]


def test_lm_takes_odd_rows(spark, odd, none):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    got = lm_score.score(odd, lm_score.fit(odd, ids)).collect()
    assert len(got) == len(ODD) and all(r.score == 0 for r in got if not r.n_tokens)
    assert lm_score.score(none, lm_score.fit(none, ids)).count() == 0
    assert lm_score.score(odd, lm_score.fit(none, ids.limit(0))).count() == len(ODD)


def test_indicator_features_are_sorted_and_distinct():
    row, x = quality.indicators(pa.array(["a a a B!! b", None, "", "x"]))
    assert set(row.tolist()) == {0, 3}
    assert len(set(zip(row.tolist(), x.tolist(), strict=True))) == len(row)


def whole_bits(texts, target):
    tok = [[lm_score.core(w) for w in (t or "").split()] for t in texts]
    v, out = len({w for x in tok for w in x}), []
    for aim in (True, False):
        pair = Counter(p for x, y in zip(tok, target, strict=True) if y or not aim for p in zip([None, *x], x, strict=False))
        one, n, kinds = Counter(), Counter(), Counter()
        for (a, b), c in pair.items():
            one[b] += c
            n[a] += c
            kinds[a] += 1
        total = sum(one.values()) + v

        def p(a, b, pair=pair, one=one, n=n, kinds=kinds, total=total):
            u = (one[b] + 1) / total
            return (pair[a, b] + kinds[a] * u) / (n[a] + kinds[a]) if n[a] else u

        out.append([sum(-math.log2(p(a, b)) for a, b in zip([None, *x], x, strict=False)) / max(1, len(x)) for x in tok])
    return out


def test_lm_query_has_every_word(spark, tmp_path, monkeypatch):
    from vesperflow.llm.queries import op8_lm_score

    rng = random.Random(11)
    docs = [(i, " ".join(f"{rng.choice('abc')}{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.randrange(60)))) for i in range(800)]
    docs += [(400, None), (401, ""), (3, "a repeated id"), (402, "ODD1 (x) !!! 99"), (None, "no id a1 a1"), (None, None)]
    assert len({w for _, t in docs for w in (t or "").split()}) > 2 * lm_score.VOCABULARY
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    good = {i for i, _ in docs if i and i % 3 == 0}
    spark.createDataFrame([(i, 1) for i in good] + [(None, 1), (3, 1), (1, 0), (9999, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    t, b = whole_bits([d[1] for d in docs], [d[0] in good for d in docs])
    want = sorted((str(i), len((x or "").split()), p, q) for (i, x), p, q in zip(docs, t, b, strict=True))
    for size in (lm_score.BLOCK_BYTES, 1500):  # one block, then several
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", size)
        got = sorted((str(r.doc_id), r.n_tokens, r.target_bits, r.background_bits) for r in op8_lm_score(spark, str(tmp_path)).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-9)


def test_lm_deals_out_repeated_ids(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choices(["a", "b", "c", "dd", "e"], k=rng.randrange(0, 40)))
    docs = [(7, text()) for _ in range(300)] + [(7, "same text here")] * 100 + [(8, text()) for _ in range(120)] + [(None, "")] * 200 + [(i, text()) for i in range(100, 300)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/d")
    rows = spark.read.parquet(f"{tmp_path}/d")
    good = {7, 101, 102, 9999}
    ids = spark.createDataFrame([(i,) for i in good] + [(7,), (None,)], "doc_id long")
    t, b = whole_bits([d[1] for d in docs], [d[0] in good for d in docs])
    want = sorted((str(i), len(x.split()), p, q) for (i, x), p, q in zip(docs, t, b, strict=True))
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 1500)
    for most in (1000, 50):
        monkeypatch.setattr(lm_score, "ID_ROWS", most)
        got = sorted((str(r.doc_id), r.n_tokens, r.target_bits, r.background_bits) for r in lm_score.score_whole(rows, ids).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-9)

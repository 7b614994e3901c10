"""The two classifiers against plain versions of their features, fits and solvers."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from conftest import docs_of
from vesperflow.llm import labelled, quality, toxicity

RNG = random.Random(21)
PARTS = ["you", "You,", "scum", "SCUM!!", "sc*m", "m0r0n", "vilekor", "vilepan!", "the", "a", "soooo", "x1", "1999", "...", "é", "DU", "Hello,", "--", "«oui»", "ok", "ok", "ok"]
LEXICON = toxicity.Lexicon(frozenset({"scum", "vile*"}), frozenset({"moron", "ok"}))


def texts(n, longest=40):
    return [RNG.choice([" ", "\n", "\t "]).join(RNG.choices(PARTS, k=RNG.randrange(0, longest))) for _ in range(n)] + [None, "", " \n "]


def words(t):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]


def level(word):
    p = toxicity.plain(word)
    own = {p} | {f"{p[:n]}*" for n in (4, 5, 6) if len(p) > n}
    return 2 if own & LEXICON.strong else 1 if own & LEXICON.weak else 0


def plain_features(t):
    w = words(t)
    if not w:
        return [0.0] * len(toxicity.FEATURES)
    lv, n = [level(x) for x in w], len(w)
    you = [x.strip("\"'.,;:!?()").lower() in toxicity.SECOND_PERSON for x in w]
    inner = [x.strip("\"'.,;:!?()[]{}<>|*&%#-_/\\") for x in w]
    near = sum(lv[i] > 0 and any(you[max(0, i - toxicity.REACH) : i + toxicity.REACH + 1]) for i in range(n))
    chars = sum(map(len, w))
    mixed = sum(bool(x) and not x.isalnum() or any(c.isdigit() for c in x) and any(c.isalpha() for c in x) for x in inner)
    drawn = sum(any(x[i] == x[i + 1] == x[i + 2] for i in range(len(x) - 2)) for x in inner)
    return [
        lv.count(2) / n, lv.count(1) / n, lv.count(2), near / n, sum(c.isupper() for x in w for c in x) / chars, sum(len(x) > 1 and x.isupper() for x in inner) / n,
        sum(not c.isalnum() for x in w for c in x) / chars, sum(x.count("!") for x in w) / n, mixed / n, drawn / n, math.log1p(n), chars / n,
    ]


def test_toxicity_features():
    t = texts(300)
    assert np.allclose(toxicity.features(pa.array(t, pa.string()), LEXICON), [plain_features(x) for x in t])


def grow(bins, g, h, rows, depth, k, l2=1.0, least=5, rate=0.15):
    """(row: value) of a tree by trying every split of every node."""
    best, split = 1e-4, None
    if depth:
        for f in range(k):
            for c in range(max(int(bins[rows, f].max()), 0) + 1):
                left, right = [r for r in rows if bins[r, f] <= c], [r for r in rows if bins[r, f] > c]
                if len(left) >= least and len(right) >= least:
                    gain = sum(g[x].sum() ** 2 / (h[x].sum() + l2) for x in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                    if gain > best + 1e-12:
                        best, split = gain, (left, right)
    if split is None:
        return {r: rate * g[rows].sum() / (h[rows].sum() + l2) for r in rows}
    return grow(bins, g, h, split[0], depth - 1, k) | grow(bins, g, h, split[1], depth - 1, k)


def test_boosting_rounds():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((150, 4)), 2)
    x[:, 3] *= rng.random(150) < 0.3
    y = ((x[:, 0] > 0.4) & (x[:, 3] > 0.1) | (x[:, 1] > 0.9)).astype(float)
    model = toxicity.boost(x, y, rounds=3)
    bins, m = model.bins(x), np.full(len(y), model.base)
    assert math.isclose(model.base, math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(3):
        p = 1 / (1 + np.exp(-m))
        got = grow(bins, y - p, p * (1 - p), list(range(len(y))), 3, 4)
        m = m + np.array([got[i] for i in range(len(y))])
    assert np.allclose(model.margins(x), m)


def test_isotonic_is_the_pooled_step_function():
    scores, y = np.array([3.0, 1, 2, 5, 4, 6, 6]), np.array([0.0, 0, 1, 1, 0, 1, 1])
    xs, ps = labelled.isotonic(scores, y)  # by score: 0 | 1 0 0 pooled | 1 | 1 1 pooled with it
    assert np.allclose(np.interp([1, 2, 3, 4, 5, 6], xs, ps), [0.25, 1.5 / 4, 1.5 / 4, 1.5 / 4, 3.5 / 4, 3.5 / 4])


def test_lexicon_matches_plain_counts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        y = int(i % 4 == 0)
        w = rng.choices([f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)], k=30)
        if y:
            for _ in range(3):
                w.insert(rng.randrange(30), rng.choice(["scum", "vilekor", "vilepan", "vilestu", "m0ron"]))
        rows.append((i, y, " ".join(w)))
    rows += [(1000 + i, 1, "same passage wherever it stands") for i in range(40)]
    na, nb = sum(y for _, y, _ in rows), sum(1 - y for _, y, _ in rows)
    a, around, b = {}, {}, {}
    for i, y, t in rows:
        w = words(t)
        for k, x in enumerate(w):
            for e in toxicity.entries(toxicity.plain(x)):
                if y:
                    a.setdefault(e, set()).add(i)
                    around.setdefault(e, set()).add((w[k - 1] if k else None, x, w[k + 1] if k + 1 < len(w) else None))
                else:
                    b.setdefault(e, set()).add(i)
    strong, weak = set(), set()
    for e in a:
        n, m = min(len(a[e]), len(around[e])), len(b.get(e, ()))
        odds = math.log((n + 0.5) / (na + 1)) - math.log((m + 0.5) / (nb + 1))
        z = odds / math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
        if n >= 3 and odds > 1.5 and z > 2.2:
            if z > 3 and n >= max(5, 0.01 * na) and m <= 0.02 * n:
                strong.add(e)
            elif n >= max(4, 0.004 * na):
                weak.add(e)
    for parts in (1, 7):  # whatever the batches
        got = toxicity.learn_lexicon(spark.createDataFrame(rows, "id long, y int, text string").repartition(parts))
        assert (got.strong, got.weak) == (strong, weak)
    assert "scum" in strong and not {e for e in strong | weak if "passage".startswith(e.rstrip("*"))}


def mixed(x):
    return (x * int(quality._MIX) & (1 << 64) - 1) >> (64 - quality.BITS)


def plain_indicators(t):
    out, hashes = set(), []
    for x in words(t):
        lead, core, trail = re.fullmatch(r"(\W*)(.*?)(\W*)", x, re.DOTALL).groups()
        hashes.append(xxhash.xxh64_intdigest("w:" + (core.lower() or lead)))
        out |= {mixed(xxhash.xxh64_intdigest("p:" + p)) for p in (lead, trail) if p and core}
        if len(core) > 1 and core.isupper():
            out.add(mixed(xxhash.xxh64_intdigest("upper")))
        if any(c.isdigit() for c in core):
            out.add(mixed(xxhash.xxh64_intdigest("digit")))
    out |= {mixed(h) for h in hashes}
    for i, (p, q) in enumerate(zip(hashes, hashes[1:], strict=False)):
        out.add(mixed(xxhash.xxh64_intdigest("repeat") if p == q else (p * int(quality._MIX) & (1 << 64) - 1) ^ (q >> 1)))
        if i and hashes[i - 1] == p == q:
            out.add(mixed(xxhash.xxh64_intdigest("thrice")))
    return out


def test_quality_indicators():
    t = texts(300, 12) + ["a a a a", "A.B a.b", "x"]
    row, x = quality.indicators(pa.array(t, pa.string()))
    for i, own in enumerate(t):
        assert set(x[row == i].tolist()) == plain_indicators(own), own


def test_quality_ratios_and_solver():
    rng = random.Random(2)
    docs = [np.array(sorted(rng.sample(range(12), rng.randrange(1, 6)))) for _ in range(60)]
    y = np.array([int(0 in d or (3 in d and 5 not in d)) for d in docs])
    r = quality.log_count_ratio(docs, y, 12)
    p = [1 + sum(v and f in d for d, v in zip(docs, y, strict=True)) for f in range(12)]
    q = [1 + sum(not v and f in d for d, v in zip(docs, y, strict=True)) for f in range(12)]
    assert np.allclose(r, [math.log(a / sum(p)) - math.log(b / sum(q)) for a, b in zip(p, q, strict=True)])
    # the solver's optimum: primal and dual objectives meet
    w, b = quality.dual_descent(docs, y, r, rounds=3000)
    x = np.zeros((60, 13))
    for i, d in enumerate(docs):
        x[i, d] = r[d] / max(1e-9, np.sqrt((r[d] ** 2).sum()))
    x[:, 12] = 1
    s = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    a = np.zeros(60)
    for _ in range(4000):  # plain coordinate ascent in order
        for i in range(60):
            a[i] = min(max(a[i] - (s[i] * (x[i] @ (x.T @ (a * s))) - 1) / (x[i] @ x[i]), 0), cost[i])
    want = x.T @ (a * s)
    assert np.allclose(np.append(w, b), want, atol=5e-3)


def test_samples_are_bounded_by_rows_and_bytes(spark):
    docs = docs_of(spark, [(i, "x" * 100, "s") for i in range(200)] + [(5, "repeated", "s")] * 300)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    sample = labelled.sample_labels(labels, "quality", 3, 1, 50)
    every = labelled.join_sample(docs, sample, 1 << 20).collect()
    assert len(every) == 50 == len({r.id for r in every})
    some = labelled.join_sample(docs, sample, 1050).collect()
    assert 0 < sum(len(r.text) for r in some) <= 1050 and {r.id for r in some} < {r.id for r in every}
    assert labelled.join_sample(docs.limit(0), sample, 1050).count() == 0

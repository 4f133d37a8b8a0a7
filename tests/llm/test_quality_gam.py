"""The additive model against plain Python: features, tables from trees, scores, and which rows it learns from."""

import math
import random

import numpy as np

from tillroll.llm import quality_gam


def features_by_hand(text):
    text = text or ""
    raw, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x]
    n = lambda test: sum(map(test, raw))
    w, chars = max(1, len(words)), max(1, len(raw))
    letters = max(1, n(lambda b: chr(b).isascii() and chr(b).isalpha()))
    return [
        math.log(1 + len(words)), n(lambda b: b in b"#*$%&|<>") / w, raw.count(b"!") / w, n(lambda b: 65 <= b <= 90) / letters, n(lambda b: 48 <= b <= 57) / chars, len(set(words)) / w,
        sum(len(x) for x in words) / w, raw.count(b"\n") / w, n(lambda b: b in b".,;:") / w, raw.count(b"|") / w, n(lambda b: b > 127) / chars, 1 - len(set(lines)) / max(1, len(lines)),
    ]


def score_by_hand(model, x):
    """Sum the looked-up values of one row, bin by bin."""
    spot = lambda k: sum(1 for c in model.cuts[k] if c <= x[k])
    total = model.base + sum(model.single[k][spot(k)] for k in range(len(model.single))) + sum(t[spot(i)][spot(j)] for (i, j), t in model.pairs.items())
    return 1 / (1 + math.exp(-total))


def tree_by_hand(g, h, smooth):
    """The best of all trees of two levels, by trying every cut."""

    def gain(a, b):
        return sum(g[a:b]) ** 2 / (sum(h[a:b]) + smooth)

    def best(a, b):
        found = [(gain(a, c) + gain(c, b) - gain(a, b), -c) for c in range(a + 1, b)]
        return max(found, default=(0, -a))

    _, cut = best(0, len(g))
    out = [0.0] * len(g)
    for a, b in ((0, -cut), (-cut, len(g))):
        won, inner = best(a, b)
        for lo, hi in ((a, -inner), (-inner, b)) if won > 0 else ((a, b),):
            for k in range(lo, hi):
                out[k] = sum(g[lo:hi]) / (sum(h[lo:hi]) + smooth)
    return out


def texts():
    rng = random.Random(3)
    return [None, "", " \n", "é!", "a b\na b\n", *(" ".join(rng.choice(["The", "cat", "| x", "SAT!!", "7%", "naïve.", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(60))]


def test_features_equal_plain_python():
    for t in texts():
        assert np.allclose(quality_gam.features(t), features_by_hand(t)), t


def test_trees_equal_trying_every_cut():
    rng = np.random.default_rng(5)
    for n in (2, 3, 7, 12):
        for _ in range(30):
            g, h = rng.normal(size=n), rng.random(n) + 0.1
            assert np.allclose(quality_gam._tree(g, h, 2.0), tree_by_hand(list(g), list(h), 2.0))


def test_boosting_equals_plain_python_on_few_bins():
    rng = np.random.default_rng(6)
    x, y = rng.random((300, 2)), None
    y = (x[:, 0] + rng.random(300) * 0.5 > 0.7).astype(int)
    model = quality_gam.fit(x, y, n_bins=4, rounds=3, pair_rounds=0, n_pairs=0)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    tables, total = [[0.0] * 4, [0.0] * 4], [model.base] * 300
    assert math.isclose(model.base, math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(3):
        for k in range(2):
            spots = [sum(1 for c in model.cuts[k] if c <= v) for v in x[:, k]]
            g, h = [0.0] * 4, [0.0] * 4
            for s, t, label in zip(spots, total, y, strict=True):
                p = 1 / (1 + math.exp(-t))
                g[s] += label - p
                h[s] += p * (1 - p)
            add = [0.1 * v for v in tree_by_hand(g, h, 2.0)]
            tables[k] = [a + b for a, b in zip(tables[k], add, strict=True)]
            total = [t + add[s] for t, s in zip(total, spots, strict=True)]
    assert np.allclose(model.single, tables)


def test_scores_of_a_table_equal_sums_row_by_row(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_gam.learn(docs, labels)
    got = {r.doc_id: r for r in quality_gam.score_quality(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) == 1000
    for r in rows:
        want = score_by_hand(model, features_by_hand(r.text))
        assert math.isclose(got[r.doc_id].score, want, rel_tol=1e-9) and got[r.doc_id].predicted == (want >= 0.3)
    assert {r.doc_id for r in quality_gam.keep_good(docs, labels).collect()} == {i for i, r in got.items() if r.predicted}


def test_learning_is_bounded_and_independent_of_order(spark):
    rows = [(i % 40, t, "x", i) for i, t in enumerate(texts() * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, x int")
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(500)] * 2 + [(None, 1, "y"), (3, None, "y")], "doc_id long, quality int, _y string")
    seen = []
    fit, quality_gam.fit = quality_gam.fit, lambda x, y, **how: seen.append((sorted(map(tuple, x)), sorted(y))) or fit(x, y, **how)
    try:
        for d in (docs, docs.repartition(5), docs.orderBy("x", ascending=False)):
            quality_gam.learn(d, labels, max_rows=20)
    finally:
        quality_gam.fit = fit
    assert seen[0] == seen[1] == seen[2] and len(seen[0][1]) == 20
    assert quality_gam.keep_good(docs, labels).columns == docs.columns

"""The pipeline's near copies against brute-force Jaccard similarity."""

import random
from itertools import combinations

import corpus_pipeline
from tillroll.llm import near_text


def kept_by_hand(rows):
    """Ids that stay, and the number of similar pairs of different texts."""
    def grams(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    root, ids = {i: i for i, _ in rows}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def link(i, j):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)

    for i, t in rows:
        key = tuple((t or "").encode().lower().split())
        link(i, ids.setdefault(key, i))
    sets, pairs = [(i, grams(" ".join(w.decode() for w in key))) for key, i in ids.items()], 0
    for (i, a), (j, b) in combinations(sets, 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            pairs += 1
            link(i, j)
    return {i for i in root if find(i) == i}, pairs


def test_stage_equals_brute_force_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, pairs = kept_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert pairs == 5 and got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_a_group_of_copies_with_edits_of_their_own(spark):
    rng = random.Random(11)
    base, texts = [f"w{rng.randrange(400)}" for _ in range(150)], [None, "", " \n", "One two", "one TWO", "one three"]
    for k in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000) if k % 3 else rng.randrange(2)}"
        texts.append(" ".join(w))
    chain = [f"c{k}" for k in range(120)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 20, 5)]
    rows = list(enumerate(texts))
    want, pairs = kept_by_hand(rows)
    got = near_text.one_of_each(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int"))
    assert pairs > 1000 and {r.doc_id for r in got.collect()} == want
    assert near_text.one_of_each(got.limit(0)).count() == 0

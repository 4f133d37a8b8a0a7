"""The pipeline's stages, one by one and together, against brute force on a small table with nulls, repeats and copies."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_text import kept_by_hand
from tests.llm.test_quality_gam import features_by_hand, score_by_hand
from tests.llm.test_scans import overlaps_by_hand
from tests.llm.test_secrets_and_licenses import spans_by_hand
from tillroll.llm import quality_gam, secret_scan

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_by_hand():
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    prose = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(n // 9)) + "."
    passage = " ".join(f"bench{i}" for i in range(30))
    texts = [prose(120) for _ in range(40)]
    texts += [" ".join(w + rng.choice(("$$$", "###", "%%%")) for w in prose(90).split()) for _ in range(30)]
    for k in range(20):  # near copies, exact copies, copies of copies
        w = texts[k % 8].split()
        w[rng.randrange(len(w))] = f"new{k % 5}"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), prose(100) + " " + passage, passage[:90] + " " + prose(60), None, "", " \n", "é token = \"0123456789abcdef0123456789abcdef\" " + prose(120)]
    texts += [prose(80) + f" password: {rng.choice('xyz')}abcdefghijk9{k} " + prose(30) for k in range(8)]
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(70), None, None, 3), (None, prose(70), None, None, None)]
    return rows, passage


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, passage = rows_by_hand()
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40 or i >= 70), 0) for i in range(90)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "two words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, passage, folder


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def same(df, rows):
    assert df.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)


def test_quality(spark, made):
    rows, _, folder = made
    model = quality_gam.learn(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet"))
    want = [r for r in rows if score_by_hand(model, features_by_hand(r[1])) >= 0.3]
    same(STAGES["quality"](spark, frame(spark, rows), folder), want)
    assert 60 < len(want) < len(rows) - 20


def test_near_duplicates(spark, made):
    rows, _, folder = made
    known = [r for r in rows if r[0] is not None]
    firsts, pairs = kept_by_hand([(r[0], r[1]) for r in dict.fromkeys(known)])
    got = STAGES["near_duplicates"](spark, frame(spark, known), folder)
    same(got, [r for r in dict.fromkeys(known) if r[0] in firsts])
    assert pairs > 10
    # Rows without an id stay only where nothing with one is like them.
    nulls = [r for r in rows if r[0] is None] + [(None, rows[0][1], "x", "y", 1)]
    got = STAGES["near_duplicates"](spark, frame(spark, [rows[0], *nulls]), folder)
    same(got, [rows[0], *nulls[:2]])


def test_decontamination(spark, made):
    rows, passage, folder = made
    items = [(1, passage), (2, None), (3, ""), (4, "two words")]
    want = [r for r in rows if not overlaps_by_hand(r[1], items)[3]]
    same(STAGES["decontaminate"](spark, frame(spark, rows), folder), want)
    assert len(rows) - len(want) == 2


def redacted(text, owners):
    spans = [(a, b) for a, rank, b, v in spans_by_hand(text) if secret_scan.KINDS[rank][4] or len(owners[v]) <= 2]
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return text and out + text[at:]


def test_secrets(spark, made):
    rows, _, folder = made
    owners = {}
    for r in rows:
        for *_, v in spans_by_hand(r[1]):
            owners.setdefault(v, set()).add(r[3] or "")
    want = [(r[0], t := redacted(r[1], owners), r[2], r[3], None if t is None else len(t)) for r in rows]
    same(STAGES["secrets"](spark, frame(spark, rows), folder), want)
    assert sum("[SECRET]" in (r[1] or "") for r in want) == 9


def encoded(rows):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    library.no_padding()
    library.no_truncation()
    for i, text, lang, source, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        yield (i, lang, source, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids)


def test_encoding(spark, made):
    rows, _, folder = made
    got = STAGES["encode"](spark, frame(spark, rows), folder)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(encoded(rows), key=repr)


def test_all_stages_together(spark, made):
    rows, passage, folder = made
    model = quality_gam.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in rows if score_by_hand(model, features_by_hand(r[1])) >= 0.3]
    ids = {k: r for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))}
    firsts, _ = kept_by_hand([(k, r[1]) for k, r in ids.items()])
    rows = [ids[k] for k in firsts if not overlaps_by_hand(ids[k][1], [(1, passage), (4, "two words")])[3]]
    owners = {}
    for r in rows:
        for *_, v in spans_by_hand(r[1]):
            owners.setdefault(v, set()).add(r[3] or "")
    want = list(encoded((r[0], redacted(r[1], owners), r[2], r[3], 0) for r in rows))
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark, made, tmp_path):
    _, _, folder = made
    none = frame(spark, []).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_driver_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    firsts, _ = kept_by_hand([(r[0], r[1]) for r in rows])
    same(STAGES["near_duplicates"](spark, frame(spark, rows), sf), [r for r in rows if r[0] in firsts])
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "encode"]

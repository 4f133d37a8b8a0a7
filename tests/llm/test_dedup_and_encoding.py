"""SimHash, suffix arrays, archives, classifier, BPE and the pipeline, against brute force, round trips and held-out rows."""

import gzip
import hashlib
import io
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tillroll.llm import bpe, components, quality_gam, simhash, suffix_dedup, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = ("plain words here " * 40_000).strip()


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5) for i, t in enumerate(texts)], "doc_id long, text string, fp string, root string, rid int, x int")


# ---- SimHash ----


def fingerprint_by_hand(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "one two", "One two THREE four É é", LONG):
        assert simhash.fingerprint(text) == fingerprint_by_hand(text)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 40)) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " ", "short", "SHORT", *base, *base[:3]]
    for b in base:
        for k in range(12):
            w = b.split()
            w[rng.randrange(len(w))] = "changed" + str(k % 4)
            texts.append(" ".join(w))
    want = components_by_hand([fingerprint_by_hand(t) for t in texts])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = simhash.one_of_each(docs(spark, texts).union(docs(spark, texts)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert kept.columns == docs(spark, []).columns and simhash.one_of_each(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_of_random_fingerprints(spark, radius):
    rng = random.Random(radius)
    centre = [rng.getrandbits(64) for _ in range(4)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centre for _ in range(25)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius)
    found = {r.node: r.root for r in components.components(edges).collect()}
    want = components_by_hand(prints, radius)
    assert [found.get(s, s) for s in signed] == [min(signed[j] for j in range(len(prints)) if want[j] == w) for w in want]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, k) for k in range(201, 260)] + [(7, 7), (205, 200), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 200 for k in range(201, 260)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- suffix arrays ----


def test_two_stage_order_and_prefixes():
    rng = np.random.default_rng(3)
    for k in range(200):
        n, symbols, depth = int(rng.integers(0, 200)), int(rng.choice([1, 2, 3, 256])), int(rng.choice([8, 20, 400]))
        text = rng.integers(0, symbols, n).astype(np.uint8) if k % 3 else np.frombuffer((b"ab" * 100)[:n], np.uint8)
        order, raw = suffix_dedup.two_stage_order(text, depth), text.tobytes()
        keys = [raw[i : i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
        common = suffix_dedup.common_prefix(text, order, depth)
        for r in range(1, n):
            assert common[r] == next((c for c, (a, b) in enumerate(zip(keys[r - 1], keys[r], strict=False)) if a != b), min(len(keys[r - 1]), len(keys[r])))


def removed_by_hand(texts, length):
    raws, seen = [(t or "").encode() for t in texts], {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in raws:
        cover = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append((len(raw), sum(cover), sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover)), bytes(b for b, c in zip(raw, cover, strict=True) if not c)))
    return out


@pytest.mark.parametrize("group_bytes", [suffix_dedup.GROUP_BYTES, 600])
def test_repeats_equal_brute_force(spark, group_bytes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (suffix_dedup.LENGTH, group_bytes))
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdé\x00 ") for _ in range(n))
    line, once = noise(220), noise(400)
    texts = [None, "", "short", "a" * 199, "b" * 201, "xy" * 400, once, once, noise(50) + once[:260] + noise(40), "c" * 200 + noise(30) + "c" * 200]
    texts += [noise(rng.randint(0, 150)) + line + noise(rng.randint(0, 150)) for _ in range(30)] + [noise(300) + once[100:] + line[:205]]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    for i, want in enumerate(removed_by_hand(texts, 200)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want, i


def test_repeats_of_empty_tables_and_long_texts(spark):
    assert suffix_dedup.remove_repeats(docs(spark, ["a"]).limit(0)).count() == 0
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(600_000))
    got = suffix_dedup.remove_repeats(docs(spark, [text + "|" + text[1000:5000], LONG])).orderBy("doc_id").collect()
    assert (got[0].n_removed, got[0].n_spans) == (8000, 2) and got[1].n_removed == len(LONG)


# ---- archives ----


def test_both_arc_versions_and_bad_archives():
    rows = [(1, "http://a/b c", b"x" * 120), (2, None, b""), (None, "dns:h", b"\r\n\r\nWARC/1.1")]
    for version in "12":
        got = list(warc.read_arc(io.BytesIO(warc.write_arc(rows, version))))
        assert [r.kind for r in got] == ["warcinfo", "response", "response", "response"] and [r.payload for r in got[1:]] == [r[2] for r in rows]
        assert got[1].uri == "http://a/b%20c" and got[1].date == "2024-01-01T00:00:00Z"
    foreign = b"filedesc://f.arc 0.0.0.0 19960101000000 text/plain 76\n1 0 Some Archive\nURL IP-address Archive-date Content-type Archive-length\n\n" b"\ndns:host 1.2.3.4 19960101 text/dns 5\nhello\n"
    got = list(warc.read_arc(io.BytesIO(foreign)))
    assert (got[1].kind, got[1].payload, got[1].date) == ("resource", b"hello", "1996-01-01T00:00:00Z")
    for bad in (b"no header\n", warc.write_arc(rows)[:-40]):
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(bad)))


def test_members_join_to_one_gzip_stream():
    parts = [b"one", b"", bytes(17 << 20)]
    assert gzip.decompress(b"".join(warc.member(p) + b"\0" for p in parts)) == b"".join(parts)


def test_pages_to_warc_and_back(spark):
    same, rows = "A" * 100, [(5, "http://a/x y"), (3, "http://b"), (9, None), (3, "http://b"), (None, "http://z")]
    rows = [(i, u, same, "clash", 1) for i, u in rows] + [(1, "http://c", "A" * 99, "", 1), (2, "http://c", "A" * 99, "", 1), (7, "dns:x", None, "", 1), (4, "http://e", "\r\n\r\nWARC/1.1\r\n\x00é" * 20, "", 1), (8, "http://l", "é\x00x" * 2_000_000, "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, source string, rid int").repartition(3)
    got = sorted((r.source, r.payload_bytes, r.record_type, r.refers_to, r.verified, r.payload_digest) for r in warc.archive_pages(df).where("source is not null").collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [g[:5] for g in got] == [(1, 99, "response", None, True), (2, 99, "response", None, True), (3, 100, "response", None, True), (3, 100, "revisit", 3, True), (4, 340, "response", None, True), (5, 100, "revisit", 3, True), (7, 0, "response", None, True), (8, 8_000_000, "response", None, True), (9, 100, "revisit", 3, True)]
    assert got[4][5] == digest("\r\n\r\nWARC/1.1\r\n\x00é" * 20) and got[6][5] == digest("")
    assert warc.archive_pages(df.limit(0)).count() == 0


# ---- classifier ----


def test_model_learns_single_features_and_a_pair():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.7) | ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5))).astype(int)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95 and (1, 2) in model.pairs
    again = quality_gam.fit(x[:3000][::-1], y[:3000][::-1])
    assert np.array_equal(model.score(x), again.score(x))


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_gam.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93 and got[got.quality == 1].predicted.mean() > 0.97


def test_scores_of_odd_rows(spark):
    df = docs(spark, [None, "", "one", "é" * 1000, LONG])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality_gam.score_quality(df, none).collect()
    assert [r.score for r in got] == [0.5] * 5 and [r.predicted for r in got] == [1] * 5
    some = spark.createDataFrame([(i, i % 2) for i in range(5)] * 2, "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_gam.score_quality(df.union(df), some).collect())
    assert quality_gam.score_quality(df.limit(0), some).count() == 0 and quality_gam.keep_good(df, none).count() == 5


# ---- BPE ----


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_padding()
    t.no_truncation()
    return t


def texts_for_bpe():
    rng = random.Random(8)
    out = [None, "", " ", "<|startoftext|>Hi<|endoftext|> <|endof", "They've I'LL 'S", "a\x1cb\x85c d", "ΟΔΟΣ İı ſK", "é 가", "x" * 3000, "ab" * 700 + " " + "qz7" * 500, "日本語テキスト👍🏽", LONG[:200_000]]
    for n in (1, 3, 8, 30, 300):
        for _ in range(30):
            out.append("".join(rng.choice("abcdefghij '.,19ABé") for _ in range(n)))
            out.append("".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x370, 0x6FF), rng.randint(0x4E00, 0x9000), rng.randint(0x1F300, 0x1F700)])) for _ in range(n)))
    return out


def test_ids_and_decoding_equal_the_library(library):
    codec = bpe.load(TOKENIZER)
    decoder = codec.decoder()
    for text in texts_for_bpe():
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.asarray(ids, "<u4").tobytes()
        assert b"".join(codec.encode(text)) == packed, text
        decoded = library.decode(ids, skip_special_tokens=False)
        assert bpe.digests(codec, decoder, text) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_the_transducer_keeps_a_bounded_tree():
    core = bpe.load(TOKENIZER).core
    symbols = [bpe.load(TOKENIZER).inner[b] for b in random.Random(2).choices(b"etaoinshrdlu", k=20_000)]
    read, late = 0, 0

    def feed():
        nonlocal read
        for read, s in enumerate(symbols, 1):  # noqa: B007
            yield s

    done = 0
    for token in core.encode(feed()):
        done += len(core.symbols.get(token, (token,)))
        late = max(late, read - done) if read < len(symbols) else late
    assert done == len(symbols) and late <= 8 * core.lookahead


def test_bytes_come_back_in_pieces():
    codec = bpe.load(TOKENIZER)
    text, whole = "naïve 日本 👍🏽 end", codec.decoder(surface=False)
    packed = b"".join(codec.encode(text))
    parts = codec.decoder(surface=False)
    pieces = [parts.feed(packed[i : i + 4]) for i in range(0, len(packed), 4)] + [parts.feed(b"", True)]
    assert "".join(pieces) == whole.feed(packed, True) and "".join(pieces).split() == ["naïve", "日本", "👍🏽", "end"]


def test_encoding_and_decoding_tables(spark, library):
    texts = texts_for_bpe()[:12]
    df = docs(spark, texts)
    got = bpe.decode(bpe.encode(df, TOKENIZER), TOKENIZER).collect()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_digests(df.limit(0), TOKENIZER, ["doc_id"]).count() == 0

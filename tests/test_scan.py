"""Whole documents through tags, fields and envelope; joins, scripts and pictures against plain Python."""

import json
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.functions.scripts import SCRIPTS, script_runs
from tillroll.images import stage
from tillroll.operators import fuzzy, layout, matrix, scan, synth, tagging
from tillroll.sources import catalog

LINES = "doc_id string, lines array<struct<text:string,x:double,y:double,width:double,height:double,confidence:double,status:string>>"


def placed(texts):
    return [(t, 10.0, 30.0 * k, 50.0, 20.0, 0.9, "ok") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def scanned(spark):
    docs = {
        "whole": placed(["Corner Store", "2024-03-15 14:35", "Milk 2 1.50 3.00", "Subtotal 3.00", "Tax 0.30", "Total 3.30", "Paid by CASH"]),
        "no total": placed(["Corner Store", "Milk 3.00", "Paid by CASH"]),
        "inferred": placed(["Corner Store", "Subtotal 10.00", "Tax 1.00", "Paid by CASH"]),
        "uncertain": placed(["Corner Store", "03/04/25", "Total 1.00"]),
        "currency": placed(["Corner Store", "Subtotal $10.00", "Total: 1500 PKR"]),
        "shuffled": [("Total 5.00", 10.0, 60.0, 50.0, 20.0, 0.9, "ok"), ("Corner Store", 10.0, 0.0, 50.0, 20.0, 0.9, "ok"), ("Milk 5.00", 10.0, 30.0, 50.0, 20.0, 0.9, "ok")],
        "arabic": [("متجر", 100.0, 0.0, 50.0, 20.0, 0.9, "ok"), ("المجموع 100.00", 10.0, 0.0, 50.0, 20.0, 0.3, "uncertain")],
        "items": placed(["Grocery Mart", "Bread 3.00", "Milk 2.50", "Eggs 1.50", "Cheese 4.00", "Subtotal 11.00"]),
        "empty": [],
        "none": None,
    }
    rows = spark.createDataFrame(list(docs.items()), LINES)
    return {r.doc_id: json.loads(r.result) for r in scan.scan(rows, engine="noisy", engine_version="1").collect()}


def test_goldens_through_the_whole_chain(scanned):
    whole, f = scanned["whole"], scanned["whole"]["fields"]
    assert list(whole) == list(catalog.RESULT_KEYS) and whole["scripts"] == ["Latn"] and whole["full_text"].startswith("Corner Store\n2024")
    assert (f["merchant"]["value"], f["date"]["value"], f["date"]["status"], f["time"]["value"], f["payment_method"]["value"], len(f["line_items"])) == ("Corner Store", "2024-03-15", "ok", "14:35:00", "cash", 1)
    assert (f["total"]["value"], f["total"]["status"], f["total"]["evidence"]["text_line_indices"]) == (3.3, "ok", [5])
    assert "total" not in scanned["no total"]["fields"] and "merchant_address" not in f
    assert (scanned["inferred"]["fields"]["total"]["value"], scanned["inferred"]["fields"]["total"]["status"], scanned["inferred"]["fields"]["total"]["evidence"]["text_line_indices"]) == (11.0, "inferred_field", [1, 2])
    assert scanned["uncertain"]["fields"]["date"]["status"] == "uncertain" and scanned["uncertain"]["fields"]["date"]["value"]["candidates"] == ["2025-04-03", "2025-03-04"]
    assert scanned["currency"]["fields"]["currency"]["value"] == "PKR"
    assert scanned["shuffled"]["fields"]["total"]["evidence"]["text_line_indices"] == [0] and scanned["shuffled"]["fields"]["merchant"]["evidence"]["text_line_indices"] == [1]
    assert [x["item_total"] for x in scanned["items"]["fields"]["line_items"]] == [3.0, 2.5, 1.5, 4.0]


def test_lines_carry_tags_and_right_to_left_rows(scanned):
    a = scanned["arabic"]
    assert a["scripts"] == ["Arab"] and [x["script"] for x in a["text_lines"]] == ["Arab", "Arab"] and a["text_lines"][1]["status"] == "uncertain"
    assert a["fields"]["total"]["value"] == 100.0 and a["fields"]["total"]["evidence"]["text_line_indices"] == [1]
    assert "script" not in scanned["whole"]["text_lines"][1] and "language" not in scanned["whole"]["text_lines"][0]
    for k in ("empty", "none"):
        assert scanned[k]["warnings"] == ["no text detected"] and scanned[k]["scripts"] == [] and scanned[k]["full_text"] == ""


def test_languages_of_lines_and_documents(spark):
    model = tagging.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert {r.code for r in tagging.model_languages(model).collect()} == {"de", "en", "es", "fr"}
    docs = spark.createDataFrame([("a", placed(["the thing and the other thing is there", "nicht für den und die einheit", "short"])), ("b", placed(["x"])), ("c", None)], LINES)
    got = {r.doc_id: r for r in scan.scan(docs, model).collect()}
    a = json.loads(got["a"].result)
    assert [x.get("language") for x in a["text_lines"]] == ["en", "de", None] and {x["code"] for x in a["languages"][:2]} == {"en", "de"}
    assert abs(sum(x["confidence"] for x in a["languages"]) - 1) < 1e-3 and got["b"].languages == got["c"].languages == []
    shown = {r.doc_id: (r.languages, r.more) for r in scan.view(scan.scan(docs, model), k=1, floor=0.2).collect()}
    assert re.fullmatch(r"(en|de) \(0\.\d\d\)", shown["a"][0]) and shown["a"][1] == 1 and shown["b"] == ("", 0)


def test_envelopes_are_checked(spark, scanned):
    good = json.dumps(scanned["whole"])
    docs = [("good", good), ("bad", good.replace('"confidence": 0.9', '"confidence": 9')), ("junk", "{"), ("error-1", '{"schema_version":"0.1.0","error":{"code":"X","message":"m"}}'), ("error-2", '{"error":{}}')]
    got = {r.name: r.problems for r in catalog.check_values(spark.createDataFrame(docs, "name string, content string")).collect()}
    assert got == {"good": [], "bad": ["text_lines"], "junk": ["json"], "error-1": [], "error-2": ["code", "message"]}


def test_engines_models_and_reports(spark, tmp_path):
    assert synth.default_engine() == "noisy" and synth.engine_of("noisy").supported_languages() == sorted(synth.BANKS)
    with pytest.raises(FileNotFoundError, match="MODEL_NOT_FOUND"):
        catalog.model_files("xx", {"TILLROLL_CACHE": str(tmp_path)}, ())
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "xx.traineddata").write_bytes(b"")
    assert len(catalog.model_files("xx", {"TILLROLL_CACHE": str(tmp_path)}, ())) == 1
    row = catalog.doctor(spark, {"TILLROLL_CACHE": "secret-place"}).first()
    assert row.cache_set and "noisy" in row.backends and "secret-place" not in str(row)
    m = matrix.language_matrix(spark)
    assert tuple(matrix.counts(m).first()) == (94, 32, 87, 32, 0) and "**87 / 94**" in matrix.report(m) and "| `ta` | Tamil | Taml |" in matrix.markdown(m)


# ---- scripts ----


def runs_by_hand(text):
    import unicodedata

    names = {"LATIN": "Latn", "ARABIC": "Arab", "CJK": "Hani", "HIRAGANA": "Hira", "HANGUL": "Hang", "CYRILLIC": "Cyrl", "DEVANAGARI": "Deva"}
    kinds = [names.get(unicodedata.name(c, "").split(" ")[0], "Zyyy") if c.isalpha() else "Zyyy" for c in text]
    last = None
    for k, s in enumerate(kinds):
        last = s if s != "Zyyy" else last
        kinds[k] = last or "Zyyy"
    first = next((s for s in kinds if s != "Zyyy"), "Zyyy")
    out = []
    for k, s in enumerate(first if s == "Zyyy" else s for s in kinds):
        if out and out[-1][0] == s:
            out[-1][2] = k + 1
        else:
            out.append([s, k, k + 1])
    return [tuple(x) for x in out]


def test_script_runs_equal_a_walk_over_characters(spark):
    rng = random.Random(6)
    parts = ["CORNER", " ", "3.49", "中文", "متجر", "Москва", "あ", "가나", "é", "!", "\n", "हिन", "", "—"]
    texts = [None, "", " ", "123.45", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(200))]
    texts = [t and t.replace("ि", "") for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", script_runs(F.col("t")).alias("r")).collect()
    for r in got:
        assert [tuple(x) for x in r.r] == runs_by_hand(texts[r.i] or ""), texts[r.i]
    assert len(SCRIPTS) == 30


# ---- joins ----


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(8)
    boxes = [(k % 3, k, rng.choice([0.0, 10.0, 25.5, 99.0, 100.0, 140.0]) + rng.randrange(40), rng.choice([0.0, 5.0, 20.0, 130.0])) for k in range(120)]
    df = spark.createDataFrame(boxes, "page int, id int, y double, height double")
    got = [tuple(r) for r in layout.overlapping_pairs(df, df, ["page"]).collect()]
    want = {(p, a, b) for p, a, y, h in boxes for q, b, z, g in boxes if p == q and min(y + h, z + g) - max(y, z) > 0.5 * (min(h, g) or 1.0)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_fuzzy_join_of_two_tables(spark):
    left = spark.createDataFrame([("Golden Markett",), ("golden market",), ("Other",), (None,)], "name string")
    right = spark.createDataFrame([("Golden Market",), ("Golden Market",), ("Other",), ("Unlike",)], "name string")
    assert sorted(map(tuple, fuzzy.fuzzy_join(left, right, "name").collect())) == [("Golden Markett", "Golden Market"), ("Other", "Other"), ("golden market", "Golden Market")]


# ---- pictures ----


def png(pixels, filters, colour):
    """A PNG whose lines are filtered as told, by the definition of each filter."""
    h, w, c = pixels.shape
    raw, above = b"", [0] * (w * c)
    for y in range(h):
        line, kind, out = pixels[y].ravel().tolist(), filters[y % len(filters)], []
        for k, v in enumerate(line):
            a, b, d = line[k - c] if k >= c else 0, above[k], above[k - c] if k >= c else 0
            p = a + b - d
            near = [0, a, b, (a + b) // 2, a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d][kind]
            out.append((v - near) % 256)
        raw, above = raw + bytes([kind, *out]), line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(pixels):
    h, w, _ = pixels.shape
    rows = b"".join(pixels[y, :, ::-1].tobytes() + b"\0" * (-3 * w % 4) for y in reversed(range(h)))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_pictures_decode(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb, gray = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8), rng.integers(0, 256, (6, 5, 1)).astype(np.uint8)
    for filters in ([0], [1], [2], [3], [4], [4, 2, 0, 3, 1]):
        assert (stage.decode(png(rgb, filters, 2)) == rgb).all() and (stage.decode(png(gray, filters, 0)) == gray[..., 0]).all()
    assert (stage.decode(bmp(rgb)) == rgb).all()
    whole = png(rgb, [0], 2)
    for broken in (whole[:-30], whole[:20], b"", b"BM", bmp(rgb)[:60], b"\xff\xd8\xff\xe0"):
        with pytest.raises(ValueError):
            stage.decode(broken)
    rows = stage.with_pixels(stage.from_content(spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(whole[:-30])), (3, None), (4, bytearray(b"")), (5, bytearray(bmp(rgb)))], "k int, content binary")))
    got = {r.k: (r.error, r.width, r.height) for r in rows.collect()}
    assert got[1] == got[5] == (None, 7, 9) and [got[k][0] for k in (2, 3, 4)] == ["decode_failed", "unreadable", "empty_file"]
    for n, data in {"a.png": png(np.repeat(stage.bars(3)[:, :, None], 3, 2), [1], 2), "b.png": whole[:-30], "c.bmp": bmp(np.repeat(stage.bars(4)[:, :, None], 3, 2))}.items():
        (tmp_path / n).write_bytes(data)
    good, bad = stage.prepare_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.mode for r in good.collect()} == {"a.png": "fast", "c.bmp": "fast"} and [r.error for r in bad.collect()] == ["decode_failed"]


def test_the_jvm_decodes_jpeg(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(20, 10, 1)
    for x in range(20):
        image.setRGB(x, 5, 0xFFFFFF)
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0junk")
    got = {r.path.rsplit("/", 1)[1]: r for r in stage.decode_files(spark, str(tmp_path), stage.read_images(spark, str(tmp_path))).collect()}
    assert (got["a.jpg"].format, got["a.jpg"].width, got["a.jpg"].height, got["a.jpg"].error, len(got["a.jpg"].pixels)) == ("JPEG", 20, 10, None, 200)
    assert got["b.jpg"].error == "decode_failed" and got["b.jpg"].pixels is None

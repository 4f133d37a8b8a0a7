"""Properties of the pixel operators, the loader's codes, seeds that survive repartitioning, and the stream."""

import json
import struct
import zlib

import numpy as np
import pytest

from tillroll.images import degrade, pixels, stage
from tillroll.operators import matrix, synth
from tillroll.operators.receipts import receipts
from tillroll.streaming import receipts as streaming

PAGE = stage.bars(42, 150, 120)


def test_gray_and_orientation():
    rgb = np.zeros((2, 3, 3), np.uint8)
    rgb[..., 1] = 200
    assert pixels.to_grayscale(rgb).tolist() == [[117] * 3] * 2 and pixels.to_grayscale(PAGE[:, :, None]).shape == PAGE.shape
    with pytest.raises(ValueError):
        pixels.to_grayscale(np.zeros((2, 2, 2)))
    a = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert [pixels.apply_orientation(a, k).tolist()[0] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [[0, 1, 2], [2, 1, 0], [5, 4, 3], [3, 4, 5], [0, 3], [3, 0], [5, 2], [2, 5], [0, 1, 2]]


def test_quality_flags_and_routes():
    assert not pixels.quality(PAGE)["needs_accurate_mode"]
    assert pixels.quality((128 + (PAGE.astype(float) - 128) * 0.12).astype(np.uint8))["is_low_contrast"] and pixels.quality((PAGE * 0.2).astype(np.uint8))["is_poorly_lit"]
    assert pixels.quality(pixels.blur(PAGE, 31, 8).astype(np.uint8))["is_blurry"]
    assert pixels.preprocess(PAGE)[1]["mode"] == "fast" and "auto_gamma" in pixels.preprocess((PAGE * 0.2).astype(np.uint8))[1]["steps"]
    assert "clahe" in pixels.preprocess((128 + (PAGE.astype(float) - 128) * 0.12).astype(np.uint8))[1]["steps"]


def test_denoising_gamma_and_thresholds():
    noisy = degrade.degrade(PAGE, "gaussian_noise", 7)
    rough = lambda g: np.abs(np.diff(g.astype(float), axis=0)).mean()
    assert rough(pixels.median(noisy)) < rough(noisy) and rough(pixels.non_local_means(noisy, 30)) < rough(noisy)
    assert (pixels.gamma(PAGE, 1) == PAGE).all() and pixels.gamma(PAGE, 2).mean() > PAGE.mean() and pixels.estimate_gamma(np.full((4, 4), 255)) == 1.0
    with pytest.raises(ValueError):
        pixels.gamma(PAGE, 0)
    assert set(np.unique(pixels.global_threshold(PAGE))) == set(np.unique(pixels.adaptive_threshold(PAGE, 24))) == {0, 255}
    flat = (120 + PAGE // 16).astype(np.uint8)
    assert pixels.clahe(flat).std() > flat.std() and pixels.unsharp(PAGE, 1.5).std() >= PAGE.std()


def test_skew_and_perspective():
    sheet = np.full((160, 160), 255, np.uint8)
    sheet[40:120, 50:110] = 20
    turned = pixels.rotate(sheet, 7)
    angle = pixels.skew_angle(turned)
    assert abs(angle) > 2 and abs(pixels.skew_angle(pixels.deskew(turned)[0])) < 1.5 and pixels.skew_angle(np.full((50, 50), 255, np.uint8)) == 0
    scene = np.full((200, 160), 30, np.uint8)
    scene[30:170, 30:130] = 240
    found = pixels.document_corners(scene)
    assert found is not None and np.abs(found - [[30, 30], [129, 30], [129, 169], [30, 169]]).max() <= 2 and pixels.document_corners(PAGE) is None
    y, x = np.mgrid[:160, :160]
    assert pixels.document_corners(np.where((x - 80) ** 2 + (y - 80) ** 2 < 60**2, 240, 30).astype(np.uint8)) is None
    tilted = pixels.document_corners(pixels.warp(scene, pixels.homography(np.array([[0, 0], [159, 0], [159, 199], [0, 199]]), np.array([[8, 5], [150, 0], [159, 190], [0, 199]])), 200, 160))
    assert tilted is not None
    assert (pixels.order_corners(found[[2, 0, 3, 1]]) == found).all() and pixels.correct_perspective(scene, found).mean() > 220


@pytest.mark.parametrize("name", degrade.DEGRADATIONS)
def test_degradations_repeat_by_seed(name):
    a = degrade.degrade(PAGE, name, 3)
    assert a.dtype == np.uint8 and (a == degrade.degrade(PAGE, name, 3)).all() and (name == "clean") == (a.shape == PAGE.shape and (a == PAGE).all())


def test_loader_codes(spark, tmp_path):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")
    files = {"ok.png": png(10, 10), "bomb.png": png(60_000, 60_000), "many.png": png(9_000, 9_000), "text.png": b"hello", "x.gif": b"GIF89a......", "none.png": b""}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    listing = spark.createDataFrame([(f"file:{tmp_path}/{n}", len(d)) for n, d in files.items()] + [(f"file:{tmp_path}/gone.png", None)], "path string, length long")
    got = {r.path.rsplit("/", 1)[1]: r.error for r in stage.with_listing(stage.read_images(spark, str(tmp_path)), listing).collect()}
    assert got == {"ok.png": None, "bomb.png": "dimensions_too_large", "many.png": "decompression_bomb_suspected", "text.png": "decode_failed", "x.gif": "unsupported_format", "none.png": "empty_file", "gone.png": "unreadable"}
    tag = b"\xff\xd8\xff\xe1\x00\x22Exif\0\0II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    assert stage.exif_orientation(tag) == 6 and stage.exif_orientation(b"junk") == 1


def test_seeds_survive_repartitioning(spark):
    cases = spark.createDataFrame([("en", 5), ("fr", 5), ("de", 9)], "language string, seed long")
    one = sorted(synth.recognize(synth.generate(cases)).collect())
    assert one == sorted(synth.recognize(synth.generate(cases.repartition(3))).collect())
    t = synth.generate(cases).first()
    assert abs(t.total - t.subtotal - t.tax) < 0.005 and t.lines[-1].startswith("TOTAL") and 3 <= len(t["items"]) <= 6
    with pytest.raises(ValueError):
        synth.engine_of("absent")


def test_matrix(spark):
    m = matrix.language_matrix(spark)
    assert (m.count(), matrix.supported(m).count(), matrix.verified(m).count(), m.where("mandatory").count()) == (94, 87, 0, 32)
    packs = matrix.installed(spark.createDataFrame([("en",), ("xx",)], "code string"), spark.createDataFrame([("en",), ("fr",)], "code string"))
    assert packs.count() == 3 and matrix.mandatory_installed(m, packs).count() == 2 and matrix.mandatory_missing(m, packs).count() == 30
    assert matrix.listing(m).first().code == "ar" and matrix.markdown(m).count("\n") == 96


def test_rendered_receipts_give_back_their_truth(spark):
    r = receipts(spark, "/root/testdata/sf0.001")
    assert r.where("n_items = 0").count() == 27 and r.count() == 1500


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"doc_id": i, "lines": ["Shop", f"Total {i}.50"]}) for i in range(3)))
    streaming.write_results(streaming.to_results(streaming.read_lines(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(120)
    got = {r.doc_id: json.loads(r.fields)["total"]["value"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {0: 0.5, 1: 1.5, 2: 2.5}

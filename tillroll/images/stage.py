"""Pictures in Spark: one Arrow stage that decodes, degrades and prepares, keyed by columns only."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.images.degrade import degrade
from tillroll.images.pixels import apply_orientation, preprocess, to_grayscale
from tillroll.operators.envelope import load_error

_OUT = "pixels binary, width int, height int, mode string, steps array<string>, angle double, blur double, contrast double, brightness double, needs_accurate_mode boolean"


def header(content: bytes) -> tuple[str | None, int | None, int | None]:
    """Format, width and height by a picture's first bytes; null where they don't tell."""
    try:
        if content.startswith(b"\x89PNG\r\n\x1a\n"):
            return "PNG", *struct.unpack_from(">II", content, 16)
        if content.startswith(b"BM"):
            w, h = struct.unpack_from("<ii", content, 18)
            return "BMP", w, abs(h)
        if content.startswith(b"\xff\xd8\xff"):
            return "JPEG", *_jpeg_size(content)
        if content[:4] in (b"II*\0", b"MM\0*"):
            return "TIFF", *_tiff_size(content)
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            return "WEBP", *_webp_size(content)
        if content[:4] == b"GIF8":
            return "GIF", *struct.unpack_from("<HH", content, 6)
    except (struct.error, IndexError):
        return _named(content), None, None
    return None, None, None


def _named(content: bytes) -> str | None:
    starts = {b"\x89PNG": "PNG", b"BM": "BMP", b"\xff\xd8\xff": "JPEG", b"II*\0": "TIFF", b"MM\0*": "TIFF", b"RIFF": "WEBP", b"GIF8": "GIF"}
    return next((name for start, name in starts.items() if content.startswith(start)), None)


def _jpeg_size(content: bytes) -> tuple[int | None, int | None]:
    """From segment to segment up to a frame header."""
    at = 2
    while at + 9 < len(content):
        if content[at] != 0xFF:
            return None, None
        kind = content[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", content, at + 5)
            return w, h
        elif kind in (0x01, *range(0xD0, 0xD9)):
            at += 2
        else:
            at += 2 + struct.unpack_from(">H", content, at + 2)[0]
    return None, None


def _tiff_size(content: bytes) -> tuple[int | None, int | None]:
    order = "<" if content[:2] == b"II" else ">"
    ifd = struct.unpack_from(order + "I", content, 4)[0]
    size: dict[int, int] = {}
    for k in range(struct.unpack_from(order + "H", content, ifd)[0]):
        tag, kind = struct.unpack_from(order + "HH", content, ifd + 2 + 12 * k)
        if tag in (256, 257):
            size[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), content, ifd + 10 + 12 * k)[0]
    return size.get(256), size.get(257)


def _webp_size(content: bytes) -> tuple[int | None, int | None]:
    kind = content[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
    if kind == b"VP8L":
        bits = struct.unpack_from("<I", content, 21)[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 ":
        w, h = struct.unpack_from("<HH", content, 26)
        return w & 0x3FFF, h & 0x3FFF
    return None, None


def with_headers(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Add format, width, height and the loader's error to rows with a picture's bytes and their ``length``."""

    @F.pandas_udf("format string, width long, height long")
    def read(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header(bytes(c)) if c is not None else (None, None, None) for c in content], columns=["format", "width", "height"]).astype({"width": "Int64", "height": "Int64"})

    df = files.withColumn("_h", read(content_col)).withColumns({c: F.col(f"_h.{c}") for c in ("format", "width", "height")}).drop("_h")
    return df.withColumn("error", load_error(F.col("length"), F.col("format"), F.col("width"), F.col("height")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length, format, width, height and error of each file; broken files are rows with an error.

    Sizes are read from the headers of PNG, BMP, JPEG, TIFF and WEBP files; one that a header does
    not tell is an error.  Empty files don't appear in Spark's listing of binary files;
    ``with_listing`` adds them.
    """
    return with_headers(spark.read.format("binaryFile").load(path).select("path", "content", "length"))


def from_content(rows: DataFrame, content_col: str = "content") -> DataFrame:
    """The same for rows that hold a picture's bytes instead of a path; null bytes are unreadable."""
    return with_headers(rows.withColumn("length", F.length(content_col).cast("long")), content_col)


def decode(content: bytes) -> np.ndarray:
    """Gray or RGB pixels of a PNG (8 bits a channel, not interlaced) or an uncompressed BMP; ValueError for others."""
    kind, w, h = header(content)
    if w is None or h is None or len(content) < 34:
        raise ValueError("decode_failed")
    if kind == "PNG":
        return _png(content, w, h)
    if kind == "BMP":
        offset, top, bits, packed = struct.unpack_from("<I", content, 10)[0], struct.unpack_from("<i", content, 22)[0] < 0, *struct.unpack_from("<HI", content, 28)
        if bits not in (24, 32) or packed not in (0, 3):
            raise ValueError("decode_failed")
        line = (w * bits // 8 + 3) // 4 * 4
        if len(content) < offset + line * h:
            raise ValueError("decode_failed")
        rows = np.frombuffer(content, np.uint8, line * h, offset).reshape(h, line)[:, : w * bits // 8].reshape(h, w, bits // 8)[..., 2::-1]
        return rows if top else rows[::-1]
    raise ValueError("decode_failed")


def _png(content: bytes, w: int, h: int) -> np.ndarray:
    depth, colour, _, _, interlaced = struct.unpack_from(">BBBBB", content, 24)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("decode_failed")
    at, data, palette = 8, [], None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IDAT":
            data.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        at += 12 + size
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("decode_failed") from e
    if len(raw) < h * (1 + w * channels):
        raise ValueError("decode_failed")
    lines = np.frombuffer(raw, np.uint8, h * (1 + w * channels)).reshape(h, 1 + w * channels)
    out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.uint8)
    for y in range(h):
        above = out[y] = _unfilter(lines[y, 0], lines[y, 1:], above, channels)
    pixels = out.reshape(h, w, channels)
    if colour == 3:
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise ValueError("decode_failed")
        return palette[pixels[..., 0]]
    return pixels[..., 0] if colour in (0, 4) else pixels[..., :3]


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line of a PNG without its filter."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError("decode_failed")
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for k in range(step, len(out)):
        a, b, c = out[k - step], up[k], up[k - step]
        if kind == 3:
            near = (a + b) // 2
        else:
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = (out[k] + near) & 255
    return np.array(out[step:], np.uint8)


def with_pixels(images: DataFrame, content_col: str = "content") -> DataFrame:
    """Gray upright ``pixels`` with their width and height, for rows that have no error; a picture that can't be decoded gets one.

    PNG and BMP are decoded here.  ``decode_files`` reads whatever the JVM can from files.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema) + ", pixels binary"
    names = images.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                pixels = None
                if r["error"] is None:
                    try:
                        gray = apply_orientation(to_grayscale(decode(bytes(r[content_col]))), exif_orientation(bytes(r[content_col])))
                        pixels, r["height"], r["width"] = np.ascontiguousarray(gray).tobytes(), *gray.shape
                    except ValueError:
                        r["error"] = "decode_failed"
                rows.append((*(r[n] for n in names), pixels))
            yield pd.DataFrame(rows, columns=[*names, "pixels"])

    return images.mapInPandas(run, schema)


def decode_files(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """``pixels`` of files by the JVM's own readers (JPEG, PNG, BMP, TIFF), for rows of ``read_images`` without an error; others keep theirs.

    The JVM decodes every file of the folder before sizes can be held against the limits, so it must hold no bombs.
    """
    read = spark.read.format("image").option("dropInvalid", True).load(path).select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("_p"), "image.*")
    gray = F.pandas_udf(lambda data, h, w, n: pd.Series([to_grayscale(np.frombuffer(d, np.uint8).reshape(y, x, c)[..., 2::-1] if c > 1 else np.frombuffer(d, np.uint8).reshape(y, x)).tobytes() for d, y, x, c in zip(data, h, w, n, strict=True)]), "binary")
    made = read.select("_p", gray("data", "height", "width", "nChannels").alias("pixels"))
    out = images.withColumn("_p", F.regexp_replace("path", "^file:/+", "file:/")).join(made, "_p", "left").drop("_p")
    return out.withColumns({"error": F.coalesce("error", F.when(F.col("pixels").isNull(), "decode_failed")), "pixels": F.when(F.col("error").isNull(), F.col("pixels"))})


def prepare_files(spark: SparkSession, path: str, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Pictures of a folder, loaded and prepared, and the rows that could not be, with their errors."""
    loaded = with_pixels(read_images(spark, path))
    good = loaded.where("error is null").select("path", "pixels", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    return prepare(good, ["path"], mode), loaded.where("error is not null").select("path", "error")


def with_listing(images: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows for listed files (path, length) that the reader leaves out: empty and unreadable ones."""
    lost = listing.join(images.select("path"), "path", "left_anti").withColumn("error", F.when(F.col("length") == 0, "empty_file").otherwise("unreadable"))
    return images.unionByName(lost, allowMissingColumns=True)


def exif_orientation(content: bytes) -> int:
    """The orientation tag of a JPEG, 1 to 8; 1 if there is none or the file is broken."""
    try:
        at = content.index(b"Exif\0\0") + 6
        order = {b"II": "<", b"MM": ">"}[content[at : at + 2]]
        ifd = at + struct.unpack_from(order + "I", content, at + 4)[0]
        for k in range(struct.unpack_from(order + "H", content, ifd)[0]):
            tag, _, _, value = struct.unpack_from(order + "HHIH", content, ifd + 2 + 12 * k)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except (ValueError, KeyError, struct.error):
        pass
    return 1


def prepare(images: DataFrame, keep: list[str], mode: str = "auto") -> DataFrame:
    """From gray pixels (pixels binary, width, height, optional degradation and seed) to prepared ones and their quality."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keep).schema) + ", " + _OUT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width))
                if getattr(r, "degradation", None):
                    a = degrade(a, r.degradation, int(r.seed))
                g, q = preprocess(a, mode)
                rows.append((*(getattr(r, k) for k in keep), g.tobytes(), g.shape[1], g.shape[0], q["mode"], q["steps"], q["angle"], q["blur"], q["contrast"], q["brightness"], q["needs_accurate_mode"]))
            yield pd.DataFrame(rows, columns=[*keep, "pixels", "width", "height", "mode", "steps", "angle", "blur", "contrast", "brightness", "needs_accurate_mode"])

    return images.mapInPandas(run, schema)


def bars(seed: int, height: int = 90, width: int = 64) -> np.ndarray:
    """A page of dark bars, as lines of text look from afar."""
    r, a = np.random.default_rng(seed), np.full((height, width), 245, np.uint8)
    for y in range(8, height - 8, 9):
        a[y : y + 4, 6 : 6 + int(r.integers(width // 3, width - 12))] = 25
    return a


def sample_images(seeds: DataFrame, seed_col: str = "seed") -> DataFrame:
    """Add pixels, width and height of a page for each seed."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeds.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [bars(int(s)) for s in pdf[seed_col]]
            yield pdf.assign(pixels=[m.tobytes() for m in made], width=[m.shape[1] for m in made], height=[m.shape[0] for m in made])

    return seeds.mapInPandas(run, fields + ", pixels binary, width int, height int")

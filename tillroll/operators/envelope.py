"""The JSON envelope of a result, and error codes as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.operators.extraction import SCALARS

VERSION = "0.1.0"
#: The keys of a result, in order; its modes and statuses.
KEYS = ("schema_version", "engine", "engine_version", "mode", "image", "processing_time_ms", "languages", "scripts", "full_text", "text_lines", "warnings", "fields")
MODES, STATUSES = ("fast", "accurate", "auto"), ("ok", "uncertain", "missing", "illegible", "truncated", "missing_region", "inferred_field")
#: Limits of the image loader.
MAX_BYTES, MAX_SIDE, MAX_PIXELS, FORMATS = 50 * 1024 * 1024, 20_000, 64_000_000, ("JPEG", "PNG", "BMP", "TIFF", "WEBP")


def load_error(size: Column, fmt: Column, width: Column, height: Column, max_pixels: int = MAX_PIXELS) -> Column:
    """The loader's verdict from what a header tells, cheapest test first; null if all pass.  A null size means that the file can't be read."""
    return (
        F.when(size.isNull(), "unreadable").when(size == 0, "empty_file").when(size > MAX_BYTES, "file_too_large").when(fmt.isNull(), "decode_failed").when(~fmt.isin(*FORMATS), "unsupported_format")
        .when(F.coalesce(width, F.lit(0)) <= 0, "decode_failed").when(F.coalesce(height, F.lit(0)) <= 0, "decode_failed").when((width > MAX_SIDE) | (height > MAX_SIDE), "dimensions_too_large")
        .when(width.cast("long") * height > max_pixels, "decompression_bomb_suspected")
    )


def error_code(load: Column) -> Column:
    return F.when(load == "unsupported_format", "UNSUPPORTED_FORMAT").when(load.isNotNull(), "INVALID_IMAGE")


def _scalar(f: Column) -> Column:
    """status, value, confidence, evidence; absent parts are null and so left out of the JSON."""
    some = lambda a: F.when(F.size(a) > 0, a)
    num = f["num"].cast("string")  # parsed, so that 100.0 is 100; what is no JSON (Infinity) stays text
    value = F.when(f["candidates"].isNotNull(), F.to_variant_object(F.struct(f["candidates"].alias("candidates")))).when(f["num"].isNotNull(), F.coalesce(F.try_parse_json(num), num.cast("variant"))).otherwise(f["value"].cast("variant"))
    return F.when(f["status"] != "missing", F.struct(f["status"].alias("status"), value.alias("value"), f["confidence"].alias("confidence"), F.when(F.size(f["evidence"]) > 0, F.struct(some(f["evidence"]).alias("text_line_indices"))).alias("evidence")))


def fields_json(fields: Column) -> Column:
    """A result's fields as JSON, without missing ones and empty lists."""
    parts = [_scalar(fields[k]).alias(k) for k in SCALARS]
    rows = F.when(F.size(fields["line_items"]) > 0, fields["line_items"])
    return F.to_json(F.struct(*parts, rows.alias("line_items")))


def _fields(fields: Column) -> Column:
    rows = F.when(F.size(fields["line_items"]) > 0, fields["line_items"])
    return F.struct(*(_scalar(fields[k]).alias(k) for k in SCALARS), rows.alias("line_items"))


def result_json(result: dict[str, Column]) -> Column:
    """The envelope of a result: twelve keys in fixed order; absent parts of lines and fields are left out."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    given = {
        "schema_version": F.lit(VERSION), "engine": F.lit("none"), "engine_version": F.lit(""), "mode": F.lit("auto"), "image": F.struct(F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("unknown").alias("format")),
        "processing_time_ms": F.lit(0.0), "languages": none("struct<code:string,confidence:double>"), "scripts": none("string"), "full_text": F.lit(""), "text_lines": none("string"), "warnings": none("string"),
    } | result
    parts = [given[k].alias(k) for k in KEYS if k != "fields"]
    return F.to_json(F.struct(*parts, _fields(given["fields"]).alias("fields")))


def error_json(code: Column, message: Column, details: Column | None = None) -> Column:
    error = [code.alias("code"), message.alias("message"), *([details.alias("details")] if details is not None else [])]
    return F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.struct(*error).alias("error")))

"""A whole document at once: order, tags, fields, and the envelope of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.scripts import dominant_scripts, is_rtl, script_runs
from tillroll.operators import tagging
from tillroll.operators.envelope import result_json
from tillroll.operators.extraction import extract_fields


def tag_documents(docs: DataFrame, lines_col: str = "lines") -> DataFrame:
    """Add ``line_scripts`` (the main script of each line, or null), ``rtl`` flags and ``scripts`` of the document, by characters."""
    df = docs.withColumn("_runs", F.transform(lines_col, lambda x: script_runs(x["text"])))
    df = df.withColumn("_each", F.transform("_runs", dominant_scripts))
    tags = {"line_scripts": F.transform("_each", lambda s: F.get(s, F.lit(0))), "rtl": F.transform("_each", is_rtl), "scripts": dominant_scripts(F.flatten("_runs"))}
    return df.withColumns(tags).drop("_runs", "_each")


def document_tags(docs: DataFrame, model: DataFrame, doc_col: str = "doc_id", lines_col: str = "lines") -> DataFrame:
    """(doc, languages: most first, line_languages: map of line index to code, unknown ones left out)."""
    each = docs.select(doc_col, F.posexplode(lines_col).alias("line", "x")).select(doc_col, "line", F.col("x.text").alias("text"))
    ranked = tagging.rank_lines(each, model, [doc_col, "line"])
    best = tagging.identify(ranked, [doc_col, "line"]).where("code != 'unknown'")
    by_line = best.groupBy(doc_col).agg(F.map_from_entries(F.collect_list(F.struct("line", "code"))).alias("line_languages"))
    listed = tagging.document_languages(ranked, doc_col).groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct("position", "code", "confidence"))).alias("l"))
    return listed.select(doc_col, F.transform("l", lambda x: F.struct(x["code"].alias("code"), x["confidence"].alias("confidence"))).alias("languages")).join(by_line, doc_col, "left")


def scan(docs: DataFrame, model: DataFrame | None = None, doc_col: str = "doc_id", lines_col: str = "lines", engine: str = "none", engine_version: str = "", mode: str = "auto") -> DataFrame:
    """Add scripts, languages, fields and ``result``, the JSON envelope, to documents with recognised lines.

    ``lines_col`` is array<struct<text, x, y, width, height, optional confidence and status>>; an
    optional ``image`` struct and ``warnings`` array go into the envelope.  A document without
    lines has empty tags, missing fields and the warning ``no text detected``.  Without a model
    no language is told.
    """
    df = tag_documents(docs, lines_col)
    if model is None:
        df = df.withColumns({"languages": F.array().cast("array<struct<code:string,confidence:double>>"), "line_languages": F.lit(None).cast("map<int,string>")})
    else:
        df = df.join(document_tags(docs, model, doc_col, lines_col), doc_col, "left").withColumn("languages", F.coalesce("languages", F.array().cast("array<struct<code:string,confidence:double>>")))
    flagged = F.transform(lines_col, lambda x, i: F.struct(x["text"].alias("text"), *(x[c].cast("double").alias(c) for c in ("x", "y", "width", "height")), F.get("rtl", i).alias("rtl")))
    df = extract_fields(df.withColumn("_boxes", F.coalesce(flagged, F.array().cast("array<struct<text:string,x:double,y:double,width:double,height:double,rtl:boolean>>"))), "_boxes")
    names = docs.schema[lines_col].dataType.elementType.names
    extra = lambda x: [x[c].alias(c) for c in ("confidence", "status") if c in names]
    box = lambda x: F.struct(*(x[c].cast("double").alias(c) for c in ("x", "y", "width", "height"))).alias("bbox")
    lines = F.transform(lines_col, lambda x, i: F.struct(x["text"].alias("text"), box(x), *extra(x), F.element_at(F.col("line_languages"), i).alias("language"), F.get("line_scripts", i).alias("script")))
    text = F.array_join(F.transform(lines_col, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    empty = F.coalesce(F.size(lines_col) == 0, F.lit(True))
    warned = F.col("warnings") if "warnings" in docs.columns else F.array().cast("array<string>")
    warned = F.when(empty, F.array_append(warned, F.lit("no text detected"))).otherwise(warned)
    parts = {
        "engine": F.lit(engine), "engine_version": F.lit(engine_version), "mode": F.lit(mode), "languages": F.col("languages"), "scripts": F.coalesce("scripts", F.array().cast("array<string>")), "full_text": F.coalesce(text, F.lit("")),
        "text_lines": lines, "warnings": warned, "fields": F.col("fields"),
    }
    if "image" in docs.columns:
        parts["image"] = F.col("image")
    return df.withColumn("result", result_json(parts)).drop("_boxes")


def view(scanned: DataFrame, doc_col: str = "doc_id", k: int = 5, floor: float = 0.05) -> DataFrame:
    """(doc, languages, more): what a person is shown of a result's languages, at most k of at least floor."""
    shown = F.filter("languages", lambda x: x["confidence"] >= floor)
    told = F.transform(F.slice(shown, 1, k), lambda x: F.format_string("%s (%.2f)", x["code"], x["confidence"]))
    return scanned.select(doc_col, F.array_join(told, ", ").alias("languages"), F.greatest(F.size(shown) - k, F.lit(0)).alias("more"))

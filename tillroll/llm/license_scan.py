"""Licence scan by canonical digest, in SQL functions only: normalise, hash, join to the digests of known texts.

Normalising lower-cases, drops copyright notices, brings equivalent spellings to one form and
reduces everything but letters and digits to single spaces; two texts that differ only there
get one SHA-256 digest.  A document's entire text is looked up among entire licence texts, and
each of its lines that speaks of a licence among known notices, since these often stand alone in
a longer text.

A copyright notice runs to the words that licence texts begin with, if they follow in its line,
or else to the end of the line if that is near.

A null text is empty.  An empty or all-punctuation text has the digest of the empty string,
which is no licence.  Very long texts are normalised and hashed whole.  Repeated rows and null
ids are rows like others, told apart by an id that staging fixes.  Ties: a document may match
several notices; each licence is listed once, sorted; of known texts that are equal after
normalising the first name counts.  An empty table gives an empty result, and without known
texts nothing is found.  Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import by_position, position, staged
from tillroll.llm.licenses import KNOWN, notices

#: Equivalent spellings, as published for matching licence texts; from, to.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("merchantibility", "merchantability"), ("favour", "favor"), ("honour", "honor"), ("judgement", "judgment"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https://", "http://"))
_NOTICE = r"(?:copyright[ \t]*(?:\(c\)|©)[ \t]*[^ \t\n_]|copyright[^\n.]{0,40}?(?:[0-9]{4}|<year>|\[yyyy\])|\(c\)[^\n.]{0,40}?(?:[0-9]{4}|<year>|\[yyyy\])|©)"
#: A notice before the words that a text begins with, and one up to the end of its line; what they are replaced by.
CUTS = ((_NOTICE + r"[^\n]{0,200}?\b(permission|redistribution|licensed|released|everyone|this)\b", "{}"), (_NOTICE + r"[^\n]{0,120}?(\n|\z)", "\n"), (r"all rights reserved\b", " "))
HAS_NOTICE = r"copyright|\(c\)|©|all rights"
SPEAKS = r"(?i)licen[cs]e|copyright|public domain|spdx|\bcc[ -]?(?:by|0)\b|\bcc0\b"


def canonical(text: Column) -> Column:
    low = F.lower(text)
    cut = low
    for pattern, by in CUTS:
        cut = F.regexp_replace(cut, pattern, by.format("$1"))
    out = F.when(low.rlike(HAS_NOTICE), cut).otherwise(low)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None, known_notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license, notice) of entire texts and of one-line notices."""
    rows = [(n, b, False) for n, b in (KNOWN if known is None else known)] + [(n, b, True) for n, b in (notices() if known_notices is None else known_notices)]
    table = spark.createDataFrame(rows, "license string, body string, notice boolean")
    return table.select(digest(F.col("body")).alias("digest"), "license", "notice").groupBy("digest", "notice").agg(F.min("license").alias("license"))


def scan_licenses(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``text_digest``, ``whole_license`` (of the entire text, or null), ``notice_licenses`` (of its lines, comma-joined, or null), ``licenses`` (of both), ``n_lines`` that matched.

    The joins' strategy is left to the optimizer: it
    broadcasts the digests only if its size is under the session's threshold, else it
    shuffles, and splits hot digests of copies.
    """
    docs = by_position(df)
    text = F.coalesce(F.col(position(df, text_col)), F.lit(""))
    lines = F.when(text.rlike(SPEAKS), F.filter(F.split(text, "\n"), lambda x: x.rlike(SPEAKS))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(position(df, id_col)).alias("_id"), digest(text).alias("digest"), F.transform(lines, digest).alias("_lines"))
    rows = staged(rows.withColumn("_rid", F.monotonically_increasing_id()), "digests")
    whole = rows.select("_rid", "_id", "digest").join(known.where("not notice").select("digest", F.col("license").alias("whole_license")), "digest", "left")
    hits = rows.select("_rid", F.explode("_lines").alias("digest")).join(known.where("notice"), "digest")
    found = hits.groupBy("_rid").agg(F.array_sort(F.collect_set("license")).alias("_found"), F.count("*").alias("_n"))
    out = whole.join(found, "_rid", "left")
    both = F.array_sort(F.array_distinct(F.array_compact(F.array_append(F.coalesce("_found", F.array().cast("array<string>")), F.col("whole_license")))))
    return out.select(
        F.col("_id").alias(id_col), F.col("digest").alias("text_digest"), "whole_license", F.array_join("_found", ",").alias("notice_licenses"),
        F.when(F.size(both) > 0, F.array_join(both, ",")).alias("licenses"), F.coalesce("_n", F.lit(0)).alias("n_lines"),
    )

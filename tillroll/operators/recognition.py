"""After recognition: words into lines, and whether and which second pass counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_WORD, LOW_MEAN = 0.4, 0.5
ESCALATED = "auto mode escalated to a second, accurate-mode OCR pass"


def words_to_lines(words: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Lines from word rows (block_num, par_num, line_num, word_num, left, top, width, height, conf, text).

    Blank words are dropped; a confidence below zero counts as zero; a line's confidence is its
    words' mean.  The order of words is made explicit before they are joined.
    """
    keys = [doc_col, "block_num", "par_num", "line_num"]
    conf = F.greatest(F.col("conf").cast("double"), F.lit(0.0)) / 100
    kept = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_c", conf)
    ordered = F.array_sort(F.collect_list(F.struct("word_num", "left", "text", F.col("_c").alias("confidence"))))
    lines = kept.groupBy(*keys).agg(
        ordered.alias("words"), F.min("left").alias("x"), F.min("top").alias("y"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"),
        (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"), F.avg("_c").alias("confidence"),
    )
    text = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    return lines.withColumns({"text": text, "status": F.when(F.col("confidence") >= LOW_WORD, "ok").otherwise("uncertain"), "n_words": F.size("words")})


def should_escalate(mode: Column, confidences: Column) -> Column:
    """Only in auto mode: no lines, or a mean confidence below one half."""
    mean = F.aggregate(confidences, F.lit(0.0), lambda a, c: a + c) / F.size(confidences)
    return (mode == "auto") & F.when(F.size(confidences) > 0, mean < LOW_MEAN).otherwise(F.lit(True))


def choose_pass(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each document the second pass's lines if it has some and no fewer than the first, else the first's.

    Both have (key, lines, warnings); only escalated documents are in the second.
    """
    joined = first.join(second.select(key, F.col("lines").alias("_l2"), F.col("warnings").alias("_w2")), key, "left")
    n1, n2 = F.size("lines"), F.coalesce(F.size("_l2"), F.lit(0))
    better = F.coalesce(F.col("_l2").isNotNull() & (n2 > 0) & ((n1 == 0) | (n2 >= n1)), F.lit(False))
    warnings = F.when(better, F.array_append(F.coalesce("_w2", F.array().cast("array<string>")), F.lit(ESCALATED))).otherwise(F.col("warnings"))
    return joined.withColumns({"lines": F.when(better, F.col("_l2")).otherwise(F.col("lines")), "warnings": warnings, "escalated": better}).drop("_l2", "_w2")


def decide_mode(mode: Column, blurry: Column, low_contrast: Column, poorly_lit: Column) -> Column:
    """struct(mode, reason): auto becomes accurate with its reasons, or fast."""
    signals = F.concat_ws(",", F.when(blurry, "blurry"), F.when(low_contrast, "low_contrast"), F.when(poorly_lit, "poorly_lit"))
    auto = F.when(signals != "", F.struct(F.lit("accurate").alias("mode"), F.concat(F.lit("auto: quality signals="), signals).alias("reason"))).otherwise(F.struct(F.lit("fast").alias("mode"), F.lit("auto: no quality signals").alias("reason")))
    return F.when(mode == "auto", auto).otherwise(F.struct(mode.alias("mode"), F.lit("explicit").alias("reason")))


def bounding_box(polygon: Column) -> Column:
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


def visual_to_logical(text: Column) -> Column:
    """A right-to-left line from display order to reading order: characters reversed, runs of Latin and digits kept."""
    back = F.reverse(text)
    runs = F.regexp_extract_all(back, F.lit(r"[\p{IsLatin}0-9][\p{IsLatin}0-9.,:/%$-]*|[^\p{IsLatin}0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^[\p{IsLatin}0-9]"), F.reverse(r)).otherwise(r)), "")

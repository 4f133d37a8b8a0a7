"""Languages and scripts of lines and documents.

A language model is a table of character trigrams with a log-probability for each language,
counted by Spark; lines are scored by joining their trigrams to it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions.base import strip
from tillroll.functions.scripts import dominant_scripts, is_rtl, script_runs

LEAST_CHARS, LEAST_PROBABILITY, SIZE = 8, 0.5, 3


def _grams(text):
    """Overlapping character trigrams in one pass; a text under three characters is its own."""
    low = F.lower(text)
    return F.when(F.length(low) < SIZE, F.array(low)).otherwise(F.regexp_extract_all(low, F.lit(rf"(?s)(?=(.{{{SIZE}}}))"), F.lit(1)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 3) -> DataFrame:
    """(gram, scores: map of language to log-probability, with add-one smoothing) from labelled texts.

    Counts are pre-aggregated by gram and language; rare grams are left out.
    """
    counts = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(_grams(F.col(text_col))).alias("gram")).groupBy("gram", "lang").count()
    counts = counts.withColumn("all", F.sum("count").over(Window.partitionBy("gram")))
    kept = counts.where(F.col("all") >= min_count).drop("all").persist()  # read four times, and far smaller than the texts
    langs = [r.lang for r in kept.select("lang").distinct().orderBy("lang").collect()]  # as many as there are languages
    totals = {r.lang: r.n for r in kept.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    size = kept.select("gram").distinct().count()
    table = kept.groupBy("gram").pivot("lang", langs).agg(F.first("count"))
    scores = [F.lit(x) for lang in langs for x in (lang, None)]
    for k, lang in enumerate(langs):
        scores[2 * k + 1] = F.log(F.coalesce(F.col(f"`{lang}`"), F.lit(0)) + 1) - math.log(totals[lang] + size)
    return table.select("gram", (F.create_map(*scores) if langs else F.lit(None).cast("map<string,double>")).alias("scores"))


def model_languages(model: DataFrame) -> DataFrame:
    """(code) of every language that a model can tell."""
    return model.select(F.explode(F.map_keys("scores")).alias("code")).distinct()


def rank_lines(lines: DataFrame, model: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, code, probability) of each language for each line of 8 characters or more."""
    grams = lines.where(F.length(strip(F.col(text_col))) >= LEAST_CHARS).select(*keys, F.explode(_grams(strip(F.col(text_col)))).alias("gram"))
    scored = grams.groupBy(*keys, "gram").count().join(model, "gram").select(*keys, "count", F.explode("scores").alias("code", "s"))
    total = scored.groupBy(*keys, "code").agg(F.sum(F.col("count") * F.col("s")).alias("s"))
    w = Window.partitionBy(*keys)
    e = total.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select(*keys, "code", (F.col("e") / F.sum("e").over(w)).alias("probability"))


def identify(ranked: DataFrame, keys: list[str], floor: float = LEAST_PROBABILITY) -> DataFrame:
    """(keys, code, confidence): the first label, or unknown under the floor."""
    top = ranked.groupBy(*keys).agg(F.max_by(F.struct("code", "probability"), F.struct("probability", "code")).alias("t"))
    return top.select(*keys, F.when(F.col("t.probability") >= floor, F.col("t.code")).otherwise("unknown").alias("code"), F.when(F.col("t.probability") >= floor, F.col("t.probability")).otherwise(0.0).alias("confidence"))


def document_languages(ranked: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc, code, confidence, position): the lines' probabilities summed, as shares, most first."""
    summed = ranked.groupBy(doc_col, "code").agg(F.sum("probability").alias("p"))
    share = summed.withColumn("confidence", F.round(F.col("p") / F.sum("p").over(Window.partitionBy(doc_col)), 4))
    return share.withColumn("position", F.row_number().over(Window.partitionBy(doc_col).orderBy(F.desc("p"), "code"))).drop("p")


def top_languages(langs: DataFrame, doc_col: str = "doc_id", k: int = 5, floor: float = 0.05) -> DataFrame:
    """At most k languages of at least floor for a view, and how many more there are."""
    held = langs.where(F.col("confidence") >= floor)
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("position", "code"))), 1, k), lambda x: x["code"])
    return held.groupBy(doc_col).agg(F.array_join(listed, ",").alias("languages"), F.greatest(F.count("*") - k, F.lit(0)).alias("more"))


def tag_lines(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``runs``, ``scripts`` and ``rtl``."""
    df = lines.withColumn("runs", script_runs(F.col(text_col)))
    df = df.withColumn("scripts", dominant_scripts(F.col("runs")))
    return df.withColumn("rtl", is_rtl(F.col("scripts")))


def script_segments(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Runs from one row for each character (keys, pos, script), by windows: fill forward, then back, then islands.

    The relational form of ``script_runs``, for tables that are stored by character.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    real = F.when(F.col("script") != "Zyyy", F.col("script"))
    filled = chars.withColumn("s", F.coalesce(F.last(real, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(real, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit("Zyyy")))
    turned = filled.withColumn("turn", (F.col("s") != F.lag("s", 1, "").over(w)).cast("int"))
    islands = turned.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "run").agg(F.first("s").alias("script"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def document_scripts(tagged: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc, scripts): codes by characters over all lines, most first."""
    runs = tagged.select(doc_col, F.explode("runs").alias("r")).where(~F.col("r.script").isin("Zyyy", "Zzzz")).groupBy(doc_col, "r.script").agg(F.sum(F.col("r.end") - F.col("r.start")).alias("n"))
    return runs.groupBy(doc_col).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "script"))), lambda x: x["script"]).alias("scripts"))

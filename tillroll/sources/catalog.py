"""Small driver-side tables and the sinks of a benchmark: capabilities, caches, registry, cases, summary."""

from __future__ import annotations

import glob
import importlib.util
import os
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import envelope, scoring
from tillroll.operators.synth import ENGINES

#: What a result must have, and an error.
RESULT_KEYS = envelope.KEYS
ERROR_KEYS = ("schema_version", "error")


def dataset_registry(spark: SparkSession) -> DataFrame:
    rows = [("seeded_receipts", "active", "operators.synth.generate"), ("rendered_receipts", "active", "operators.receipts.receipts")]
    return spark.createDataFrame(rows, "name string, state string, maker string")


def capabilities(spark: SparkSession) -> DataFrame:
    """name, available and reason of each backend, and the number of CPUs."""
    rows = [(n, True, "built in", os.cpu_count()) for n in ENGINES]
    for module, name in (("pytesseract", "tesseract"), ("paddleocr", "paddleocr")):
        there = importlib.util.find_spec(module) is not None
        rows.append((name, there, "" if there else f"{module} is not installed", os.cpu_count()))
    return spark.createDataFrame(rows, "name string, available boolean, reason string, cpu_count int")


def cache_dir(environment: dict[str, str] | None = None) -> str:
    """The model folder: TILLROLL_CACHE, or tillroll under XDG_CACHE_HOME, or under ~/.cache."""
    env = os.environ if environment is None else environment
    return env.get("TILLROLL_CACHE") or os.path.join(env.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "tillroll")


def model_files(language: str, environment: dict[str, str] | None = None, system: tuple[str, ...] = ("/usr/share/tessdata", "/usr/share/tesseract-ocr/5/tessdata")) -> list[str]:
    """Model files of a language in the cache and the system's folders; without one an error names the folders."""
    folders = [os.path.join(cache_dir(environment), "models"), *system]
    found = [p for folder in folders for p in sorted(glob.glob(os.path.join(glob.escape(folder), f"{glob.escape(language)}.traineddata")))]
    if not found:
        raise FileNotFoundError(f"MODEL_NOT_FOUND: no model of '{language}' in {', '.join(folders)}")
    return found


def cache_info(spark: SparkSession, path: str) -> DataFrame:
    """Number and total size of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_truth(receipts: DataFrame, path: str) -> None:
    receipts.write.partitionBy("language").json(path)


def write_cases(cases: DataFrame, path: str) -> None:
    """One JSON object for each case, in folders by backend and language."""
    cases.write.partitionBy("backend", "language").json(path)


def summary(cases: DataFrame) -> DataFrame:
    """One row of JSON: overall measures and the breakdown, in order of its keys."""
    parts = scoring.breakdown(cases)
    rows = parts.agg(F.array_sort(F.collect_list(F.struct("language", "degradation", "backend", *(c for c in parts.columns if c not in ("language", "degradation", "backend"))))).alias("breakdown"))
    over = scoring.overall(cases)
    return over.select(F.struct(*over.columns).alias("overall")).crossJoin(rows).select(F.to_json(F.struct("overall", "breakdown")).alias("summary"))  # one row each


def check_documents(docs: DataFrame, name_col: str = "name", json_col: str = "content") -> DataFrame:
    """Whether each JSON text has a result's keys, or an error's if its name says so: (name, valid, missing)."""
    keys = F.coalesce(F.json_object_keys(json_col), F.array().cast("array<string>"))
    want = F.when(F.contains(name_col, F.lit("error")), F.array(*map(F.lit, ERROR_KEYS))).otherwise(F.array(*map(F.lit, RESULT_KEYS)))
    missing = F.array_except(want, keys)
    return docs.select(name_col, (F.size(missing) == 0).alias("valid"), missing.alias("missing"))


_RESULT = """struct<schema_version:string,engine:string,mode:string,image:struct<width:double,height:double,format:string>,processing_time_ms:double,languages:array<struct<code:string,confidence:double>>,scripts:array<string>,
    full_text:string,text_lines:array<struct<text:string,bbox:struct<x:double,y:double,width:double,height:double>,confidence:double,status:string>>,warnings:array<string>,fields:map<string,string>>"""


def check_values(docs: DataFrame, name_col: str = "name", json_col: str = "content") -> DataFrame:
    """(name, problems): which values of a result's JSON its schema doesn't allow, sorted; errors are checked for a code and a message.

    A document that is no JSON has the problem ``json``.
    """
    # Parsed once each, in columns that the optimizer doesn't merge: a rule that parses for itself costs a parse for each rule.
    is_error, kinds = F.coalesce(F.contains(name_col, F.lit("error")), F.lit(False)), (_RESULT, "struct<schema_version:string,error:struct<code:string,message:string>>")
    docs = docs.select(name_col, F.col(json_col).alias("_json")).select(name_col, F.json_object_keys("_json").isNull().alias("_junk"), F.when(~is_error, F.from_json("_json", kinds[0])).alias("_r"), F.when(is_error, F.from_json("_json", kinds[1])).alias("_e"))
    r, e = F.col("_r"), F.col("_e")
    share = lambda c: c.isNull() | c.between(0, 1)
    lines, langs, image = r["text_lines"], r["languages"], r["image"]
    rules = {
        "schema_version": r["schema_version"].rlike(r"^[0-9]+[.][0-9]+[.][0-9]+$"), "mode": r["mode"].isin(*envelope.MODES), "image": (image["width"] >= 0) & (image["height"] >= 0) & image["format"].isNotNull(),
        "processing_time_ms": r["processing_time_ms"] >= 0, "languages": F.forall(langs, lambda x: x["code"].isNotNull() & x["confidence"].between(0, 1)), "scripts": F.forall(r["scripts"], lambda x: x.rlike("^[A-Z][a-z]{3}$")),
        "full_text": r["full_text"].isNotNull(), "warnings": r["warnings"].isNotNull(), "fields": r["fields"].isNotNull(),
        "text_lines": F.forall(lines, lambda x: x["text"].isNotNull() & (x["bbox"]["width"] >= 0) & (x["bbox"]["height"] >= 0) & share(x["confidence"]) & (x["status"].isNull() | x["status"].isin(*envelope.STATUSES))),
    }
    failing = lambda checks: F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()))))
    errors = {"code": e["error"]["code"].rlike("^[A-Z_]+$"), "message": e["error"]["message"].isNotNull()}
    bad = F.when(is_error, failing(errors)).otherwise(failing(rules))
    return docs.select(name_col, F.when(F.col("_junk"), F.array(F.lit("json"))).otherwise(bad).alias("problems"))


def doctor(spark: SparkSession, environment: dict[str, str] | None = None) -> DataFrame:
    """One row: the versions in use, which backends are available, and whether the cache's variable is set (not its value)."""
    env = os.environ if environment is None else environment
    have = capabilities(spark).where("available").agg(F.array_sort(F.collect_list("name")).alias("backends"))
    facts = [spark.version, platform.python_version(), "TILLROLL_CACHE" in env, os.path.isdir(cache_dir(env))]
    return have.select(*(F.lit(v).alias(n) for n, v in zip(("spark", "python", "cache_set", "cache_exists"), facts, strict=True)), "backends")

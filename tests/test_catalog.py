"""Registry, capabilities, caches, sinks and the envelope check."""

import json

from pyspark.sql import functions as F

from tillroll.operators import synth
from tillroll.sources import catalog


def test_tables_and_sinks(spark, tmp_path):
    assert catalog.dataset_registry(spark).count() == 2 and catalog.capabilities(spark).where("available").count() >= 1
    assert catalog.cache_dir({"TILLROLL_CACHE": "/x"}) == "/x" and catalog.cache_dir({"XDG_CACHE_HOME": "/y"}) == "/y/tillroll"
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "a").write_bytes(b"123")
    assert tuple(catalog.cache_info(spark, str(tmp_path / "models")).first()) == (1, 3)
    catalog.write_truth(synth.generate(spark.createDataFrame([("en", 1), ("fr", 2)], "language string, seed long")), str(tmp_path / "truth"))
    assert spark.read.json(str(tmp_path / "truth")).count() == 2
    cases = spark.range(10).select(F.lit("en").alias("language"), (F.col("id") % 2).cast("string").alias("degradation"), F.lit("noisy").alias("backend"), F.lit(None).cast("string").alias("error"), *(F.lit(0.5).alias(c) for c in ("cer", "wer", "normalized_edit_distance")), *(F.lit(True).alias(c) for c in ("merchant_match", "date_exact_match", "total_exact_match")), F.lit(2.0).alias("elapsed_ms"))
    catalog.write_cases(cases, str(tmp_path / "cases"))
    got = json.loads(catalog.summary(spark.read.json(str(tmp_path / "cases")).withColumn("degradation", F.col("degradation").cast("string")).withColumn("error", F.lit(None).cast("string"))).first().summary)
    assert got["overall"]["n"] == 10 and [x["degradation"] for x in got["breakdown"]] == ["0", "1"]


def test_envelope_check(spark):
    docs = [("good", json.dumps({k: 1 for k in catalog.RESULT_KEYS})), ("short", "{\"mode\": 1}"), ("an_error", json.dumps({"schema_version": 1, "error": {}})), ("broken", "{")]
    got = {r.name: r.valid for r in catalog.check_documents(spark.createDataFrame(docs, "name string, content string")).collect()}
    assert got == {"good": True, "short": False, "an_error": True, "broken": False}

"""The extractors over a stream: stateless, so the batch functions serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.envelope import fields_json
from tillroll.operators.extraction import extract_fields


def read_lines(spark: SparkSession, path: str, schema: str = "doc_id long, lines array<string>") -> DataFrame:
    """JSON files of line arrays as they arrive."""
    return spark.readStream.schema(schema).json(path)


def to_results(stream: DataFrame) -> DataFrame:
    return extract_fields(stream).select("doc_id", fields_json(F.col("fields")).alias("fields"))


def write_results(stream: DataFrame, path: str, checkpoint: str):
    """Append results as JSON lines; exactly once, by the file sink's log."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

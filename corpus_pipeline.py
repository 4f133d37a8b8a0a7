"""A training corpus from ``documents``: quality, near duplicates, benchmark passages, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last returns the
columns of ``documents``.  The driver writes what a stage returns as Parquet and reads it again
as the next stage's docs; ``run`` does the same in the shared folder.

1. quality: drops rows that the classifier scores below 0.3;
2. near_duplicates: of each component of texts with a five-word Jaccard similarity of 0.8 or more
   keeps the row with the least doc_id; SimHash's links come first, MinHash widens them, for the
   former alone finds few pairs at that similarity;
3. decontaminate: drops rows that hold a span of a benchmark item;
4. secrets: replaces secrets in the texts, and sets n_chars anew;
5. encode: token ids of each text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, decontaminate, near_text, quality_gam, secret_scan
from tillroll.llm._common import staged

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_text.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = secret_scan.redact_secrets(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, public_tokenizers.path(TOKENIZER), ["doc_id", "lang", "source"], with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", benchmark_decontamination), ("secrets", secrets), ("encode", encode)]
#: The classifier and the token ids are beyond SQL; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs

"""Queries over the tables against brute force."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillroll.functions import metrics
from tillroll.operators import fuzzy, tagging

SF = "/root/testdata/sf0.001"


def test_fuzzy_names_equal_brute_force(spark):
    rng = random.Random(3)
    names = ["", " ", "a", "A", "ab", "old anvil", "cold anvil", "Old Anvil ", "é" * 9]
    for n in range(1, 31):
        base = "".join(rng.choice("abcd ") for _ in range(n))
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(1, n // 4 + 2)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice("abcdX") * rng.randrange(2)
            names.append("".join(w))
    df = spark.createDataFrame([(x,) for x in [*names, None]], "name string")
    a = df.where("name is not null").distinct().select(F.col("name").alias("a"))
    want = {tuple(r) for r in a.crossJoin(a.withColumnRenamed("a", "b")).where(F.col("a") != F.col("b")).where(metrics.fuzzy_match(F.col("a"), F.col("b"))).collect()}
    got = [tuple(r) for r in fuzzy.similar_pairs(df, "name").collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want


def test_every_name_has_a_row_and_other_first_words_link(spark):
    got = {r.name: r.n_near for r in entry.queries()["fuzzy_names_whole"](spark, SF).collect()}
    assert len(got) == 62 and sum(got.values()) == 20 and got["old anvil"] == got["cold anvil"] == 1


def test_the_language_model_learns_from_all_documents(spark, monkeypatch):
    seen, train = [], tagging.train
    monkeypatch.setattr(tagging, "train", lambda docs, **k: seen.append(docs.count()) or train(docs, **k))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["document_languages"](spark, SF).collect()}
    lines = spark.read.parquet(f"{SF}/conversations.parquet")
    want = tagging.document_languages(tagging.rank_lines(lines, train(docs), ["conv_id", "turn"]), "conv_id")
    assert seen == [docs.count()] and got == {tuple(r) for r in want.collect()}

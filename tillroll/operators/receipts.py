"""Receipts rendered from a star schema, with their truth: SQL-side test data of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: o_orderkey, description, quantity, unit_price and item_total."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("description"), F.col("p_retailprice").cast(MONEY).alias("unit_price"))
    return items.join(parts, "l_partkey").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "description", "quantity", "unit_price", (F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("item_total"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, nation, lines and the true merchant, date, subtotal, tax and total of each order.

    Lines with equal order and number exist, so items are ordered by all their columns.
    """
    each = F.struct("l_linenumber", "l_partkey", "quantity", F.concat_ws(" ", "description", F.col("quantity").cast("string"), F.col("unit_price").cast("string"), F.col("item_total").cast("string")).alias("line"))
    grouped = order_items(spark, sf_dir).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(each)).alias("items"), F.sum("item_total").cast(MONEY).alias("subtotal"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("merchant"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    df = orders.join(customers, "o_custkey").join(nations, "c_nationkey").join(grouped, "o_orderkey", "left")
    df = df.withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast(MONEY))).withColumn("tax", F.round(F.col("subtotal") * F.lit("0.07").cast("decimal(3,2)"), 2).cast(MONEY))
    df = df.withColumn("total", (F.col("subtotal") + F.col("tax")).cast(MONEY))
    rows = F.coalesce(F.transform("items", lambda x: x["line"]), F.array().cast("array<string>"))
    sums = F.array(*(F.concat(F.lit(f"{label} "), F.col(c).cast("string"), F.lit(tail)) for label, c, tail in (("SUBTOTAL", "subtotal", ""), ("TAX", "tax", ""), ("TOTAL", "total", " USD"))))
    lines = F.concat(F.array("merchant", "nation", F.concat(F.col("date"), F.lit(" 14:35"))), rows, sums)
    return df.select("o_orderkey", "nation", "merchant", "date", "subtotal", "tax", "total", F.size(rows).alias("n_items"), lines.alias("lines"))


def date_in_form(day: Column, key: Column) -> Column:
    """A date in one of four forms by key: ISO, day first, month first, and by name."""
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "d MMMM yyyy")
    return F.coalesce(*(F.when(key % 4 == k, F.date_format(day, f)) for k, f in enumerate(forms)))

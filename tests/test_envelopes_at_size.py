"""Envelopes are parsed once, and the cheap tests before patterns change nothing."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillroll.functions import dates
from tillroll.functions.base import numbered
from tillroll.operators import scan
from tillroll.operators.layout import reading_order

SF = "/root/testdata/sf0.001"
LINES = "doc_id string, lines array<struct<text:string,x:double,y:double,width:double,height:double>>"


def calls(spark, name, *functions):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return [plan.count(f"{f}(") for f in functions]


def test_envelope_problems_parses_a_text_once(spark):
    # One for results and one for errors, of which a row takes one.
    assert calls(spark, "envelope_problems", "from_json", "get_json_object") == [2, 0]


def test_text_with_a_line_separator_stays_in_the_envelope(spark):
    docs = spark.createDataFrame([("a", [("Corner\u2028Store", 0.0, 0.0, 9.0, 9.0), ("Total 1.50", 0.0, 20.0, 9.0, 9.0), ("1,234 Rs 5", 0.0, 40.0, 9.0, 9.0)])], LINES)
    fields = json.loads(scan.scan(docs).first().result)["fields"]
    assert fields["merchant"]["value"] == "Corner\u2028Store" and fields["total"]["value"] == 1.5
    assert fields["currency"]["value"] == {"candidates": ["PKR", "INR", "LKR", "NPR"]}


@pytest.mark.parametrize("boxes", [[(0.0, 5.0), (5.0, 5.0), (10.0, 0.0)], [(0.0, 5.0), (2.0, 5.0), (4.0, 5.0)], [(0.0, float("nan")), (9.0, 5.0)], [(float("nan"), 5.0), (9.0, 5.0)], [(0.0, -5.0), (1.0, 5.0)], [(0.0, None), (1.0, 5.0)], []])
def test_boxes_apart_are_read_as_the_fold_reads_them(spark, boxes):
    """A last pair of boxes in one row, far below, keeps the others from the short way."""
    far = [(1e6, 5.0), (1e6, 5.0)]
    rows = spark.createDataFrame([([(float(k), y, 1.0, h) for k, (y, h) in enumerate(b)],) for b in (boxes, boxes + far)], "b array<struct<x:double,y:double,width:double,height:double>>")
    short, whole = [r.o for r in rows.select(reading_order(F.col("b")).alias("o")).collect()]
    assert short == [k for k in whole if k < len(boxes)]


def test_dates_of_all_forms_pass_the_cheap_test(spark):
    lines = ["2024-3-5", "٢٠٢٤-٠٣-٠٥", "5/3/2024 x", "5 MAR 24", "5 march. 2024", "MAR. 5, 2024", "July\t4 1999", "5 Mar 2024", "25.12.2024", "anvil 12 1050.00", "marble 1 2024", "12-31", "no"]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select("t", dates.date(numbered(F.array("t"))).alias("d"))
    got = {r.t: r.d.value or r.d.candidates for r in rows.collect()}
    day, either = "2024-03-05", ["2024-03-05", "2024-05-03"]
    assert got["2024-3-5"] == got["٢٠٢٤-٠٣-٠٥"] == got["5 MAR 24"] == got["5 march. 2024"] == got["MAR. 5, 2024"] == got["5 Mar 2024"] == day
    assert got["5/3/2024 x"] == either and got["July\t4 1999"] == "1999-07-04" and got["25.12.2024"] == "2024-12-25" and got["anvil 12 1050.00"] is None and got["no"] is None and got["12-31"] is None


def test_result_json_parses_a_text_once(spark):
    assert calls(spark, "result_json", "from_json", "get_json_object") == [1, 0]

"""Golden values of the extractors, layout, tagging and scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tillroll.functions import amounts, dates, labels, metrics
from tillroll.functions.base import numbered
from tillroll.functions.scripts import dominant_scripts, script_runs
from tillroll.operators import envelope, extraction, recognition, scoring, tagging
from tillroll.operators.layout import reading_order


def fields(spark, cases):
    """The fields of lists of lines, as one row for each."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, lines array<string>")
    return [r.fields for r in extraction.extract_fields(df).orderBy("i").collect()]


def test_amounts(spark):
    cases = {"1,234.56": 1234.56, "1.234,56": 1234.56, "12.34": 12.34, "1,234": None, "1.234": None, "1,234,567": 1234567.0, "42": 42.0, "1.5": 1.5, "1.2345": 1.2345, "1,23,456": None, "1.234,567.89": None, "1,1234567": None, "1.1234567": 1.1234567, " 3 000 ": 3000.0, "": None, "abc": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", amounts.parse_amount(F.col("t")).alias("p"))
    for r in df.collect():
        assert r.p.value == cases[r.t] and r.p.ambiguous == (cases[r.t] is None), r


def test_whole_receipts(spark):
    a, b, c, d, e = fields(
        spark,
        [
            ["Corner Store", "2024-03-15 14:35", "Milk 2 1.50 3.00", "Subtotal 3.00", "Tax 0.30", "Total 3.30", "Paid by CASH"],
            ["Corner Store", "Milk 3.00", "Paid by CASH"],
            ["Corner Store", "Subtotal 10.00", "Tax 1.00", "Paid by CASH"],
            [],
            None,
        ],
    )
    assert (a.merchant.value, a.date.value, a.time.value, a.total.num, a.total.evidence, a.payment_method.value, len(a.line_items)) == ("Corner Store", "2024-03-15", "14:35:00", 3.3, [5], "cash", 1)
    assert b.total.status == "missing" and b.total.num is None
    assert (c.total.status, c.total.num, c.total.evidence) == ("inferred_field", 11.0, [1, 2])
    assert d.total.status == e.total.status == "missing" and d.line_items == [] and a.merchant_address.status == "missing"


def test_amount_fields_and_known_odd_results(spark):
    got = fields(spark, [["Total: [illegible]"], ["Subtotal 100.00", "Discount 10.00", "Tax 9.00"], ["Wireless mouse 5.00"], ["Private label 2.00"], ["Total 1,234", "9.99"], ["TOTAL", "9.99"], ["Sub total 5.00", "Grand Total 6.00"], ["المجموع 100.00"]])
    assert (got[0].total.status, got[0].total.evidence) == ("uncertain", [0])
    assert got[1].total.num == 99.0 and got[1].total.evidence == [0, 1, 2]
    assert got[2].discounts.num == 5.0 and got[2].line_items == [] and got[3].tax.num == 2.0
    assert got[4].total.status == "uncertain" and (got[5].total.num, got[5].total.evidence) == (9.99, [0, 1])
    assert got[6].total.num == 6.0 and got[6].subtotal.num == 5.0 and got[7].total.num == 100.0


@pytest.mark.parametrize(
    ("line", "status", "value"),
    [("2024-3-5", "ok", "2024-03-05"), ("25/03/2024", "ok", "2024-03-25"), ("03/25/24", "ok", "2024-03-25"), ("03/04/25", "uncertain", "2025-04-03|2025-03-04"), ("4.4.2024", "ok", "2024-04-04"), ("32/13/2024", "missing", None), ("15 March 2024", "ok", "2024-03-15"), ("Mar. 5, 24", "ok", "2024-03-05"), ("15 Marble 2024", "ok", "2024-03-15"), ("0000-01-05", "ok", "0000-01-05"), ("2023-02-29", "missing", None), ("1/2/123", "uncertain", "0123-02-01|0123-01-02"), ("12 items 2024 03/04/25", "missing", None), ("٢٥/٠٣/٢٠٢٤", "ok", "2024-03-25"), ("none", "missing", None)],
)
def test_dates(spark, line, status, value):
    f = spark.createDataFrame([(["x", line],)], "lines array<string>").select(dates.date(numbered(F.col("lines"))).alias("d")).first().d
    assert (f.status, f.value or ("|".join(f.candidates) if f.candidates else None)) == (status, value)


def test_times_currencies_and_labels(spark):
    times = {"14:35": "14:35:00", "2:35 PM": "14:35:00", "12:05 am": "00:05:00", "25:10": None, "13:00 PM": None, "10:75": None, "9:05:07": "09:05:07", "no": None}
    money = {"$5": "USD", "€5": "EUR", "₹5": "INR", "500 PKR $": "PKR", "¥5": "JPY|CNY", "none": None, "CA$5": "AUD", "US$5": "SGD", "₪5 ILS": None, "Rs 5": "PKR|INR|LKR|NPR", "XUSD": None}
    pays = {"VISA **** 1234": "visa", "Checkout lane 3": "cheque", "Credit": "credit_card", "x": None}
    shop = {"Receipt #: A1234-5": "A1234-5", "Invoice No 77": None, "Order # B/77-1 ": "B/77-1", "nothing": None}
    one = lambda f, cases: {r.t: r.f for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", f(numbered(F.array("t"))).alias("f")).collect()}
    for f, cases in ((dates.time_of_day, times), (labels.currency, money), (labels.payment_method, pays), (labels.receipt_number, shop)):
        for t, got in one(f, cases).items():
            assert (got.value or ("|".join(got.candidates) if got.candidates else None)) == cases[t], t
    got = fields(spark, [["Receipt", "12/34", "x", "Shop  "], ["Ref no", "ZX-900"], ["Subtotal $10.00", "Total: 1500 PKR"]])
    assert got[0].merchant.value == "Shop" and (got[1].receipt_number.value, got[1].receipt_number.evidence) == ("ZX-900", [0, 1]) and got[2].currency.value == "PKR"


def test_line_items(spark):
    got = fields(spark, [["Milk 2 1.50 3.00", "Gift wrap 5.00", "Odd 2 3.00 9.00", "Total 3.00", "7 8", "Pair 4 2.50", "Bad 1,234"]])[0].line_items
    assert [(r.line, r.description, r.quantity, r.quantity_status, r.unit_price, r.item_total, r.status) for r in got] == [(0, "Milk", 2.0, "ok", 1.5, 3.0, "ok"), (1, "Gift wrap", 1.0, "inferred_field", None, 5.0, "ok"), (2, "Odd", 1.0, "inferred_field", 3.0, 9.0, "uncertain"), (5, "Pair", 1.0, "inferred_field", 4.0, 2.5, "ok")]


def order_by_hand(boxes, rtl):
    rows = []
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][1] + boxes[i][3] / 2):
        for row in rows:
            a, b = boxes[row[-1]], boxes[i]
            if min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]) > 0.5 * (min(a[3], b[3]) or 1.0):
                row.append(i)
                break
        else:
            rows.append([i])
    return [i for row in rows for i in sorted(row, key=lambda i: boxes[i][0], reverse=sum(rtl[i] for i in row) > len(row) / 2)]


def test_reading_order_equals_brute_force(spark):
    rng = random.Random(6)
    cases = [([], [])]
    for _ in range(60):
        n = rng.randint(1, 12)
        cases.append(([(float(rng.randint(0, 5)), float(rng.randint(0, 90)), 50.0, float(rng.choice([0, 10, 20, 30]))) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, b array<struct<x:double,y:double,width:double,height:double>>, r array<boolean>")
    for r in df.select("i", reading_order(F.col("b"), F.col("r")).alias("o")).collect():
        assert r.o == order_by_hand(*cases[r.i])


def test_evidence_names_the_given_lines(spark):
    lines = [("Total 9.99", 10.0, 60.0), ("Corner Store", 10.0, 0.0), ("Milk 9.99", 10.0, 30.0)]
    df = spark.createDataFrame([([(t, x, y, 50.0, 20.0) for t, x, y in lines],)], "lines array<struct<text:string,x:double,y:double,width:double,height:double>>")
    f = extraction.extract_fields(df).first().fields
    assert f.total.evidence == [0] and f.merchant.evidence == [1] and f.line_items[0].line == 2


def test_scripts(spark):
    cases = {"12 மோத TOTAL 100": ([("Taml", 0, 7), ("Latn", 7, 16)], ["Latn", "Taml"]), "123.45": ([("Zyyy", 0, 6)], []), "MILK 3.49": ([("Latn", 0, 9)], ["Latn"]), "中あア가": ([("Hani", 0, 1), ("Hira", 1, 2), ("Kana", 2, 3), ("Hang", 3, 4)], ["Hani", "Hira", "Kana", "Hang"]), "": ([], [])}
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("r", script_runs(F.col("t")))
    for r in df.select("t", "r", dominant_scripts(F.col("r")).alias("d")).collect():
        assert ([tuple(x) for x in r.r], r.d) == cases[r.t]


def test_languages_vote_to_one(spark):
    docs = spark.createDataFrame([("en", "the cat and the dog went to the market with the children " * 20), ("fr", "le chat et le chien sont dans la maison avec les enfants " * 20)], "lang string, text string")
    model = tagging.train(docs)
    lines = spark.createDataFrame([(1, 0, "the children went to the market"), (1, 1, "les enfants sont dans la maison"), (2, 0, "short")], "doc_id int, line int, text string")
    ranked = tagging.rank_lines(lines, model, ["doc_id", "line"])
    assert {(r.line, r.code) for r in tagging.identify(ranked, ["doc_id", "line"]).collect()} == {(0, "en"), (1, "fr")}
    shares = tagging.document_languages(ranked).collect()
    assert {r.doc_id for r in shares} == {1} and math.isclose(sum(r.confidence for r in shares), 1, abs_tol=1e-3)


def test_error_rates(spark):
    row = spark.createDataFrame([("kitten", "sitting", "", "abc", "a b c", "a x c", "Golden Market", " golden markett", "")], "a string, b string, c string, d string, e string, f string, g string, h string, i string")
    got = row.select(metrics.cer(F.col("a"), F.col("b")), metrics.cer(F.col("c"), F.col("d")), metrics.wer(F.col("e"), F.col("f")), metrics.fuzzy_match(F.col("g"), F.col("h")), metrics.cer(F.col("c"), F.col("i")), metrics.fuzzy_match(F.col("c"), F.lit("  ")), metrics.fuzzy_match(F.col("a"), F.col("b"))).first()
    assert list(got) == [0.5, 1.0, 1 / 3, True, 0.0, True, False]


def test_escalation_and_choice(spark):
    cases = [("auto", [], True), ("auto", [0.4, 0.5], True), ("auto", [0.5], False), ("fast", [], False), ("accurate", [0.1], False)]
    df = spark.createDataFrame(cases, "m string, c array<double>, want boolean")
    assert all(r.got == r.want for r in df.select("want", recognition.should_escalate(F.col("m"), F.col("c")).alias("got")).collect())
    first = spark.createDataFrame([(1, ["a"], ["w"]), (2, [], ["w"]), (3, ["a", "b"], ["w"])], "doc_id int, lines array<string>, warnings array<string>")
    second = spark.createDataFrame([(1, ["z"], []), (2, [], []), (3, ["z"], [])], "doc_id int, lines array<string>, warnings array<string>")
    assert {r.doc_id: r.escalated for r in recognition.choose_pass(first, second).collect()} == {1: True, 2: False, 3: False}


def test_words_to_lines(spark):
    words = [(1, 1, 1, 1, 2, 30, 0, 20, 10, 39.0, "b"), (1, 1, 1, 1, 1, 0, 2, 20, 10, -1.0, "a"), (1, 1, 1, 1, 3, 60, 0, 9, 9, 90.0, " "), (1, 2, 1, 1, 1, 0, 50, 20, 10, 40.0, "c")]
    got = recognition.words_to_lines(spark.createDataFrame(words, "doc_id int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string")).orderBy("block_num").collect()
    assert [(r.text, r.x, r.y, r.width, r.height, round(r.confidence, 4), r.status) for r in got] == [("a b", 0, 0, 50, 12, 0.195, "uncertain"), ("c", 0, 50, 20, 10, 0.4, "ok")]


def test_plan_seeds_and_choices(spark):
    import hashlib

    plan = scoring.case_plan(spark, "fr,en,fr", "clean,crop", samples=2, seed_base=5, max_cases=3).collect()
    seed = lambda lang, k: 5 + int.from_bytes(hashlib.sha256(f"{lang}:{k}".encode()).digest()[:8], "big") % 1_000_000
    assert [(r.language, r["sample"], r.degradation, r.seed) for r in plan] == [("fr", 0, "clean", seed("fr", 0)), ("fr", 0, "crop", seed("fr", 0)), ("fr", 1, "clean", seed("fr", 1))]
    with pytest.raises(ValueError):
        scoring.choose("xx", scoring.LANGUAGES)


def test_envelope(spark):
    import json

    df = spark.createDataFrame([(["Shop A", "03/04/25", "Total 3.30"],)], "lines array<string>")
    got = json.loads(extraction.extract_fields(df).select(envelope.fields_json(F.col("fields"))).first()[0])
    assert got["total"] == {"status": "ok", "value": 3.3, "confidence": 0.8, "evidence": {"text_line_indices": [2]}} and "tax" not in got and "line_items" not in got
    assert got["date"]["value"] == {"candidates": ["2025-04-03", "2025-03-04"]} and got["merchant"]["value"] == "Shop A"

"""Queries of the receipt operators over the driver's tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions import amounts, dates, labels, metrics
from tillroll.functions.base import numbered
from tillroll.functions import base, keywords
from tillroll.operators import envelope, extraction, fuzzy, matrix, recognition, scan, scoring, tagging
from tillroll.operators.layout import overlapping_pairs, reading_order
from tillroll.operators.receipts import date_in_form, order_items, receipts, table


def _money(c: str) -> F.Column:
    return F.round(F.col(c), 2)


# ---- receipts from the star schema ----


def receipt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts(spark, sf_dir).select("o_orderkey", F.array_join("lines", "\n").alias("full_text"), "n_items")


def totals_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many receipts' extracted totals equal the truth, by nation."""
    r = receipts(spark, sf_dir).withColumn("f", amounts.total(numbered(F.col("lines"))))
    return r.groupBy("nation").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("f.num") - F.col("total")) < 0.005).alias("n_equal"), F.round(F.sum("f.num"), 2).alias("extracted"))


def labeled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = extraction.extract_fields(receipts(spark, sf_dir).select("o_orderkey", "lines"))
    return f.select("o_orderkey", F.col("fields.subtotal.num").alias("subtotal"), F.col("fields.tax.num").alias("tax"), F.col("fields.total.num").alias("total"), F.col("fields.total.status").alias("status"), F.get("fields.total.evidence", F.lit(0)).alias("line"), F.col("fields.discounts.status").alias("discount_status"))


def inferred_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = receipts(spark, sf_dir).select("o_orderkey", F.filter("lines", lambda t: ~t.startswith("TOTAL")).alias("lines"))
    f = extraction.extract_fields(r).select("o_orderkey", "fields.total.*")
    return f.select("o_orderkey", "status", F.col("num").alias("total"), "confidence", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


def dates_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.lit("On "), date_in_form(F.col("o_orderdate"), F.col("o_orderkey")), F.lit(" at "), F.when(F.col("o_orderkey") % 2 == 0, "2:05 PM").otherwise("09:07:30"))
    n = o.select("o_orderkey", numbered(F.array(F.lit("Shop"), line)).alias("n"))
    f = n.select("o_orderkey", dates.date(F.col("n")).alias("d"), dates.time_of_day(F.col("n")).alias("t"))
    return f.select("o_orderkey", F.col("d.status").alias("status"), F.col("d.value").alias("date"), F.array_join("d.candidates", "|").alias("candidates"), F.col("t.value").alias("time"))


def currency_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    marks = ["$5.00", "€ 5", "£5 and ₹5", "¥5", "Rs 5", "5 PKR, 7 EUR", "CA$5", "5.00"]
    mark = lambda shift: F.get(F.array(*map(F.lit, marks)), ((F.col("o_orderkey") + shift) % len(marks)).cast("int"))
    n = o.select("o_orderkey", labels.currency(numbered(F.array(mark(0), mark(0), mark(3)))).alias("c"))
    return n.select("o_orderkey", "c.status", F.coalesce("c.value", F.array_join("c.candidates", "|")).alias("currency"), F.size("c.evidence").cast("long").alias("n_lines"))


def merchant_payment_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    pay = F.get(F.array(*map(F.lit, ("Paid by VISA **** 1234", "CASH", "Debit Card", "checkout lane", "thanks"))), (F.col("o_orderkey") % 5).cast("int"))
    lines = F.array(F.lit("Receipt no: "), F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")), F.lit("12/34"), F.col("c_name"), pay)
    n = o.select("o_orderkey", numbered(lines).alias("n"))
    f = n.select("o_orderkey", labels.merchant(F.col("n")).alias("m"), labels.payment_method(F.col("n")).alias("p"), labels.receipt_number(F.col("n")).alias("r"))
    return f.select("o_orderkey", F.col("m.value").alias("merchant"), F.col("m.status").alias("merchant_status"), F.col("p.value").alias("payment"), F.col("r.value").alias("number"), F.col("r.confidence").alias("confidence"))


def line_items_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of whole receipts; by the rules a merchant or nation with a number in its name reads as one."""
    r = receipts(spark, sf_dir).select("o_orderkey", "lines")
    return extraction.exploded_items(r, ["o_orderkey"]).select("o_orderkey", "line", "description", "quantity", "quantity_status", "unit_price", "item_total", "status")


def item_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that don't multiply: quantity is inferred and the status uncertain."""
    lines = F.array(F.concat_ws(" ", "description", F.col("quantity").cast("string"), F.col("unit_price").cast("string"), (F.col("item_total") + 1).cast("string")))
    items = order_items(spark, sf_dir).groupBy("description", "quantity", "unit_price", "item_total").count()
    found = extraction.exploded_items(items.withColumn("lines", lines), ["description", "item_total", "count"]).toDF("name", "true_total", "n_rows", "line", "status", "description", "quantity", "quantity_status", "unit_price", "item_total")
    return found.groupBy("status", "quantity_status").agg(F.sum("n_rows").alias("n"), F.round(F.sum(F.col("item_total") * F.col("n_rows")), 2).alias("total"), F.count_if(F.col("name") == F.col("description")).alias("n_named"))


def amount_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", amounts.find_amounts(F.coalesce("text", F.lit(""))).alias("tokens"))
    d = d.select("doc_id", "tokens", F.transform("tokens", amounts.amount_value).alias("v"))
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("v", lambda x: x.isNull())).cast("long").alias("n_ambiguous"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"))


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
    forms = F.array(F.col("p").cast("string"), F.replace(F.col("p").cast("string"), F.lit("."), F.lit(",")), F.regexp_replace(F.col("p").cast("string"), r"(\d)(?=(\d{3})+\.)", "$1,"), F.regexp_extract(F.col("p").cast("string"), r"^(\d+)", 1), F.lit("1,234"))
    v = li.select("p", F.posexplode(forms).alias("form", "token")).withColumn("v", amounts.amount_value(F.col("token")))
    return v.groupBy("form").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_ambiguous"), F.count_if(F.abs(F.col("v") - F.col("p")) < 1).alias("n_near"))


# ---- text ----


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a label word, and the lines after them, by windows."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    w = Window.partitionBy("doc_id").orderBy("line")
    return lines.withColumn("after", F.lead("text").over(w)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.length("text") == 0).alias("n_empty"), F.max(F.length("text")).alias("longest"), F.count_if(F.col("after") == F.col("text")).alias("n_twice"))


def dominant_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts of each page's address."""
    p = tagging.tag_lines(table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    return p.select("page_id", F.array_join("scripts", ",").alias("scripts"), F.size("runs").cast("long").alias("n_runs"), "rtl")


def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and scripts of every whole text."""
    d = tagging.tag_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.array_join("scripts", ",").alias("scripts"), F.size("runs").cast("long").alias("n_runs"), F.get("runs", F.lit(0))["end"].alias("first_end"), "rtl")


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts with a word of totals or taxes, first and all."""
    n = table(spark, sf_dir, "documents").select("doc_id", base.numbered(F.split("text", "\n")).alias("n"))
    found = n.select("doc_id", base.all_lines(F.col("n"), keywords.TOTAL + keywords.TAX + keywords.DISCOUNT).alias("f"), base.first(F.col("n"), lambda x: base.contains_any(x["l"], ("licen", "password", "token")))["i"].alias("first_word"))
    return found.select("doc_id", F.size("f").cast("long").alias("n_lines"), F.get("f", F.lit(0)).alias("first_line"), F.array_join(F.col("f").cast("array<string>"), ",").alias("lines"), "first_word")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's different lines, in order of their first."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.sha2(F.array_join("l", "\n"), 256).alias("lines_sha256"))


def script_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs from one row for each character."""
    from tillroll.functions.scripts import char_script

    chars = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.filter(F.split(F.concat(F.lit("12 é"), "n_name", F.lit("中文 3")), ""), lambda c: c != "")).alias("pos", "c"))
    return tagging.script_segments(chars.withColumn("script", char_script(F.col("c"))), ["n_nationkey"]).select("n_nationkey", "script", "start", "end")


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tagging.train(table(spark, sf_dir, "documents"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ranked = tagging.rank_lines(lines, model, ["conv_id", "turn"])
    return tagging.document_languages(ranked, "conv_id")


def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("ref"))
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("ref").alias("hyp"))
    j = p.join(q, "p_partkey")
    return j.select("p_partkey", F.round(metrics.cer(F.col("ref"), F.col("hyp")), 6).alias("cer"), F.round(metrics.normalized_distance(F.col("ref"), F.col("hyp")), 6).alias("ned"), F.round(metrics.wer(F.col("ref"), F.col("hyp")), 6).alias("wer"))


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a letter lost, joined fuzzily to the true ones: how many each is like, and the best."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    at = (F.col("p_partkey") % F.length("name")).cast("int")
    lost = names.select(F.concat(F.expr("substring(name, 1, cast(p_partkey % length(name) as int))"), F.substring("name", at + 2, F.length("name"))).alias("name")).distinct()
    near = fuzzy.fuzzy_join(lost, names, "name")
    best = F.min(F.struct(F.levenshtein(F.lower("a"), F.lower("b")).alias("d"), "b"))["b"]
    return near.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("n_near"), best.alias("best"))


def fuzzy_names_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name with the number of its similar names, and of their rows."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    near = fuzzy.similar_pairs(names, "name").join(names.select(F.col("name").alias("b"), F.col("n").alias("m")), "b")
    linked = near.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("n_near"), F.sum("m").alias("n_rows"))
    return names.select("name").join(linked, "name", "left").select("name", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


# ---- recognition ----


def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[ \n]")).alias("pos", "text"))
    k, n = F.col("pos"), F.length("text")
    words = w.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("block_num"), (k / 24).cast("int").alias("par_num"), (k / 8).cast("int").alias("line_num"), (k % 8).alias("word_num"), ((k % 8) * 60).alias("left"), ((k / 8).cast("int") * 30).alias("top"), (n * 7).alias("width"), F.lit(20).alias("height"), ((n * 37) % 101 - 1).alias("conf"), "text")
    lines = recognition.words_to_lines(words)
    return lines.select("doc_id", "line_num", "text", "x", "y", "width", "height", F.round("confidence", 6).alias("confidence"), "status", F.col("n_words").cast("long").alias("n_words"))


def escalate_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    made = lambda n, mark: F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(mark), i.cast("string")))
    k = F.col("doc_id")
    first = o.select("doc_id", made(k % 4, "a").alias("lines"), F.array(F.lit("w1")).alias("warnings"), F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: ((k % 10) / 10.0)).alias("confs"))
    second = first.where(recognition.should_escalate(F.lit("auto"), F.when(F.size("lines") > 0, F.col("confs")).otherwise(F.array().cast("array<double>")))).select("doc_id", made((k * 7) % 5, "b").alias("lines"), F.array().cast("array<string>").alias("warnings"))
    got = recognition.choose_pass(first, second)
    return got.select("doc_id", "escalated", F.array_join("lines", ",").alias("text"), F.array_join("warnings", ",").alias("warnings"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 300).alias("blur"), (F.col("event_id") * 53 % 90).alias("contrast"), (F.col("event_id") * 71 % 256).alias("brightness"))
    flags = e.select("event_id", (F.col("blur") < 100).alias("blurry"), (F.col("contrast") < 40).alias("low"), ((F.col("brightness") < 60) | (F.col("brightness") > 225)).alias("lit"))
    return flags.select("event_id", recognition.decide_mode(F.lit("auto"), F.col("blurry"), F.col("low"), F.col("lit")).alias("m")).select("event_id", "m.mode", "m.reason")


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 7).alias("k"))
    size = F.when(p.k == 0, None).when(p.k == 1, 0).when(p.k == 2, 60 * 1024 * 1024).otherwise(1000)
    load = envelope.load_error(size, F.when(p.k == 3, "GIF").otherwise("PNG"), F.when(p.k == 4, 30_000).when(p.k == 5, 9_000).otherwise(100), F.when(p.k == 5, 9_000).otherwise(100))
    return p.select("page_id", load.alias("load_error"), envelope.error_code(load).alias("code"))


def reading_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order's lines, two to a row, given in order of part."""
    li = table(spark, sf_dir, "lineitem")
    box = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", ((F.col("l_linenumber") % 2) * 100.0).alias("x"), (F.floor(F.col("l_linenumber") / 2) * 30.0).alias("y"), F.lit(50.0).alias("width"), F.lit(20.0).alias("height"))
    o = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("b"))
    return o.select("l_orderkey", F.array_join(F.transform(reading_order(F.col("b")), lambda i: F.get("b", i)["l_linenumber"].cast("string")), ",").alias("numbers"))


def row_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order's boxes that share a row, by an interval join."""
    box = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), (F.col("l_partkey") % 90 * 1.0).alias("y"), (F.col("l_linenumber") % 4 * 15.0).alias("height"))
    pairs = overlapping_pairs(box, box, ["l_orderkey"]).where(F.col("id") < F.col("other"))
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("id.l_linenumber") * 10 + F.col("other.l_linenumber")).cast("long").alias("numbers"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda t, i: F.struct(t.alias("text"), F.lit(10.0).alias("x"), (i * 30.0).alias("y"), F.lit(50.0).alias("width"), F.lit(20.0).alias("height"), F.lit(0.9).alias("confidence"), F.lit("ok").alias("status"))
    return scan.scan(receipts(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.transform("lines", box).alias("lines")))


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in the envelopes of scanned receipts."""
    kind = """struct<mode:string,scripts:array<string>,full_text:string,text_lines:array<struct<bbox:struct<y:double>,script:string>>,
        fields:struct<total:struct<value:double,status:string,evidence:struct<text_line_indices:array<int>>>,date:struct<value:string>,discounts:string,merchant:struct<value:string>>>"""
    # One parse of the whole envelope: it is a column of its own, so that no path below parses again.
    j = _scanned(spark, sf_dir).select("doc_id", F.json_object_keys("result").alias("keys"), F.from_json("result", kind).alias("j")).select("doc_id", "keys", "j.*")
    line = lambda k: F.get("text_lines", F.lit(k))
    return j.select(
        "doc_id", F.array_join("keys", ",").alias("keys"), F.sha2("full_text", 256).alias("full_text_sha256"), F.array_size("text_lines").cast("long").alias("n_lines"), line(2)["bbox"]["y"].alias("y"),
        line(0)["script"].alias("first_script"), line(2)["script"].alias("date_script"), F.get("scripts", F.lit(0)).alias("script"), F.col("fields.total.value").alias("total"), F.col("fields.total.status").alias("total_status"),
        F.get("fields.total.evidence.text_line_indices", F.lit(0)).alias("total_line"), F.col("fields.date.value").alias("date"), F.col("fields.discounts").alias("discounts"), F.col("fields.merchant.value").alias("merchant"), "mode",
    )


def envelope_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned receipts and damaged ones against the schema."""
    from tillroll.sources.catalog import check_values

    r, k = F.col("result"), F.col("doc_id") % 6
    damaged = F.when(k == 0, r).when(k == 1, F.regexp_replace(r, '"mode":"auto"', '"mode":"slow"')).when(k == 2, F.regexp_replace(r, '"status":"ok","script"', '"status":"odd","script"')).when(k == 3, F.substring(r, 1, 40)).when(k == 4, F.regexp_replace(r, '"schema_version":"[^"]*",', "")).otherwise(envelope.error_json(F.lit("OCR_FAILED"), F.when(F.col("doc_id") % 4 == 1, "no")))
    docs = _scanned(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.when(k == 5, "-error").otherwise("")).alias("name"), damaged.alias("content"))
    return check_values(docs).select("name", F.array_join("problems", ",").alias("problems"))


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats, sizes and loader errors of headers made from parts' numbers."""
    from tillroll.images.stage import from_content

    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 30_000).cast("int").alias("w"), (F.col("p_size") * 200).cast("int").alias("h"))
    big = lambda c, n: F.lpad(F.hex(F.col(c)), 2 * n, "0")
    little = lambda c, n: F.concat(*(F.substring(big(c, n), 2 * n - 2 * k - 1, 2) for k in range(n)))
    less = p.withColumns({"w1": F.greatest(F.col("w") - 1, F.lit(0)), "h1": F.col("h") - 1})
    k = F.col("p_partkey") % 7
    made = (
        F.when(k == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big("w", 4), big("h", 4), F.lit("0802000000"))).when(k == 1, F.concat(F.lit("424D" + "00" * 16), little("w", 4), little("h", 4), F.lit("01001800")))
        .when(k == 2, F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), big("h", 2), big("w", 2), F.lit("03012200021101031101"))).when(k == 3, F.concat(F.lit("49492A00080000000200000104000100000"), F.lit("0"), little("w", 4), F.lit("0101040001000000"), little("h", 4)))
        .when(k == 4, F.concat(F.lit("52494646000000005745425056503858" + "0A00000000000000"), little("w1", 3), little("h1", 3))).when(k == 5, F.concat(F.lit("474946383961"), little("w", 2), little("h", 2))).otherwise("68656C6C6F")
    )
    return from_content(less.select("p_partkey", F.unhex(made).alias("content"))).select("p_partkey", "format", "width", "height", "error")


# ---- benchmark cases and the language matrix ----


def case_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.case_plan(spark, samples=4, seed_base=7)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact table of cases with the shape of the benchmark's."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    part = lambda n, m: (k * n % m) / F.lit(float(m))
    return e.select(F.col("event_type").alias("language"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("degradation"), F.lit("sim").alias("backend"), F.when(k % 11 == 0, "x").alias("error"), part(37, 128).alias("cer"), part(53, 128).alias("wer"), part(71, 128).alias("normalized_edit_distance"), F.when(k % 5 != 0, k % 2 == 0).alias("merchant_match"), (k % 3 == 0).alias("date_exact_match"), (k % 4 == 0).alias("total_exact_match"), (k % 64).cast("double").alias("elapsed_ms"))


def accuracy_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.breakdown(_cases(spark, sf_dir))


def accuracy_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.overall(_cases(spark, sf_dir))


def accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.breakdown_sets(_cases(spark, sf_dir), [("language",), ("degradation",), ()])


def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction scored against the truth, every seventh receipt being unread."""
    r = receipts(spark, sf_dir).select(F.col("o_orderkey").alias("case_id"), F.concat_ws(" ", "merchant", "nation").alias("text"), "merchant", "date", F.col("total").cast("double").alias("total"), "lines")
    f = extraction.extract_fields(r).select("case_id", "text", F.col("fields.merchant.value").alias("merchant"), F.col("fields.date.value").alias("date"), F.col("fields.total.num").alias("total"), F.when(F.col("case_id") % 7 == 0, "OCR_FAILED").alias("error"))
    return scoring.score_cases(f, r.drop("lines"))


def backend_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix.language_matrix(spark)
    return m.select("code", scoring.backend_code(F.col("code"), "tesseract").alias("tesseract"), scoring.backend_code(F.col("code"), "paddleocr").alias("paddle"))


def matrix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.by_script(matrix.supported(matrix.language_matrix(spark)))


def matrix_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mandatory languages, those installed and those missing, if the corpus's languages were the packs."""
    m = matrix.language_matrix(spark)
    packs = matrix.installed(table(spark, sf_dir, "documents").select(F.col("lang").alias("code")), spark.createDataFrame([("en",), ("ur",)], "code string"))
    have, lack = matrix.mandatory_installed(m, packs), matrix.mandatory_missing(m, packs)
    return have.withColumn("state", F.lit("installed")).union(lack.withColumn("state", F.lit("missing")))


def top_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's most frequent languages as a view shows them."""
    d = table(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("code")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("source")
    share = d.withColumn("confidence", F.round(F.col("c") / F.sum("c").over(w), 4)).withColumn("position", F.row_number().over(w.orderBy(F.desc("c"), "code")))
    return tagging.top_languages(share, "source", k=2)


QUERIES = {
    f.__name__: f
    for f in (receipt_render, totals_by_nation, labeled_amounts, inferred_total, dates_times, currency_vote, merchant_payment_number, line_items_exploded, item_totals, amount_tokens, amount_parse, line_stats, dominant_script, document_scripts, keyword_lines, dedup_first, script_windows, document_languages, char_error_rate, fuzzy_names, fuzzy_names_whole, words_to_lines, escalate_select, quality_gate, error_codes, reading_order_rows, row_overlaps, result_json, envelope_problems, image_headers, case_plan, accuracy_breakdown, accuracy_overall, accuracy_grouping_sets, score_cases, backend_codes, matrix_filter, matrix_sets, top_languages)
}


# ---- pictures and simulated recognition ----


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages drawn, degraded in all ways, prepared and judged."""
    from tillroll.images.stage import prepare, sample_images

    seeds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seed"))
    bad = spark.createDataFrame([(d,) for d in scoring.DEGRADATIONS], "degradation string")
    cases = sample_images(seeds).crossJoin(bad)  # both sides are short lists
    return prepare(cases, ["seed", "degradation"]).select("seed", "degradation", "mode", F.array_join("steps", ",").alias("steps"), "width", "height", "needs_accurate_mode")


def simulated_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts from seeds, misread, extracted and scored against their truth."""
    from tillroll.operators import synth

    langs = F.array(*map(F.lit, sorted(synth.BANKS)))
    cases = table(spark, sf_dir, "customer").select(F.get(langs, (F.col("c_custkey") % len(synth.BANKS)).cast("int")).alias("language"), F.col("c_custkey").alias("seed"))
    truth = synth.generate(cases)
    read = extraction.extract_fields(synth.recognize(truth))
    hyp = read.select(F.col("seed").alias("case_id"), F.array_join("lines", "\n").alias("text"), F.col("fields.merchant.value").alias("merchant"), F.col("fields.date.value").alias("date"), F.col("fields.total.num").alias("total"), F.lit(None).cast("string").alias("error"))
    scored = scoring.score_cases(hyp, truth.select(F.col("seed").alias("case_id"), F.array_join("lines", "\n").alias("text"), "merchant", "date", "total"))
    full = scored.join(cases.select(F.col("seed").alias("case_id"), "language"), "case_id").withColumns({"degradation": F.lit("noisy"), "backend": F.lit("noisy"), "elapsed_ms": F.lit(0.0)})
    return scoring.breakdown(full)


QUERIES |= {f.__name__: f for f in (image_quality, simulated_accuracy)}

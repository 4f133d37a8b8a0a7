"""Writing systems of characters, runs and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.base import let

#: Script name and ISO 15924 code.
SCRIPTS = (
    ("Latin", "Latn"), ("Arabic", "Arab"), ("Devanagari", "Deva"), ("Tamil", "Taml"), ("Telugu", "Telu"), ("Bengali", "Beng"), ("Gurmukhi", "Guru"), ("Gujarati", "Gujr"), ("Kannada", "Knda"), ("Malayalam", "Mlym"),
    ("Oriya", "Orya"), ("Sinhala", "Sinh"), ("Han", "Hani"), ("Hiragana", "Hira"), ("Katakana", "Kana"), ("Hangul", "Hang"), ("Thai", "Thai"), ("Lao", "Laoo"), ("Myanmar", "Mymr"), ("Khmer", "Khmr"), ("Tibetan", "Tibt"),
    ("Cyrillic", "Cyrl"), ("Greek", "Grek"), ("Hebrew", "Hebr"), ("Armenian", "Armn"), ("Georgian", "Geor"), ("Ethiopic", "Ethi"), ("Thaana", "Thaa"), ("Cherokee", "Cher"), ("Canadian_Aboriginal", "Cans"),
)
COMMON, UNKNOWN, RIGHT_TO_LEFT = "Zyyy", "Zzzz", ("Arab", "Hebr", "Thaa")
_COMMON = r"^[\s\p{IsCommon}\p{IsInherited}]*$"


def char_script(c: Column) -> Column:
    """ISO 15924 code of one character, by the JVM's Unicode tables; white space and common signs are Zyyy, other scripts Zzzz."""
    out = F.when(c.rlike(r"(?U)" + _COMMON), COMMON).when(c.rlike(r"^[A-Za-z]"), "Latn")
    for name, code in SCRIPTS:
        out = out.when(c.rlike(rf"^\p{{Is{name}}}"), code)
    return out.otherwise(UNKNOWN)


#: Stretches of characters of one kind: a script, common ones, or others.
_TOKENS = r"(?U)" + "|".join([rf"\p{{Is{name}}}+" for name, _ in SCRIPTS] + [r"[\s\p{IsCommon}\p{IsInherited}]+", r"[^\s\p{IsCommon}\p{IsInherited}" + "".join(rf"\p{{Is{name}}}" for name, _ in SCRIPTS) + "]+"])
_ASCII = r"^[\x00-\x7F]+\z"
_PLAIN = r"(?U)^[\s\p{IsCommon}\p{IsInherited}\p{IsLatin}]*\p{IsLatin}[\s\p{IsCommon}\p{IsInherited}\p{IsLatin}]*$"


def script_runs(text: Column) -> Column:
    """array<struct<script, start, end>>: common characters take the script before them, leading ones that after them.

    A text of Latin and common characters is one run, and so is one of ASCII characters; others are
    folded stretch by stretch, and the array of runs grows only where the script changes.
    """
    none = F.array().cast("array<struct<script:string,start:int,end:int>>")
    text = F.coalesce(text, F.lit(""))

    def step(acc: Column, token: Column) -> Column:
        return let(F.struct(char_script(F.substring(token, 1, 1)).alias("k"), (acc["n"] + F.length(token)).alias("n")), lambda x: grown(acc, x["k"], x["n"]))

    def grown(acc: Column, k: Column, n: Column) -> Column:
        # The open run is script from start to n; it is put away where another real script begins.
        joins = acc["script"].isNull() | (k == COMMON) | (k == acc["script"]) | (acc["script"] == COMMON)
        done = F.when(joins, acc["runs"]).otherwise(F.array_append(acc["runs"], F.struct(acc["script"], acc["start"], acc["n"].alias("end"))))
        script = F.when(joins & (k == COMMON), F.coalesce(acc["script"], k)).otherwise(k)
        return F.struct(n.alias("n"), script.alias("script"), F.when(joins, acc["start"]).otherwise(acc["n"]).alias("start"), done.alias("runs"))

    def closed(x: Column) -> Column:
        return F.when(x["script"].isNull(), x["runs"]).otherwise(F.array_append(x["runs"], F.struct(x["script"], x["start"], x["n"].alias("end"))))

    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("script"), F.lit(0).alias("start"), none.alias("runs"))
    folded = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), zero, step, closed)
    one = lambda script: F.array(F.struct(script.alias("script"), F.lit(0).alias("start"), F.length(text).alias("end")))
    return F.when(text.rlike(_ASCII), one(F.when(text.rlike("[A-Za-z]"), "Latn").otherwise(COMMON))).when(text.rlike(_PLAIN), one(F.lit("Latn"))).otherwise(folded)


def dominant_scripts(runs: Column, min_run_length: int = 1) -> Column:
    """Codes by characters, most first, ties by first seen, without common and unknown ones."""
    def counted(kept: Column) -> Column:
        codes = F.array_distinct(F.transform(kept, lambda r: r["script"]))
        return F.transform(codes, lambda c, i: F.struct((-F.aggregate(F.filter(kept, lambda r: r["script"] == c), F.lit(0), lambda a, r: a + r["end"] - r["start"])).alias("n"), i.alias("i"), c.alias("c")))

    kept = F.filter(runs, lambda r: ~r["script"].isin(COMMON, UNKNOWN) & (r["end"] - r["start"] >= min_run_length))
    return let(kept, lambda k: F.when(F.size(k) < 2, F.transform(k, lambda r: r["script"])).otherwise(F.transform(F.sort_array(counted(k)), lambda s: s["c"])))


def is_rtl(scripts: Column) -> Column:
    return F.coalesce(F.get(scripts, F.lit(0)).isin(*RIGHT_TO_LEFT), F.lit(False))

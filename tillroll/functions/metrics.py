"""Error rates between texts: characters, words, and fuzzy equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.base import let, strip

#: Words are numbered and spelled as single characters from here up to the surrogates.
_FROM, _MOST = 0x0100, 0xD800 - 0x0100


def _rate(distance: Column, ref_size: Column, hyp_size: Column) -> Column:
    return F.when(ref_size == 0, F.when(hyp_size == 0, 0.0).otherwise(1.0)).otherwise(distance / ref_size)


def cer(ref: Column, hyp: Column) -> Column:
    return _rate(F.levenshtein(ref, hyp), F.char_length(ref), F.char_length(hyp))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays, by the built-in one over texts with one character for each distinct word.

    Texts with more than 55,040 distinct words between them raise an error.
    """
    spelled = lambda ws, names: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(names, w) + (_FROM - 1)), 4, "0")), "UTF-16BE")), "")
    return let(F.array_distinct(F.concat(a, b)), lambda n: F.when(F.size(n) > _MOST, F.raise_error(F.lit("too many distinct words")).cast("int")).otherwise(F.levenshtein(spelled(a, n), spelled(b, n))))


def wer(ref: Column, hyp: Column) -> Column:
    return let(F.struct(words(ref).alias("a"), words(hyp).alias("b")), lambda x: _rate(word_distance(x["a"], x["b"]), F.size(x["a"]), F.size(x["b"])))


def normalized_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


def fuzzy_match(a: Column, b: Column, threshold: float = 0.8) -> Column:
    x, y = F.lower(strip(a)), F.lower(strip(b))
    return ((x == "") & (y == "")) | (1 - normalized_distance(x, y) >= threshold)

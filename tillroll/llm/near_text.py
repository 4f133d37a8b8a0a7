"""Near copies of texts by the Jaccard similarity of their word shingles: SimHash and MinHash candidates, verified exactly.

Two texts at a similarity of 0.8 differ in 10 of 64 SimHash bits on average, and ball hashing up
to that radius would emit 8 million variants a text.  So SimHash's links within its radius are
only the first candidates, and MinHash finds the rest.  Every distinct text emits ``BANDS`` hashes of ``ROWS`` minima each.  A pair at the threshold of
0.8 shares none with a probability of (1 - 0.8 ** 6) ** 40, about five in a million; everything
else is exact: candidates are verified on the shingles themselves, with ``5 * common >= 4 * all``.

The texts that share a hash form a group, and no group has to try all its pairs.  First each
is held against the group's most central text, the one with the most company over all its
groups, and what passes is joined into components.  Then the texts outside of the group's
largest component are held against all others of such groups that no link reaches yet and that
share one of their rarest shingles, as similar texts must; a large group of copies with edits of
their own thus makes few pairs.  A pair within one component changes nothing, so the components
are those of all verified pairs.

Texts have A-Z lower-cased and words between white space; under ``shingle`` words make one
shingle, and texts without words (empty or null) are copies of each other.  Copies, told by
64 bits of their words, collapse before anything is emitted.  Very long texts are read whole.
Repeated rows and ids are copies; a null id stays only where its component has no other.  Ties go
to the row read first.  An empty table gives an empty result.  Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from tillroll.llm._common import by_position, discard, position, sized, staged
from tillroll.llm.components import components
from tillroll.llm.simhash import links, without

ROWS, BANDS, CHUNK = 6, 40, 1 << 11
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64)
_MIX = _RANDOM.integers(0, 1 << 63, (ROWS, BANDS), np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """The distinct hashes of runs of so many words, in order."""
    runs = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(r)) for r in runs), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of minima, different from band to band."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[at : at + CHUNK] * _TIMES + _PLUS).min(1), out=least)
    mixed = least.reshape(ROWS, BANDS)
    mixed = ((mixed ^ (mixed >> np.uint64(31))) * _MIX).sum(0, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def simhash(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def with_bands(df: DataFrame, keep: list[str], text_col: str, shingle: int = 5) -> DataFrame:
    """Columns ``keep``, ``key`` of the text's words, its number ``n`` of distinct shingles, their SimHash ``fp``, and its ``bands``."""
    kept = df.select(*keep, F.col(text_col).alias("_text"))
    schema = StructType(list(kept.schema)[:-1]).add("key", LongType()).add("n", IntegerType()).add("fp", LongType()).add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, found = [], [], [], []
            for x in batch.column("_text"):
                words = _words(x.as_py())
                hashes = shingles(words, shingle)
                keys.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                sizes.append(len(hashes))
                prints.append(simhash(hashes))
                found.append(bands(hashes))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), lists], names=schema.names)

    return kept.mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Of the pairs (a, b) of keys, those whose texts (key, text) are similar."""
    both = pairs.join(texts.toDF("a", "_ta"), "a").join(texts.toDF("b", "_tb"), "b").select("a", "b", "_ta", "_tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(16)(lambda text: shingles(_words(text), shingle))
        for batch in batches:
            passed = [similar(held(x.as_py()), held(y.as_py())) for x, y in zip(batch.column("_ta"), batch.column("_tb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _rarest(texts: DataFrame, shingle: int) -> DataFrame:
    """From texts (key, text, root, rest), the rarest fifth of each text's shingles: (h, key, n, left, root, rest).

    ``left`` counts the shingles of the text from this one on, rarest first.  Similar texts of n and n2
    shingles have 4 / 9 of n + n2 in common, none of them before the first, so that many are left there in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in enumerate(batch.column(1)):
                found = shingles(_words(x.as_py()), shingle).view(np.int64)
                same = [pa.repeat(batch.column(c)[at], len(found)) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *same], names=["h", "key", "root", "rest"])

    each = staged(texts.mapInArrow(run, "h long, key long, root long, rest boolean"), "shingles")
    seen = each.groupBy("h").agg(F.count("*").alias("seen"))
    w = Window.partitionBy("key")
    placed = each.join(seen, "h").withColumn("n", F.count("*").over(w)).withColumn("left", F.col("n") + 1 - F.row_number().over(w.orderBy("seen", "h")))
    return placed.where("seen > 1 and 5 * left >= 4 * n").select("h", "key", "n", "left", "root", "rest")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _links(groups: DataFrame, close: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Edges that hold the components of all similar pairs together; groups are (band, key, n, m) with m members, close are candidates (a, b)."""
    alike = lambda x, y: 5 * F.least(x, y) >= 4 * F.greatest(x, y)
    company = groups.groupBy("key").agg(F.sum("m").alias("company"))
    lead = groups.join(company, "key").groupBy("band").agg(F.max(F.struct("company", "key", "n")).alias("x")).select("band", F.col("x.key").alias("head"), F.col("x.n").alias("head_n"))
    tried = staged(groups.join(lead, "band").where((F.col("key") != F.col("head")) & alike("n", "head_n")).select(*_pair("key", "head")).union(close).distinct(), "tried")
    first = staged(_verified(tried, texts, shingle), "links")
    rooted = groups.where("m > 2").join(components(first).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("band").agg(F.max(F.struct("c", "root")).alias("x"), F.count("*").alias("k")).where("k > 1").select("band", F.col("x.root").alias("main"))
    state = rooted.join(open_, "band").groupBy("key").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("rest"))
    held = staged(_rarest(texts.join(state, "key"), shingle), "open")
    rest = held.where("rest").select("h", F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("root").alias("root2"))
    across = held.join(rest, "h").where((F.col("root") != F.col("root2")) & (9 * F.least("left", "left2") >= 4 * (F.col("n") + F.col("n2")))).select(*_pair("key", "key2")).distinct()
    second = _verified(across.join(tried, ["a", "b"], "left_anti"), texts, shingle)
    return first.union(second)


def _close(distinct: DataFrame, radius: int) -> DataFrame:
    """Candidate pairs of keys: texts whose SimHashes are linked, each print standing for its least key, and the other keys of a print with that."""
    least = distinct.groupBy("fp").agg(F.min("key").alias("key"))
    same = distinct.join(least.withColumnRenamed("key", "head"), "fp").where("key != head").select(*_pair("key", "head"))
    apart = links(distinct.select("fp"), radius).join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(*_pair("x", "y"))
    return same.union(apart)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 2) -> DataFrame:
    """The rows of df, of each component of similar texts only the one with the least id; of repeats of that id, any one."""
    docs, text = staged(by_position(df).withColumn("_rid", F.monotonically_increasing_id()), "rows"), position(df, text_col)
    read = docs.select("_rid", F.col(position(df, id_col)).alias("_id"), text)
    rows = staged(with_bands(read, ["_rid", "_id"], text, shingle), "bands")
    distinct = rows.join(rows.groupBy("key").agg(F.min("_rid").alias("_rid")), ["_rid", "key"], "left_semi")
    emitted = distinct.select("key", "n", F.explode("bands").alias("band"))
    groups = staged(emitted.withColumn("m", F.count("*").over(Window.partitionBy("band"))).where("m > 1").select("band", "key", "n", "m"), "groups")
    close = staged(_close(distinct.select("key", "fp"), radius), "close")
    near = staged(groups.select("key").union(close.select("a")).union(close.select("b")).distinct().join(distinct.select("key", "_rid"), "key"), "near")
    texts = staged(docs.select("_rid", text).join(sized(near), "_rid").select("key", text), "texts")
    linked = components(_links(groups, close, texts, shingle)).withColumnRenamed("node", "key")
    order = F.struct(F.col("_id").isNull(), "_id", "_rid")
    least = rows.groupBy("key").agg(F.min(order).alias("o"))
    first = least.join(linked, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("o")["_rid"].alias("_rid"))
    out = without(docs, rows, first).toDF(*df.columns)
    discard(rows, groups, close, near, texts, linked)
    return out

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius.  Two fingerprints at
most the radius apart share a variant, and two that share one are at most the radius apart, so
the shuffle on variants finds every link and, for an even radius, nothing else; pairs are
deduplicated and verified all the same.  A variant has at most as many fingerprints near it as
one fingerprint has variants (65 at radius 2), so no group is large; instead of all its pairs
each group emits the path through them, which keeps components whole.

Copies collapse to one fingerprint before anything is emitted.

Texts have A-Z lower-cased and words between white space; fewer than ``shingle`` words make one
shingle of all, and a text without words (empty or null) has fingerprint zero, which is linked
like any other.  Very long texts are read whole, in chunks.  Repeated rows and repeated ids link
as copies do; a null id is a row like others, but no component is named after it unless it has
no other.  Ties: a bit set in just half of the hashes is 0.  An empty table gives an empty
result.  Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.llm._common import by_position, position, sized, staged
from tillroll.llm.components import components

CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over XXH64 of word shingles; memory beyond the words is bounded by a chunk."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = max(1, len(words) - shingle + 1)
    ones, hashed = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, shingles, CHUNK):
        part = words[at : min(at + CHUNK, shingles) + shingle - 1]
        runs = zip(*(part[k:] for k in range(shingle)), strict=False) if len(part) >= shingle else [part]
        bits = np.unpackbits(np.frombuffer(b"".join([hashed(b" ".join(r), seed) for r in runs]), np.uint8))
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > shingles).tobytes(), "big")


def with_fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3, out_col: str = "fp") -> DataFrame:
    """Columns ``keep`` and the fingerprint as a signed long."""
    kept = df.select(*keep, F.col(text_col).alias("_text"))
    schema = StructType(list(kept.schema)[:-1]).add(out_col, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(prints)], names=schema.names)

    return kept.mapInArrow(run, schema)


def masks(within: int) -> list[int]:
    """All signed 64-bit masks of at most so many bits."""
    unsigned = [sum(1 << b for b in bits) for n in range(within + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that hold the link graph's components together."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius must be 0, 2 or 4")
    ball = F.array(*(F.lit(m).cast("long") for m in masks(radius // 2)))
    emitted = prints.select("fp").distinct().select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    beside = emitted.selectExpr("fp as a", "lag(fp) over (partition by variant order by fp) as b").where("b is not null").distinct()
    return beside.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _named(df: DataFrame, keep: list[str], text: str, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Of df with column _id, the rows staged as (_rid, _id, keep, _fp), without texts, and (_fp, root, component_id) of each fingerprint."""
    prints = with_fingerprints(df, ["_id", *keep], text, shingle, "_fp")
    rows = staged(prints.withColumn("_rid", F.monotonically_increasing_id()), "prints")
    distinct = rows.groupBy("_fp").agg(F.min("_id").alias("least"))
    linked = components(links(distinct.withColumnRenamed("_fp", "fp"), radius)).select(F.col("node").alias("_fp"), "root")
    rooted = distinct.join(linked, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    return rows, rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("_fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, radius: int = 2, shingle: int = 3) -> DataFrame:
    """Per row: the columns ``keep`` (the id if None), ``fp`` and ``component_id``, the least id that links reach."""
    keep = [id_col] if keep is None else keep
    held = [f"_c{i}" for i in range(len(keep))]
    docs = by_position(df).select(F.col(position(df, id_col)).alias("_id"), *(F.col(position(df, c)).alias(h) for c, h in zip(keep, held, strict=True)), F.col(position(df, text_col)).alias("_t"))
    rows, named = _named(docs, held, "_t", radius, shingle)
    return rows.join(named, "_fp").select(*(F.col(h).alias(c) for h, c in zip(held, keep, strict=True)), F.col("_fp").alias("fp"), "component_id")


def without(df: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of df, staged with column _rid, whose _rid is in first.

    Those that go are staged first, as ids, and counted: while they are few enough to be broadcast
    no text is shuffled.
    """
    gone = staged(rows.select("_rid").join(first, "_rid", "left_anti"), "gone")
    return df.join(sized(gone), "_rid", "left_anti").drop("_rid")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of df, of each component only the one with the least id; of repeats of that id, any one."""
    docs = staged(by_position(df).withColumn("_rid", F.monotonically_increasing_id()), "rows")
    read = docs.select(F.col(position(df, id_col)).alias("_id"), F.col("_rid").alias("_row"), F.col(position(df, text_col)).alias("_t"))
    rows, named = _named(read, ["_row"], "_t", radius, shingle)
    rows = rows.drop("_rid").withColumnRenamed("_row", "_rid")
    order = F.struct(F.col("_id").isNull(), "_id", "_rid")
    first = rows.join(named.select("_fp", "root"), "_fp").groupBy("root").agg(F.min(order)["_rid"].alias("_rid"))
    return without(docs, rows, first).toDF(*df.columns)

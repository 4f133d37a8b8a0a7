"""Removal of long repeated byte strings by suffix arrays that are sorted in two stages.

A window is a string of ``length`` bytes (200) within one text; every byte covered by a window
that also starts anywhere else is removed.

One suffix array over a corpus isn't to be had on a cluster, so windows first meet by content.
Every window takes the least hash of its ``gram``-byte strings as its key: equal windows have
equal keys.  Consecutive windows with one key form a segment (in periodic text a segment ends
after as many windows as a window has grams).  Segments with one content are counted, not
repeated: the windows of a segment found twice are repeated, and one of it stands for all.
Only keys with several contents, or with a gram that comes twice in one segment, need sorting.

Their segments go into blocks of at most ``GROUP_BYTES``, and each block gets a suffix array
(``two_stage_order``): suffixes smaller than their successors are sorted directly, the others are
induced from them by scans over the buckets of first bytes.  Neighbours in the array with a
common prefix of ``length`` are repeated windows.  A key whose segments fill more than a block (a
common line in many surroundings) is dealt to several by content; what sorting has collapsed in
each of them, one row for every different window, is then merged by 128-bit digests over that
key's blocks.

So exact copies and shared passages are settled where whole segments are equal, by 64-bit key and
64-bit digest, and the suffix arrays decide the rest; README has the shares.

Null texts are empty; texts under ``length`` bytes have no window; very long texts are read whole,
one at a time.  Repeated rows are copies and lose every byte if they are long enough; null ids are
rows like others.  Ties need no rule: equal windows all go, the first one too.  An empty table
gives an empty result.  Columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.llm._common import by_position, discard, parallel, position, release, staged, staged_table

LENGTH, GRAM = 200, 32
#: Blocks that are sorted at once are about this large at most.
GROUP_BYTES = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


# ---- suffix sorting -------------------------------------------------------------------------


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text's suffixes in order of their first ``depth`` bytes; a suffix that ends is the smaller."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # Symbols 1..256; the end is 0.  A suffix is smaller than its successor if its first symbol that differs from the next one is smaller.
    t = text.astype(np.int32) + 1
    nxt = np.append(t[1:], 0)
    differs = np.flatnonzero(t != nxt)
    first = differs[np.searchsorted(differs, np.arange(n))]
    small = t[first] < nxt[first]
    start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=257))])  # bucket c begins at start[c]
    order = np.full(n, -1, np.int64)
    direct = np.flatnonzero(small)
    if len(direct):
        padded = np.concatenate([text, np.zeros(depth, np.uint8)])
        keys = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))[direct]
        # A fixed-length byte string compares as memory does; ties with the padding are settled by length, so longer ones come last.
        direct = direct[::-1][np.argsort(np.ascontiguousarray(keys[::-1]).view(f"S{depth}").ravel(), kind="stable")]
        counts = np.bincount(t[direct], minlength=257)
        at = start[1:258] - counts  # sorted ones fill the end of their bucket
        offset = np.arange(len(direct)) - np.repeat(np.cumsum(counts) - counts, counts)
        order[at[t[direct]] + offset] = direct
    fill = start[:257].copy()  # next free place for induced suffixes of each bucket

    def induce(found: np.ndarray, above: int) -> None:
        """Place the predecessors of found, in that order, if they are larger than their successors."""
        before = found[found > 0] - 1
        before = before[~small[before] & (t[before] > above)]
        if len(before):
            c = t[before]
            by = np.argsort(c, kind="stable")
            before, c = before[by], c[by]
            heads = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            sizes = np.diff(np.append(heads, len(c)))
            order[np.repeat(fill[c[heads]], sizes) + np.arange(len(c)) - np.repeat(heads, sizes)] = before
            fill[c[heads]] += sizes

    if not small[n - 1]:  # the last suffix follows from the empty one
        c = t[n - 1]
        order[fill[c]] = n - 1
        fill[c] += 1
    for c in np.flatnonzero(np.bincount(t, minlength=257)):
        # Induced suffixes that begin with a run of c induce others of the same bucket, wave by wave.
        wave = order[start[c] : fill[c]]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[~small[before] & (t[before] == c)]
            order[fill[c] : fill[c] + len(wave)] = wave
            fill[c] += len(wave)
        induce(order[start[c] : start[c + 1]], c)
    return order


def common_prefix(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order, at most depth; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(text) + depth, 8), (1, 1))
    live, at = np.arange(1, len(order)), 0
    while len(live) and at < depth:
        take = min(8, depth - at)
        a, b = order[live] + at, order[live - 1] + at
        same = words[a, :take] == words[b, :take]
        run = np.where(same.all(1), take, same.argmin(1))
        room = len(text) - np.maximum(a, b)
        out[live] += np.minimum(run, room)
        live = live[(run == take) & (room > take)]
        at += take
    return out


def sorted_windows(segments: list[bytes], times: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the segments, in sorted order: segment, place in it, number of its class of equal ones, and how often the class occurs; times: how often a segment does."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum(sizes)
    order = two_stage_order(text, length)
    owner = np.searchsorted(ends, order, side="right")
    equal = common_prefix(text, order, length) >= length
    whole = order + length <= ends[owner]  # no match crosses a segment's end
    group = np.cumsum(~equal)
    weight = np.bincount(group, np.where(whole, np.asarray(times)[owner], 0), group[-1] + 1 if len(group) else 0)
    return owner[whole], (order - (ends - sizes)[owner])[whole], group[whole], weight[group[whole]].astype(np.int64)


def repeated_starts(segments: list[bytes], times: list[int], length: int) -> list[np.ndarray]:
    """For each segment, at which of its windows a repeated string starts."""
    owner, place, _, weight = sorted_windows(segments, times, length)
    again = weight >= 2
    return [np.sort(place[again & (owner == k)]) for k in range(len(segments))]


# ---- keys and segments ----------------------------------------------------------------------


def _gram_hashes(raw: np.ndarray, gram: int, level: int) -> np.ndarray:
    """Hashes of all gram-byte strings, by sums of powers modulo 2**64 and a mixer that depends on level."""
    n = len(raw) - gram + 1
    powers = np.full(len(raw), _B, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    back = np.full(n, pow(int(_B), -1, 1 << 64), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)])
    h = (sums[gram:] - sums[:n]) * back
    h ^= h >> np.uint64(29)
    h *= _MIX[level % len(_MIX)] + np.uint64(2 * level)
    h ^= h >> np.uint64(32)
    h *= _MIX[(level + 1) % len(_MIX)]
    return h ^ (h >> np.uint64(31))


def _sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values: suffix minima of one block against prefix minima of the next."""
    n = len(h) - w + 1
    pad = -len(h) % w
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows, times the key's gram occurs in it, 2 at most) of each segment of one text."""
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    w = length - gram + 1
    h = _gram_hashes(raw, gram, level)
    least = _sliding_least(h, w)
    heads = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    sizes = np.diff(np.append(heads, len(least)))
    if sizes.max() > w:  # periodic text: cut long segments
        parts = -(-sizes // w)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        heads = np.repeat(heads, parts) + inner * w
        sizes = np.diff(np.append(heads, len(least)))
    keys = least[heads]
    ends = heads + sizes + w - 1  # grams of the segment end here
    # How often a key's gram occurs: grams that equal the least of the windows that begin or end there.
    spots = np.flatnonzero(h[: len(least)] == least)
    last = np.flatnonzero(h[w - 1 :] == least) + w - 1
    spots = np.union1d(spots, last)
    inner = h[spots]
    times = np.zeros(len(keys), np.int64)
    lo, hi = np.searchsorted(spots, heads), np.searchsorted(spots, ends)
    for k in np.flatnonzero(hi - lo > 1):
        times[k] = np.count_nonzero(inner[lo[k] : hi[k]] == keys[k])
    return keys.view(np.int64), heads, sizes, np.clip(times, 1, 2)


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _segment_rows(length: int, gram: int):
    """From (rid, text) to a row for each segment.  A content is known by key and digest together, 128 bits."""
    names = ["rid", "start", "n", "key", "content", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_py().encode()
                keys, heads, sizes, times = segments(np.frombuffer(raw, np.uint8), length, gram)
                if len(keys):
                    content = np.array([_digest(raw[a : a + c + length - 1]) for a, c in zip(heads.tolist(), sizes.tolist(), strict=True)], np.int64)
                    for column, v in zip(out, (np.full(len(keys), rid), heads, sizes, keys, content, times), strict=True):
                        column.append(v)
                    held += len(keys)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=names)
                    out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=names)

    return run


_SORTED = ("key", "content", "first", "windows", "lo", "hi", "times")


def _digest128(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sort_blocks(length: int, group_bytes: int):
    """From (key, part, shared, content, c, bytes), whole parts one after another, to _SORTED.

    A row without a digest is a run of repeated windows.  A key with several parts is shared; it
    also has a row with a digest for each of its different windows, and this one's place if it
    isn't known to be repeated.
    """

    def solve(block: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, _, shared, contents, times, segs = zip(*block, strict=True)
        owner, place, group, weight = sorted_windows(list(segs), list(times), length)
        again = weight >= 2
        out: list[tuple] = []
        by = np.lexsort((place[again], owner[again]))
        at, where = owner[again][by], place[again][by]
        heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1))) if len(at) else np.zeros(0, int)
        for head, n in zip(heads.tolist(), np.diff(np.append(heads, len(at))).tolist(), strict=True):
            out.append((keys[at[head]], contents[at[head]], int(where[head]), n, None, None, None))
        if any(shared):
            _, one = np.unique(group, return_index=True)
            for k, p, w in zip(owner[one].tolist(), place[one].tolist(), weight[one].tolist(), strict=True):
                if shared[k]:
                    known = w >= 2
                    out.append((keys[k], None if known else contents[k], None if known else p, 1, *_digest128(segs[k][p : p + length]), min(w, 2)))
        for a in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a : a + 50_000], strict=True)], names=list(_SORTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, size, group_size = [], [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "shared", "content", "c", "bytes")), strict=True):
                if group and group[-1][:2] != row[:2]:
                    if block and size + group_size > group_bytes:
                        yield from solve(block)
                        block, size = [], 0
                    block.extend(group)
                    size, group, group_size = size + group_size, [], 0
                group.append(row)
                group_size += len(row[5])
        if block and size + group_size > group_bytes:
            yield from solve(block)
            block = []
        if block or group:
            yield from solve(block + group)

    return run


def repeated_windows(segs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """From distinct segments (key, content, c, bytes), the runs (key, content, first, windows) of repeated windows."""
    # Half a block a part, for parts are dealt by hash and some get more.
    sized = segs.groupBy("key").agg(F.ceil(F.sum(F.length("bytes")) / group_bytes).cast("int").alias("n"))
    parts = F.when(F.col("n") > 1, F.pmod("content", 2 * F.col("n"))).otherwise(0)
    dealt = segs.join(sized, "key").select("key", parts.alias("part"), (F.col("n") > 1).alias("shared"), "content", "c", "bytes")
    blocks = dealt.repartition(parallel(segs.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    done = staged(blocks.mapInArrow(_sort_blocks(length, group_bytes), ", ".join(f"{n} long" for n in _SORTED)), "sorted")
    merged = done.where("lo is not null")
    twice = merged.groupBy("lo", "hi").agg(F.sum("times").alias("s")).where("s >= 2").select("lo", "hi")
    across = merged.where("content is not null").join(twice, ["lo", "hi"])
    return done.where("lo is null").select(*_SORTED[:4]).unionByName(across.select(*_SORTED[:4]))


def _cut(keep: list[str], length: int):
    """From (keep, text, spans) to the text without its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py().encode()
                at, removed, runs, out = 0, 0, 0, []
                end = -1
                for x in sorted((x["a"], x["b"]) for x in spans.as_py() or ()):
                    a, b = x
                    if a > end:
                        out.append(raw[at:a])
                        runs += 1
                        removed += b - a
                        end = b
                    elif b > end:
                        removed += b - end
                        end = b
                    at = max(at, end)
                out.append(raw[at:])
                n_bytes.append(len(raw))
                n_removed.append(removed)
                n_spans.append(runs)
                kept.append(b"".join(out))
            made = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: the columns ``keep`` (doc_id if None), n_bytes, n_removed, n_spans and ``kept``, the remaining bytes (which may part a character).

    The result reads a table of the texts in the session's catalog; ``clean_up`` drops it.
    """
    keep = ["doc_id"] if keep is None else keep
    held = [f"_c{i}" for i in range(len(keep))]
    docs = by_position(df).select(*(F.col(position(df, c)).alias(h) for c, h in zip(keep, held, strict=True)), F.coalesce(F.col(position(df, text_col)), F.lit("")).alias("text"))
    texts = staged_table(docs.withColumn("rid", F.monotonically_increasing_id()), "rid", parallel(df.sparkSession))
    release(df.sparkSession)
    segs = staged(texts.select("rid", "text").mapInArrow(_segment_rows(length, gram), "rid long, start long, n long, key long, content long, times long"), "segments")
    keys = segs.groupBy("key").agg(F.sum("times").alias("t"), F.count("*").alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("t >= 2")
    keys = keys.select("key", ((F.col("lo") == F.col("hi")) & (F.col("c") >= 2)).alias("whole"))
    hits = staged(segs.join(keys, "key").drop("times"), "hits")
    discard(segs)
    release(df.sparkSession)
    some = hits.where("not whole")
    rep = F.min(F.struct("rid", "start", "n")).alias("r")
    distinct = some.groupBy("key", "content").agg(F.count("*").alias("c"), rep).select("key", "content", "c", "r.rid", "r.start", "r.n")
    take = F.expr(f"substring(cast(text as binary), cast(start + 1 as int), cast(n + {length - 1} as int))")
    pieces = staged(distinct.join(texts.select("rid", "text"), "rid").select("key", "content", "c", take.alias("bytes")), "pieces")
    release(df.sparkSession)
    found = repeated_windows(pieces, length).groupBy("key", "content").agg(F.collect_list(F.struct("first", "windows")).alias("f"))
    inner = some.join(found, ["key", "content"]).select("rid", "start", F.explode("f").alias("f"))
    spans = hits.where("whole").select("rid", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("b")).alias("x"))
    spans = spans.unionByName(inner.select("rid", F.struct((F.col("start") + F.col("f.first")).alias("a"), (F.col("start") + F.col("f.first") + F.col("f.windows") + length - 1).alias("b")).alias("x")))
    per_row = spans.groupBy("rid").agg(F.collect_list("x").alias("spans"))
    discard(pieces)
    joined = texts.join(per_row, "rid", "left").select(*held, "text", "spans")
    schema = StructType(list(joined.schema)[: len(held)])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    cut = joined.mapInArrow(_cut(held, length), schema.add("kept", "binary"))
    return cut.toDF(*keep, "n_bytes", "n_removed", "n_spans", "kept")

"""Benchmark decontamination by winnowing, in SQL functions only.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased.  An item's
windows are its spans of ``span`` consecutive words; an item of fewer words, but not none, is
one window.  Both sides keep, of every window, the ``k``-word gram with the least hash, the last
of several; neighbouring windows mostly keep the same gram, so about one gram in four is a
fingerprint.  Equal windows keep equal grams at equal places, so joining the fingerprints meets
every shared window.  A hit is then extended: the words around the document's gram are compared
with those around the item's, as far as a window may reach, and a common run of ``span`` words
marks its words.  That is exact: every shared window lies in the run around its own gram.

Short items get fingerprints of windows of their own length, so they are found as surely.

Of a document's grams only those go further whose hash is set in a small table of bits of the
items' grams.  The items' fingerprints and their surroundings are measured first.  Up to ``max_bytes`` of them
they are broadcast, and documents' texts are never shuffled.  Beyond that documents' fingerprints
are shuffled to them, without texts, and candidates meet their document's words by row id.  Both
ways give the same rows.

Null and empty texts have no words and no hits.  Very long texts are read whole.  Repeated rows
are judged each for itself, by a row id that staging fixes, and null ids are rows like others.
Null item ids have windows like others, but are not listed.  Ties: equal grams in a window
count by the last one; equal items are listed each.  Without items nothing is contaminated; an
empty table of documents gives an empty result.  Columns of documents and items may have any
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import ascii_lower, by_position, discard, position, sized, staged

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The items' side is broadcast up to this many bytes, words and their overhead in memory counted.
MAX_BYTES = 64 << 20
#: A fingerprint holds 40 bits of a gram's hash above this many of its place, so that of equal hashes the last is the least.
_PLACE = 24
_ITSELF = -1
#: A table of so many bits, by hash, tells which grams may be an item's; its size is fixed, and the more items there are the less it spares.
_SLOTS = 1 << 20


def words(text: Column) -> Column:
    # Far cheaper than regexp_extract_all, which makes a match object of each word.
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _bound(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is evaluated once; nested columns would be inlined and multiply."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _around(at: str, span: str, reach: str) -> str:
    """The words before a gram, nearest first, and those from it on, as far as a window reaches."""
    return f"reverse(slice(_w, greatest({at} - {reach} + 1, 1), least({at}, {reach}))) as before, slice(_w, {at} + 1, {span}) as after"


def _bits(ctx: DataFrame) -> str:
    """The table of bits of the items' grams, as a constant array."""
    slot = F.shiftright("key", 10).bitwiseAND(_SLOTS - 1)
    words_ = ctx.select(slot.alias("s")).distinct().groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
    held = {r.w: r.b for r in words_.collect()}  # at most _SLOTS / 64 numbers
    return "cast(split('" + ",".join(str(held.get(w, 0)) for w in range(_SLOTS // 64)) + "', ',') as array<bigint>)"


def _fingerprints(df: DataFrame, span: int, k: int, out: str, around: bool = True, bits: str | None = None) -> DataFrame:
    """Add ``out``: an array of (key, at) and the words around, for the kept grams of the windows of span words of column ``_w``.

    With bits only for grams that may be an item's.
    """
    k, low = min(k, span), (1 << _PLACE) - 1
    gram = f"xxhash64(x{''.join(f', get(_w, i + {j})' for j in range(1, k))})"
    grams = f"transform(slice(_w, 1, size(_w) - {k - 1}), (x, i) -> shiftleft(shiftright({gram}, {_PLACE}), {_PLACE}) + ({low} - (i & {low})))"
    width, steps = span - k + 1, []
    while (have := 1 + sum(steps)) < width:  # the least of twice as many, from two overlapping halves
        steps.append(min(have, width - have))
    name = f"g{len(steps)}"
    key = f"shiftright(x, {_PLACE}) * 1024L + {span}"
    place = f"cast(i + pmod({low} - (x & {low}) - i, {low + 1}) as int)"
    struct = _bound(place, "p", f"struct({key} as key, p as at{', ' + _around('p', str(span), str(span - k)) if around else ''})")
    slot = f"(shiftright(x, {_PLACE}) & {_SLOTS - 1})"
    known = f"and (shiftright(get({bits}, cast(shiftright({slot}, 6) as int)), cast({slot} & 63 as int)) & 1L) = 1" if bits else ""
    found = f"array_compact(transform({name}, (x, i) -> case when (i = 0 or x <> get({name}, i - 1)) {known} then {struct} end))"
    for n, step in reversed(list(enumerate(steps))):
        found = _bound(f"transform(slice(g{n}, 1, size(g{n}) - {step}), (x, i) -> least(x, get(g{n}, i + {step})))", f"g{n + 1}", found)
    found = _bound(grams, "g0", found)
    return df.withColumn(out, F.expr(f"case when size(_w) >= {span} then {found} else cast(array() as array<struct<key:bigint,at:int{',before:array<string>,after:array<string>' if around else ''}>>) end"))


def _surroundings(items: DataFrame, id_col: str, text_col: str, span: int, k: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Of the items' fingerprints the distinct (ctx, key, span, before, after); (ctx, item_id); and the lengths of windows that occur."""
    each = by_position(items).select(F.col(position(items, id_col)).cast("string").alias("item_id"), words(F.col(position(items, text_col))).alias("_w"))
    each = staged(each.where(F.size("_w") > 0).withColumn("span", F.least(F.size("_w"), F.lit(span))), "items")
    lengths = sorted(r.span for r in each.select("span").distinct().collect())  # at most span numbers
    made = each.select("item_id", F.lit(0).cast("long").alias("key"), "span", F.col("_w").alias("before"), F.col("_w").alias("after")).limit(0)
    for length in lengths:
        part = _fingerprints(each.where(F.col("span") == length), length, k, "_f").select("item_id", "span", F.explode_outer("_f").alias("f"))
        made = made.unionByName(part.select("item_id", "f.key", "span", "f.before", "f.after"))
    made = staged(made.distinct(), "windows")
    place = ["key", "span", "before", "after"]
    ctx = staged(made.select(place).distinct().withColumn("ctx", F.monotonically_increasing_id()), "surroundings")
    of_item = staged(made.join(ctx, place).where("item_id is not null").select("ctx", "item_id").distinct(), "of_item")
    discard(each, made)
    return ctx, of_item, lengths


def _bytes(ctx: DataFrame) -> int:
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 24)
    return ctx.select(F.coalesce(F.sum(size("before") + size("after") + 96), F.lit(0))).first()[0]


def _runs(met: DataFrame, *cols: str) -> DataFrame:
    """Of documents' grams (key, at, before, after) that met an item's (span, i_before, i_after, ctx), (cols, a, b, ctx) where words a to b are common and make a window."""
    upto = lambda side: _bound(f"transform(i_{side}, (x, t) -> x <=> get({side}, t))", "y", f"case when array_position(y, false) > 0 then cast(array_position(y, false) as int) - 1 else size(i_{side}) end")
    met = met.select(*cols, "key", "span", "at", "ctx", F.expr(f"struct({upto('before')} as l, {upto('after')} as r)").alias("x"))
    return met.where(f"key = {_ITSELF} or x.l + x.r >= span").select(*cols, (F.col("at") - F.col("x.l")).alias("a"), (F.col("at") + F.col("x.r")).alias("b"), "ctx")


def _hits(rows: DataFrame, names: list[str], ctx: DataFrame, lengths: list[int], k: int, max_bytes: int, itself: bool) -> DataFrame:
    """From rows (_rid, names, _w) to staged (_rid, names, a, b, ctx), a row for each hit.

    With itself there is also a row with null a for each row, and only that one has the names.
    """
    kept = ctx.select("ctx", "key", "span", F.col("before").alias("i_before"), F.col("after").alias("i_after"))
    none = F.array().cast("array<string>")
    small = _bytes(ctx) <= max_bytes
    if not small:
        rows = staged(rows, "words")
    spread, bits = rows, _bits(ctx)
    for length in lengths:
        spread = _fingerprints(spread, length, k, f"_f{length}", small, bits)
    each = [F.col(f"_f{n}") for n in lengths]
    # Outer generators, for from inner ones the optimizer infers a filter that evaluates the hashes again.
    if small:
        if itself:
            each.append(F.array(F.struct(F.lit(_ITSELF).cast("long").alias("key"), F.lit(0).alias("at"), none.alias("before"), none.alias("after"))))
            kept = kept.unionByName(ctx.sparkSession.range(1).select(F.lit(None).cast("long").alias("ctx"), F.lit(_ITSELF).cast("long").alias("key"), F.lit(0).alias("span"), none.alias("i_before"), none.alias("i_after")))
        spread = spread.select("_rid", *names, F.explode_outer(F.concat(*each) if each else F.lit(None).cast("array<struct<key:bigint,at:int,before:array<string>,after:array<string>>>")).alias("f"))
        runs = _runs(spread.select("_rid", *names, "f.*").join(F.broadcast(kept), "key"), "_rid", *names)
    else:
        spread = spread.select("_rid", F.explode_outer(F.concat(*each)).alias("f")).select("_rid", "f.*")
        some = spread.join(kept, "key").groupBy("_rid").agg(F.collect_list(F.struct("key", "span", "at", "ctx", "i_before", "i_after")).alias("_m"))
        around = F.expr(f"transform(_m, m -> struct(m.key as key, m.span as span, m.at as at, m.ctx as ctx, m.i_before as i_before, m.i_after as i_after, {_around('m.at', 'm.span', f'(m.span - least(m.span, {k}))')}))")
        met = rows.join(some, "_rid").select("_rid", *names, around.alias("_m")).select("_rid", *names, F.explode_outer("_m").alias("m")).select("_rid", *names, "m.*")
        runs = _runs(met, "_rid", *names)
        if itself:
            runs = runs.unionByName(rows.select("_rid", *names), allowMissingColumns=True)
    only = lambda c: (F.when(F.col("ctx").isNull(), F.col(c)) if itself else F.col(c)).alias(c)
    return staged(runs.select("_rid", *map(only, names), F.when(F.col("ctx").isNotNull(), F.col("a")).alias("a"), "b", "ctx"), "hits")


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, span: int = 10, k: int = 4, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: the columns ``keep`` (the id if None), n_words, n_hit, items (sorted as strings) and contaminated."""
    keep = [id_col] if keep is None else keep
    ctx, of_item, lengths = _surroundings(items, item_id_col, item_text_col, span, k)
    names = [f"_c{i}" for i in range(len(keep))]
    rows = by_position(docs).select(*(F.col(position(docs, c)).alias(n) for c, n in zip(keep, names, strict=True)), words(F.col(position(docs, text_col))).alias("_w"))
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("_rid", F.monotonically_increasing_id())
    hits = _hits(rows, [*names, "n_words"], ctx, lengths, k, max_bytes, True)
    found = hits.where("a is not null")
    # Words under the union of runs: each run adds what lies beyond the furthest end before it.
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"))
    n_hit = F.aggregate(F.sort_array(F.collect_set(F.struct("a", "b"))), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step)["n"]
    counted = found.groupBy("_rid").agg(n_hit.alias("n_hit"))
    listed = found.select("_rid", "ctx").distinct().join(of_item, "ctx").groupBy("_rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = hits.where("a is null").join(counted, "_rid", "left").join(listed, "_rid", "left")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 4, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs without a hit.

    Hits are staged as ids and two hashes of texts, 128 bits, and counted: while they are few
    enough to be broadcast no text is shuffled.
    """
    rows, i, text = by_position(docs), position(docs, id_col), position(docs, text_col)
    digest = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), F.col(text)))
    ctx, of_item, lengths = _surroundings(items, item_id_col, item_text_col, span, k)
    discard(of_item)
    read = rows.select(F.col(i).alias("_i"), digest.alias("_d"), words(F.col(text)).alias("_w")).withColumn("_rid", F.monotonically_increasing_id())
    found = sized(staged(_hits(read, ["_i", "_d"], ctx, lengths, k, max_bytes, False).select("_i", "_d").distinct(), "contaminated"))
    return rows.join(found, F.col(i).eqNullSafe(F.col("_i")) & (digest == F.col("_d")), "left_anti").toDF(*docs.columns)

"""Secret scan with corpus-wide ownership frequency, in SQL functions only.

Each text is scanned for three base kinds and, broadly, for whatever else may be a credential:
public token formats, connection strings, bearer headers, values beside credential words, quoted
and bare random-looking strings.  Candidates are hashed and counted over the whole corpus by
distinct repositories and distinct owners.  A candidate held by at most ``max_owners`` owners is
owner-specific and live-looking, in however many of their repositories it lies; one that more
owners hold is a widely copied example.  Base spans always stay; spans of the further kinds are
added where they are live-looking.

Positions are found natively: what ``split`` leaves between matches and the matches
themselves, alternately, add up to the text, so running sums of their lengths give code-point
offsets.  The sums are windows over rows of (row, kind), and spans are cut from blocks of the
text, so both grow with the text and its hits, not with their product.

A null text is empty and has no spans.  A very long text is scanned whole, and its hits are
rows.  Rows are told apart by an id of their own, so null and repeated document ids are fine,
and a repeated row is scanned again.  Null owners count as one owner, null repositories as one
repository.  Ties: spans with one start are listed in the order of KINDS; copies of a candidate
within a text are spans of their own and count once.  An empty table gives an empty result.
Extra columns, whatever their names, are kept out of the result unless asked for;
``redact_secrets`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm._common import by_position, position, staged

#: Kind, pattern, group that holds the secret, least characters of it, counted as base.
#: The further kinds are public token formats and general shapes of credentials.
KINDS = (
    ("assign", r"""(?=[PpSsTtAa])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    ("hex", r"[0-9a-f]{16,}", 0, 16, True),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, False),
    ("cloud", r"AIza[A-Za-z0-9_-]{35}", 0, 39, False),
    ("pay", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 24, False),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----\r?\n[A-Za-z0-9+/=\r\n]+-----END [A-Z ]*PRIVATE KEY-----", 0, 40, False),
    ("login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9_.%+-]{1,64}:([^\x00-\x20:/@\"'<>]{4,128})@[A-Za-z0-9.-]+", 1, 4, False),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]{20,})", 1, 20, False),
    ("beside", r"""(?i:pwd|pass|credentials?|auth|signature|access.key|private.key|client.key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", 1, 12, False),
    ("quoted", r"""["']([A-Za-z0-9+/_=-]{20,})""", 1, 20, False),
    ("random", r"[A-Za-z0-9+/_=-]{32,}", 0, 32, False),
)
#: A value of these kinds counts only if it has both letters and this many digits, and one of PLAIN_HEX only if it isn't all of the kind hex.
MIXED, DIGITS, PLAIN_HEX = ("beside", "quoted", "random"), 4, ("random",)
#: What a text must have for a kind, cheap to test: a long enough run, tried only where it begins; a word before a sign; a literal.
_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{15}"
_KEYED = r"(?=[PpSsTtAaCc])(?i:(?:passw|secret|token|api_?key|pwd|pass|credential|auth|signature|access.key|private.key|client.key)[a-z]{0,3})[\"']?\x20*[:=]"
_LITERALS = {"jwt": "eyJ", "pem": "PRIVATE KEY", "login": "://", "bearer": "earer "}
_PARTS = "array<struct<rank:int,gaps:array<int>,sizes:array<int>,hashes:array<string>>>"
_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,base:boolean,live:boolean>>"
BLOCK = 4096


def _guard(text: Column, kind: str) -> Column:
    if kind in ("assign", "beside"):
        return (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(_KEYED)
    return F.contains(text, F.lit(_LITERALS[kind])) if kind in _LITERALS else text.rlike(_RUN)


def _suspect(text: Column) -> Column:
    """Whether a text may have a candidate of any kind."""
    return _guard(text, "hex") | _guard(text, "assign") | _guard(text, "jwt") | _guard(text, "pem") | _guard(text, "login") | _guard(text, "bearer")


def _matches(text: Column, rank: int) -> Column:
    """Lengths between and of one kind's matches, and the hashes of the values that count; null where there are none."""
    kind, pattern, group, least, _ = KINDS[rank]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def hashed(v: Column) -> Column:
        counts = F.length(v) >= least
        if kind in MIXED:
            counts &= (F.regexp_count(v, F.lit("[0-9]")) >= DIGITS) & v.rlike("[A-Za-z]")
        if kind in PLAIN_HEX:
            counts &= ~v.rlike("^[0-9a-f]+$")
        return F.when(counts, F.sha2(v, 256))

    # regexp_extract_all and split agree on matches: both go from left to right and never overlap.
    parts = F.struct(F.lit(rank).alias("rank"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), F.transform(whole, F.length).alias("sizes"), F.transform(value, hashed).alias("hashes"))
    there = text.rlike(pattern if kind != "random" else _RUN.replace("15", str(least)))
    return F.when(F.col("_" + (kind if kind in _LITERALS else "keyed" if kind in ("assign", "beside") else "run")) & there, parts)


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``_parts``, an array with an entry for each kind that occurs, and a fixed ``_rid``."""
    t = F.coalesce(F.col(text), F.lit(""))
    flags = {"_run": _guard(t, "hex"), "_keyed": _guard(t, "assign")} | {f"_{k}": _guard(t, k) for k in _LITERALS}
    found = F.array_compact(F.array(*(_matches(t, k) for k in range(len(KINDS)))))
    parts = F.when(F.greatest(*flags), found).otherwise(F.array()).cast(_PARTS)
    return docs.withColumns(flags).withColumn("_parts", parts).drop(*flags).withColumn("_rid", F.monotonically_increasing_id())


def _candidates(rows: DataFrame, *cols: str) -> DataFrame:
    """From rows with ``_rid`` and ``_parts`` to a row for each candidate: _rid, cols, rank, start, stop, h."""
    one = rows.where(F.size("_parts") > 0).select("_rid", *cols, F.explode("_parts").alias("p"))
    # The last gap has no match after it.
    zipped = F.slice(F.arrays_zip(F.col("p.gaps").alias("gap"), F.col("p.sizes").alias("n"), F.col("p.hashes").alias("h")), F.lit(1), F.size("p.sizes"))
    one = one.select("_rid", *cols, F.col("p.rank").alias("rank"), F.posexplode(zipped).alias("at", "x"))
    run = Window.partitionBy("_rid", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("stop", F.sum(F.col("x.gap") + F.col("x.n")).over(run).cast("int"))
    return one.where("x.h is not null").select("_rid", *cols, "rank", (F.col("stop") - F.col("x.n")).alias("start"), "stop", F.col("x.h").alias("h"))


def ownership(hits: DataFrame) -> DataFrame:
    """From rows (h, repo, owner), ``n_repos`` and ``n_owners`` per h.

    Counted in levels, each pre-aggregated before its shuffle, so that a hash that half of the
    corpus holds still reaches its task as one row per owner and map task.
    """
    by_repo = hits.groupBy("h", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = by_repo.groupBy("h", "owner").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("n_owners"))
    repos = by_repo.groupBy("h", "repo").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("n_repos"))
    return owners.join(repos, "h")


def _judged(rows: DataFrame, max_owners: int) -> DataFrame:
    """From rows (_rid, _repo, _owner, _parts), staged, to (_rid, start, rank, stop, live, h) of every candidate."""
    each = staged(_candidates(rows, "_repo", "_owner"), "candidates")
    live = ownership(each.select("h", F.col("_repo").alias("repo"), F.col("_owner").alias("owner"))).select("h", (F.col("n_owners") <= max_owners).alias("live"))
    return each.join(live, "h").select("_rid", "start", "rank", "stop", "live", "h")


def _owned(df: DataFrame, repo_col: str, owner_col: str | None) -> list[Column]:
    owner = F.col(position(df, owner_col)) if owner_col else F.lit(None)
    return [F.col(position(df, repo_col)).cast("string").alias("_repo"), owner.cast("string").alias("_owner")]


def scan_secrets(df: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str | None = "source", keep: list[str] | None = None, max_owners: int = 2) -> DataFrame:
    """Per row of df: the columns ``keep`` (``repo_col`` if None), ``spans`` (array of structs), ``n_live`` and ``n_copied``.

    ``spans`` has every base span and the live-looking ones of the further kinds, each with
    ``live``.  ``n_live`` and ``n_copied`` count the row's different candidates of any kind.
    """
    keep = [repo_col] if keep is None else keep
    held = [f"_c{i}" for i in range(len(keep))]
    docs = by_position(df)
    docs = docs.select(*(F.col(position(df, c)).alias(h) for c, h in zip(keep, held, strict=True)), *_owned(df, repo_col, owner_col), F.col(position(df, text_col)).alias("_t"))
    scan = staged(_scanned(docs, "_t").drop("_t"), "secrets")
    kinds = F.array(*(F.lit(k[0]) for k in KINDS))
    base = F.col("rank").isin([r for r, k in enumerate(KINDS) if k[4]])
    span = F.struct("start", "rank", "stop", F.get(kinds, F.col("rank")).alias("kind"), base.alias("base"), "live")
    values = lambda test: F.size(F.collect_set(F.when(test, F.col("h")))).cast("long")
    per_row = _judged(scan, max_owners).groupBy("_rid").agg(F.array_sort(F.collect_list(span)).alias("_x"), values(F.col("live")).alias("_live"), values(~F.col("live")).alias("_copied"))
    found = scan.where(F.size("_parts") > 0).select("_rid", *held).join(per_row, "_rid", "left").drop("_rid")
    out = found.unionByName(scan.where(F.size("_parts") == 0).select(*held), allowMissingColumns=True)
    spans = F.filter(F.coalesce("_x", F.array().cast(_SPANS)), lambda x: x["base"] | x["live"])
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select(*(F.col(h).alias(c) for c, h in zip(keep, held, strict=True)), spans.alias("spans"), n("_live").alias("n_live"), n("_copied").alias("n_copied"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _piece(blocks: Column, start: Column, stop: Column) -> Column:
    """Characters start to stop of a text in blocks; the cost is that of the piece and two blocks."""
    i, j = (start / BLOCK).cast("int"), (stop / BLOCK).cast("int")
    tail = F.concat(F.substring(F.get(blocks, i), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(blocks, j), F.lit(1), stop % BLOCK), F.lit("")))
    return F.when(stop <= start, "").when(i == j, F.substring(F.get(blocks, i), start % BLOCK + 1, stop - start)).otherwise(tail)


def redact_secrets(df: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str | None = "source", mark: str = "[SECRET]", max_owners: int = 2) -> DataFrame:
    """df with each span that ``scan_secrets`` reports, or run of overlapping ones, replaced by ``mark``.

    Only rows with candidates are staged and meet their spans in a shuffle; the others go
    straight from the input to the result.
    """
    docs, text = by_position(df), position(df, text_col)
    t = F.coalesce(F.col(text), F.lit(""))
    some = staged(_scanned(docs.select("*", *_owned(df, repo_col, owner_col)).where(_suspect(t)), text), "redact")
    base = F.col("rank").isin([r for r, k in enumerate(KINDS) if k[4]])
    cut = _judged(some.select("_rid", "_repo", "_owner", "_parts"), max_owners).where(base | F.col("live"))
    before = Window.partitionBy("_rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("start") >= F.coalesce(F.max("stop").over(before), F.lit(0))).cast("int")
    through = Window.partitionBy("_rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    runs = cut.withColumn("f", fresh).withColumn("run", F.sum("f").over(through)).groupBy("_rid", "run").agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    per_row = runs.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_cuts"))
    blocks = F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    done = some.join(per_row, "_rid", "left").withColumn("_blocks", F.when(F.col("_cuts").isNotNull(), blocks))
    # Gaps before each cut, and what is left after the last one.
    kept = F.transform("_cuts", lambda x, i: _piece(F.col("_blocks"), F.when(i == 0, 0).otherwise(F.get("_cuts", i - 1)["b"]), x["a"]))
    rest = _piece(F.col("_blocks"), F.element_at("_cuts", -1)["b"], F.length(t))
    done = done.withColumn(text, F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(F.array_join(F.array_append(kept, rest), mark)))
    return docs.where(~_suspect(t)).unionByName(done.select(*docs.columns)).toDF(*df.columns)

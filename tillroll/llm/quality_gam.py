"""Text quality by a generalised additive model with pairwise interactions.

Features are cut into bins at quantiles.  Cyclic boosting visits the features in turn; each
visit fits a shallow tree (two levels) to the logistic loss's gradient over that feature's
bins and adds a small step to its lookup table.  Then the pairs that lower the remaining loss
most get two-dimensional tables in the same way, from trees that cut each side once.  A score
is the sigmoid of the sum of the looked-up values: bin lookups and additions, vectorised.

The model learns from at most ``max_rows`` labelled ids, those with the least hash, and of a
repeated id from one row, that with the least hash of its text; so what reaches the driver is
bounded and does not depend on the order of rows.  Only these rows' features are taken for
learning; all texts are scored, in one pass.  Without usable labels every score is 0.5.

Null and empty texts have feature values of their own (no words) and are scored; very long ones
are read whole.  Labels of a repeated id are averaged and cut at one half; null labels and null
ids teach nothing.  Repeated rows get equal scores.  Ties: a value on a bin's edge belongs to
the bin above; of equally good cuts the lowest counts.  An empty table gives an empty result.
Columns of documents and labels may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tillroll.llm._common import by_position, position

FEATURES = ("log_words", "symbols", "shouts", "upper", "digits", "distinct", "word_length", "lines", "stops", "pipes", "beyond_ascii", "repeated_lines")
MAX_ROWS = 20_000


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_SYMBOL, _UPPER, _LOWER, _DIGIT, _STOP = _class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(b".,;:")


def features(text: str | None) -> list[float]:
    """One value for each of FEATURES, from the whole text."""
    raw = (text or "").encode()
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x]
    w, chars, letters = max(1, len(words)), max(1, len(raw)), max(1.0, n @ (_UPPER + _LOWER))
    return [np.log1p(len(words)), n @ _SYMBOL / w, n[33] / w, n @ _UPPER / letters, n @ _DIGIT / chars, len(set(words)) / w, sum(map(len, words)) / w, n[10] / w, n @ _STOP / w, n[124] / w, n[128:].sum() / chars, 1 - len(set(lines)) / max(1, len(lines))]


def with_features(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    kept = df.select(*keep, F.col(text_col).alias("_text"))
    schema = StructType(list(kept.schema)[:-1]).add("x", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column("_text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), x], names=schema.names)

    return kept.mapInArrow(run, schema)


@dataclass
class Gam:
    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.cuts:
            b = self.bins(x)
            for k, t in enumerate(self.single):
                total += t[b[k]]
            for (i, j), t in self.pairs.items():
                total += t[b[i], b[j]]
        return 1 / (1 + np.exp(-total))


def _step(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    return g / (h + smooth)


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int, smooth: float) -> tuple[float, int]:
    """Best gain and cut of bins lo to hi."""
    if hi - lo < 2:
        return 0.0, lo
    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    a, b = cg[:-1], ch[:-1]
    gain = a * a / (b + smooth) + (cg[-1] - a) ** 2 / (ch[-1] - b + smooth) - cg[-1] ** 2 / (ch[-1] + smooth)
    k = int(np.argmax(gain))
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """A two-level tree over one feature's bins, as a value for each bin."""
    out = np.zeros(len(g))
    _, cut = _split(g, h, 0, len(g), smooth)
    for lo, hi in ((0, cut), (cut, len(g))):
        gain, inner = _split(g, h, lo, hi, smooth)
        for a, b in ((lo, inner), (inner, hi)) if gain > 0 else ((lo, hi),):
            if b > a:
                out[a:b] = _step(g[a:b].sum(), h[a:b].sum(), smooth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """The best cut of the first side, each part cut once along the second: gain and a value for each cell."""
    best, table = 0.0, np.zeros(g.shape)
    for cut in range(1, g.shape[0]):
        gain, value = 0.0, np.zeros(g.shape)
        for rows in (slice(0, cut), slice(cut, None)):
            a, b = g[rows].sum(0), h[rows].sum(0)
            won, at = _split(a, b, 0, len(a), smooth)
            gain += won + a.sum() ** 2 / (b.sum() + smooth)
            for cols in (slice(0, at), slice(at, None)):
                value[rows, cols] = _step(a[cols].sum(), b[cols].sum(), smooth)
        gain -= g.sum() ** 2 / (h.sum() + smooth)
        if gain > best:
            best, table = gain, value
    return best, table


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 24, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 4, rate: float = 0.1, smooth: float = 2.0) -> Gam:
    """The same rows give the same model, whatever their order."""
    if len(y) == 0 or len(x) == 0:
        return Gam()
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order].astype(float)
    mean = (y.sum() + 1) / (len(y) + 2)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = Gam(cuts, float(np.log(mean / (1 - mean))), [np.zeros(len(c) + 1) for c in cuts])
    bins, total = model.bins(x), np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(bins):
            g, h = slopes()
            size = len(model.single[k])
            add = rate * _tree(np.bincount(b, g, size), np.bincount(b, h, size), smooth)
            model.single[k] += add
            total += add[b]
    # Pairs on the same bins: a table has a cell for each two of them.
    g, h = slopes()
    shape = lambda i, j: (len(model.single[i]), len(model.single[j]))
    cell = lambda i, j, v: np.bincount(bins[i] * shape(i, j)[1] + bins[j], v, shape(i, j)[0] * shape(i, j)[1]).reshape(shape(i, j))
    gains = sorted(((-_pair_tree(cell(i, j, g), cell(i, j, h), smooth)[0], i, j) for i, j in combinations(range(len(bins)), 2)))
    model.pairs = {(i, j): np.zeros(shape(i, j)) for _, i, j in gains[:n_pairs]}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = slopes()
            add = rate * _pair_tree(cell(i, j, g), cell(i, j, h), smooth)[1]
            table += add
            total += add[bins[i], bins[j]]
    return model


def held_out(id_col: Column) -> Column:
    """One row in five, by a checksum of the id; a null id counts as held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, **how) -> Gam:
    """Fit on the documents whose label is known and whose id isn't held out."""
    known = by_position(labels).select(F.col(position(labels, id_col)).alias("_id"), F.col(position(labels, label_col)).alias("_y"))
    known = known.where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    rows = by_position(docs).select(F.col(position(docs, id_col)).alias("_id"), F.col(position(docs, text_col)).alias("_t"))
    # Labels of ids that no document has would take the place of others.
    known = known.join(rows.select("_id"), "_id", "left_semi")
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    taken = rows.join(F.broadcast(sample), "_id").withColumn("_h", F.xxhash64("_t"))  # at most max_rows ids
    one = with_features(taken, ["_id", "_y", "_h"], "_t").groupBy("_id", "_y").agg(F.min(F.struct("_h", "x"))["x"].alias("x"))
    got = one.select("x", "_y").toPandas()
    return fit(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["_y"].to_numpy(int), **how)


def _score_pass(rows: DataFrame, text: str, model: Gam, threshold: float | None) -> DataFrame:
    """rows with ``_score`` instead of their text; with a threshold, the rows as they are that score at least so much."""
    schema = StructType([f for f in rows.schema if f.name != text]).add("_score", "double") if threshold is None else rows.schema
    keep = [n for n in rows.columns if n != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(text)], float).reshape(-1, len(FEATURES))
            scores = model.score(x)
            if threshold is None:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], names=schema.names)
            else:
                yield batch.filter(pa.array(scores >= threshold))

    return rows.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: the id, held_out, score and predicted."""
    model = learn(docs, labels, id_col, text_col, max_rows=max_rows)
    rows = by_position(docs).select(F.col(position(docs, id_col)).alias("_id"), F.col(position(docs, text_col)).alias("_t"))
    score = F.col("_score")
    return _score_pass(rows, "_t", model, None).select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns; no text is shuffled."""
    model = learn(docs, labels, id_col, text_col, max_rows=max_rows)
    return _score_pass(by_position(docs), position(docs, text_col), model, threshold).toDF(*docs.columns)

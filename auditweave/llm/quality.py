"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the whole text: counts of character kinds, words and lines, in ratios. Training: features are
cut at quantiles into bins; shallow trees on one feature's bins at a time are boosted in turn (cyclically) into
one lookup table a feature; then the pairs whose tables would still gain most get tables of their own in the same
way. A score is the logistic function of the sum of table entries, added up for all rows of a batch at once.

Training reads at most about `MAX_LABELLED` labelled rows, chosen by a hash of their ids, a bounded sample;
everything else covers all rows. Where labels are missing or all alike, every score is 0.5 or the one class's share.
Null and empty texts are scored like others (all counts 0). Several labels of a document count as their smallest, as do its several texts in training.
Repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

MAX_LABELLED = 20_000
FEATURES = (
    "log_words", "word_length", "upper", "digits", "marks", "symbols", "bars", "non_ascii", "distinct_words",
    "top_word", "repeats", "log_line_length", "distinct_lines", "stops", "top_word_long",
)
_KIND = np.zeros(256, np.int8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#$%&*@^~<>{}[]\\=+_", b"|", b".,;:"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 7


def features_of(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    data = text.encode("utf-8", "replace")
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8)
    words, lines = data.split(), data.split(b"\n")
    n, chars = max(1, len(words)), max(1, len(data))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    return [
        np.log1p(len(words)), chars / n, kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, kinds[5] / chars, kinds[7] / chars,
        len(counts) / n, top / n, sum(map(eq, words, words[1:])) / n, np.log1p(chars / len(lines)), len(set(lines)) / len(lines), kinds[6] / n, top / n * np.log1p(n),
    ]


def _matrix(texts) -> np.ndarray:
    rows = [features_of(t.as_py() or "") for t in texts]
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


@dataclass
class Model:
    """Cut points of each feature, one table a feature, and one table for each chosen pair."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, b = np.full(len(x), self.base), self.bins(x)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """Leaf values over ordered bins of the tree that cuts greedily, `depth` deep."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h, ridge) + _gain(g.sum() - left_g, h.sum() - left_h, ridge)
        cut = int(gains.argmax()) + 1
        if gains[cut - 1] > _gain(g.sum(), h.sum(), ridge) + 1e-9:
            return np.concatenate((_tree(g[:cut], h[:cut], ridge, depth - 1), _tree(g[cut:], h[cut:], ridge, depth - 1)))
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The cross of one cut in each feature with the largest gain: its leaf values over the grid, and the gain."""
    up_g, up_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = lambda s: (s, s[:, -1:] - s, s[-1:, :] - s, s[-1, -1] - s[:, -1:] - s[-1:, :] + s)
    quarters = list(zip(parts(up_g), parts(up_h), strict=True))
    gains = sum(_gain(a, b, ridge) for a, b in quarters)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    leaf = [a[i, j] / (b[i, j] + ridge) for a, b in quarters]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gains[i, j] - _gain(g.sum(), h.sum(), ridge))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 200, pair_rounds: int = 80, pairs: int = 6, rate: float = 0.1, ridge: float = 1.0) -> Model:
    if not len(y):
        return Model()
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(base=float(np.log(share / (1 - share))))
    model.cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if y.min() == y.max():
        return model
    b, total = model.bins(x), np.full(len(y), model.base)
    slope = lambda: ((y - (p := 1 / (1 + np.exp(-total)))), np.maximum(p * (1 - p), 1e-9))
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = (np.bincount(b[:, j], w, len(table)) for w in slope())
            step = rate * _tree(g, h, ridge, 2)
            table += step
            total += step[b[:, j]]
    shape = lambda i, j: (len(model.tables[i]), len(model.tables[j]))
    grid = lambda i, j, w: np.bincount(b[:, i] * shape(i, j)[1] + b[:, j], w, shape(i, j)[0] * shape(i, j)[1]).reshape(shape(i, j))
    g, h = slope()
    gains = [(_pair_tree(grid(i, j, g), grid(i, j, h), ridge)[1], i, j) for i in range(x.shape[1]) for j in range(i)]
    model.pairs = [(i, j, np.zeros(shape(i, j))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slope()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), ridge)[0]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and `features` of each row."""
    kind = dict(docs.dtypes)[id_col]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = _matrix(batch.column(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[id_col, "features"])

    return docs.select(id_col, text_col).mapInArrow(measure, f"`{id_col}` {kind}, features array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled rows that are not held out; only the texts of the sample are measured."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, max_labelled / max(1, n)) * (1 << 20)))
    quality = {r["doc_id"]: float(r["quality"] > 0) for r in some.collect()}
    ids = F.broadcast(some.select("doc_id"))  # bounded by max_labelled
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = sorted(features(texts).collect())
    x = np.array([r["features"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([quality[r["doc_id"]] for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    kind, model = dict(docs.dtypes)["doc_id"], train(docs, labels)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(add, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that the classifier accepts."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(_matrix(batch.column(at))) >= threshold))

    return docs.mapInArrow(good, docs.schema)

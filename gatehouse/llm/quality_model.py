"""A quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text becomes ``FEATURES``.  Training bins each feature at its quantiles, grows trees of fixed depth on
histograms of gradients (logistic loss, second order), and flattens them into arrays (feature, threshold, value) in
which the children of node i are 2i+1 and 2i+2.  Prediction walks all texts of a batch down all trees with numpy.

The model is fitted on a bounded sample of at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of
the id.  The sample's ids and labels are broadcast (that bound), statistics are made where the texts are, and numbers
alone come to the driver.  Scoring is a map; nothing is shuffled.

Null and empty texts have the statistics of an empty text and get a score.  A document whose labels disagree counts
with their mean, one with several texts with the smallest statistics, so a fit can be repeated; null labels and ids
are not learned from.  Without labels every score is 0.5, with one kind of label
near it.  Repeated rows are scored alike; the empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chunks
from .quality import LETTER, UPPER, Stats, per_text

TRAIN_ROWS, TREES, DEPTH, BINS, RATE, REGULAR = 20_000, 80, 4, 64, 0.12, 1.0
FEATURES = ("words", "word_length", "symbols", "pipes", "exclaims", "upper", "digits", "points", "repeated_words", "repeated_lines", "line_words", "other_bytes", "variety", "letters")


def flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


PIPE, EXCLAIM, DIGIT, POINT, OTHER = flags(b"|"), flags(b"!"), flags(b"0123456789"), flags(b".,;:?"), flags(bytes(range(128, 256)))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES); shares are per word, letter or byte."""
    s = Stats(data, offsets)
    words, size, letters = np.maximum(s.n_words, 1), np.maximum(np.diff(offsets), 1), np.maximum(s.n_letters, 1)
    count = lambda x: per_text(x[data], offsets)
    with np.errstate(over="ignore"):
        distinct = np.unique(s.hashes + s.words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
    variety = np.bincount(s.words.doc[distinct], minlength=s.n) / words
    columns = [np.log1p(s.n_words), s.word_chars / words, s.n_symbols / words, count(PIPE) / words, count(EXCLAIM) / words, count(UPPER) / letters, count(DIGIT) / size, count(POINT) / words, s.n_repeat_words / words, s.n_dup_lines / np.maximum(s.n_lines, 1), s.n_words / np.maximum(s.n_lines, 1), count(OTHER) / size, variety, count(LETTER) / size]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Forest:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Fit to labels between 0 and 1."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    if not len(x):
        return Forest(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # x > e[b] where bin > b
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    total, found = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            gain, choice = np.full(width, 1e-9), [(0, np.inf)] * width
            for f, e in enumerate(edges):
                place = at * BINS + bins[:, f]
                g, h = (np.cumsum(np.bincount(place, v, width * BINS).reshape(width, BINS), axis=1) for v in (grad, hess))
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                better = g**2 / (h + REGULAR) + gr**2 / (hr + REGULAR) - g[:, -1:] ** 2 / (h[:, -1:] + REGULAR)
                better[(h < 1e-3) | (hr < 1e-3)] = 0
                better = better[:, : len(e)]
                if not better.shape[1]:
                    continue
                best = np.argmax(better, axis=1)
                for k in np.flatnonzero(better[np.arange(width), best] > gain):
                    gain[k], choice[k] = better[k, best[k]], (f, e[best[k]])
            for k, (f, e) in enumerate(choice):
                feature[first + k], threshold[first + k] = f, e
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + REGULAR)
        total += value[leaf]
        for part, new in zip(found, (feature, threshold, value), strict=True):
            part.append(new)
    return Forest(base, *(np.stack(v) for v in found))


def measured(df: DataFrame, id_col: str, text_col: str, extra: str | None = None) -> DataFrame:
    """(id, label if ``extra`` names one, FEATURES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                x = features(data, offsets)
                kept = [batch.column(c).slice(a, b - a) for c in (["id", "label"] if extra else ["id"])]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, x.T.copy())], [*(["id", "label"] if extra else ["id"]), *FEATURES])

    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(extra).alias("label")] if extra else [])]
    schema = f"id {df.schema[id_col].dataType.simpleString()}" + ", label double" * bool(extra) + "".join(f", {x} double" for x in FEATURES)
    return df.select(*columns).mapInArrow(run, schema)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> Forest:
    """Fit on the rows of ``df`` that ``labels`` (id_col, label_col) marks."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("marked_id")).agg(F.avg(F.col(label_col).cast("double")).alias("marked_label"))
    picked = marked.orderBy(F.xxhash64("marked_id"), "marked_id").limit(most)
    rows = df.select(id_col, text_col).join(F.broadcast(picked), F.col(id_col) == F.col("marked_id"))
    one = measured(rows, id_col, text_col, "marked_label").groupBy("id").agg(F.min(F.struct(*FEATURES, "label")).alias("x"))
    told = one.select("id", "x.*").toPandas().sort_values("id")
    return grow(told[list(FEATURES)].to_numpy(), told["label"].to_numpy())


def classify(df: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, score, predicted (1 from ``threshold`` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                score = model.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)

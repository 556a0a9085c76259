"""Language identification: the nearest of several clustered centroids per language.

A text becomes a vector of its byte n-grams (one to three bytes of UTF-8, ASCII lower-cased, what is no letter of
ASCII counted as a space), hashed to ``DIMENSIONS`` places: log term frequency times inverse document frequency,
normalised.  Each language has up to ``CLUSTERS`` centroids by spherical k-means.  A text takes the language of the
centroid with the largest cosine, which is its score (0 to 1).  It is rejected (``lang`` is then ``und``) if it lies
farther from that centroid than the ``REACH`` quantile of the training texts of the language, times ``SLACK``.

The model is fitted on a bounded sample, drawn by a hash of id and text: about ``TRAIN_PER_LANGUAGE`` texts a language
and ``TRAIN_ROWS`` in all, of the ``TRAIN_ROWS`` / 2 most frequent languages; rows that repeat id, text and language
count once.  The same rows give the same model, however they are dealt.  Its vectors are made on the executors.
Prediction is a map over whole texts; nothing is shuffled, and the model (languages x CLUSTERS x DIMENSIONS floats)
travels with the tasks.

Null texts and texts without any letter are ``und`` with score 0, as is everything if no text was labelled.  Ties go
to the language that sorts first.  Repeated rows are predicted alike; the empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, chunks

DIMENSIONS, CLUSTERS, REACH, SLACK = 4096, 4, 0.995, 1.25
TRAIN_PER_LANGUAGE, TRAIN_ROWS, MOST_ROWS = 400, 3000, 512
UNKNOWN = "und"
LETTERS = LOWER.copy()
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts of each text, (texts, DIMENSIONS)."""
    n, data = len(offsets) - 1, LETTERS[data].astype(np.uint32)
    text = np.repeat(np.arange(n), np.diff(offsets)) * DIMENSIONS
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    out = np.zeros(n * DIMENSIONS, np.int64)
    gram = np.zeros(len(data), np.uint32)
    for size in (1, 2, 3):
        gram = gram[: len(data) - size + 1] * np.uint32(256) + data[size - 1 :]
        whole = left[: len(gram)] >= size
        place = ((gram + np.uint32(size << 24)) * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(text[: len(gram)][whole] + place[whole], minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(found).astype(np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts, the same for the same vectors."""
    middle = vectors.mean(axis=0)
    centres = [vectors[int(np.argmax(vectors @ middle))]]
    while len(centres) < min(k, len(vectors)):
        near = np.max(np.stack([vectors @ c for c in centres]), axis=0)
        if near.min() > 0.9999:
            break
        centres.append(vectors[int(np.argmin(near))])
    out = np.stack(centres)
    for _ in range(rounds):
        mine = np.argmax(vectors @ out.T, axis=1)
        for c in range(len(out)):
            if (mine == c).any():
                total = vectors[mine == c].sum(axis=0)
                out[c] = total / max(np.linalg.norm(total), 1e-12)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray  # the language of each centroid
    reach: np.ndarray  # the least cosine of each centroid that is not rejected

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, whether it is near enough) of each text."""
        cosine = weighted(counts(data, offsets), self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = cosine[np.arange(len(best)), best]
        return self.of[best], np.clip(score, 0, 1).astype(np.float64), score >= self.reach[best]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, most: int = TRAIN_ROWS) -> Model | None:
    """Fit on rows with a language and a letter; None if there are none."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most // 2).collect()}
    if not sizes:
        return None
    each = max(2, min(per_language, most // len(sizes)))
    part = F.element_at(F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))]), F.col(lang_col))
    marked = rows.select(F.xxhash64(id_col, text_col).alias("mark"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), part.alias("part"))
    draw = F.shiftrightunsigned("mark", 11).cast("double") / float(1 << 53)
    picked = marked.where(draw < F.col("part")).select("mark", "text", "lang").dropDuplicates(["mark", "lang"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text"), most_rows=MOST_ROWS):
                found = np.minimum(counts(data, offsets), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array([x.tobytes() for x in found], pa.binary())], ["lang", "counts"])

    def taken(sample: DataFrame) -> list[tuple[str, bytes]]:
        return sorted((r.lang, bytes(r.counts)) for r in sample.mapInArrow(vectors, "lang string, counts binary").toLocalIterator())

    told = taken(picked) or taken(marked.select("mark", "text", "lang").dropDuplicates(["mark", "lang"]).orderBy("mark", "lang").limit(most))
    languages = sorted({x for x, _ in told})
    found = np.stack([np.frombuffer(x, "<u2") for _, x in told])
    number = np.array([languages.index(x) for x, _ in told])
    idf = (np.log((1 + len(found)) / (1 + (found > 0).sum(axis=0))) + 1).astype(np.float32)
    full = weighted(found, idf)
    centroids, of, reach = [], [], []
    for k in range(len(languages)):
        mine = full[number == k]
        centres = clustered(mine, CLUSTERS)
        far = np.quantile(1 - (mine @ centres.T).max(axis=1), REACH)
        centroids.append(centres)
        of += [k] * len(centres)
        reach += [1 - SLACK * far] * len(centres)
    return Model(languages, idf, np.concatenate(centroids), np.array(of), np.array(reach))


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang (``und`` if rejected), nearest (``und`` only without a letter), score, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text"), most_rows=MOST_ROWS):
                letters = batch.column("letters").slice(a, b - a).to_numpy(zero_copy_only=False)
                if model:
                    number, score, near = model.predict(data, offsets)
                else:
                    number, score, near, letters = np.zeros(b - a, int), np.zeros(b - a), np.zeros(b - a, bool), np.zeros(b - a, bool)
                near = near & letters
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(number.tolist(), letters.tolist(), strict=True)]
                lang = [x if ok else UNKNOWN for x, ok in zip(names, near.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(lang, pa.string()), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(~near)], ["id", "lang", "nearest", "score", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"id {kind}, lang string, nearest string, score double, rejected boolean").withColumnRenamed("id", id_col)

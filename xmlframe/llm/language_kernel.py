"""Language ID with a string kernel.

The kernel of two texts is the cosine of their sets of character n-grams, lengths 1 to 3 blended, case
folded. Nyström landmarks turn it into features: the kernel values against the landmarks times the
inverse root of the landmarks' own kernel matrix. One ridge regression for each language, fitted on these
features, separates it from the rest; the largest output names the language.

Whole texts are scored in blocks. Of a text's n-grams only their number and those that a landmark has
matter to its kernel values: a block is a 0/1 matrix over the landmarks' n-grams, and scoring is a product
with the landmarks' matrix and one with the regression's weights.

Learning reads whole texts in tasks. The driver gets the landmarks' n-grams and one row of kernel values for
each text learned from, so it holds FIT_ROWS x LANDMARKS numbers, however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free, id_remainder, materialize, slices, strings

#: N-gram lengths; values that n-grams are hashed to; landmarks, and the least number for each language; ridge;
#: labelled rows to fit on, at most about.
LENGTHS, COLUMNS, LANDMARKS, EACH, RIDGE, FIT_ROWS = (1, 2, 3), 1 << 18, 96, 4, 1e-2, 4_000
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Entries of a block's matrix.
BLOCK = 1 << 21


class Marks:
    """Marks the hashed n-grams of one text after the other in an array of COLUMNS places."""

    def __init__(self):
        self.seen = np.zeros(COLUMNS, bool)

    def of(self, text: str, columns: np.ndarray | None = None) -> tuple[int, np.ndarray]:
        """The number of n-grams of a whole text and which of the columns they hit; without columns, all that
        they hit. N-grams do not cross texts, and runs of characters that are not letters count as one space."""
        places = _places(text)
        for h in places:
            self.seen[h] = True
        n = int(np.count_nonzero(self.seen))
        found = np.flatnonzero(self.seen) if columns is None else self.seen[columns]
        for h in places:
            self.seen[h] = False
        return n, found


def _places(text: str) -> list[np.ndarray]:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(codes):
        return []
    letter = _letters(codes)
    codes = np.where(letter, codes, 32)
    kept = codes[letter | np.concatenate([[False], letter[:-1]])]
    codes = np.concatenate([[32], kept, [32] if len(kept) and kept[-1] != 32 else []]).astype(np.uint64)
    out = []
    for n in LENGTHS:
        h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for k in range(n):
            h = (h + codes[k : k + len(h)]) * np.uint64(MULTIPLIERS[k]) & np.uint64(0xFFFFFFFF)
        h ^= h >> np.uint64(15)
        h = (h * np.uint64(MULTIPLIERS[n - 1])) & np.uint64(0xFFFFFFFF)
        out.append(((h >> np.uint64(8)) % COLUMNS).astype(np.int64))
    return out


_is_letter: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.array([chr(c).isalpha() for c in range(0x32000)], bool)
    return _is_letter[np.minimum(codes, len(_is_letter) - 1)]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Landmarks:
    columns: np.ndarray  # the n-grams that a landmark has
    matrix: np.ndarray  # columns x landmarks: 1 / root of the landmark's number of n-grams, where it has the n-gram

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Landmarks:
        columns = np.unique(np.concatenate(sets))
        matrix = np.zeros((len(columns), len(sets)), np.float32)
        for k, s in enumerate(sets):
            matrix[np.searchsorted(columns, s), k] = 1 / np.sqrt(len(s))
        return cls(columns, matrix)

    def kernel(self, texts: list[str], marks: Marks) -> np.ndarray:
        """The kernel values of whole texts against the landmarks, a block of texts at a time."""
        out, step = [], max(1, BLOCK // len(self.columns))
        for at in range(0, len(texts), step):
            block = texts[at : at + step]
            x, n = np.zeros((len(block), len(self.columns)), np.float32), np.ones((len(block), 1), np.float32)
            for row, text in enumerate(block):
                count, x[row] = marks.of(text, self.columns)
                n[row] = max(1, count)
            out.append((x @ self.matrix) / np.sqrt(n))
        return np.concatenate(out) if out else np.zeros((0, self.matrix.shape[1]), np.float32)


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # landmarks x languages: inverse root times ridge weights
    offset: np.ndarray

    def scores(self, texts: list[str], marks: Marks) -> np.ndarray:
        return self.landmarks.kernel(texts, marks) @ self.weights + self.offset


def fit_rows(docs: DataFrame, rows: int = FIT_ROWS, held_out: int = 1, folds: int = 3) -> DataFrame:
    """About `rows` rows to learn from, by a hash of the id: text and language known, a letter in the
    text, crc32 of the id modulo `folds` not `held_out`. Rare languages keep more of their rows: each
    language has an equal part of the bound, and one row at least."""
    known = docs.filter((id_remainder("doc_id", folds) != held_out) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64("doc_id", F.lit(7), "text")
    counts = known.groupBy("lang").agg(F.count("*"), F.min(order)).collect()
    if not counts:
        return known.limit(0)
    each = rows / len(counts)
    keep, lowest = free("keep", docs.columns), free("lowest", docs.columns)
    parts = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n), first) for lang, n, first in counts], f"lang string, {keep} double, {lowest} long")
    chosen = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < F.col(keep) * (1 << 20)) | (order == F.col(lowest))
    return known.join(F.broadcast(parts), "lang").filter(chosen).select(*docs.columns)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of whole texts, beside the texts."""
    marks = Marks()
    for part in slices(batches, "text", rows=128):
        found = [marks.of(t or "")[1].astype(np.int32).tobytes() for t in strings(part.column(2))]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], ["h", "lang", "text", "grams"])


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Learn from the whole texts of `fit_rows`. Landmarks are the same number of rows of each language, first
    in the hash order of the ids. None if there is nothing to learn from."""
    spark = docs.sparkSession
    sample = fit_rows(docs, rows).select(F.xxhash64("doc_id").alias("h"), "lang", "text")
    sample = materialize(sample.mapInArrow(_sets, "h long, lang string, text string, grams binary"), "language-sample")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "grams"))  # of about FIT_ROWS rows in all
    n_languages = max(1, sample.select("lang").distinct().count())
    chosen = sample.select("lang", "h", "grams").withColumn("place", place).filter(F.col("place") <= max(EACH, LANDMARKS // n_languages))
    chosen = [np.frombuffer(r["grams"], np.int32) for r in chosen.orderBy("lang", "place").collect()]
    if not chosen:
        discard(sample)
        return None
    landmarks = Landmarks.of(chosen)
    shared = spark.sparkContext.broadcast(landmarks)  # the n-grams of the landmarks, whatever the input

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()
        for part in slices(batches, "text", rows=128):
            k = shared.value.kernel([t or "" for t in strings(part.column(2))], marks)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in k], pa.binary())], ["h", "lang", "k"])

    found = sorted(tuple(r) for r in sample.select("h", "lang", "text").mapInArrow(values, "h long, lang string, k binary").collect())
    discard(sample)
    languages = sorted({lang for _, lang, _ in found})
    x = np.frombuffer(b"".join(k for _, _, k in found), np.float32).reshape(len(found), -1).astype(np.float64)
    y = np.array([languages.index(lang) for _, lang, _ in found])
    eigenvalues, vectors = np.linalg.eigh(landmarks.matrix.T.astype(np.float64) @ landmarks.matrix)
    root = vectors * (1 / np.sqrt(np.maximum(eigenvalues, 1e-6))) @ vectors.T
    z = x @ root
    mean, goal = z.mean(axis=0), np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = np.bincount(y, minlength=len(languages))
    heavy = (len(y) / (len(languages) * share))[y][:, None]  # languages weigh the same
    w = np.linalg.solve((z - mean).T @ ((z - mean) * heavy) + RIDGE * len(y) * np.eye(z.shape[1]) / z.shape[1], (z - mean).T @ ((goal - goal.mean(axis=0)) * heavy))
    return Model(languages, landmarks, (root @ w).astype(np.float32), (goal.mean(axis=0) - mean @ w).astype(np.float32))


def identify(docs: DataFrame, model: Model | None, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language of each whole text and a score from 0 to 1. Null texts, texts without a letter and
    all texts if there is no model are `und` with score 0. Columns of docs stay, but those with the names of the
    two new ones give way."""
    docs = docs.drop(prediction, score)
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    at = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, marks = shared.value, Marks()
        for part in slices(batches, text, rows=128):
            texts = strings(part.column(at))
            lang, sure = ["und"] * len(texts), [0.0] * len(texts)
            if m and (real := [k for k, t in enumerate(texts) if t and has_letter(t)]):
                s = m.scores([texts[k] for k in real], marks).astype(np.float64)
                p = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                for k, best, row in zip(real, s.argmax(axis=1), p, strict=True):
                    lang[k], sure[k] = m.languages[best], float(row[best])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(sure, pa.float64())], [*names, prediction, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{schema}, `{prediction}` string, `{score}` double")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text; learned from rows that are not held out. Rows with
    one id, or none, are rows of their own."""
    held = docs.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return identify(held, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")

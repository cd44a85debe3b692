"""Toxicity by a chain of classifiers.

The categories are predicted one after the other, each by a linear model over the presence of selected
words and word beginnings; the probabilities of the earlier categories are further inputs of the later
models. In training these come from models that have not seen the row: each fold is predicted by a model
of the other folds, with features that the other folds select.

The labels hold one flag. Toxic texts come in kinds - languages, vocabularies -, so the earlier categories are
the kinds of the toxic rows learned from, found by clustering their telling features (kind_1 to kind_3), and
the flag itself (toxic) is the last category: what is predicted has gone through the whole chain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_remainder, materialize, slices, strings

#: Labelled rows of each label to fit on, at most about; features of a model, at most; folds; ridge; steps of a fit;
#: kinds; standard errors that a feature's frequencies must lie apart.
FIT_ROWS, FEATURES, FOLDS, RIDGE, STEPS, KINDS, APART = 8_000, 512, 3, 1e-4, 120, 3, 7
CATEGORIES = (*[f"kind_{k + 1}" for k in range(KINDS)], "toxic")
WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6)
WORDS_KEPT = 500_000


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """The features of a text's distinct words: the words, `abcd*` for a beginning that one of them has, and
    `abcd**` for one that several have."""
    starts = Counter(w[:n] for w in words for n in BEGINNINGS if len(w) >= n)
    return words | {f"{s}*" for s in starts} | {f"{s}**" for s, n in starts.items() if n > 1}


class Lookup(dict):
    """A word's selected features, and its beginnings of which two count; the latest words are kept."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        starts = [word[:n] for n in BEGINNINGS if len(word) >= n]
        once = tuple(self.index[f] for f in [word, *[f"{s}*" for s in starts]] if f in self.index)
        found = self[word] = once, tuple(self.index[f"{s}**"] for s in starts if f"{s}**" in self.index)
        return found

    def present(self, text: str | None) -> list[int]:
        """Indices of the features in a text."""
        out, often = set(), Counter()
        for w in words_of(text):
            once, twice = self[w]
            out.update(once)
            often.update(twice)
        return sorted(out | {i for i, n in often.items() if n > 1})


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the last weight is the intercept. Both
    labels weigh the same. A label that is always the same gives a constant."""
    if not len(y) or y.min() == y.max():
        return np.append(np.zeros(x.shape[1]), 8.0 if len(y) and y[0] else -8.0)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32, copy=False)
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    rate = 4 / (float(((x * x).sum(axis=1) * weight).sum()) + 1e-9)
    w = z = np.zeros(x.shape[1])
    for k in range(steps):
        off = weight * (sigmoid((x @ z.astype(np.float32)).astype(np.float64)) - y)
        grad = (off.astype(np.float32) @ x).astype(np.float64) + RIDGE * np.append(z[:-1], 0)
        new = z - 4 * rate * grad
        w, z = new, new + k / (k + 3) * (new - w)
    return w


@dataclass
class Chain:
    index: dict[str, int]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column for each category, in the chain's order."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            seen = np.hstack([x, out])
            out = np.hstack([out, sigmoid(seen @ w[:-1] + w[-1])[:, None]])
        return out


def matrix(present: list[list[int]], columns: int, kind: type = np.float32) -> np.ndarray:
    x = np.zeros((len(present), columns), kind)
    for row, found in enumerate(present):
        x[row, found] = 1
    return x


def _feature_counts(train: DataFrame) -> DataFrame:
    """(f, p0, q0, p1, q1, ...): in how many toxic rows (p) and others (q) of each fold a feature occurs, of
    features that occur in three rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches, "text"):
            for t, y, k in zip(strings(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                counts.update((f, y, k) for f in features_of(words_of(t)))
            if len(counts) > WORDS_KEPT:
                yield batch(counts)
                counts = Counter()
        yield batch(counts)

    def batch(counts: Counter) -> pa.RecordBatch:
        f, y, k = zip(*counts, strict=True) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(y, pa.int32()), pa.array(k, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["f", "y", "fold", "n"])

    rows = train.select("text", "label", "fold").mapInArrow(work, "f string, y int, fold int, n long")
    total = lambda y, k: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n"))), F.lit(0)).alias(f"{'qp'[y]}{k}")
    return rows.groupBy("f").agg(*[total(y, k) for k in range(FOLDS) for y in (1, 0)]).filter(" + ".join(f"p{k} + q{k}" for k in range(FOLDS)) + " >= 3")


def _best(counts: DataFrame, sizes: dict[tuple[int, int], int], without: int | None) -> list[tuple[str, bool]]:
    """The FEATURES features with the largest difference between toxic and other rows, in standard errors and
    APART at least, in all folds but one, and whether each is commoner in toxic rows."""
    seen = [k for k in range(FOLDS) if k != without]
    pos, neg = (max(1, sum(sizes.get((y, k), 0) for k in seen)) for y in (1, 0))
    p, q = (F.expr(" + ".join(f"{side}{k}" for k in seen)) for side in "pq")
    gap = F.abs(p / pos - q / neg) / F.sqrt((p + q + 1) / (pos + neg) * (1 / pos + 1 / neg))
    return [tuple(r) for r in counts.select("f", (p / pos > q / neg).alias("more"), gap.alias("gap")).filter(F.col("gap") >= APART).orderBy(F.desc("gap"), "f").limit(FEATURES).select("f", "more").collect()]


def kinds_of(x: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Which of KINDS clusters each row of a 0/1 matrix is in, by cosine; the first centres are far apart."""
    v = x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    if not len(v):
        return np.zeros(0, int)
    centres = v[:1]
    while len(centres) < min(KINDS, len(v)):
        centres = np.vstack([centres, v[(v @ centres.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        near = (v @ centres.T).argmax(axis=1)
        sums = np.stack([v[near == k].sum(axis=0) for k in range(len(centres))])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-9)
    return near


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, rows: int = FIT_ROWS) -> Chain | None:
    """Learn from labelled documents whose crc32 of the id modulo `folds` is not 0: about `rows` of each
    label, by a hash of the id; the bound holds for fitting alone. A document with several labels counts
    with the largest. None without labelled documents."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_remainder("doc_id", folds) != 0))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None
    rate = F.when(F.col("label") == 1, min(1.0, rows / counts.get(1, 1))).otherwise(min(1.0, rows / counts.get(0, 1)))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < rate * (1 << 20))
    # About 2 * rows ids at most, whatever the input: no text is shuffled, and the texts are read once.
    train = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    train = materialize(train.select(F.xxhash64("doc_id").alias("h"), "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-rows")
    sizes = {(r[0], r[1]): r[2] for r in train.groupBy("label", "fold").count().collect()}
    if not sizes:
        discard(train)
        return None
    words = materialize(_feature_counts(train), "toxicity-words")
    best = {k: _best(words, sizes, k) for k in (None, *range(FOLDS))}
    names = sorted({f for found in best.values() for f, _ in found})
    index = {f: k for k, f in enumerate(names)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(index)
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([look.present(t) for t in strings(part.column(1))], pa.list_(pa.int32()))], ["h", "label", "fold", "present"])

    got = sorted((tuple(r) for r in train.mapInArrow(read, "h long, label int, fold int, present array<int>").collect()))
    discard(train, words)
    x = matrix([r[3] for r in got], len(names), np.uint8)
    toxic, fold = np.array([r[1] == 1 for r in got]), np.array([r[2] for r in got])
    telling = [index[f] for f, more in best[None] if more]
    kind = np.full(len(got), -1)
    kind[toxic] = kinds_of(x[toxic][:, telling].astype(np.float32))
    columns = {k: [index[f] for f, _ in found] for k, found in best.items()}
    weights, earlier = [], np.zeros((len(got), 0), np.float32)
    for y in [*[kind == k for k in range(KINDS)], toxic]:
        # A row's probability for the models behind comes from a model, and from features, of the other folds.
        held = np.zeros((len(got), 1), np.float32)
        for k in range(FOLDS):
            mine = fold == k
            if mine.any() and not mine.all():
                seen = np.hstack([x[:, columns[k]], earlier])
                w = logistic(seen[~mine], y[~mine])
                held[mine, 0] = sigmoid(seen[mine] @ w[:-1] + w[-1])
        weights.append(logistic(np.hstack([x[:, columns[None]], earlier]), y))
        earlier = np.hstack([earlier, held])
    return Chain({f: k for k, (f, _) in enumerate(best[None])}, weights)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, kind_1, kind_2, kind_3, toxic, predicted) of every whole text: the categories'
    probabilities in the chain's order, and 1 if toxic, the last, is at least `threshold`. Null texts count as
    empty, equal texts get equal values; rows with one id are rows of their own, and a null id is one like others.
    Without labels all are 0. Other columns of docs are not looked at. An empty table gives an empty result."""
    chain = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES features, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        look = Lookup(c.index) if c else None
        for part in slices(batches, "text"):
            n = part.num_rows
            p = c.probabilities(matrix([look.present(t) for t in strings(part.column(2))], len(c.index))) if c else np.zeros((n, len(CATEGORIES)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(p[:, k].astype(np.float64)) for k in range(len(CATEGORIES))], pa.array((p[:, -1] >= threshold).astype(np.int32))], ["doc_id", "held_out", *CATEGORIES, "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, {', '.join(f'{c} double' for c in CATEGORIES)}, predicted int")

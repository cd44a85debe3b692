"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark columns. Boosted trees on a bounded sample of labelled rows are taken
apart: the path to each node is a conjunction of thresholds, a rule. A lasso logistic regression keeps
few of the rules and gives them weights. What it keeps is compiled back into one Spark column, so that
scoring is a projection without a shuffle or Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, materialize, word_array

#: Labelled rows to fit on, at most about; boosted trees and their depth; lasso strength.
FIT_ROWS, TREES, DEPTH, LASSO = 20_000, 8, 3, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a whole text, as columns over the columns of `prepared`. All are 0 for an empty
    or null text."""
    t, w = F.col("_t"), F.col("_w")
    chars, words = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(w), F.lit(1))
    count = lambda keep: F.length(F.regexp_replace(t, keep, "")) / chars
    distinct = F.size(F.array_distinct(w))
    pairs = F.greatest(F.size(w) - 1, F.lit(1))
    same = F.size(F.filter(F.arrays_zip(F.slice(w, 1, pairs).alias("a"), F.slice(w, 2, pairs).alias("b")), lambda p: p["a"] == p["b"]))
    return {
        "chars": F.log1p(F.length(t)),
        "words": F.log1p(F.size(w)),
        "word_chars": (F.length(t) - F.size(w)) / words,
        "letters": count(r"\P{L}+"),
        "symbols": count(r"[\p{L}\p{N}\s.,;:!?'\"()-]+"),
        "digits": count(r"\P{N}+"),
        "capitals": count(r"\P{Lu}+"),
        "stops": count(r"[^.!?]+"),
        "commas": count(r"[^,;:]+"),
        "line_feeds": count(r"[^\n]+"),
        "distinct": distinct / words,
        "repeated": same / words,
    }


def prepared(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", word_array(F.col("_t")))


@dataclass
class Rule:
    conditions: list[tuple[str, str, float]]  # statistic, "<=" or ">", threshold
    weight: float = 0.0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s) <= v if op == "<=" else F.col(s) > v for s, op, v in self.conditions])


@dataclass
class RuleEnsemble:
    """score = sigmoid(intercept + sum of the weights of the rules that hold)."""

    names: list[str]
    rules: list[Rule]
    intercept: float

    def score(self, df: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """Add the score; a column of df with its name gives way. The statistics are computed once, in a
        projection below the rules."""
        df = df.drop(out)
        total = reduce(lambda a, r: a + F.when(r.column(), r.weight).otherwise(0.0), self.rules, F.lit(self.intercept))
        stats = prepared(df.select(*[F.col(c).alias(f"_in_{k}") for k, c in enumerate(df.columns)], F.col(text).alias("_text")), "_text").withColumns(statistics(F.col("_text")))
        return stats.select(*[F.col(f"_in_{k}").alias(c) for k, c in enumerate(df.columns)], (1 / (1 + F.exp(-total))).alias(out))


def tree_rules(model: GBTClassificationModel, names: list[str]) -> list[Rule]:
    """The path to each node but the roots, of all trees; equal paths once."""
    found: dict[tuple, Rule] = {}

    def walk(node, path: tuple) -> None:
        if path:
            found.setdefault(tuple(sorted(path)), Rule(list(path)))
        if node.numDescendants() > 0:
            split = node.split()
            name, value = names[split.featureIndex()], split.threshold()
            walk(node.leftChild(), (*path, (name, "<=", value)))
            walk(node.rightChild(), (*path, (name, ">", value)))

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found.values())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, folds: int = 5) -> RuleEnsemble:
    """Learn from documents with a label whose crc32 of the id modulo `folds` is not 0: about `rows` of
    them, by a hash of the id; the bound holds for fitting alone. Without labels of both kinds the score is
    0.5, or the only label. A document with several labels counts with the largest."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_remainder("doc_id", folds) != 0))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("double").alias("label"))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < min(1.0, rows / max(1, known.count())) * (1 << 20))
    # At most about `rows` ids: a few hundred KB whatever the input, so that no text is shuffled.
    train = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    stats = statistics(F.col("text"))
    names = list(stats)
    train = materialize(prepared(train, "text").select("label", *[c.cast("double").alias(k) for k, c in stats.items()]), "quality-fit")
    kinds = [r[0] for r in train.select("label").distinct().collect()]
    if len(kinds) < 2:
        return RuleEnsemble([], [], {0.0: -10.0, 1.0: 10.0}[kinds[0]] if kinds else 0.0)
    # A handful of partitions in a fixed order: fitting is many small jobs, and must not vary by run.
    train = train.repartition(4, "label", *names).sortWithinPartitions("label", *names)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(train).select("label", "features", *names).cache()
    try:
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.5, seed=1, cacheNodeIds=False).fit(data)
        rules = tree_rules(trees, names)
        held = data.select("label", *[r.column().cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
        held = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(held).select("label", "features")
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(held)
    finally:
        data.unpersist()
    for r, w in zip(rules, lasso.coefficients, strict=True):
        r.weight = float(w)
    return RuleEnsemble(names, [r for r in rules if r.weight], float(lasso.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs. Null and empty texts have the score of
    an empty text. Other columns of docs are not looked at."""
    model = fit(docs, labels)
    out = model.score(docs.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "text"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

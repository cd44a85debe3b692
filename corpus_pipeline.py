"""A corpus pipeline of five stages. Each takes what the stage before kept, as a written table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmlframe.llm.common import discard, finished, free
from xmlframe.llm.language_kernel import fit, identify
from xmlframe.llm.line_dedup import unrepeated
from xmlframe.llm.ngram_jaccard import keep_one
from xmlframe.llm.sentencepiece_bpe import encode_digests
from xmlframe.llm.source_mixing import mix_texts


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 7): documents without a letter, or without text, go; lang becomes what the
    text says, and stays, or is `und` if null, where there is nothing to learn from."""
    docs = docs.filter(F.col("text").rlike(r"\p{L}"))
    said, sure = free("lang_pred", docs.columns), free("score", docs.columns)
    found = identify(docs, fit(docs), prediction=said, score=sure)
    return found.withColumn("lang", F.when(F.col(said) != "und", F.col(said)).otherwise(F.coalesce("lang", said))).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 8): lines that an earlier document has, exactly or nearly, go, and documents
    of which nothing is left."""
    return unrepeated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (operator 4): of each group of linked documents the smallest id stays."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (operator 2): the documents as the mix takes them, as often as it takes them."""
    return mix_texts(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece coding (operator 3): the digests of the ids of each row, and of their decoding, with the language
    that the first stage found."""
    return encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("source_mixing", mixture),
    ("sentencepiece", encoding),
]

#: SQL cannot express the stages: they learn, join by edit distance, walk graphs and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again; tables that are no longer read are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, finished(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .language_kernel import language_of_documents
from .line_dedup import line_digests
from .media_sniff import media_columns
from .metric_join import embedding_duplicates
from .ngram_jaccard import jaccard_components
from .quality_rules import quality_scores
from .sentencepiece_bpe import encode_digests
from .source_mixing import mixed_taken
from .token_counts import token_counts
from .toxicity_chain import toxicity

PIECES = "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of each whole document; null and empty texts score as an empty text."""
    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; null texts have none, equal ids are rows of their own."""
    return mixed_taken(_documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each whole document and of their decoding; null texts count as empty."""
    return encode_digests(_documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set size and component of each document; rows of one id are one node, null ids and texts without words have no links."""
    return jaccard_components(_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each whole document; null texts count as empty."""
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's probabilities for each whole document, and what they predict; null texts count as empty."""
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each whole document; `und` for null texts and texts without a letter."""
    return language_of_documents(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document before and after dedup; null ids count as the last document, rows of one id as one."""
    return line_digests(_documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text stored as media, sniffed and read back; null texts count as empty."""
    return media_columns(_documents(spark, sf_dir))


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector; rows without a label or a usable vector have no links, rows of one id count each."""
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


_REACH = """
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.id)
"""

_JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (
  SELECT id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
nodes AS (SELECT id, len(sh) AS n FROM sets),
grams AS (SELECT id, unnest(sh) AS g FROM sets),
pairs AS (SELECT a.id AS x, b.id AS y, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN nodes nx ON nx.id = x JOIN nodes ny ON ny.id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
{_REACH}
SELECT n.id AS doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id FROM nodes n JOIN reach r USING (id) GROUP BY ALL
"""

_VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.id AS x, b.id AS y FROM nodes a JOIN nodes b ON a.label = b.label AND a.id < b.id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
{_REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM both_ways b WHERE b.x = n.id)::BIGINT AS n_links, min(r.c) AS component_id, n.id = min(r.c) AS kept
FROM nodes n JOIN reach r USING (id) GROUP BY n.id
"""


def oracle_sql() -> dict[str, str]:
    """The other queries learn, tokenize, cut text in seeded blocks or store files; tests/llm holds them
    against brute force, the libraries and exact round trips."""
    return {"op4_ngram_jaccard": _JACCARD, "op10_metric_join": _VECTORS}

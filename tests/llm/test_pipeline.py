"""The pipeline's stages, each held against its operator's rules on its own input."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from xmlframe.llm.common import materialize
from xmlframe.llm.ngram_jaccard import similar_groups
from xmlframe.llm.source_mixing import mix


def test_stages(spark, docs, none, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    seen = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], str(tmp_path)), f"test-{name}"))
        assert name == corpus_pipeline.STAGES[-1][0] or seen[-1].columns == plain.columns
    first, language, lines, near, mixed, coded = seen
    letters = first.filter(F.col("text").rlike(r"\p{L}"))
    assert language.count() == letters.count() and language.filter("lang is null").isEmpty()
    assert lines.select("doc_id").exceptAll(language.select("doc_id")).isEmpty()
    split = lines.select("doc_id", F.explode(F.split("text", "\n")).alias("x")).filter("trim(x) <> ''")
    assert split.groupBy("x").agg(F.countDistinct("doc_id").alias("n")).filter("n > 1").isEmpty()
    groups = similar_groups(lines)
    assert near.count() == groups.filter("component = id or id is null").count()
    assert similar_groups(near).filter("component <> id").isEmpty()
    words = mixed.select(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))).first()[0]
    assert words == mix(near).agg(F.sum("taken")).first()[0]
    assert coded.count() == mixed.count() and coded.filter("n_tokens < 2").isEmpty()
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("n_tokens")).first() == coded.agg(F.sum("n_tokens")).first()


def test_stages_take_an_empty_table(spark, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
    assert public_tokenizers.path("piece_bpe_32k.model")


def test_documents_stay_if_no_language_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "...", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.language(spark, docs, "").collect()] == [(1, "some words", "und")]


def test_the_result_tells_the_language_that_was_found(spark, tmp_path):
    """Every row has a language that the first stage found: other labels or texts would give others."""
    own = {"en": "the river and the old house near the wood", "de": "der Fluss und das alte Haus bei dem Wald"}
    rows = [(k, f"{own[lang]} {k} {k * 7}", lang if k % 4 else None, "a", 0) for k, lang in enumerate(["en", "de"] * 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "lang").distinct().collect()
    assert found and all(r["lang"] == ("en", "de")[r["doc_id"] % 2] for r in found)

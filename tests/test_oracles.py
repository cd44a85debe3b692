"""Each query against its SQL in DuckDB, and the contract of the entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
import tools_verify
from xmlframe import queries as xml_queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return tools_verify.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(xml_queries.oracle_sql()))
def test_query(spark, con, sf_dir, name):
    assert isinstance(con, duckdb.DuckDBPyConnection)
    assert not tools_verify.compare(spark, con, name, sf_dir)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_positions_are_of_whole_texts(spark, sf_dir):
    at = entry.queries()["pos_02_whole_text"](spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for doc_id, line, col, middle_line, middle_col in at.collect():
        for text, found in ((texts[doc_id], (line, col)), (texts[doc_id][: len(texts[doc_id]) // 2], (middle_line, middle_col))):
            assert found == (text.count("\n") + 1, len(text) - text.rfind("\n")), doc_id


def test_differences_and_invalid_characters_are_found_in_whole_texts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for doc_id, at_end, at_middle, same in entry.queries()["diff_02_whole_text"](spark, sf_dir).collect():
        assert (at_end, at_middle, same) == (len(texts[doc_id]), len(texts[doc_id]) // 2, True), doc_id
    for doc_id, at, code, valid in entry.queries()["chr_11_whole_text"](spark, sf_dir).collect():
        assert (at, code, valid) == (len(texts[doc_id].encode()), 1, True), doc_id

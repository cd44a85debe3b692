"""Reading documents and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encoding
from ..operators.codec import OPTIONS


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, text, encoding, error) of whole files, decoded by what their bytes say."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    guess = encoding.guess(F.col("content"))
    return files.select("path", "content", encoding.decode(F.col("content"))["text"].alias("text"), guess["encoding"].alias("encoding"), guess["error"].alias("error"))


def read_records(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """One row for each `row_tag` element of files, of a given schema; large files are split."""
    return spark.read.format("xml").schema(schema).options(**OPTIONS).option("rowTag", row_tag).load(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """A document on each line of text files: line ends inside are written as references."""
    line = F.replace(F.replace(F.col(column), F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))
    df.select(line.alias("value")).write.text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def to_bytes(text, charset: str = "utf-8"):
    return F.encode(text, charset)

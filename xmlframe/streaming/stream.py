"""Documents on streams. Operators that look at one row at a time, checks and events among them, run as they
are; those with windows over a document's events run in foreachBatch, a document being whole in one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.codec import OPTIONS
from ..operators.events import tag_name, tokenize


def read_records(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    return spark.readStream.format("xml").schema(schema).options(**OPTIONS).option("rowTag", row_tag).load(path)


def tag_counts(stream: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Running counts of element names; the state holds a row for each name."""
    rows = tokenize(stream, doc_id, text).filter(F.col("token").rlike(r"\A<[^!?/]"))
    return rows.groupBy(tag_name(F.col("token")).alias("name")).agg(F.count("*").alias("n_elements"))


def by_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Append operator(batch) to a Parquet table. Each batch has its own folder, written anew on a
    repeat, so that a batch that is run twice counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

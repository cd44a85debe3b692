"""What the operators share: the cluster's shared folder, tables written there, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: a temporary folder if driver and executors are
    one process (local mode); on a cluster that is an error, for executors could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(?:\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost
    executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    _written.append(table)
    return table


_written: list[DataFrame] = []


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, written as a table; the tables that were written on the way to it are deleted."""
    before = len(_written)
    out = materialize(make(), name)
    discard(*_written[before:-1])
    del _written[before:-1]
    return out


def free(name: str, taken: list[str]) -> str:
    """The name, or the name with as many underscores in front as make it none of those taken."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more: what was made of them must be written."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(conf).delete(path, True)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    """Python strings of a column; bytes that are not UTF-8 become U+FFFD instead of an error."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most `rows` rows and about `size` bytes of text (one row at least),
    so that very long texts do not add up in a worker."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        step = max(1, min(rows, int(size * batch.num_rows / max(1, batch.column(k).nbytes))))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if part.num_rows > 1 and part.column(k).nbytes > 2 * size:
                yield from (part.slice(i, 1) for i in range(part.num_rows))
            else:
                yield part


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for a row: a plain column that lambdas refer to may be
    computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def id_remainder(column: str, n: int):
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def word_array(text):
    """The words `[^\\x20\\x09-\\x0D]+` of a text column; null gives an empty array."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5), " "), "")

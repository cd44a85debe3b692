"""Conformance corpora: verdicts from checks, and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, suite, expected, content, golden) of a folder of test files: what is expected comes from
    the folders' or files' names, golden from an `out` folder beside the file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path).select("path", "content")
    is_out = F.col("path").contains("/out/")
    golden = files.filter(is_out).select(F.replace("path", F.lit("/out/"), F.lit("/")).alias("path"), F.col("content").alias("golden"))
    expected = F.when(F.col("path").contains("not-wf"), "not-wf").when(F.col("path").contains("invalid"), "invalid").when(F.col("path").contains("valid"), "valid").when(F.col("path").rlike("pass[^/]*\\z"), "valid").when(F.col("path").rlike("fail[^/]*\\z"), "not-wf")
    suite = F.regexp_extract("path", r"xmlconf/([^/]+)/", 1)
    return files.filter(~is_out).join(golden, "path", "left").select("path", suite.alias("suite"), expected.alias("expected"), "content", "golden")


def verdict(expected: Column, ok: Column, output: Column | None = None, golden: Column | None = None) -> Column:
    """true (passed), false, or null (not judged): valid and invalid files must be well-formed, not-wf
    files must not; where a golden output is known, it must be equal."""
    same = F.lit(True) if output is None else F.coalesce(golden == "<IGNORE>", F.lit(False)) | golden.isNull() | output.eqNullSafe(golden)
    return F.when(expected.isin("valid", "invalid"), F.coalesce(ok, F.lit(False)) & same).when(expected == "not-wf", ~F.coalesce(ok, F.lit(False)))


def counters() -> list[Column]:
    return [F.count_if(F.col("success")).alias("passed"), F.count_if(~F.col("success")).alias("failed"), F.count_if(F.col("success").isNull()).alias("skipped")]


def roll_up(results: DataFrame, *levels: str) -> DataFrame:
    """Counters at each level of a hierarchy and above; `level` counts the levels that are summed over."""
    return results.rollup(*levels).agg(*counters(), F.grouping_id().alias("grouping"))


def breakdown(results: DataFrame, *by: str) -> DataFrame:
    """Counters for each combination of columns, with all subtotals, and the share that passed in percent."""
    out = results.cube(*by).agg(*counters(), F.grouping_id().alias("grouping"))
    return out.withColumn("pct", F.round(100 * F.col("passed") / F.nullif(F.col("passed") + F.col("failed"), F.lit(0)), 2))

"""Namespaces as joins: declarations have ranges of positions, names look theirs up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import XML_URI, XMLNS_URI, declaration_error, split_name


def element_ranges(rows: DataFrame) -> DataFrame:
    """events with end_pos on start tags: the position of the element's end tag (its own, if it is empty)."""
    level = Window.partitionBy("doc_id", "_level").orderBy("pos")
    tag = F.col("kind").isin("STAG", "ETAG") & ~F.col("empty")
    out = rows.withColumn("_level", F.when(tag, F.col("depth")))
    return out.withColumn("end_pos", F.when(F.col("empty"), F.col("pos")).when(F.col("kind") == "STAG", F.lead("pos").over(level))).drop("_level")


def scopes(rows: DataFrame) -> DataFrame:
    """(doc_id, prefix, uri, start_pos, end_pos, error): the declarations of events; prefix is empty for
    the default, uri null where the default is taken back, error as `declaration_error`."""
    tags = element_ranges(rows).filter("kind = 'STAG'")
    a = tags.select("doc_id", F.col("pos").alias("start_pos"), "end_pos", F.explode("attrs").alias("a")).filter(F.col("a.name").rlike("\\Axmlns(?::|\\z)"))
    prefix = F.when(F.col("a.name") == "xmlns", F.lit(None).cast("string")).otherwise(F.substring(F.col("a.name"), F.lit(7), F.char_length(F.col("a.name"))))
    return a.select("doc_id", F.coalesce(prefix, F.lit("")).alias("prefix"), F.nullif(F.col("a.value"), F.lit("")).alias("uri"), "start_pos", "end_pos", declaration_error(prefix, F.col("a.value")).alias("error"))


def _resolve(names: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """names (doc_id, pos, prefix, ...) with uri: that of the innermost declaration around the position."""
    d = declared.select(F.col("doc_id").alias("_doc"), F.col("prefix").alias("_prefix"), "uri", "start_pos", "end_pos")
    on = names["doc_id"].eqNullSafe(d["_doc"]) & (names["prefix"] == d["_prefix"]) & (names["pos"] >= d["start_pos"]) & (names["pos"] <= d["end_pos"])
    found = names.join(d, on, "left").groupBy(*keys).agg(F.max_by(F.struct("uri", "start_pos"), "start_pos").alias("_f"))
    return found.withColumns({"uri": F.col("_f.uri"), "declared": F.col("_f").isNotNull()}).drop("_f")


def _fixed(prefix: Column, uri: Column) -> Column:
    return F.when(prefix == "xml", XML_URI).when(prefix == "xmlns", XMLNS_URI).otherwise(uri)


def resolve_elements(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, name, prefix, local, ns_uri, error) of each start tag. The default namespace holds;
    error is UnknownNamespacePrefix, or IllegalName for names with two colons or the local name xmlns."""
    names = rows.filter("kind = 'STAG'").select("doc_id", "pos", "name", F.coalesce("prefix", F.lit("")).alias("prefix"), "local")
    got = _resolve(names, scopes(rows), ["doc_id", "pos", "name", "prefix", "local"])
    uri = _fixed(F.col("prefix"), F.col("uri"))
    error = F.when(F.col("local").isNull() | (F.col("local") == "xmlns"), "IllegalName").when((F.col("prefix") != "") & uri.isNull() & ~F.col("declared"), "UnknownNamespacePrefix")
    return got.select("doc_id", "pos", "name", "prefix", "local", uri.alias("ns_uri"), error.alias("error"))


def resolve_attributes(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, ord, name, prefix, local, value, ns_uri, error) of each attribute that declares no
    namespace. The default namespace does not hold. error also is NonUniqueAttribute for a second
    attribute of an element with the same URI and local name."""
    a = rows.filter("kind = 'STAG'").select("doc_id", "pos", F.posexplode("attrs").alias("ord", "a")).select("doc_id", "pos", "ord", F.col("a.name").alias("name"), "a.value", split_name(F.col("a.name")).alias("q"))
    a = a.filter(~F.col("name").rlike("\\Axmlns(?::|\\z)")).select("doc_id", "pos", "ord", "name", "value", F.col("q.prefix").alias("prefix"), F.col("q.local").alias("local"))
    keys = ["doc_id", "pos", "ord", "name", "value", "prefix", "local"]
    got = _resolve(a, scopes(rows), keys).withColumn("ns_uri", F.when(F.col("prefix").isNotNull(), _fixed(F.col("prefix"), F.col("uri"))))
    same = Window.partitionBy("doc_id", "pos", "ns_uri", "local").orderBy("ord")
    error = F.when(F.col("local").isNull(), "IllegalName").when(F.col("prefix").isNotNull() & F.col("ns_uri").isNull() & ~F.col("declared"), "UnknownNamespacePrefix").when(F.row_number().over(same) > 1, "NonUniqueAttribute")
    return got.select(*keys, "ns_uri", error.alias("error"))


def namespace_errors(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, error): all that is wrong with namespaces, by position."""
    parts = [scopes(rows).select("doc_id", F.col("start_pos").alias("pos"), "error"), resolve_elements(rows).select("doc_id", "pos", "error"), resolve_attributes(rows).select("doc_id", "pos", "error")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("error is not null")


def name_counts(rows: DataFrame) -> DataFrame:
    """(ns_uri, local, n_elements)."""
    return resolve_elements(rows).groupBy("ns_uri", "local").agg(F.count("*").alias("n_elements"))

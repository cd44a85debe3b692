"""Qualified names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import NAME

XML_URI = "http://www.w3.org/XML/1998/namespace"
XMLNS_URI = "http://www.w3.org/2000/xmlns/"


def split_name(name: Column) -> Column:
    """struct<prefix, local> of a qualified name; null if it has two colons, or an empty part."""
    parts = F.split(name, ":", -1)
    ok = (F.size(parts) <= 2) & F.forall(parts, lambda p: p != "")
    return F.when(ok, F.struct(F.when(F.size(parts) == 2, F.get(parts, 0)).alias("prefix"), F.element_at(parts, -1).alias("local")))


def valid_name(name: Column) -> Column:
    return name.rlike(rf"\A{NAME}\z")


def declaration_error(prefix: Column, uri: Column) -> Column:
    """IllegalNamespaceUri if a prefix (null: the default) must not be bound to the URI, else null."""
    bad = (
        (prefix.isNotNull() & (uri == ""))
        | (prefix.eqNullSafe("xml") != (uri == XML_URI))
        | (prefix.eqNullSafe("xmlns") != (uri == XMLNS_URI))
    )
    return F.when(bad, F.lit("IllegalNamespaceUri"))

"""Character classes of XML as regular expressions, and predicates over string columns. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound

# The classes of the XML 1.0 recommendation, fifth edition, in Java's notation.
SPACE = r"\x20\x09\x0A\x0D"
PUNCT = r"\x22\x27()*+,\-./:<=>\[\]@|!$"
NAME_START = (
    r":A-Z_a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}"
    r"\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
)
NAME_CHAR = NAME_START + r"\-.0-9\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}"
CHAR = r"\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}"
PUBID = r"\x20\x0D\x0Aa-zA-Z0-9\-'()+,./:=?;!*#@$_%"
CONTENT = r"\x09\x0A\x20-\x25\x27-\x3B\x3D-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}"
#: The older editions know no name characters above U+FFFF.
NAME_START_BMP = NAME_START.replace(r"\x{10000}-\x{EFFFF}", "")
NAME_CHAR_BMP = NAME_CHAR.replace(r"\x{10000}-\x{EFFFF}", "")

NAME = f"[{NAME_START}][{NAME_CHAR}]*"
NCNAME = NAME.replace("[:", "[")
CLASSES = {"space": SPACE, "punct": PUNCT, "name_start": NAME_START, "name": NAME_CHAR, "char": CHAR, "pubid": PUBID, "content": CONTENT}


def all_in(text: Column, kind: str) -> Column:
    """Whether all characters are of a class (true for an empty text, null for null)."""
    return text.rlike(rf"\A[{CLASSES[kind]}]*\z")


def is_name(text: Column, dialect: str = "full") -> Column:
    first, rest = (NAME_START_BMP, NAME_CHAR_BMP) if dialect == "dom" else (NAME_START, NAME_CHAR)
    return text.rlike(rf"\A[{first}][{rest}]*\z")


def only_space(text: Column) -> Column:
    return all_in(text, "space")


def prefix_length(text: Column, kind: str) -> Column:
    """Characters of the class that the text begins with."""
    return F.char_length(F.regexp_extract(text, rf"\A[{CLASSES[kind]}]*", 0))


def prefix_bytes(text: Column, kind: str) -> Column:
    return F.octet_length(F.regexp_extract(text, rf"\A[{CLASSES[kind]}]*", 0))


def first_invalid(text: Column) -> Column:
    """struct<offset: long, char: string> of the first character that XML does not allow, or null. The
    offset counts UTF-8 bytes."""
    good = F.regexp_extract(text, rf"\A[{CHAR}]*", 0)
    bad = F.substring(text, F.char_length(good) + 1, F.lit(1))
    return F.when(F.char_length(good) < F.char_length(text), F.struct(F.octet_length(good).cast("long").alias("offset"), bad.alias("char")))


def line_column(text: Column, offset: Column) -> Column:
    """struct<line, column>, both from 1, of a byte offset; CR, LF and CRLF end lines."""
    before = F.decode(F.substring(F.encode(text, "utf-8"), F.lit(1), offset.cast("int")), "utf-8")
    breaks = F.regexp_replace(before, "\r\n?", "\n")
    return F.struct(
        (F.char_length(breaks) - F.char_length(F.replace(breaks, F.lit("\n"), F.lit(""))) + 1).alias("line"),
        (F.char_length(F.substring_index(breaks, "\n", -1)) + 1).alias("column"),
    )


def first_difference(a: Column, b: Column) -> Column:
    """Offset in characters of the first difference of two texts, null if they are equal. By halves: at each step
    the beginnings up to the middle of what is left are compared, so no text is cut into characters."""
    return bound(a, lambda x: bound(b, lambda y: _first_difference(x, y)))


def _first_difference(a: Column, b: Column) -> Column:
    same = lambda n: F.left(a, n) == F.left(b, n)
    middle = lambda s: ((s["low"] + s["high"] + 1) / 2).cast("int")
    start = F.struct(F.lit(0).alias("low"), F.least(F.char_length(a), F.char_length(b)).alias("high"))

    def step(s: Column, _: Column) -> Column:
        n = middle(s)
        further = F.when(same(n), F.struct(n.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (n - 1).alias("high")))
        return F.when(s["low"] >= s["high"], s).otherwise(further)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.char_length(a) + 1)).cast("int") + 1)
    return F.when(a != b, F.aggregate(steps, start, step)["low"])

"""Escaping, references and line ends as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five predefined entities.
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}


def _replace(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escape(text: Column, mode: str = "default") -> Column:
    """mode: content (& and <, > only behind ]]), attr_apos, attr_quot (for attributes in these quotes),
    default (all five), ascii (all five, and decimal references for what is not ASCII)."""
    if mode == "content":
        return _replace(text, ("&", "&amp;"), ("<", "&lt;"), ("]]>", "]]&gt;"))
    if mode == "attr_apos":
        return _replace(text, ("&", "&amp;"), ("<", "&lt;"), ("'", "&apos;"))
    if mode == "attr_quot":
        return _replace(text, ("&", "&amp;"), ("<", "&lt;"), ('"', "&#34;"))
    five = _replace(text, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"))
    if mode == "default":
        return five
    if mode == "ascii":
        return _references(five, lambda c: F.concat(F.lit("&#"), code_point(c).cast("string"), F.lit(";")))
    if mode == "normal":
        shown = _replace(five, ("\r", "&#xD;"))
        return _references(shown, lambda c: F.concat(F.lit("&#x"), F.hex(code_point(c)), F.lit(";")))
    raise ValueError(f"no escaping mode {mode}")


def _references(text: Column, form) -> Column:
    """Runs of ASCII stay as they are; only other characters are looked at one by one."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|(?s)."), F.lit(0))
    return F.array_join(F.transform(parts, lambda c: F.when(c.rlike(r"\A[\x00-\x7F]"), c).otherwise(form(c))), "")


def code_point(char: Column) -> Column:
    return F.conv(F.hex(F.encode(char, "utf-32")), 16, 10).cast("long")


def from_code_point(code: Column) -> Column:
    """The character of a code point; null if XML does not allow it."""
    ok = code.isin(9, 10, 13) | code.between(0x20, 0xD7FF) | code.between(0xE000, 0xFFFD) | code.between(0x10000, 0x10FFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32"))


def reference_code(ref: Column) -> Column:
    """The number in `&#10;` or `&#xA;`; null if there is none."""
    hexed = F.regexp_extract(ref, r"\A&#x([0-9A-Fa-f]{1,8});\z", 1)
    plain = F.regexp_extract(ref, r"\A&#([0-9]{1,9});\z", 1)
    return F.when(hexed != "", F.conv(hexed, 16, 10)).when(plain != "", plain).cast("long")


def resolve(ref: Column) -> Column:
    """The text that a reference stands for: a character reference or a predefined entity; else null."""
    named = reduce(lambda c, e: c.when(ref == f"&{e[0]};", e[1]), list(ENTITIES.items())[1:], F.when(ref == "&lt;", "<"))
    return F.coalesce(named, from_code_point(reference_code(ref)))


def unescape(text: Column) -> Column:
    """All references of a text resolved; unknown ones stay."""
    named = lambda c: _replace(c, ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '"'), ("&amp;", "&"))
    parts = F.regexp_extract_all(text, F.lit(r"&#?\w+;|[^&]+|&"), F.lit(0))
    numbered = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("&"), F.coalesce(resolve(p), p)).otherwise(p)), "")
    return F.when(text.contains("&#"), numbered).otherwise(named(text))


def unknown_reference(text: Column) -> Column:
    """The first reference that stands for nothing known, or null."""
    return F.get(F.filter(F.regexp_extract_all(text, F.lit(r"&[^;<&\s]*;?"), F.lit(0)), lambda r: resolve(r).isNull()), 0)


def line_ends(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def basic_auth(user: Column, password: Column) -> Column:
    """The value of an Authorization header."""
    return F.concat(F.lit("Basic "), plain_base64(F.concat(user, F.lit(":"), password).cast("binary")))


def plain_base64(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def strict_unbase64(text: Column) -> Column:
    """The bytes of a Base64 text, white space ignored; null if it is none."""
    bare = F.regexp_replace(text, r"\s", "")
    ok = bare.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(ok, F.unbase64(F.when(ok, bare)))

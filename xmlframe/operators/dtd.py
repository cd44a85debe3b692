"""DOCTYPE declarations as structs and rows of markup declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.arrays import bound

_LITERAL = "\"[^\"]*\"|'[^']*'"
_EXTERNAL = rf"(?:SYSTEM\s+({_LITERAL})|PUBLIC\s+({_LITERAL})(?:\s+({_LITERAL}))?)"
_HEAD = rf"<!DOCTYPE\s+({chars.NAME})(?:\s+{_EXTERNAL})?\s*"
DECLARATION = rf"""<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!(?:ELEMENT|ATTLIST|ENTITY|NOTATION)\s(?:[^>"']|{_LITERAL})*>|%{chars.NAME};"""


_REFERENCE = rf"&{chars.NAME};|&#[0-9]+;|&#x[0-9A-Fa-f]+;"
_ENTITY_VALUE = rf"""(?:"(?:[^%&"]|{_REFERENCE})*+"|'(?:[^%&']|{_REFERENCE})*+')"""
_ATTRIBUTE_VALUE = rf"""(?:"(?:[^<&"]|{_REFERENCE})*+"|'(?:[^<&']|{_REFERENCE})*+')"""
_PUBLIC = r"""(?:"[\x20\r\na-zA-Z0-9\-'()+,./:=?;!*#@$_%]*"|'[\x20\r\na-zA-Z0-9\-()+,./:=?;!*#@$_%]*')"""
_LINKED = rf"(?:SYSTEM\s+(?:{_LITERAL})|PUBLIC\s+{_PUBLIC}\s+(?:{_LITERAL}))"
_CHOICE = lambda name: rf"\(\s*{name}(?:\s*\|\s*{name})*\s*\)"
_TYPE = rf"(?:CDATA|ID|IDREFS?|ENTITY|ENTITIES|NMTOKENS?|NOTATION\s+{_CHOICE(chars.NAME)}|{_CHOICE(f'[{chars.NAME_CHAR}]+')})"
_DEFAULT = rf"(?:#REQUIRED|#IMPLIED|(?:#FIXED\s+)?{_ATTRIBUTE_VALUE})"
#: Declarations of the internal subset, all but the content models of elements.
_PLAIN = (
    rf"<!ATTLIST\s+{chars.NAME}(?:\s+{chars.NAME}\s+{_TYPE}\s+{_DEFAULT})*+\s*>"
    rf"|<!ENTITY\s+{chars.NAME}\s+(?:{_ENTITY_VALUE}|{_LINKED}(?:\s+NDATA\s+{chars.NAME})?)\s*>"
    rf"|<!ENTITY\s+%\s+{chars.NAME}\s+(?:{_ENTITY_VALUE}|{_LINKED})\s*>"
    rf"|<!NOTATION\s+{chars.NAME}\s+(?:{_LINKED}|PUBLIC\s+{_PUBLIC})\s*>"
    rf"|<!--(?:(?!--)[{chars.CHAR}])*+-->|<\?(?![xX][mM][lL][\s?]){chars.NAME}(?:\s(?:(?!\?>)[{chars.CHAR}])*+)?\?>|%{chars.NAME};|\s+"
)
_MIXED = rf"\(\s*#PCDATA\s*\)\*?|\(\s*#PCDATA(?:\s*\|\s*{chars.NAME})+\s*\)\*"
#: The innermost group of a content model: one kind of separator, and names as its items.
_ITEM = rf"{chars.NAME}[?*+]?"
_GROUP = rf"\(\s*{_ITEM}(?:(?:\s*\|\s*{_ITEM})+|(?:\s*,\s*{_ITEM})*)\s*\)"


def content_model(model: Column) -> Column:
    """Whether a content model is one of the grammar: EMPTY, ANY, mixed, or balanced groups of one kind of
    separator each. The innermost groups become names until no parenthesis is left: as often as there are
    opening ones, at most."""
    levels = F.sequence(F.lit(1), F.greatest(F.regexp_count(model, F.lit(r"\(")), F.lit(1)))
    left = F.aggregate(levels, model, lambda m, _: F.when(m.contains("("), F.regexp_replace(m, _GROUP, "g")).otherwise(m))
    return model.rlike(rf"\A(?:EMPTY|ANY|{_MIXED})\z") | (model.startswith("(") & bound(left, lambda m: m.rlike(r"\Ag[?*+]?\z")))


def well_formed(token: Column) -> Column:
    """Whether a DOCTYPE token follows the grammar, its internal subset included."""
    head = rf"<!DOCTYPE\s+{chars.NAME}(?:\s+{_LINKED})?\s*"
    elements = F.regexp_extract_all(token, F.lit(rf"<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!ELEMENT\s+{chars.NAME}\s+([^>]*?)\s*>"), F.lit(1))
    models = F.forall(F.filter(elements, lambda m: m != ""), content_model)
    return token.rlike(rf"\A{head}(?:\[(?:<!ELEMENT\s+{chars.NAME}\s+[^>]+>|{_PLAIN})*+\]\s*)?>\z") & models


def _bare(literal: Column) -> Column:
    return F.when(literal != "", F.substring(literal, F.lit(2), F.char_length(literal) - 2))


def _external(text: Column, pattern: str, first: int) -> Column:
    """struct<kind, pub_id, system> or null; PUBLIC ids with characters they must not have give null."""
    system, public, second = (F.regexp_extract(text, pattern, first + k) for k in range(3))
    return F.when(system != "", F.struct(F.lit("SYSTEM").alias("kind"), F.lit(None).cast("string").alias("pub_id"), _bare(system).alias("system"))).when(
        (public != "") & chars.all_in(_bare(public), "pubid"), F.struct(F.lit("PUBLIC").alias("kind"), _bare(public).alias("pub_id"), _bare(second).alias("system"))
    )


def doctype(text: Column) -> Column:
    """struct<root, external_id, subset> of the DOCTYPE in a text; null without one."""
    token = F.regexp_extract(text, _HEAD + r"(?:\[((?:<!--[\s\S]*?-->|<\?[\s\S]*?\?>|[^\]\"']|\"[^\"]*\"|'[^']*')*+)\]\s*)?>", 0)
    subset = F.regexp_extract(token, r"\A[^\[]*\[([\s\S]*)\]\s*>\z", 1)
    return F.when(token != "", F.struct(F.regexp_extract(token, _HEAD, 1).alias("root"), _external(token, _HEAD, 2).alias("external_id"), F.when(token.rlike(r"\]\s*>\z"), subset).alias("subset")))


def declarations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, kind, name, content, value, external_id, ndata, attlist) of the internal subset.

    kind: ELEMENT, ATTLIST, ENTITY, PARAMETER_ENTITY, NOTATION, PI, COMMENT or REFERENCE. content is an
    element's model: EMPTY, ANY, MIXED(a|b), PCDATA or CHILDREN(..) without white space, null for a model
    that is none (parentheses that do not balance, separators mixed in one group). value is an
    entity's text, its references not expanded."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), doctype(F.col(text))["subset"].alias("subset"))
    rows = rows.select("doc_id", F.posexplode(F.regexp_extract_all("subset", F.lit(DECLARATION), F.lit(0))).alias("pos", "d"))
    d = F.col("d")
    kind = (
        F.when(d.startswith("<!--"), "COMMENT").when(d.startswith("<?"), "PI").when(d.startswith("%"), "REFERENCE")
        .when(d.rlike(r"\A<!ENTITY\s+%\s"), "PARAMETER_ENTITY").otherwise(F.regexp_extract(d, r"\A<!([A-Z]+)", 1))
    )
    name = F.nullif(F.regexp_extract(d, rf"\A<!(?:ELEMENT|ATTLIST|NOTATION|ENTITY(?:\s+%)?)\s+({chars.NAME})", 1), F.lit(""))
    written = F.regexp_extract(d, rf"\A<!ELEMENT\s+{chars.NAME}\s+([\s\S]*?)\s*>\z", 1)
    model = F.regexp_replace(written, r"\s+", "")
    mixed = F.regexp_replace(model, r"\A\(#PCDATA\|?|\)\*?\z", "")
    content = (
        F.when(model.isin("EMPTY", "ANY"), model).when(model.rlike(r"\A\(#PCDATA\)\*?\z"), "PCDATA")
        .when(model.rlike(rf"\A\(#PCDATA(?:\|{chars.NAME})+\)\*\z"), F.concat(F.lit("MIXED("), mixed, F.lit(")")))
        .when(content_model(written), F.concat(F.lit("CHILDREN"), model))
    )
    entity = rf"\A<!ENTITY(?:\s+%)?\s+{chars.NAME}\s+"
    value = _bare(F.regexp_extract(d, rf"{entity}({_LITERAL})\s*>\z", 1))
    out = rows.select(
        "doc_id", "pos", kind.alias("kind"), name.alias("name"), F.when(F.col("d").startswith("<!ELEMENT"), content).alias("content"), value.alias("value"),
        _external(d, rf"\A<!(?:ENTITY(?:\s+%)?|NOTATION)\s+{chars.NAME}\s+{_EXTERNAL}", 1).alias("external_id"),
        F.nullif(F.regexp_extract(d, rf"\sNDATA\s+({chars.NAME})\s*>\z", 1), F.lit("")).alias("ndata"),
        F.when(d.startswith("<!ATTLIST"), F.transform(F.regexp_extract_all(d, F.lit(rf"\s({chars.NAME})\s+(CDATA|ID|IDREFS?|ENTITY|ENTITIES|NMTOKENS?|NOTATION\s*\([^)]*\)|\([^)]*\))\s+(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?(?:{_LITERAL}))"), F.lit(0)), lambda a: F.regexp_replace(F.trim(a), r"\s+", " "))).alias("attlist"),
    )
    return out

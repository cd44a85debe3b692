"""Writing XML: builders that return string columns, and events back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.escape import escape
from . import events


def attribute(name: str, value: Column, mode: str = "default") -> Column:
    """` name="value"`, nothing for null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), escape(value.cast("string"), mode), F.lit('"')), F.lit(""))


def element(name: str, *content: Column, attrs: dict[str, Column] | None = None) -> Column:
    """An element of markup columns; null content counts as nothing, and without any it closes itself."""
    head = F.concat(F.lit(f"<{name}"), *[attribute(k, v) for k, v in (attrs or {}).items()])
    if not content:
        return F.concat(head, F.lit("/>"))
    inner = F.concat(*[F.coalesce(c, F.lit("")) for c in content])
    return F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inner, F.lit(f"</{name}>")))


def characters(text: Column, mode: str = "content") -> Column:
    return escape(text.cast("string"), mode)


def cdata(text: Column) -> Column:
    """A CDATA section; the end mark inside is cut in two sections."""
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def comment(text: Column) -> Column:
    """A comment; null where the text cannot be one."""
    return F.when(~text.contains("--") & ~text.endswith("-"), F.concat(F.lit("<!--"), text, F.lit("-->")))


def instruction(target: str, data: Column | None = None) -> Column:
    return F.concat(F.lit(f"<?{target}"), *([] if data is None else [F.lit(" "), data]), F.lit("?>"))


def declaration(version: str = "1.0", encoding: str | None = None, standalone: bool | None = None) -> str:
    parts = [f'version="{version}"', *([f'encoding="{encoding}"'] if encoding else []), *([] if standalone is None else [f'standalone="{"yes" if standalone else "no"}"'])]
    return f"<?xml {' '.join(parts)}?>"


def _attributes(attrs: Column, mode: str) -> Column:
    return F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), escape(a["value"], mode), F.lit('"'))), "")


FORMS = {"compact": "content", "normal": "normal", "canonical": "default"}


def _piece(form: str, kind: Column, token: Column, empty: Column, depth: Column, name: Column, attrs: Column, text: Column) -> Column:
    """The text of one event; see `serialize`."""
    plain = FORMS[form]
    breaks = lambda c: F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("&#10;")), F.lit("\t"), F.lit("&#9;")), F.lit("\r"), F.lit("&#13;"))
    shown = F.when((depth > 0) | F.lit(form == "compact"), escape(text, plain)).otherwise("")
    inside = _attributes(F.array_sort(attrs) if form == "canonical" else attrs, "attr_quot" if form == "compact" else plain)
    if form == "canonical":  # of the five, the apostrophe stays as it is
        shown, inside = (breaks(F.replace(c, F.lit("&apos;"), F.lit("'"))) for c in (shown, inside))
    head = F.concat(F.lit("<"), name, F.coalesce(inside, F.lit("")))
    start = F.when(empty, F.concat(head, F.lit("/>") if form == "compact" else F.concat(F.lit("></"), name, F.lit(">")))).otherwise(F.concat(head, F.lit(">")))
    data = F.coalesce(F.concat(F.lit(" "), text), F.lit(" " if form == "canonical" else ""))
    out = F.when(kind == "STAG", start).when(kind == "ETAG", F.concat(F.lit("</"), name, F.lit(">"))).when(kind == "CHARACTERS", shown).when(kind == "PI", F.concat(F.lit("<?"), name, data, F.lit("?>")))
    if form == "canonical":
        out = out.when((kind == "XML_DECL") & ~token.rlike("version\\s*=\\s*[\"']1\\.0[\"']"), token)
    else:
        out = out.when(kind == "COMMENT", F.concat(F.lit("<!--"), text, F.lit("-->"))).when(kind.isin("XML_DECL", "DTD"), token)
    return F.coalesce(out, F.lit(""))


def rewritten(text: Column, form: str = "normal") -> Column:
    """A document written anew in a form of `serialize`, within its row; null for null and empty texts."""
    piece = lambda e: _piece(form, e["kind"], e["token"], e["empty"], e["depth"], events.name_of(e["kind"], e["token"]), events.attributes(e["token"]), events.text_of(e["kind"], e["token"]))
    return F.when(F.char_length(text) > 0, F.array_join(F.transform(events.located(text), piece), ""))


def serialize(rows: DataFrame, form: str = "normal") -> DataFrame:
    """(doc_id, xml): events as text again, also those that were filtered or changed; `rewritten` does the same
    for unchanged documents without gathering their events.

    form `compact` escapes little and keeps empty tags; `normal` escapes all five and what is not ASCII,
    writes both tags, and keeps declaration, comments and PIs; `canonical` writes both tags, CR, LF and tab
    as references, PIs with a space behind the target, attributes by name, and drops comments, DOCTYPEs
    and declarations of version 1.0."""
    names = ("kind", "token", "empty", "depth", "name", "attrs", "text")
    out = rows.select("doc_id", "pos", _piece(form, *[F.col(c) for c in names]).alias("piece"))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("xml"))


def balanced(rows: DataFrame) -> DataFrame:
    """(doc_id, balanced): whether start and end tags are as many."""
    step = F.when((F.col("kind") == "STAG") & ~F.col("empty"), 1).when(F.col("kind") == "ETAG", -1).otherwise(0)
    return rows.groupBy("doc_id").agg((F.sum(step) == 0).alias("balanced"))

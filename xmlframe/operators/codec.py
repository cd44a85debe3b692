"""Typed rows from XML and XML from typed rows. Decoding is Spark's from_xml with the conventions of
this library: `@name` for attributes, `$value` for inner text, texts not trimmed; plus strict casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chars
from ..functions.arrays import bound
from ..functions.escape import escape
from . import events

OPTIONS = {"attributePrefix": "@", "valueTag": "$value", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


def decode(xml: Column, schema: str | T.StructType, **options: str) -> Column:
    """A struct of the schema; fields that are absent or of another type are null. Booleans follow `BOOLEANS`:
    more words in elements than in attributes. `decode_strict` says why something is null."""
    kind = _parsed(schema)
    loose = _with_texts(kind)
    read = F.from_xml(xml, loose, OPTIONS | options)
    return read if loose == kind else bound(read, lambda x: _with_booleans(x, kind, "element"))


def _parsed(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _with_texts(kind: T.DataType) -> T.DataType:
    """The type with strings in place of booleans."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _with_texts(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with_texts(kind.elementType))
    return T.StringType() if isinstance(kind, T.BooleanType) else kind


def _with_booleans(value: Column, kind: T.DataType, where: str) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_with_booleans(value[f.name], f.dataType, "attribute" if f.name.startswith("@") else "element").alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _with_booleans(x, kind.elementType, where))
    return boolean(value, where) if isinstance(kind, T.BooleanType) else value


_CHILD = "struct<name:string,at:bigint,text:string,markup:boolean>"


def _children(xml: Column) -> Column:
    """array<struct<name, at, text, markup>> of the root's child elements in order: their names, the byte at which
    they begin, their texts, and whether there is more than text in them."""

    def read(rows: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(rows) - 1)
        at = lambda i: F.get(rows, i)
        starts = F.filter(places, lambda i: (at(i)["kind"] == "STAG") & (at(i)["depth"] == 2))
        ends = F.filter(places, lambda i: (at(i)["depth"] == 2) & ((at(i)["kind"] == "ETAG") | at(i)["empty"]))

        def child(a: Column, b: Column) -> Column:
            inner = F.slice(rows, a + 2, F.greatest(b - a - 1, F.lit(0)))
            text = F.array_join(F.transform(inner, lambda r: F.coalesce(F.when(r["kind"] == "CHARACTERS", events.text_of(r["kind"], r["token"])), F.lit(""))), "")
            return F.struct(events.tag_name(at(a)["token"]).alias("name"), (at(a)["end_offset"] - F.octet_length(at(a)["token"])).alias("at"), text.alias("text"), F.exists(inner, lambda r: r["kind"].isin("STAG", "ETAG")).alias("markup")).cast(_CHILD)

        return F.zip_with(starts, ends, child)

    return F.when(F.char_length(xml) > 0, bound(events.located(xml), read))


def _misread(text: Column, kind: T.DataType, where: str) -> Column:
    """The code for a text that is no value of a scalar type; null for one that is."""
    names = {T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long"}
    if type(kind) in names:
        return F.when(integer(text, names[type(kind)]).isNull(), "Int")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(floating(text).isNull(), "Float")
    if isinstance(kind, T.BooleanType):
        return F.when(boolean(text, where).isNull(), "InvalidBoolean")
    return F.lit(None).cast("string")


def _error(code: Column, detail: Column, offset: Column, hint: Column) -> Column:
    return F.struct(code.alias("code"), detail.cast("string").alias("detail"), offset.cast("long").alias("offset"), hint.cast("string").alias("hint"))


def _field_errors(field: T.StructField, children: Column, attrs: Column, root_at: Column) -> list[Column]:
    """Arrays of what may be wrong with a field; entries without a code are right."""
    kind, hint, none = field.dataType, F.lit(field.name), F.lit(None).cast("string")
    if isinstance(kind, (T.StructType, T.MapType)) or field.name.startswith("$"):
        return []
    item = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if field.name.startswith("@"):
        given = F.filter(attrs, lambda a: a["name"] == field.name[1:])
        return [F.transform(given, lambda a: _error(_misread(a["value"], item, "attribute"), a["value"], root_at, hint))]
    mine = lambda c: c["name"] == field.name

    def apart(c: Column, i: Column) -> Column:
        together = F.lit(isinstance(kind, T.ArrayType)) & mine(F.get(children, i - 1))
        return _error(F.when(mine(c) & F.exists(F.slice(children, F.lit(1), i), mine) & ~together, "EndOfArrayExpected"), none, c["at"], hint)

    out = [F.transform(children, apart)]
    if not isinstance(item, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        code = lambda c: F.when(c["markup"], "NoMarkupExpected").otherwise(_misread(c["text"], item, "element"))
        out.append(F.transform(F.filter(children, mine), lambda c: _error(code(c), F.when(~c["markup"], c["text"]), c["at"], hint)))
    return out


def decode_strict(xml: Column, schema: str | T.StructType, root: str | None = None) -> Column:
    """struct<value, error> of a record: value as `decode`, null with an error, and error the first thing that is
    wrong: struct<code, detail, offset, hint>, the offset in bytes of the element (the root's for attributes), the
    hint being the field.

    Codes: those of `events.first_error`; RootStruct for another root; EndOfArrayExpected for elements of one
    name that do not stand together, or of a field that is no array; NoMarkupExpected for elements in a scalar;
    Int, Float, InvalidBoolean for texts of another type. Fields below the first level are not looked at: what
    they cannot hold is null. A null text gives nulls."""
    return bound(xml, lambda text: _strictly(text, _parsed(schema), root))


def _strictly(xml: Column, kind: T.StructType, root: str | None) -> Column:
    none = F.lit(None).cast("string")

    def judged(children: Column) -> Column:
        head = F.regexp_extract(xml, _ROOT, 0)
        root_at = F.octet_length(head) - F.octet_length(F.regexp_extract(head, r"<[^<]*\z", 0))
        attrs = events.attributes(F.regexp_extract(xml, _ROOT_TAG, 1))
        found = [e for f in kind.fields for e in _field_errors(f, children, attrs, root_at)]
        wrong = F.filter(F.concat(*found), lambda e: e["code"].isNotNull()) if found else F.array().cast("array<struct<code:string,detail:string,offset:bigint,hint:string>>")
        own = F.get(F.array_sort(wrong, lambda x, y: (x["offset"] - y["offset"]).cast("int")), 0)
        return own if root is None else F.when(~root_is(xml, root), _error(F.lit("RootStruct"), F.regexp_extract(xml, _ROOT, 1), root_at, none)).otherwise(own)

    broken = events.first_error(xml)
    wrong = bound(broken, lambda b: F.when(b.isNotNull(), _error(b["code"], b["detail"], b["offset"], none)).otherwise(bound(_children(xml), judged)))
    return bound(wrong, lambda w: F.struct(F.when(w.isNull(), decode(xml, kind)).alias("value"), w.alias("error")))


def choice(xml: Column, arms: list[str]) -> Column:
    """struct<tag, content> of an enumeration: the arm whose name the root has, or a child element of the root
    has (content: its text), or the root's whole text is (content null). Null for what names no arm."""
    def chosen(text: Column) -> Column:
        bare = F.regexp_extract(text, r"\A(?:<\?[\s\S]*?\?>|\s)*<[^>]*>([^<]*)</[^>]*>\s*\z", 1)

        def told(children: Column) -> Column:
            found = F.get(F.filter(children, lambda c: c["name"].isin(*arms)), 0)
            own = F.regexp_extract(text, _ROOT, 1)
            return (
                F.when(own.isin(*arms), F.struct(own.alias("tag"), bare.alias("content")))
                .when(F.size(children) > 0, bound(found, lambda c: F.when(c.isNotNull(), F.struct(c["name"].alias("tag"), c["text"].alias("content")))))
                .when(F.trim(bare).isin(*arms), F.struct(F.trim(bare).alias("tag"), F.lit(None).cast("string").alias("content")))
            )

        return bound(_children(text), told)

    return bound(xml, chosen)


def decode_any(xml: Column) -> Column:
    """A self-describing value of the document."""
    return F.from_xml(xml, "variant", OPTIONS)


#: The prolog and the root's name.
_ROOT = rf"\A(?:[{chars.SPACE}]|<\?[\s\S]*?\?>|<!--[\s\S]*?-->|<!DOCTYPE[^>\[]*(?:\[[^\]]*\]\s*)?>)*<([^\s/>]+)"

#: Its start tag.
_ROOT_TAG = _ROOT.replace("<([^", "(<(?:[^") + r"""(?:[^>"']|"[^"]*"|'[^']*')*>)"""


def root_is(xml: Column, name: str) -> Column:
    """Whether the root element has the name."""
    return F.regexp_extract(xml, _ROOT, 1) == name


# What counts as true and false in element text, attributes and messages.
BOOLEANS = {"element": (["true", "1", "yes", "on"], ["false", "0", "no", "off"]), "attribute": (["true", "1"], ["false", "0"]), "rpc": (["1"], ["0"])}


def boolean(text: Column, where: str = "element") -> Column:
    yes, no = BOOLEANS[where]
    bare = F.trim(F.translate(text, "\t\r\n", "   "))
    return F.when(bare.isin(*yes), True).when(bare.isin(*no), False)


_RANGES = {"byte": (-(2**7), 2**7 - 1), "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1), "ubyte": (0, 2**8 - 1), "ushort": (0, 2**16 - 1), "uint": (0, 2**32 - 1), "ulong": (0, 2**64 - 1)}
_WIDER = {"ubyte": "short", "ushort": "int", "uint": "long", "ulong": "decimal(20,0)"}


def integer(text: Column, kind: str = "int") -> Column:
    """A whole number of the kind from trimmed text; null if it is none or out of range."""
    low, high = _RANGES[kind]
    bare = F.trim(F.translate(text, "\t\r\n", "   "))
    n = F.when(bare.rlike(r"\A[+-]?[0-9]{1,38}\z"), bare.try_cast("decimal(38,0)"))
    return F.when((n >= F.lit(str(low)).cast("decimal(38,0)")) & (n <= F.lit(str(high)).cast("decimal(38,0)")), n.cast(_WIDER.get(kind, kind)))


def floating(text: Column, kind: str = "double") -> Column:
    bare = F.trim(F.translate(text, "\t\r\n", "   "))
    return F.when(bare.rlike(r"(?i)\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?\z|\A[+-]?(?:inf|infinity|nan)\z"), bare.try_cast(kind))


def adjacent(names: Column) -> Column:
    """Whether equal names of an array stand together, as a sequence's elements must."""
    changed = F.filter(names, lambda n, i: (i == 0) | (F.get(names, i - 1) != n))
    return F.size(changed) == F.size(F.array_distinct(changed))


def number_text(value: Column) -> Column:
    """A number without an exponent or needless zeros: 42.0 is 42."""
    wide = F.format_number(value.cast("decimal(38,10)"), 10)
    return F.regexp_replace(F.regexp_replace(F.replace(wide, F.lit(","), F.lit("")), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")


def _scalar(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        raise ValueError("bytes have no text form")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return number_text(value)
    return escape(value.cast("string"))


def _content(value: Column, kind: T.DataType, tag: str) -> Column:
    """One element, or one for each item of an array; nothing for null."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(value, lambda x: _content(x, kind.elementType, tag)), ""), F.lit(""))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise ValueError("map keys must be strings")
        items = F.transform(F.map_entries(value), lambda e: F.concat(F.lit("<"), e["key"], F.lit(">"), _scalar(e["value"], kind.valueType), F.lit("</"), e["key"], F.lit(">")))
        inner = F.array_join(items, "")
        return F.when(value.isNotNull(), F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise("")
    if isinstance(kind, T.StructType):
        attrs, inner = [], []
        for f in kind.fields:
            field = value[f.name]
            if f.name.startswith("@"):
                if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                    raise ValueError(f"attribute {f.name} is not a scalar")
                attrs.append(F.coalesce(F.concat(F.lit(f' {f.name[1:]}="'), _scalar(field, f.dataType), F.lit('"')), F.lit("")))
            elif f.name.startswith("$"):
                inner.append(F.coalesce(_scalar(field, f.dataType), F.lit("")) if not isinstance(f.dataType, (T.StructType, T.ArrayType)) else _content(field, f.dataType, f.name[1:]))
            else:
                inner.append(_content(field, f.dataType, f.name))
        head, body = F.concat(F.lit(f"<{tag}"), *attrs), F.concat(F.lit(""), *inner)
        return F.when(value.isNotNull(), F.when(body == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), body, F.lit(f"</{tag}>")))).otherwise("")
    return F.coalesce(F.concat(F.lit(f"<{tag}>"), _scalar(value, kind), F.lit(f"</{tag}>")), F.lit(""))


def encode(df: DataFrame, column: str, root: str) -> Column:
    """The XML of a column of df, by its type: fields `@x` are attributes, `$x` stand inline, arrays
    repeat their tag, nulls are left out. A type that XML cannot hold is an error when the plan is made."""
    return _content(F.col(column), df.schema[column].dataType, root)


def tagged(tag: Column, arms: dict[str, Column], style: str = "external", tag_field: str = "type", content_field: str = "content") -> Column:
    """A variant by its tag: external `<A>..</A>`, internal `<type>A</type>..`, adjacent
    `<type>A</type><content>..</content>`, or untagged. arms are markup columns."""
    out = F.lit(None).cast("string")
    for name, inner in arms.items():
        form = {
            "external": F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>")),
            "internal": F.concat(F.lit(f"<{tag_field}>{name}</{tag_field}>"), inner),
            "adjacent": F.concat(F.lit(f"<{tag_field}>{name}</{tag_field}><{content_field}>"), inner, F.lit(f"</{content_field}>")),
            "untagged": inner,
        }[style]
        out = F.when(tag == name, form).otherwise(out)
    return out

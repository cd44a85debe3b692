"""XML-RPC messages: encoding by schema into markup columns, decoding in the row, from the message's tokens.
Calls over HTTP are no query and are left to the caller.

A value is struct<type, text, value>: text is that of a scalar, value a variant of any value, nested ones
included. Tokens become pieces of JSON one by one - a tag is a bracket, a comma is told by what stands before -
so values of any depth are read without recursion; what does not make JSON in the end is an error.

Calls and responses as programs write them - tags without attributes, no white space between them, no comments, CDATA
or numbered references - are spared the walk over tokens: replacing their tags makes JSON of the whole list of params.
What does not come out whole is walked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import escape
from ..functions.arrays import bound, running_sums
from . import codec, events


def value(column: Column, kind: T.DataType) -> Column:
    """`<value>` of a column by its type. Longs and other types that messages cannot hold are an error
    when the plan is made."""
    wrap = lambda tag, text: F.concat(F.lit(f"<value><{tag}>"), text, F.lit(f"</{tag}></value>"))
    if isinstance(kind, T.BooleanType):
        out = wrap("boolean", column.cast("int").cast("string"))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        out = wrap("i4", column.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = wrap("double", codec.number_text(column))
    elif isinstance(kind, T.StringType):
        out = wrap("string", escape.escape(column))
    elif isinstance(kind, T.BinaryType):
        out = wrap("base64", escape.plain_base64(column))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = wrap("dateTime.iso8601", F.date_format(column, "yyyyMMdd'T'HH:mm:ss"))
    elif isinstance(kind, T.NullType):
        out = F.lit("<value><nil/></value>")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("<value><array><data>"), F.array_join(F.transform(column, lambda x: value(x, kind.elementType)), ""), F.lit("</data></array></value>"))
    elif isinstance(kind, T.StructType):
        out = F.concat(F.lit("<value><struct>"), *[_member(F.lit(f.name), value(column[f.name], f.dataType)) for f in kind.fields], F.lit("</struct></value>"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        out = F.concat(F.lit("<value><struct>"), F.array_join(F.transform(F.map_entries(column), lambda e: _member(e["key"], value(e["value"], kind.valueType))), ""), F.lit("</struct></value>"))
    else:
        raise ValueError(f"{kind.simpleString()} has no XML-RPC form")
    return F.coalesce(out, F.lit("<value><nil/></value>"))


def _member(name: Column, inner: Column) -> Column:
    return F.concat(F.lit("<member><name>"), escape.escape(name), F.lit("</name>"), inner, F.lit("</member>"))


def params(df: DataFrame, columns: list[str]) -> Column:
    """`<params>` with a param for each column; none gives an empty element."""
    each = [F.concat(F.lit("<param>"), value(F.col(c), df.schema[c].dataType), F.lit("</param>")) for c in columns]
    return F.concat(F.lit("<params>"), *each, F.lit("</params>"))


def call(df: DataFrame, method: Column, columns: list[str]) -> Column:
    return F.concat(F.lit("<?xml version=\"1.0\"?><methodCall><methodName>"), escape.escape(method), F.lit("</methodName>"), params(df, columns), F.lit("</methodCall>"))


def response(df: DataFrame, column: str) -> Column:
    return F.concat(F.lit('<?xml version="1.0"?><methodResponse>'), params(df, [column]), F.lit("</methodResponse>"))


def fault(code: Column, text: Column) -> Column:
    inner = F.concat(_member(F.lit("faultCode"), value(code.cast("int"), T.IntegerType())), _member(F.lit("faultString"), value(text, T.StringType())))
    return F.concat(F.lit('<?xml version="1.0"?><methodResponse><fault><value><struct>'), inner, F.lit("</struct></value></fault></methodResponse>"))


# Element names of messages.
INTEGERS = ["int", "i1", "i2", "i4", "i8"]
TEXTS = ["string", "value", "name", "methodName"]
TAGGED = ["dateTime.iso8601", "base64"]
VALUE = "struct<type:string,text:string,value:variant>"


def pieces(message: Column) -> Column:
    """array<struct<tag, opens, closes, text>> of a message: tags with their names, and texts with references
    resolved. Comments, instructions, declarations and white space between tags are left out."""

    def piece(token: Column) -> Column:
        tag = token.startswith("<") & ~token.startswith("<![")
        ends = token.startswith("</")
        text = F.when(token.startswith("<!["), F.substring(token, F.lit(10), F.char_length(token) - 12)).when(token.startswith("&"), F.coalesce(escape.resolve(token), token)).when(token.contains("\r"), escape.line_ends(token)).otherwise(token)
        return F.struct(F.when(tag, events.tag_name(token)).alias("tag"), (tag & ~ends).alias("opens"), (ends | (tag & events.is_empty(token))).alias("closes"), F.when(~tag, text).alias("text"))

    kept = F.filter(events.tokens(message), lambda x: ~(x.startswith("<?") | x.startswith("<!-") | x.startswith("<!D")))

    def without_space(rows: Column) -> Column:
        """A blank text counts beside other text, and as all that one of TEXTS or TAGGED holds."""

        def counts(r: Column, i: Column) -> Column:
            before, after = F.get(rows, i - 1), F.get(rows, i + 1)
            beside = before["tag"].isNull() | after["tag"].isNull()
            return r["tag"].isNotNull() | ~r["text"].rlike(r"\A[ \t\r\n]*\z") | ((i > 0) & (i < F.size(rows) - 1) & (beside | (before["opens"] & ~before["closes"] & after["closes"] & ~after["opens"] & before["tag"].isin(*TEXTS, *TAGGED))))

        return F.filter(rows, counts)

    return bound(F.transform(kept, piece), without_space)


def _json_text(text: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _json(rows: Column) -> Column:
    """The JSON text of the pieces of one value (or of `params`). `!` stands for what cannot be: it is no JSON."""

    def one(r: Column, i: Column) -> Column:
        before, after = F.get(rows, i - 1), F.get(rows, i + 1)
        tag, first = r["tag"], i == 0
        second = ~first & before["closes"] & before["tag"].eqNullSafe(tag)  # the one before of the same container
        comma = F.when(second, ",").otherwise("")
        bare = after["text"].isNotNull() | (after["closes"] & ~after["opens"] & after["tag"].eqNullSafe("value"))
        was_bare = before["text"].isNotNull() | (before["opens"] & ~before["closes"] & before["tag"].eqNullSafe("value"))
        whole = r["opens"] & r["closes"]
        closed = (
            F.when(tag == "value", F.concat(comma, F.lit('""'))).when(tag == "string", F.lit('""')).when(tag == "struct", F.lit("{}")).when(tag.isin("data", "array", "params"), F.lit("[]"))
            .when(tag == "nil", F.lit("null")).when(tag == "base64", F.lit('{"base64":""}')).otherwise("!")
        )
        opened = (
            F.when(tag == "value", F.concat(comma, F.when(bare, '"').otherwise(""))).when(tag.isin("member", "param"), comma).when(tag.isin("string", "name"), F.lit('"'))
            .when(tag.isin(*TAGGED), F.concat(F.lit('{"'), tag, F.lit('":"'))).when(tag == "struct", F.lit("{")).when(tag.isin("data", "params"), F.lit("["))
            .when(tag == "nil", F.lit("null")).when(tag.isin("array", "boolean", "double", *INTEGERS), F.lit("")).otherwise("!")
        )
        ended = (
            F.when(tag == "value", F.when(was_bare, '"').otherwise("")).when(tag == "string", F.lit('"')).when(tag == "name", F.lit('":')).when(tag.isin(*TAGGED), F.lit('"}'))
            .when(tag == "struct", F.lit("}")).when(tag.isin("data", "params"), F.lit("]")).otherwise("")
        )
        within = F.when(before["opens"], before["tag"])
        number = F.regexp_replace(F.trim(r["text"]), r"\A\+", "")
        text = (
            F.when(before["text"].isNotNull() | within.isin(*TEXTS, *TAGGED), _json_text(r["text"]))
            .when(within.isin(*INTEGERS), F.coalesce(codec.integer(r["text"], "long").cast("string"), F.lit("!")))
            .when(within == "double", F.when(number.rlike(r"\A-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"), F.regexp_replace(number, r"\A(-?)0+(?=[0-9])", "$1")).otherwise("!"))
            .when(within == "boolean", F.when(F.trim(r["text"]) == "1", "true").when(F.trim(r["text"]) == "0", "false").otherwise("!"))
            .otherwise("!")
        )
        return F.when(tag.isNull(), text).when(whole, closed).when(r["opens"], opened).otherwise(ended)

    return F.array_join(F.transform(rows, one), "")


def _cut(rows: Column, opens: Column, closes: Column) -> Column:
    return F.zip_with(opens, closes, lambda a, b: F.when(b.isNotNull() & a.isNotNull() & (a <= b), F.slice(rows, a + 1, b - a + 1)))


def _places(rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1))


def _elements(rows: Column, tag: str) -> Column:
    """array<array<piece>>: the pieces of each element of a name that no other of its name is in, tags included."""
    mine = lambda side: F.filter(_places(rows), lambda i: F.get(rows, i)[side] & F.get(rows, i)["tag"].eqNullSafe(tag))
    return _cut(rows, mine("opens"), mine("closes"))


def _spans(rows: Column, tag: str, level: int = 1) -> Column:
    """`_elements` of a name that may stand in others of its name: those that stand in level - 1."""
    step = lambda r: F.when(~r["tag"].eqNullSafe(tag), 0).otherwise(r["opens"].cast("int") - r["closes"].cast("int"))

    def cut(levels: Column) -> Column:
        mine = lambda i: F.get(rows, i)["tag"].eqNullSafe(tag)
        opens = F.filter(_places(rows), lambda i: mine(i) & F.get(rows, i)["opens"] & (F.get(levels, i) + F.get(rows, i)["closes"].cast("int") == level))
        closes = F.filter(_places(rows), lambda i: mine(i) & F.get(rows, i)["closes"] & (F.get(levels, i) == level - 1))
        return _cut(rows, opens, closes)

    return F.when(F.size(rows) > 0, bound(running_sums(F.transform(rows, step)), cut))


def _value(rows: Column) -> Column:
    """The value (see above) that the pieces of one `<value>` element hold; null for other pieces."""
    return bound(rows, _value_of)


def _value_of(rows: Column) -> Column:
    second = F.get(rows, 1)
    named = F.when(second["opens"], F.when(second["tag"].isin("int"), "i4").otherwise(second["tag"])).otherwise("string")
    kind = F.when(F.get(rows, 0)["tag"].eqNullSafe("value"), F.when(F.size(rows) == 1, "string").otherwise(named))
    text = F.array_join(F.transform(F.filter(rows, lambda r: r["text"].isNotNull()), lambda r: r["text"]), "")
    return bound(kind, lambda k: F.when(k.isNotNull(), F.struct(k.alias("type"), F.when(~k.isin("struct", "array"), text).alias("text"), F.try_parse_json(_json(rows)).alias("value"))))


def scalar(markup: Column) -> Column:
    """The value of one `<value>` element: struct<type, text, value>. Bare text is a string."""
    return bound(pieces(markup), _value)


def as_int(v: Column) -> Column:
    return F.when(v["type"] == "i4", codec.integer(v["text"], "int"))


def as_double(v: Column) -> Column:
    return F.when(v["type"] == "double", codec.floating(v["text"]))


def as_boolean(v: Column) -> Column:
    return F.when(v["type"] == "boolean", codec.boolean(v["text"], "rpc"))


def as_string(v: Column) -> Column:
    return F.when(v["type"].isin("string", "dateTime.iso8601"), v["text"])


def as_bytes(v: Column) -> Column:
    return F.when(v["type"] == "base64", escape.strict_unbase64(v["text"]))


def as_timestamp(v: Column) -> Column:
    return F.when(v["type"] == "dateTime.iso8601", F.try_to_timestamp(v["text"], F.lit("yyyyMMdd'T'HH:mm:ss")))


def type_error(v: Column, wanted: str) -> Column:
    return F.when(v["type"] != wanted, F.struct(F.lit("WrongType").alias("code"), v["type"].alias("detail")))


def _params(rows: Column) -> Column:
    return F.transform(_elements(rows, "param"), lambda p: _value(F.slice(p, F.lit(2), F.size(p) - 2)))


def param_values(message: Column) -> Column:
    """array<struct<type, text, value>>: a value for each param of a call or response."""
    return bound(pieces(message), _params)


def _members(rows: Column) -> Column:
    """map<string, value>; of equal names the last counts."""

    def entry(m: Column) -> Column:
        name, value = F.get(_elements(m, "name"), 0), F.get(_spans(m, "value"), 0)
        return F.struct(F.array_join(F.transform(F.filter(name, lambda r: r["text"].isNotNull()), lambda r: r["text"]), "").alias("key"), _value(value).alias("value"))

    def last_of_each(back: Column) -> Column:
        # Later members come first, and the first of each name is kept: maps take no key twice.
        names = F.transform(back, lambda e: e["key"])
        return F.map_from_entries(F.filter(back, lambda e, i: F.array_position(names, e["key"]) == i + 1))

    return bound(F.reverse(F.transform(_spans(rows, "member"), entry)), last_of_each)


def members(markup: Column) -> Column:
    """map<string, struct<type, text, value>> of the members of a struct, the outermost of the markup."""
    return bound(pieces(markup), _members)


def items(markup: Column) -> Column:
    """array<struct<type, text, value>> of an array's items. markup: the array's `<value>`."""
    return bound(pieces(markup), lambda rows: F.transform(_spans(rows, "value", 2), _value))


def any_value(message: Column) -> Column:
    """The value of a `<value>` element, or the list of params of a message, as a variant: structs are objects,
    arrays lists, dateTime.iso8601 and base64 objects with one field of that name. Null if it is neither."""
    return bound(pieces(message), lambda rows: F.try_parse_json(bound(F.when(F.get(rows, 0)["tag"] == "value", rows).otherwise(F.get(_elements(rows, "params"), 0)), _json)))


def enumerated(v: Column, names: list[str]) -> Column:
    """struct<tag, value> of an enumeration: an int is the place of a name, a string a name, and a struct of one
    member has the name as its member's. Null for what names none."""
    return bound(v, lambda x: _enumerated(x, names))


def _enumerated(v: Column, names: list[str]) -> Column:
    known = F.array(*[F.lit(n) for n in names])
    fields = F.when(v["type"] == "struct", F.variant_get(v["value"], "$", "map<string,variant>"))

    def told(tagged: Column) -> Column:
        tag = F.when(v["type"] == "i4", F.get(known, as_int(v))).when(v["type"] == "string", v["text"]).when(F.size(tagged) == 1, F.get(F.map_keys(tagged), 0))
        return bound(tag, lambda t: F.when(t.isin(*names), F.struct(t.alias("tag"), F.get(F.map_values(tagged), 0).alias("value"))))

    return bound(fields, told)


def _texts(rows: Column, tag: str) -> Column:
    return F.transform(_elements(rows, tag), lambda span: F.trim(F.array_join(F.transform(F.filter(span, lambda r: r["text"].isNotNull()), lambda r: r["text"]), "")))


def _count(rows: Column, tag: str) -> Column:
    return F.size(F.filter(rows, lambda r: r["opens"] & r["tag"].eqNullSafe(tag)))


def _unread(params: Column) -> Column:
    """A param without a value, or with one that is none."""
    return F.exists(params, lambda p: F.coalesce(p["value"].isNull(), F.lit(True)))


#: What stands for `<value>`, `</value>`, `<data>`, `</data>` and `</struct>` while tags are replaced: no text may have them.
_OPEN, _CLOSE, _FIRST, _LAST, _ENDED = "\x01", "\x02", "\x03", "\x04", "\x05"
_UNPLAIN = r"[\x00-\x08\x0b-\x1f]|&(?!(?:lt|gt|amp|apos|quot);)"
_WHOLE, _REAL = r"-?[1-9][0-9]{0,17}|0", r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?"
_TYPED = r"<param>(?=<value><(int|i[1248]|string|boolean|double|dateTime\.iso8601|base64)>([^<]*)</\1></value></param>)"
_BARE = r"<param>(?=<value>([^<]*)</value></param>)"
_NUMBERS = rf"<value><(?:(int|i[1248])>({_WHOLE})</\1>|double>({_REAL})</double>)</value>"
_STRINGS = r"<value>(?:<string>([^<]*)</string>|([^<]*))</value>"
_PAIRS = r"<value><(dateTime\.iso8601|base64)>([^<]*)</\1></value>"
#: Each takes tags only where they stand side by side, so text or tags at other places stay, and show.
_WORDS = [("<value><boolean>1</boolean></value>", f"{_OPEN}true{_CLOSE}"), ("<value><boolean>0</boolean></value>", f"{_OPEN}false{_CLOSE}"), ("<value><nil/></value>", f"{_OPEN}null{_CLOSE}")]
_CONTAINERS = [
    ("<value><array><data>", _OPEN + _FIRST), ("</data></array></value>", _LAST + _CLOSE), ("<value><struct></struct></value>", f"{_OPEN}{{}}{_CLOSE}"),
    ("<value><struct><member><name>", _OPEN + '{"'), ("</member></struct></value>", _ENDED + _CLOSE), (_FIRST + _OPEN, "["), (_FIRST + _LAST, "[]"),
    (_CLOSE + "</member><member><name>", ',"'), (f"</name>{_OPEN}", '":'), (_CLOSE + _OPEN, ","), (_CLOSE + _LAST, "]"), (_CLOSE + _ENDED, "}"),
]
_ENDS = [('"value":' + _OPEN, '"value":'), (_CLOSE + "</param>{", "},{")]
_CONTROLS = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")]
_RESOLVED = [("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '\\"'), ("&amp;", "&")]


def _plain_params(markup: Column) -> Column:
    """`_params` of what stands within `<params>`, if replacing tags makes JSON of it; else null."""
    fixed = lambda c, pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)
    where = lambda c, has, use: bound(c, lambda x: F.when(x.rlike(has), use(x)).otherwise(x))
    untyped = lambda x: fixed(F.regexp_replace(x, _BARE, '{"type":"string","text":"$1","value":'), [(f"<param><value><{k}>", f'{{"type":"{k}","value":<value><{k}>') for k in ("struct", "array")])

    text = where(markup, r'[\\"\n\t]', lambda x: fixed(x, _CONTROLS))
    text = where(F.regexp_replace(text, _TYPED, '{"type":"$1","text":"$2","value":'), "<param>", untyped)
    text = where(text, '[{]"type":"int"', lambda x: fixed(x, [('{"type":"int"', '{"type":"i4"')]))
    text = F.regexp_replace(F.regexp_replace(text, _NUMBERS, f"{_OPEN}$2$3{_CLOSE}"), _STRINGS, f'{_OPEN}"$1$2"{_CLOSE}')
    text = where(F.regexp_replace(text, _PAIRS, f'{_OPEN}{{"$1":"$2"}}{_CLOSE}'), "<boolean>|<nil/>", lambda x: fixed(x, _WORDS))
    text = fixed(where(text, "<data>|<struct>", lambda x: fixed(x, _CONTAINERS)), _ENDS)
    text = F.regexp_replace(text, rf"{_CLOSE}</param>\z", "}")

    def read(made: Column) -> Column:
        json = F.when(~made.rlike(f"[<{_OPEN}-{_ENDED}]"), F.concat(F.lit("["), where(made, "&", lambda x: fixed(x, _RESOLVED)), F.lit("]")))
        return F.try_variant_get(F.try_parse_json(json), "$", f"array<{VALUE}>")

    found = bound(F.when((markup != "") & ~markup.rlike(_UNPLAIN), text), read)
    # A nil among the params is null here, and is walked.
    return bound(found, lambda p: F.when(~F.coalesce(F.exists(p, lambda v: v["type"].isNull() | v["value"].isNull()), F.lit(True)), p))


def _plain(message: Column, before: str, after: str) -> tuple[Column, Column]:
    """What stands between the regular expressions (its first group of `before`), and the plain params of a message."""
    shape = rf"\A(?:<\?[^<>?]*\?>)?{before}<params>(<param>.+</param>)</params>{after}\z"
    return F.regexp_extract(message, f"(?s){shape}", 1), bound(F.regexp_extract(message, f"(?s){shape}", 2), _plain_params)


def decode_call(message: Column) -> Column:
    """struct<method, params, error> of a methodCall, params being values of any depth."""
    return bound(message, _decode_call)


def _decode_call(message: Column) -> Column:
    name, plain = _plain(message, "<methodCall><methodName>([^<>&\\r]*)</methodName>", "</methodCall>")
    return bound(plain, lambda p: F.when(p.isNotNull(), F.struct(F.trim(name).alias("method"), p.alias("params"), F.lit(None).cast("string").alias("error"))).otherwise(_walked_call(message)))


def _walked_call(message: Column) -> Column:
    def decoded(rows: Column) -> Column:
        def told(x: Column) -> Column:
            error = (
                F.when(~F.get(rows, 0)["tag"].eqNullSafe("methodCall"), "ExpectedMethodCall").when(F.size(x["names"]) == 0, "MissingMethodName").when(F.size(x["names"]) > 1, "DuplicateMethodName")
                .when(_count(rows, "params") > 1, "DuplicateParams").when(_unread(x["params"]), "InvalidValue")
            )
            return bound(error, lambda e: F.struct(F.when(e.isNull(), F.get(x["names"], 0)).alias("method"), F.when(e.isNull(), x["params"]).alias("params"), e.alias("error")))

        return bound(F.struct(F.coalesce(_texts(rows, "methodName"), F.array().cast("array<string>")).alias("names"), _params(rows).alias("params")), told)

    return bound(pieces(message), decoded)


def decode_response(message: Column) -> Column:
    """struct<ok, params, fault_code, fault_string, error> of a methodResponse."""

    def decoded(rows: Column) -> Column:
        def told(x: Column) -> Column:
            fault = _count(rows, "fault") > 0
            code, text = (F.try_element_at(x["members"], F.lit(k)) for k in ("faultCode", "faultString"))
            error = F.when(~F.get(rows, 0)["tag"].eqNullSafe("methodResponse"), "ExpectedMethodResponse").when(~fault & (_count(rows, "params") == 0), "ParamsOrFaultExpected").when(_unread(x["params"]), "InvalidValue")
            return bound(error, lambda e: F.struct(F.when(e.isNull(), ~fault).alias("ok"), F.when(e.isNull() & ~fault, x["params"]).alias("params"), F.when(e.isNull() & fault, as_int(code)).alias("fault_code"), F.when(e.isNull() & fault, as_string(text)).alias("fault_string"), e.alias("error")))

        return bound(F.struct(_params(rows).alias("params"), F.when(_count(rows, "fault") > 0, _members(rows)).alias("members")), told)

    return bound(pieces(message), decoded)


def receive(status: Column, content_type: Column, body: Column) -> Column:
    """struct<error, response> of an HTTP answer's status, content type and text body."""
    error = F.when(status != 200, "Status").when(~F.lower(F.trim(F.substring_index(content_type, ";", 1))).eqNullSafe("text/xml"), "ContentType")
    return F.struct(error.alias("error"), F.when(error.isNull(), decode_response(body)).alias("response"))


def charset(content_type: Column) -> Column:
    """The charset parameter of a content type, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*\"?([^\";\s]+)", 1)), F.lit(""))

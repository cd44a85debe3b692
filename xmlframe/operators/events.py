"""Documents to event rows, and well-formedness, all in column expressions.

A document's tokens come from one regular expression; what it cannot read is a token of one character,
so tokens always cover the document. A document is a row of the input with its tokens at hand as an array:
depth and byte offsets are running sums of that array, and well-formedness is one walk over it, which plain
documents are spared by a regular expression that takes elements off from the inside. Nothing is
shuffled; rows with one id, or none, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars, escape
from ..functions.arrays import bound, running_sums
from ..functions.names import split_name
from . import dtd

#: The alternatives: comment, CDATA, processing instruction, DOCTYPE, end tag, start tag, reference, text.
#: In a DOCTYPE's internal subset, quotes in comments and instructions are no literals.
TOKEN = (
    r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>"
    r"""|<!DOCTYPE(?:[^>\["']|"[^"]*"|'[^']*')*+(?:\[(?:<!--[\s\S]*?-->|<\?[\s\S]*?\?>|[^\]"']|"[^"]*"|'[^']*')*+\]\s*+)?>"""
    r"""|</[^>]*+>|<[^!?/>\s"'<](?:[^>"'<]|"[^"]*"|'[^']*')*+>|&[^;<&\s]*+;?|[^<&]++|[\s\S]"""
)
_NAME = chars.NAME
_VALUE = "\"[^\"]*\"|'[^']*'"
ATTRIBUTE = rf"""([^\s=/>"']+)\s*=\s*({_VALUE})"""
_DECLARATION = (
    r"""\A<\?xml\s+version\s*=\s*(?:"1\.[0-9]+"|'1\.[0-9]+')(?:\s+encoding\s*=\s*(?:"[A-Za-z][A-Za-z0-9._-]*"|'[A-Za-z][A-Za-z0-9._-]*'))?"""
    r"""(?:\s+standalone\s*=\s*(?:"(?:yes|no)"|'(?:yes|no)'))?\s*\?>\z"""
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, token): the tokens of each document in order. Null and empty documents have none."""
    read = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("tokens"))
    return read.select("doc_id", F.posexplode("tokens").alias("pos", "token"))


def kind_of(token: Column) -> Column:
    """XML_DECL, DTD, STAG, ETAG, CHARACTERS, PI, COMMENT, or BAD for an unreadable character."""
    return (
        F.when(~token.startswith("<") & ~(token == "&"), "CHARACTERS")
        .when(token.startswith("<!--"), "COMMENT")
        .when(token.startswith("<![CDATA["), "CHARACTERS")
        .when(token.rlike(r"\A<\?xml\s"), "XML_DECL")
        .when(token.startswith("<?"), "PI")
        .when(token.startswith("<!DOCTYPE"), "DTD")
        .when(token.startswith("</"), "ETAG")
        .when(F.char_length(token) > 1, "STAG")
        .otherwise("BAD")
    )


def tag_name(token: Column) -> Column:
    return F.regexp_extract(token, r"\A</?([^\s/>]*)", 1)


def attributes(tag: Column) -> Column:
    """array<struct<name, value>> of a start tag, values with their references resolved, in order."""
    found = F.regexp_extract_all(F.regexp_replace(tag, r"\A<[^\s/>]+", ""), F.lit(ATTRIBUTE), F.lit(0))
    value = lambda a: F.regexp_extract(a, rf"=\s*({_VALUE})\s*\z", 1)
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"\A[^\s=]+", 0).alias("name"), escape.unescape(F.substring(value(a), F.lit(2), F.char_length(value(a)) - 2)).alias("value")))


def declaration(token: Column) -> Column:
    """struct<version, encoding, standalone> of an XML declaration."""
    pick = lambda name: F.nullif(F.regexp_extract(token, rf"""\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    return F.struct(pick("version").alias("version"), pick("encoding").alias("encoding"), (pick("standalone") == "yes").alias("standalone"))


def text_of(kind: Column, token: Column) -> Column:
    return (
        F.when(kind == "COMMENT", F.substring(token, F.lit(5), F.char_length(token) - 7))
        .when(token.startswith("<![CDATA["), F.substring(token, F.lit(10), F.char_length(token) - 12))
        .when(kind == "PI", F.nullif(F.regexp_extract(token, r"\A<\?[^\s?]+\s+([\s\S]*)\?>\z", 1), F.lit("")))
        .when((kind == "CHARACTERS") & token.startswith("&"), F.coalesce(escape.resolve(token), token))
        .when(kind == "CHARACTERS", escape.line_ends(token))
    )


def is_empty(token: Column) -> Column:
    """Whether a start tag closes itself."""
    return token.endswith("/>")


def name_of(kind: Column, token: Column) -> Column:
    """The name of a tag, the target of an instruction or declaration, the root that a DOCTYPE names."""
    return (
        F.when(kind.isin("STAG", "ETAG"), tag_name(token))
        .when(kind.isin("PI", "XML_DECL"), F.regexp_extract(token, r"\A<\?([^\s?]*)", 1))
        .when(kind == "DTD", F.regexp_extract(token, r"\A<!DOCTYPE\s+([^\s\[>]+)", 1))
    )


def located(text: Column) -> Column:
    """array<struct<token, kind, empty, depth, end_offset>> of a document; see `events`."""

    def with_sums(rows: Column) -> Column:
        step = lambda r: F.when(r["kind"] == "ETAG", -1).when((r["kind"] == "STAG") & ~r["empty"], 1).otherwise(0)
        sums = F.struct(running_sums(F.transform(rows, step)).alias("depth"), running_sums(F.transform(rows, lambda r: F.octet_length(r["token"]))).alias("ends"))

        def zipped(s: Column) -> Column:
            inside = lambda r: F.when((r["kind"] == "ETAG") | r["empty"], 1).otherwise(0)
            return F.transform(rows, lambda r, i: F.struct(r["token"].alias("token"), r["kind"].alias("kind"), r["empty"].alias("empty"), (F.get(s["depth"], i) + inside(r)).cast("int").alias("depth"), F.get(s["ends"], i).alias("end_offset")))

        return bound(sums, zipped)

    kinds = F.transform(tokens(text), lambda x: F.struct(x.alias("token"), kind_of(x).alias("kind")))
    return bound(F.transform(kinds, lambda r: F.struct(r["token"].alias("token"), r["kind"].alias("kind"), ((r["kind"] == "STAG") & is_empty(r["token"])).alias("empty"))), with_sums)


def events(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_attributes: bool = True) -> DataFrame:
    """(doc_id, pos, kind, name, prefix, local, attrs, text, empty, depth, start_offset, end_offset, token).

    Offsets count UTF-8 bytes. depth is 0 for what stands outside the root, and a tag's is that of its
    element's content. An empty element is one STAG row with empty = true; `with_end_tags` adds its ETAG.
    Attributes are an own projection, so plans that do not read them do not extract them."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(located(F.col(text))).alias("pos", "e")).select("doc_id", "pos", "e.*")
    rows = rows.withColumn("name", name_of(F.col("kind"), F.col("token")))
    split = F.when(F.col("kind").isin("STAG", "ETAG"), split_name(F.col("name")))
    return rows.select(
        "doc_id", "pos", "kind", "name", split["prefix"].alias("prefix"), split["local"].alias("local"),
        *([F.when(F.col("kind") == "STAG", attributes(F.col("token"))).alias("attrs")] if with_attributes else []),
        text_of(F.col("kind"), F.col("token")).alias("text"), "empty", "depth",
        (F.col("end_offset") - F.octet_length("token")).alias("start_offset"), "end_offset", "token",
    )


def with_end_tags(rows: DataFrame) -> DataFrame:
    """events with an ETAG row behind each empty start tag, and positions counted anew."""
    more = rows.withColumn("_k", F.explode(F.when(F.col("empty"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    end = F.col("_k") == 1
    more = more.withColumn("kind", F.when(end, "ETAG").otherwise(F.col("kind"))).withColumn("start_offset", F.when(end, F.col("end_offset")).otherwise(F.col("start_offset")))
    if "attrs" in rows.columns:
        more = more.withColumn("attrs", F.when(~end, F.col("attrs")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "_k")) - 1
    return more.withColumn("_p", place).drop("pos", "_k").withColumnRenamed("_p", "pos").select(*rows.columns)


# ---------------------------------------------------------------------------- well-formedness

# The codes of errors, and details such as "quote or single quote", are those that users of
# well-formedness reports know.

def _error(code: str, detail: Column | str | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(detail) if detail is None or isinstance(detail, str) else detail).cast("string").alias("detail"))


def _reference_error(ref: Column) -> Column:
    """What is wrong with a reference that stands for nothing."""
    return (
        F.when(~ref.startswith("&#") & ~ref.rlike(rf"\A&[{chars.NAME_START}]"), _error("IllegalNameStartChar", F.substring(ref, F.lit(2), F.lit(1))))
        .when(~ref.endswith(";"), _error("ExpectToken", ";"))
        .when(ref.startswith("&#"), _error("InvalidCharacterReference", F.regexp_replace(ref, r"\A&#x?|;\z", "")))
        .otherwise(_error("UnknownEntity", F.substring(ref, F.lit(2), F.char_length(ref) - 2)))
    )


def _first_reference_error(text: Column) -> Column:
    return F.when(text.contains("&"), bound(escape.unknown_reference(text), lambda ref: F.when(ref.isNotNull(), _reference_error(ref))))


def _attributes_error(rest: Column) -> Column:
    """What is wrong behind a start tag's name."""
    attr = rf"\s+{_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*')"
    unread = lambda left: (
        F.when(left.rlike(rf"\A\s+{_NAME}\s*=\s*[\"'][^\"']*<"), _error("IllegalAttributeValue"))
        .when(left.rlike(rf"\A\s+{_NAME}\s*=\s*[^\"']"), _error("ExpectToken", "quote or single quote"))
        .when(left.rlike(rf"\A\s+{_NAME}\s*(?:[^=\s]|\s)"), _error("ExpectToken", "="))
        .otherwise(_error("ExpectToken", ">"))
    )
    repeated = lambda names: F.get(F.filter(names, lambda n, i: F.array_position(names, n) <= i), 0)
    names = F.transform(F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.regexp_extract(a, r"\A[^\s=]+", 0))
    values = F.array_join(F.regexp_extract_all(rest, F.lit(_VALUE), F.lit(0)), "")
    second = bound(bound(names, repeated), lambda n: F.when(n.isNotNull(), _error("NonUniqueAttribute", n)))
    return bound(
        F.regexp_replace(rest, rf"\A(?:{attr})*+", ""),
        lambda left: F.when(~left.rlike(r"\A\s*/?>\z"), unread(left)).otherwise(F.coalesce(second, F.when(rest.contains("&"), bound(values, _first_reference_error)))),
    )


def _tag_error(tag: Column) -> Column:
    def judged(name: Column) -> Column:
        rest = F.substring(tag, F.char_length(name) + 2, F.char_length(tag))
        return (
            F.when(~name.rlike(rf"\A[{chars.NAME_START}]"), _error("IllegalNameStartChar", F.substring(name, F.lit(1), F.lit(1))))
            .when(~chars.is_name(name), _error("IllegalName", name))
            .otherwise(bound(rest, lambda r: F.when(~r.rlike(r"\A\s*/?>\z"), _attributes_error(r))))
        )

    return bound(tag_name(tag), judged)


def _bad_error(token: Column, after: Column) -> Column:
    """What a character that begins no token is: an unfinished construct, told by what follows."""
    return (
        F.when(token == "&", F.when(after.isNull(), _error("UnexpectedEof")).otherwise(_error("IllegalNameStartChar", F.substring(after, F.lit(1), F.lit(1)))))
        .when(after.isNull() | after.rlike(r"\A!--|\A!\[CDATA\["), _error("UnexpectedEof"))
        .when(after.startswith("!DOCTYPE") | after.startswith("/"), _error("ExpectToken", ">"))
        .when(after.startswith("?"), _error("ExpectToken", "?>"))
        .when(after.rlike(rf"\A[{chars.NAME_START}][^\"']*=\s*[\"']"), _error("IllegalAttributeValue"))
        .when(after.rlike(rf"\A[{chars.NAME_START}]"), _error("UnexpectedEof"))
        .otherwise(_error("IllegalNameStartChar", F.substring(after, F.lit(1), F.lit(1))))
    )


def token_error(kind: Column, token: Column, after: Column, dialect: str = "full") -> Column:
    """struct<code, detail> of what is wrong within a token, wherever it stands, or null."""
    inner = F.substring(token, F.lit(5), F.char_length(token) - 7)
    target = F.regexp_extract(token, r"\A<\?([^\s?]*)", 1)
    illegal = lambda code: bound(chars.first_invalid(token)["char"], lambda c: F.when(c.isNotNull(), _error(code, c)))
    text = F.when(token.startswith("&"), _first_reference_error(token))
    if dialect == "simple":
        text = text.when(~token.startswith("<") & token.contains("]]>"), F.coalesce(illegal("InvalidCharacter"), _error("IllegalCDataSectionEnd")))
    declared = _error("DtdError", "Unsupported") if dialect == "simple" else F.when(~dtd.well_formed(token), _error("ExpectToken", ">"))
    return (
        F.when(kind == "CHARACTERS", text.otherwise(illegal("InvalidCharacter")))
        .when(kind == "STAG", _tag_error(token))
        .when(kind == "ETAG", F.when(~token.rlike(rf"\A</{_NAME}\s*>\z"), F.when(token.rlike(rf"\A</{_NAME}"), _error("ExpectToken", ">")).otherwise(_error("IllegalNameStartChar", F.substring(token, F.lit(3), F.lit(1))))))
        .when(kind == "COMMENT", F.when(inner.contains("--") | inner.endswith("-"), _error("CommentColonColon")).otherwise(illegal("IllegalChar")))
        .when(kind == "XML_DECL", F.when(~token.rlike(_DECLARATION), _error("ExpectToken", "?>")))
        .when(
            kind == "PI",
            F.when(F.lower(target) == "xml", _error("InvalidPITarget"))
            .when(~token.rlike(rf"\A<\?{_NAME}(?:\s[\s\S]*)?\?>\z"), F.when(token.rlike(rf"\A<\?{_NAME}"), _error("ExpectToken", "?>")).otherwise(_error("IllegalNameStartChar", F.substring(target, F.lit(1), F.lit(1)))))
            .otherwise(illegal("IllegalChar")),
        )
        .when(kind == "DTD", declared)
        .when(kind == "BAD", _bad_error(token, after))
    )


def _place_error(kind: Column, token: Column, state: Column, dialect: str) -> Column:
    """What is wrong with a token standing where it does, whatever it says. state: see `_walk`."""
    depth, root = F.size(state["stack"]), state["root"]
    blank = chars.only_space(token)
    first_char = F.regexp_extract(token, rf"\A[{chars.SPACE}]*([\s\S])", 1)
    if dialect == "dom":
        late = F.when((kind != "CHARACTERS") | ~blank, _error("TrailingContent"))
        return (
            F.when(root & (depth == 0), late)
            .when((kind == "XML_DECL") & (root | state["declared"] | state["doctype"]), _error("UnexpectedDecl"))
            .when((kind == "DTD") & (root | state["doctype"]), _error("UnexpectedDocType"))
            .when((depth == 0) & (kind == "CHARACTERS") & ~blank, _error("PrologCharacters"))
            .when((depth == 0) & (kind == "ETAG"), _error("EndEventMismatch", tag_name(token)))
        )
    second = _error("ExpectedDocumentEnd") if dialect == "full" else _error("Expected", "comment, PI")
    markup = token.rlike(r"\A(?:&|<)")
    outside = F.when(~markup & ~blank, _error("UnexpectedCharacter", first_char))
    if dialect == "simple":
        outside = F.when(markup, _error("Expected", "comment, PI")).otherwise(outside)
    out = (
        F.when((kind == "XML_DECL") & (state["at"] > 0), _error("InvalidPITarget"))
        .when(kind.isin("STAG", "ETAG") & (depth == 0) & root, second)
        .when((kind == "CHARACTERS") & (depth == 0), outside)
    )
    return out if dialect == "simple" else out.when((kind == "DTD") & (root | state["doctype"]), _error("UnexpectedDocType"))


#: An element of up to eight attributes, none twice, with neither elements nor references in it; \x01 stands for an
#: element that was one.
_WHITE = rf"[{chars.SPACE}]"
_PLAIN_CHAR = chars.CHAR.replace(r"\x20-", r"\x20\x21\x23-\x25\x28-\x3B\x3D-")  # without quotes, & and <
_PLAIN_NAME = _NAME + "+"
_PLAIN_VALUE = rf"""(?:"[{_PLAIN_CHAR}']*+"|'[{_PLAIN_CHAR}"]*+')"""
_PLAIN_ATTRIBUTE = rf"{_WHITE}++({_PLAIN_NAME}){_WHITE}*+={_WHITE}*+{_PLAIN_VALUE}"
_LATER = _PLAIN_ATTRIBUTE.replace(f"({_PLAIN_NAME})", _PLAIN_NAME)
_PLAIN = rf"<({_PLAIN_NAME})(?:{_PLAIN_ATTRIBUTE}(?!(?:{_LATER}){{0,7}}{_WHITE}++\2{_WHITE}*+=)){{0,8}}{_WHITE}*+"
_LEAF = rf"""{_PLAIN}(?:/>|>[{_PLAIN_CHAR}"'\x01]*+</\1{_WHITE}*+>)"""
#: Levels of elements that are taken off before a document is walked.
LEVELS = 8


def _surely_good(text: Column) -> Column:
    """Whether elements taken off one level after the other, from the inside, leave one root and white space about
    it: what they do is well-formed in every dialect. False says nothing: such documents are walked."""
    # References to what is predefined become a character that no name has.
    taken = F.when(text.contains("&"), F.regexp_replace(text, "&(?:lt|gt|amp|apos|quot);", "\\$")).otherwise(text)
    for _ in range(LEVELS):
        taken = bound(taken, lambda x: F.when(F.char_length(x) > 1, F.regexp_replace(x, _LEAF, "\x01")).otherwise(x))
    return F.when(text.rlike(r"<[!?]|\]\]>|\x01"), False).otherwise(taken.rlike(rf"\A{_WHITE}*+\x01{_WHITE}*+\z"))


def _walk(rows: Column, dialect: str) -> Column:
    """struct<stack, at, root, declared, doctype, error> behind the last token, or behind the first that is
    wrong. rows: array<struct<token, kind, error>>, the error being that of the token itself; stack: the names
    of the open elements; at: the number of tokens; root, declared, doctype: what has come."""
    state = "struct<stack:array<string>,at:int,root:boolean,declared:boolean,doctype:boolean,error:struct<code:string,detail:string>>"
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("at"), *[F.lit(False).alias(k) for k in ("root", "declared", "doctype")], F.lit(None).alias("error")).cast(state)

    def step(s: Column, x: Column) -> Column:
        kind, token, stack = x["kind"], x["token"], s["stack"]
        top = F.get(stack, F.size(stack) - 1)
        closed = F.when(kind == "ETAG", F.when(top.isNull(), _error("ETagAfterRootElement")).when(top != tag_name(token), _error("WrongETagName", top)))
        wrong = F.coalesce(_place_error(kind, token, s, dialect), x["error"], closed)
        after = F.when((kind == "STAG") & ~is_empty(token), F.array_append(stack, tag_name(token))).when(kind == "ETAG", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        come = F.struct(after.alias("stack"), (s["at"] + 1).alias("at"), (s["root"] | (kind == "STAG")).alias("root"), (s["declared"] | (kind == "XML_DECL")).alias("declared"), (s["doctype"] | (kind == "DTD")).alias("doctype"), F.lit(None).cast("struct<code:string,detail:string>").alias("error"))
        found = lambda w: F.when(w.isNull(), come).otherwise(s.withField("error", w))
        return F.when(s["error"].isNotNull(), s).otherwise(bound(wrong, found))

    return F.aggregate(rows, start, step)


def first_error(text: Column, dialect: str = "full") -> Column:
    """struct<code, detail, offset> of the first thing that keeps a text from being a well-formed document;
    null if nothing does, or for a null text. See `check`."""
    if dialect not in ("full", "simple", "dom"):
        raise ValueError(f"no dialect {dialect}")
    return bound(text, lambda t: F.when(~_surely_good(t), _first_error(t, dialect)))


def _first_error(text: Column, dialect: str) -> Column:
    at = lambda error, offset: F.struct(error["code"].alias("code"), error["detail"].alias("detail"), offset.cast("long").alias("offset"))

    def judged(rows: Column) -> Column:
        errors = F.transform(rows, lambda r, i: F.struct(r["token"].alias("token"), r["kind"].alias("kind"), token_error(r["kind"], r["token"], F.get(rows, i + 1)["token"], dialect).alias("error")))
        last = F.get(rows, F.size(rows) - 1)["token"]
        offset = lambda n: F.aggregate(F.slice(rows, F.lit(1), n), F.lit(0).cast("long"), lambda sum_, r: sum_ + F.octet_length(r["token"]))
        unfinished = F.when(~last.rlike(r"\A(?:<|&)") | F.lit(dialect == "dom"), _error("UnexpectedEof")).otherwise(_error("OpenElementAtEof"))
        rootless = {"full": F.lit(None).cast("struct<code:string,detail:string>"), "simple": _error("Expected", "XML"), "dom": _error("UnexpectedEof")}[dialect]

        def told(state: Column) -> Column:
            at_end = F.when(F.size(state["stack"]) > 0, unfinished).when(~state["root"], rootless)
            return F.when(state["error"].isNotNull(), at(state["error"], offset(state["at"]))).otherwise(bound(at_end, lambda e: F.when(e.isNotNull(), at(e, F.octet_length(text)))))

        return bound(_walk(errors, dialect), told)

    kinds = F.transform(tokens(text), lambda x: F.struct(x.alias("token"), kind_of(x).alias("kind")))
    return F.when(text.isNotNull(), bound(kinds, judged))


def check(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dialect: str = "full") -> DataFrame:
    """(doc_id, ok, error): whether each document is well-formed, and the first thing that is wrong:
    struct<code, detail, offset>, offset being the byte at which the token that shows it begins.

    An XML declaration is the first thing of a document, and a DOCTYPE comes once and before the root; its
    internal subset is checked. Dialect `full` allows DOCTYPEs, documents without a root, and references and
    CDATA outside the root; `simple` allows none of these, nor `]]>` in text; `dom` is `full` with a root
    that must be, nothing but white space behind it, and codes of its own for what stands in a wrong place
    (there, a declaration may follow white space and comments). A null document is neither ok nor wrong.
    A row of docs is a row of the result, also with a null or repeated id; other columns are not looked at."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).isNotNull().alias("_some"), first_error(F.col(text), dialect).alias("error"))
    return found.select("doc_id", F.when(F.col("_some"), F.col("error").isNull()).alias("ok"), "error")


def tag_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(name, n_elements): how often each element name occurs; only start tags leave the scan."""
    rows = tokenize(docs, doc_id, text).filter(F.col("token").rlike(r"\A<[^!?/]"))
    return rows.groupBy(tag_name(F.col("token")).alias("name")).agg(F.count("*").alias("n_elements"))


def attribute_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = tokenize(docs, doc_id, text).filter(F.col("token").rlike(r"\A<[^!?/]") & F.col("token").contains("="))
    return rows.select(F.explode(attributes(F.col("token"))).alias("a")).groupBy(F.col("a.name").alias("name")).agg(F.count("*").alias("n_attributes"))

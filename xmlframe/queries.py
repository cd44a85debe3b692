"""The library's queries and their DuckDB counterparts. Rows of the tables are written as XML, an operator
runs, and what it returns is plain SQL over the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chars, encoding, escape, names
from .operators import codec, conformance, dtd, events, namespaces, rpc, tree, writer
from .plans import xpath
from .sources import documents as sources
from .sources.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **parts: str):
    """Register a query under its function's name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task, about, where work on a row costs far more than moving it.
TASK_ROWS = 50_000


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, and to tasks of about TASK_ROWS rows, before work that costs far more than moving a
    row. A table that is spread as widely by its files is not dealt. (Counting reads the files' footers only.)"""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ documents made of rows

def region_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region: its name and its nations, by key."""
    n = t(spark, sf_dir, "nation")
    one = writer.element("nation", writer.characters(F.col("n_name")), attrs={"key": F.col("n_nationkey")})
    per = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("x")))), lambda x: x["x"]), "").alias("nations"))
    r = t(spark, sf_dir, "region").join(per, F.col("r_regionkey") == F.col("n_regionkey"))
    doc = writer.element("region", writer.element("name", writer.characters(F.col("r_name"))), F.col("nations"), attrs={"key": F.col("r_regionkey")})
    return r.select(F.col("r_regionkey").cast("long").alias("doc_id"), doc.alias("text"))


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dealt(t(spark, sf_dir, "customer"))
    doc = writer.element("customer", writer.element("name", writer.characters(F.col("c_name"))), writer.element("nation", F.col("c_nationkey").cast("string")), attrs={"key": F.col("c_custkey"), "segment": F.col("c_mktsegment")})
    return c.select(F.col("c_custkey").alias("doc_id"), doc.alias("text"), "c_name", "c_nationkey", "c_mktsegment")


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order with its lines."""
    li = t(spark, sf_dir, "lineitem")
    line = writer.element("line", writer.element("part", F.col("l_partkey").cast("string")), writer.element("quantity", F.col("l_quantity").cast("int").cast("string")), attrs={"n": F.col("l_linenumber"), "flag": F.col("l_returnflag")})
    lines = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("x")))), lambda x: x["x"]), "").alias("x"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit('<order key="'), F.col("l_orderkey").cast("string"), F.lit('">'), F.col("x"), F.lit("</order>")).alias("text"))


def choose(key: Column, options: list) -> Column:
    """One of the options by the key's remainder."""
    out = F.lit(None)
    for k, o in enumerate(options):
        out = F.when(key % len(options) == k, o if isinstance(o, Column) else F.lit(o)).otherwise(out)
    return out


# ------------------------------------------------------------------ sources and sinks

@query("SELECT c_custkey AS doc_id, md5('<customer key=\"' || c_custkey || '\" segment=\"' || c_mktsegment || '\"><name>' || c_name || '</name><nation>' || c_nationkey || '</nation></customer>') AS digest FROM customer")
def snk_01_compact(spark, sf_dir):
    return customer_docs(spark, sf_dir).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents")
def snk_03_bytes(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.octet_length(sources.to_bytes(F.col("text"))).cast("long").alias("n_bytes"))


@query("SELECT c_custkey AS doc_id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def src_06_records(spark, sf_dir):
    x = codec.decode(F.col("text"), "struct<`@key`:bigint,`@segment`:string,name:string,nation:int>")
    return customer_docs(spark, sf_dir).select(x.alias("x")).select(F.col("x.@key").alias("doc_id"), "x.name", "x.nation", F.col("x.@segment").alias("segment"))


@query("SELECT c_custkey AS doc_id, 'Basic ' || to_base64(encode(c_name || ':' || c_mktsegment)) AS header FROM customer")
def src_11_basic_auth(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), escape.basic_auth(F.col("c_name"), F.col("c_mktsegment")).alias("header"))


# ------------------------------------------------------------------ characters

def _class_query(kind: str):
    def run(spark, sf_dir):
        d = t(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w"))
        return counted(d.select(chars.all_in(F.col("w"), kind).alias("holds"), chars.prefix_length(F.col("w"), kind).alias("prefix")), "holds", "prefix")

    c = chars.CLASSES[kind]
    sql = f"WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents) SELECT regexp_matches(w, '^[{c.replace(chr(39), chr(39) * 2)}]*$', 's') AS holds, length(regexp_extract(w, '^[{c.replace(chr(39), chr(39) * 2)}]*'))::INT AS prefix, count(*) AS n FROM w GROUP BY ALL"
    return run, sql.replace("]*$'", "]*\\z'").replace("'^[", "'\\A[")


for _id, _kind in (("chr_01_space", "space"), ("chr_02_punct", "punct"), ("chr_03_name_start", "name_start"), ("chr_04_name_char", "name"), ("chr_05_char", "char"), ("chr_06_pubid", "pubid"), ("chr_07_content", "content")):
    QUERIES[_id], ORACLES[_id] = _class_query(_kind)


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN false ELSE true END AS bmp, true AS full_ok, count(*) AS n FROM part GROUP BY ALL")
def chr_08_dom_names(spark, sf_dir):
    name = F.concat(F.lit("n"), choose(F.col("p_partkey"), ["\U00010400", "é", "b"]), F.col("p_partkey").cast("string"))
    return counted(t(spark, sf_dir, "part").select(chars.is_name(name, "dom").alias("bmp"), chars.is_name(name).alias("full_ok")), "bmp", "full_ok")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN octet_length(encode(left(text, 40))) END AS at, CASE WHEN doc_id % 2 = 0 THEN 1 END AS code FROM documents")
def chr_09_first_invalid(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    x = chars.first_invalid(F.when(F.col("doc_id") % 2 == 0, F.concat(F.left("text", F.lit(40)), F.lit("\x01tail"))).otherwise(F.col("text")))
    return d.select("doc_id", x["offset"].alias("at"), escape.code_point(x["char"]).cast("int").alias("code"))


@query("SELECT doc_id, octet_length(encode(text)) AS at, 1 AS code, true AS valid FROM documents")
def chr_11_whole_text(spark, sf_dir):
    """An invalid character behind each whole text, and none in the text itself."""
    x = chars.first_invalid(F.concat("text", F.lit("\x01tail")))
    return t(spark, sf_dir, "documents").select("doc_id", x["offset"].alias("at"), escape.code_point(x["char"]).cast("int").alias("code"), chars.first_invalid(F.col("text")).isNull().alias("valid"))


@query("SELECT n_nationkey % 4 = 0 AS blank, count(*) AS n FROM nation GROUP BY ALL")
def chr_10_only_space(spark, sf_dir):
    text = F.when(F.col("n_nationkey") % 4 == 0, " \t\r\n").otherwise(F.concat(F.lit(" "), F.col("n_name")))
    return counted(t(spark, sf_dir, "nation").select(chars.only_space(text).alias("blank")), "blank")


@query("SELECT doc_id, length(regexp_extract(text, '\\A[a-zA-Z0-9 \\n\\-''()+,./:=?;!*#@$_%\\r]*'))::INT AS prefix FROM documents")
def scn_01_prefix(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", chars.prefix_length(F.col("text"), "pubid").alias("prefix"))


@query("SELECT doc_id, (length(left(text, 200)) - length(replace(left(text, 200), chr(10), '')) + 1)::INT AS line, (length(regexp_extract(left(text, 200), '[^\\n]*\\z')) + 1)::INT AS col FROM documents")
def pos_01_line_column(spark, sf_dir):
    at = chars.line_column(F.col("text"), F.octet_length(F.left("text", F.lit(200))))
    return t(spark, sf_dir, "documents").select("doc_id", at["line"].alias("line"), at["column"].alias("col"))


@query("WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS a, string_split(regexp_replace(left(text, length(text) // 2), '\\r\\n?', chr(10), 'g'), chr(10)) AS m FROM documents) SELECT doc_id, len(a)::INT AS line, (length(a[-1]) + 1)::INT AS col, len(m)::INT AS middle_line, (length(m[-1]) + 1)::INT AS middle_col FROM d")
def pos_02_whole_text(spark, sf_dir):
    """The ends and the middles of whole texts."""
    end = chars.line_column(F.col("text"), F.octet_length("text"))
    middle = chars.line_column(F.col("text"), F.octet_length(F.left("text", F.floor(F.char_length("text") / 2).cast("int"))))
    return t(spark, sf_dir, "documents").select("doc_id", end["line"].alias("line"), end["column"].alias("col"), middle["line"].alias("middle_line"), middle["column"].alias("middle_col"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(text) > 9 THEN 9 WHEN doc_id % 2 = 0 THEN length(text) END::INT AS at FROM documents")
def diff_01_first_difference(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    other = F.when(F.col("doc_id") % 2 == 0, F.concat(F.left("text", F.lit(9)), F.lit("\x02"))).otherwise(F.left("text", F.lit(60)))
    first = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.left("text", F.lit(60)))
    return d.select("doc_id", chars.first_difference(first, other).cast("int").alias("at"))


@query("SELECT doc_id, length(text)::INT AS at_end, (length(text) // 2)::INT AS at_middle, true AS same FROM documents")
def diff_02_whole_text(spark, sf_dir):
    """Each whole text against itself, itself with a mark behind it, and itself with a mark in its middle."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    middle = F.concat(F.left("text", half), F.lit("\x02"), F.substring("text", half + 2, F.char_length("text")))
    at = {"at_end": F.concat("text", F.lit("\x02")), "at_middle": middle}
    found = [chars.first_difference(F.col("text"), other).cast("int").alias(k) for k, other in at.items()]
    return t(spark, sf_dir, "documents").select("doc_id", *found, chars.first_difference(F.col("text"), F.col("text")).isNull().alias("same"))


# ------------------------------------------------------------------ escaping and references

_FIVE = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '\"', '&quot;')"
_MARKED = "text || ' <a href=\"x\">''&]]></a>'"


def _escape_query(mode: str, sql: str):
    def run(spark, sf_dir):
        d = dealt(t(spark, sf_dir, "documents")).withColumn("text", F.concat("text", F.lit(" <a href=\"x\">'&]]></a>")))
        return d.select("doc_id", F.md5(escape.escape(F.col("text"), mode)).alias("digest"))

    return run, f"WITH d AS (SELECT doc_id, {_MARKED} AS text FROM documents) SELECT doc_id, md5({sql}) AS digest FROM d"


for _id, _mode, _sql in (
    ("esc_01_content", "content", "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), ']]>', ']]&gt;')"),
    ("esc_02_attr_apos", "attr_apos", "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '''', '&apos;')"),
    ("esc_03_attr_quot", "attr_quot", "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '\"', '&#34;')"),
    ("esc_04_default", "default", _FIVE),
    ("esc_05_ascii", "ascii", f"list_aggregate(list_transform(string_split({_FIVE}, ''), lambda c: CASE WHEN c <> '' AND unicode(c) > 127 THEN '&#' || unicode(c) || ';' ELSE c END), 'string_agg', '')"),
    ("norm_03_normal", "normal", f"list_aggregate(list_transform(string_split({_FIVE}, ''), lambda c: CASE WHEN c <> '' AND unicode(c) > 127 THEN '&#x' || to_hex(unicode(c)) || ';' ELSE c END), 'string_agg', '')"),
):
    QUERIES[_id], ORACLES[_id] = _escape_query(_mode, _sql)


@query("SELECT p_partkey, chr((128512 + p_size)::INT) AS plain, chr((225 + p_size)::INT) AS hexed FROM part")
def ref_01_character_references(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    plain = F.concat(F.lit("&#"), (F.col("p_size") + 128512).cast("string"), F.lit(";"))
    hexed = F.concat(F.lit("&#x"), F.hex(F.col("p_size") + 225), F.lit(";"))
    return p.select("p_partkey", escape.resolve(plain).alias("plain"), escape.resolve(hexed).alias("hexed"))


@query("SELECT doc_id, md5(text || '<&>\"''') AS digest FROM documents")
def ref_02_unescape(spark, sf_dir):
    text = F.concat("text", F.lit("<&>\"'"))
    return dealt(t(spark, sf_dir, "documents")).select("doc_id", F.md5(escape.unescape(escape.escape(text))).alias("digest"))


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN '<' WHEN 1 THEN '>' WHEN 2 THEN '&' WHEN 3 THEN '''' WHEN 4 THEN '\"' END AS text FROM nation")
def ref_03_entities(spark, sf_dir):
    ref = choose(F.col("n_nationkey"), ["&lt;", "&gt;", "&amp;", "&apos;", "&quot;", "&nent;"])
    return t(spark, sf_dir, "nation").select("n_nationkey", escape.resolve(ref).alias("text"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '&' || lower(replace(n_name, ' ', '_')) || ';' END AS unknown FROM nation")
def ref_04_unknown(spark, sf_dir):
    text = F.concat(F.lit("a &lt; b &#65; "), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("&"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit(";"))).otherwise("c"))
    return t(spark, sf_dir, "nation").select("n_nationkey", escape.unknown_reference(text).alias("unknown"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def ref_05_line_ends(spark, sf_dir):
    text = F.regexp_replace("text", "\n", "\r\n")
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(escape.line_ends(F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.translate("text", "\n", "\r")))).alias("digest"))


# ------------------------------------------------------------------ events

_RE2_TOKEN = events.TOKEN.replace("*+", "*").replace("++", "+").replace("?+", "?").replace("'", "''")
_KIND = "CASE WHEN left(k, 1) <> '<' AND k <> '&' THEN 'CHARACTERS' WHEN k LIKE '<!--%' THEN 'COMMENT' WHEN k LIKE '<![CDATA[%' THEN 'CHARACTERS' WHEN regexp_matches(k, '\\A<\\?xml\\s') THEN 'XML_DECL' WHEN k LIKE '<?%' THEN 'PI' WHEN k LIKE '<!DOCTYPE%' THEN 'DTD' WHEN k LIKE '</%' THEN 'ETAG' WHEN length(k) > 1 THEN 'STAG' ELSE 'BAD' END"


@query(f"WITH k AS (SELECT unnest(regexp_extract_all(html, '{_RE2_TOKEN}')) AS k FROM pages) SELECT {_KIND} AS kind, count(*) AS n, sum(octet_length(encode(k)))::BIGINT AS n_bytes FROM k GROUP BY ALL")
def evt_01_kinds(spark, sf_dir):
    rows = events.tokenize(dealt(t(spark, sf_dir, "pages")), "page_id", "html")
    return rows.groupBy(events.kind_of(F.col("token")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.octet_length("token").cast("long")).alias("n_bytes"))


@query("SELECT kind, depth, count(*) AS n FROM (SELECT unnest(['STAG', 'ETAG']) AS kind, 1 AS depth FROM region UNION ALL SELECT unnest(['STAG', 'ETAG', 'STAG', 'ETAG']), unnest([2, 2, 3, 3]) FROM nation) GROUP BY ALL")
def evt_02_end_tags(spark, sf_dir):
    n = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").cast("int").alias("n"))
    docs = n.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("<r>"), F.repeat(F.lit("<n><x/></n>"), F.col("n")), F.lit("</r>")).alias("text"))
    return counted(events.with_end_tags(events.events(docs)), "kind", "depth")


@query("SELECT c_custkey AS doc_id, 2::BIGINT AS n_attributes, c_custkey::VARCHAR AS first, c_mktsegment AS second FROM customer")
def evt_05_attributes(spark, sf_dir):
    rows = events.events(customer_docs(spark, sf_dir)).filter("pos = 0")
    return rows.select("doc_id", F.size("attrs").cast("long").alias("n_attributes"), F.col("attrs")[0]["value"].alias("first"), F.col("attrs")[1]["value"].alias("second"))


@query("SELECT n_nationkey, '1.' || (n_nationkey % 2) AS version, CASE WHEN n_nationkey % 3 = 0 THEN 'UTF-8' END AS encoding, CASE WHEN n_nationkey % 2 = 0 THEN true END AS standalone FROM nation")
def evt_06_declaration(spark, sf_dir):
    k = F.col("n_nationkey")
    text = F.concat(F.lit("<?xml version='1."), (k % 2).cast("string"), F.lit("'"), F.when(k % 3 == 0, ' encoding = "UTF-8"').otherwise(""), F.when(k % 2 == 0, "\n standalone='yes'").otherwise(""), F.lit(" ?>"))
    return t(spark, sf_dir, "nation").select("n_nationkey", events.declaration(text).alias("d")).select("n_nationkey", "d.*")


@query("SELECT n_nationkey AS doc_id, k AS kind, CASE k WHEN 'COMMENT' THEN ' c ' || n_name WHEN 'PI' THEN n_name ELSE '<' || n_name || '>]]' END AS text FROM nation, (SELECT unnest(['COMMENT', 'PI', 'CHARACTERS']) AS k)")
def evt_08_comment_pi_cdata(spark, sf_dir):
    n = F.col("n_name")
    text = F.concat(F.lit("<e><!-- c "), n, F.lit("--><?p  "), n, F.lit("?><![CDATA[<"), n, F.lit(">]]]]></e>"))
    rows = events.events(t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), text.alias("text")))
    return rows.filter("kind in ('COMMENT', 'PI', 'CHARACTERS')").select("doc_id", "kind", "text")


@query("SELECT doc_id, md5(text || '&') AS digest FROM documents")
def evt_09_character_data(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<d>"), escape.escape(F.concat("text", F.lit("&"))), F.lit("</d>")).alias("text"))
    table = tree.tree(d).filter("node_type = 'text'")
    return table.select("doc_id", F.md5("value").alias("digest"))


@query("SELECT c_custkey AS doc_id, 0::BIGINT AS root_at, octet_length(encode('<customer key=\"' || c_custkey || '\" segment=\"' || c_mktsegment || '\">')) AS name_at, octet_length(encode('<customer key=\"' || c_custkey || '\" segment=\"' || c_mktsegment || '\"><name>' || c_name || '</name>')) AS nation_at FROM customer")
def evt_10_offsets(spark, sf_dir):
    rows = events.events(customer_docs(spark, sf_dir), with_attributes=False).filter("kind = 'STAG'")
    at = lambda n: F.max(F.when(F.col("name") == n, F.col("start_offset")))
    return rows.groupBy("doc_id").agg(at("customer").alias("root_at"), at("name").alias("name_at"), at("nation").alias("nation_at"))


# What is wrong, by the key's remainder: document, code, detail and offset in the two dialects.
BROKEN = [
    ("<p>x</p>", None, None, None, None, None, None),
    ("<list><item></list></item>", "WrongETagName", "item", 12, "WrongETagName", "item", 12),
    ("<p id='1' lang='en' id='2'/>", "NonUniqueAttribute", "id", 0, "NonUniqueAttribute", "id", 0),
    ("<p>é<q>", "OpenElementAtEof", None, 8, "OpenElementAtEof", None, 8),
    ("<p/> tail", "UnexpectedCharacter", "t", 4, "UnexpectedCharacter", "t", 4),
    ("<p/><q/>", "ExpectedDocumentEnd", None, 4, "Expected", "comment, PI", 4),
    ("<p>&copyright;</p>", "UnknownEntity", "copyright", 3, "UnknownEntity", "copyright", 3),
    ("<p>&#2;</p>", "InvalidCharacterReference", "2", 3, "InvalidCharacterReference", "2", 3),
    ("<p>&amp</p>", "ExpectToken", ";", 3, "ExpectToken", ";", 3),
    ("<p>]]></p>", None, None, None, "IllegalCDataSectionEnd", None, 3),
    ("<!-- one -- two --><p/>", "CommentColonColon", None, 0, "CommentColonColon", None, 0),
    ("<!DOCTYPE p><p/>", None, None, None, "DtdError", "Unsupported", 0),
    ("<p><![CDATA[x]></p>", "UnexpectedEof", None, 3, "UnexpectedEof", None, 3),
    ("</p>", "ETagAfterRootElement", None, 0, "ETagAfterRootElement", None, 0),
    ("<p width=12></p>", "ExpectToken", "quote or single quote", 0, "ExpectToken", "quote or single quote", 0),
    ("<p q='x<y'/>", "IllegalAttributeValue", None, 0, "IllegalAttributeValue", None, 0),
    ("<?xml version='1.0'?><?XML?><p/>", "InvalidPITarget", None, 21, "InvalidPITarget", None, 21),
    ("", None, None, None, "Expected", "XML", 0),
    ("<p/><?xml version='1.0'?>", "InvalidPITarget", None, 4, "InvalidPITarget", None, 4),
    ("<?xml version='1.0'?><?xml version='1.0'?><p/>", "InvalidPITarget", None, 21, "InvalidPITarget", None, 21),
    (" <?xml version='1.0'?><p/>", "InvalidPITarget", None, 1, "InvalidPITarget", None, 1),
    ("<!DOCTYPE p><?xml version='1.0'?><p/>", "InvalidPITarget", None, 12, "DtdError", "Unsupported", 0),
    ("<!DOCTYPE p><!DOCTYPE p><p/>", "UnexpectedDocType", None, 12, "DtdError", "Unsupported", 0),
    ("<p><!DOCTYPE p></p>", "UnexpectedDocType", None, 3, "DtdError", "Unsupported", 3),
    ("<!DOCTYPE p [ words ]><p/>", "ExpectToken", ">", 0, "DtdError", "Unsupported", 0),
    ("<!DOCTYPE p [<!ELEMENT p (q|>]><p/>", "ExpectToken", ">", 0, "DtdError", "Unsupported", 0),
    ("<!DOCTYPE p [<!ELEMENT p ((q,r)|(s|t)+)*>]><p/>", None, None, None, "DtdError", "Unsupported", 0),
    ("<!DOCTYPE p [<!-- isn't -->]><p/>", None, None, None, "DtdError", "Unsupported", 0),
]


def _check_query(dialect: str, at: int):
    def run(spark, sf_dir):
        key = F.col("o_orderkey")
        docs = dealt(t(spark, sf_dir, "orders").select("o_orderkey")).select(key.alias("doc_id"), choose(key, [b[0] for b in BROKEN]).cast("string").alias("text"))
        found = events.check(docs, dialect=dialect)
        return counted(found.select((F.col("doc_id") % len(BROKEN)).alias("k"), "ok", F.col("error.code").alias("code"), F.col("error.detail").alias("detail"), F.col("error.offset").alias("start")), "k", "ok", "code", "detail", "start")

    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {'true' if b[at] is None else 'false'}, {q(b[at])}, {q(b[at + 1])}, {q(b[at + 2])})" for k, b in enumerate(BROKEN))
    return run, f"SELECT v.k::BIGINT AS k, ok, code, detail, begins::BIGINT AS start, count(*) AS n FROM orders JOIN (VALUES {values}) v(k, ok, code, detail, begins) ON o_orderkey % {len(BROKEN)} = v.k GROUP BY ALL"


QUERIES["check_01_full"], ORACLES["check_01_full"] = _check_query("full", 1)
QUERIES["check_02_simple"], ORACLES["check_02_simple"] = _check_query("simple", 4)


_XML_DOC = "'<d id=\"' || doc_id || '\"><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), ']]>', ']]&gt;') || '</p>'"


@query(f"WITH d AS (SELECT doc_id, octet_length(encode({_XML_DOC})) AS n, regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS odd FROM documents) SELECT doc_id, NOT odd AS closed, CASE WHEN NOT odd THEN 'WrongETagName' ELSE 'InvalidCharacter' END AS code, CASE WHEN NOT odd THEN n END AS start FROM d")
def check_03_documents(spark, sf_dir):
    """Whole texts as XML, well-formed to the end, and with an end tag of another name behind the text."""
    text = F.concat(F.lit('<d id="'), F.col("doc_id").cast("string"), F.lit('"><p>'), escape.escape(F.col("text"), "content"), F.lit("</p>"))
    d = dealt(t(spark, sf_dir, "documents")).select("doc_id", events.first_error(F.concat(text, F.lit("</d>"))).isNull().alias("closed"), events.first_error(F.concat(text, F.lit("</e>"))).alias("e"))
    return d.select("doc_id", "closed", F.col("e.code").alias("code"), F.when(F.col("closed"), F.col("e.offset")).alias("start"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n_lines, true AS ok FROM lineitem GROUP BY 1")
def check_04_orders(spark, sf_dir):
    return order_docs(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit("<line ")).cast("long").alias("n_lines"), events.first_error(F.col("text"), "simple").isNull().alias("ok"))


@query("SELECT count(*) AS n, count(*) FILTER (html LIKE '<!DOCTYPE%') AS n_refused FROM pages")
def check_05_pages(spark, sf_dir):
    """All pages, whatever they begin with, to their first error."""
    found = events.check(dealt(t(spark, sf_dir, "pages")), "page_id", "html", "simple")
    return found.agg(F.count("*").alias("n"), F.count(F.when(F.col("error.code") == "DtdError", 1)).alias("n_refused"))


@query("SELECT 'DtdError' AS code, count(*) AS n FROM pages WHERE html LIKE '<!DOCTYPE%' HAVING count(*) > 0")
def vis_05_doctype_rejected(spark, sf_dir):
    pages = dealt(t(spark, sf_dir, "pages")).filter(F.col("html").startswith("<!DOCTYPE"))
    return counted(events.check(pages, "page_id", "html", "simple").select(F.col("error.code").alias("code")), "code")


@query("SELECT c_custkey AS doc_id, md5('<customer key=\"' || c_custkey || '\" segment=\"' || c_mktsegment || '\"><name>' || c_name || '</name><nation>' || c_nationkey || '</nation></customer>') AS digest FROM customer")
def norm_02_round_trip(spark, sf_dir):
    return customer_docs(spark, sf_dir).select("doc_id", F.md5(writer.rewritten(F.col("text"), "normal")).alias("digest"))


@query("SELECT n_nationkey AS doc_id, '<doc a=\"&lt;1\" b=\"2\"><?p ' || n_name || '?><?x ?>a&#9;b&#10;</doc>' AS xml FROM nation")
def norm_04_canonical(spark, sf_dir):
    text = F.concat(F.lit("<?xml version='1.0'?><!DOCTYPE doc><doc b='2' a='&lt;1'><!-- c --><?p "), F.col("n_name"), F.lit("?><?x?>a\tb\r\n</doc>"))
    docs = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), text.alias("text"))
    return writer.serialize(events.events(docs), "canonical")


# ------------------------------------------------------------------ namespaces

def namespaced(spark, sf_dir) -> DataFrame:
    """A document for each nation: default and prefixed names, a binding anew inside, one taken back."""
    k = F.col("n_nationkey")
    prefix = choose(k, ["a:", "b:", "", "c:"])
    text = F.concat(F.lit("<root xmlns='urn:d' xmlns:a='urn:a' xmlns:b='urn:b'><x xmlns:b='urn:inner'><"), prefix, F.lit("n key='1' a:key='2'/></x><y xmlns=''><z/></y><"), prefix, F.lit("m/></root>"))
    return t(spark, sf_dir, "nation").select(k.cast("long").alias("doc_id"), text.alias("text"))


_PREFIX_URI = "CASE n_nationkey % 4 WHEN 0 THEN 'urn:a' WHEN 1 THEN '{b}' WHEN 2 THEN 'urn:d' END"


@query("SELECT n_nationkey AS doc_id, CASE n_nationkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN NULL WHEN 2 THEN NULL END AS prefix, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name END AS local FROM nation")
def ns_01_split(spark, sf_dir):
    name = F.concat(choose(F.col("n_nationkey"), ["a:", "", "a:b:", ":"]), F.col("n_name"))
    q = names.split_name(name)
    return t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), q["prefix"].alias("prefix"), q["local"].alias("local"))


@query(f"SELECT n_nationkey::BIGINT AS doc_id, local, CASE local WHEN 'root' THEN 'urn:d' WHEN 'x' THEN 'urn:d' WHEN 'n' THEN {_PREFIX_URI.format(b='urn:inner')} WHEN 'm' THEN {_PREFIX_URI.format(b='urn:b')} END AS ns_uri, CASE WHEN local IN ('n', 'm') AND n_nationkey % 4 = 3 THEN 'UnknownNamespacePrefix' END AS error FROM nation, (SELECT unnest(['root', 'x', 'n', 'y', 'z', 'm']) AS local)")
def ns_04_elements(spark, sf_dir):
    return namespaces.resolve_elements(events.events(namespaced(spark, sf_dir))).select("doc_id", "local", "ns_uri", "error")


@query("SELECT n_nationkey::BIGINT AS doc_id, v.name, v.uri AS ns_uri, v.value FROM nation, (VALUES ('key', NULL, '1'), ('a:key', 'urn:a', '2')) v(name, uri, value)")
def ns_05_attributes(spark, sf_dir):
    return namespaces.resolve_attributes(events.events(namespaced(spark, sf_dir))).select("doc_id", "name", "ns_uri", "value")


@query("SELECT n_nationkey::BIGINT AS doc_id, CASE n_nationkey % 4 WHEN 0 THEN 'IllegalNamespaceUri' WHEN 1 THEN 'IllegalNamespaceUri' WHEN 2 THEN 'IllegalNamespaceUri' END AS error FROM nation WHERE n_nationkey % 4 < 3")
def ns_07_reserved(spark, sf_dir):
    attr = choose(F.col("n_nationkey"), ["xmlns:p=''", f"xmlns:p='{names.XML_URI}'", "xmlns:xml='urn:x'", f"xmlns:xml='{names.XML_URI}'"])
    docs = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("<e "), attr, F.lit("/>")).alias("text"))
    return namespaces.namespace_errors(events.events(docs)).select("doc_id", "error")


@query("SELECT n_nationkey::BIGINT AS doc_id, CASE n_nationkey % 3 WHEN 0 THEN 'NonUniqueAttribute' ELSE 'IllegalName' END AS error FROM nation WHERE n_nationkey % 3 < 2")
def ns_08_unique(spark, sf_dir):
    text = choose(F.col("n_nationkey"), ["<e xmlns:a='u' xmlns:b='u' a:x='1' b:x='2'/>", "<p:xmlns xmlns:p='u'/>", "<e xmlns='u' xmlns:a='u' a:x='1' x='2'/>"])
    docs = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.cast("string").alias("text"))
    return namespaces.namespace_errors(events.events(docs)).select("doc_id", "error")


@query(f"SELECT CASE local WHEN 'root' THEN 'urn:d' WHEN 'x' THEN 'urn:d' WHEN 'n' THEN {_PREFIX_URI.format(b='urn:inner')} WHEN 'm' THEN {_PREFIX_URI.format(b='urn:b')} END AS ns_uri, local, count(*) AS n_elements FROM nation, (SELECT unnest(['root', 'x', 'n', 'y', 'z', 'm']) AS local) GROUP BY ALL")
def agg_02_namespaced_names(spark, sf_dir):
    return namespaces.name_counts(events.events(namespaced(spark, sf_dir)))


# ------------------------------------------------------------------ DTD

def dtd_docs(spark, sf_dir) -> DataFrame:
    n, k = F.translate("n_name", " ", "_"), F.col("n_nationkey")
    external = choose(k, [F.lit(""), F.concat(F.lit(" SYSTEM '"), n, F.lit(".dtd'")), F.concat(F.lit(" PUBLIC '-//"), n, F.lit("' \"s\""))])
    text = F.concat(F.lit("<!DOCTYPE "), n, external, F.lit(" [<!ELEMENT a (title, (part | note)*, map*)><!ELEMENT b (#PCDATA | c)* ><!ELEMENT c EMPTY>"
                    "<!ENTITY v \"&lt;"), n, F.lit("\"><!ENTITY % pe 'x'><!ENTITY pic SYSTEM \"img/p.png\" NDATA png><!ATTLIST a id ID #REQUIRED><!-- > -->]><a/>"))
    return t(spark, sf_dir, "nation").select(k.cast("long").alias("doc_id"), text.alias("text"))


@query("SELECT n_nationkey::BIGINT AS doc_id, replace(n_name, ' ', '_') AS root, CASE n_nationkey % 3 WHEN 1 THEN 'SYSTEM' WHEN 2 THEN 'PUBLIC' END AS kind, CASE WHEN n_nationkey % 3 = 2 THEN '-//' || replace(n_name, ' ', '_') END AS pub_id, CASE n_nationkey % 3 WHEN 1 THEN replace(n_name, ' ', '_') || '.dtd' WHEN 2 THEN 's' END AS system FROM nation")
def dtd_01_doctype(spark, sf_dir):
    d = dtd.doctype(F.col("text"))
    return dtd_docs(spark, sf_dir).select("doc_id", d["root"].alias("root"), d["external_id"]["kind"].alias("kind"), d["external_id"]["pub_id"].alias("pub_id"), d["external_id"]["system"].alias("system"))


@query("SELECT n_nationkey::BIGINT AS doc_id, v.kind, v.name, v.content, CASE v.name WHEN 'v' THEN '&lt;' || replace(n_name, ' ', '_') WHEN 'pe' THEN 'x' END AS value, v.system, v.ndata FROM nation, (VALUES ('ELEMENT', 'a', 'CHILDREN(title,(part|note)*,map*)', NULL, NULL), ('ELEMENT', 'b', 'MIXED(c)', NULL, NULL), ('ELEMENT', 'c', 'EMPTY', NULL, NULL), ('ENTITY', 'v', NULL, NULL, NULL), ('PARAMETER_ENTITY', 'pe', NULL, NULL, NULL), ('ENTITY', 'pic', NULL, 'img/p.png', 'png'), ('ATTLIST', 'a', NULL, NULL, NULL), ('COMMENT', NULL, NULL, NULL, NULL)) v(kind, name, content, system, ndata)")
def dtd_04_declarations(spark, sf_dir):
    return dtd.declarations(dtd_docs(spark, sf_dir)).select("doc_id", "kind", "name", "content", "value", F.col("external_id.system").alias("system"), "ndata")


# ------------------------------------------------------------------ encodings

def encoded(spark, sf_dir) -> DataFrame:
    k, n = F.col("n_nationkey"), F.concat("n_name", F.lit(" ¤é"))
    head = lambda label: F.concat(F.lit(f"<?xml version='1.0' encoding='{label}'?><n>"), n, F.lit("</n>"))
    plain = F.concat(F.lit("<n>"), n, F.lit("</n>"))
    data = choose(k, [F.encode(plain, "utf-8"), F.concat(F.unhex(F.lit("FFFE")), F.encode(plain, "utf-16le")), F.concat(F.unhex(F.lit("FEFF")), F.encode(plain, "utf-16be")), F.encode(head("ISO-8859-1"), "iso-8859-1"), F.encode(head("nonsense"), "utf-8")])
    return t(spark, sf_dir, "nation").select(k.alias("doc_id"), data.alias("content"))


@query("SELECT n_nationkey AS doc_id, CASE n_nationkey % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'utf-16be' WHEN 3 THEN 'windows-1252' END AS encoding, CASE WHEN n_nationkey % 5 = 4 THEN 'UnsupportedEncoding' END AS error FROM nation")
def enc_01_guess(spark, sf_dir):
    return encoded(spark, sf_dir).select("doc_id", encoding.guess(F.col("content")).alias("g")).select("doc_id", "g.*")


@query("SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 5 < 4 THEN n_name || ' ¤é' END AS text FROM nation")
def enc_02_decode(spark, sf_dir):
    text = encoding.decode(F.col("content"))["text"]
    return encoded(spark, sf_dir).select("doc_id", F.regexp_extract(text, "<n>([^<]*)</n>", 1).alias("text"))


# ------------------------------------------------------------------ writing

@query("SELECT n_nationkey AS doc_id, '<?xml version=\"1.0\" encoding=\"UTF-8\"?><!--c--><n k=\"' || n_nationkey || '\"><e/><![CDATA[' || n_name || ']]><?p ' || n_name || '?>a&lt;b</n>' AS xml FROM nation")
def wrt_01_builders(spark, sf_dir):
    n = F.col("n_name")
    body = writer.element("n", writer.element("e"), writer.cdata(n), writer.instruction("p", n), writer.characters(F.lit("a<b")), attrs={"k": F.col("n_nationkey"), "none": F.lit(None).cast("string")})
    return t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit(writer.declaration(encoding="UTF-8")), writer.comment(F.lit("c")), body).alias("xml"))


@query("SELECT n_nationkey::BIGINT AS doc_id, n_nationkey % 2 = 0 AS balanced FROM nation")
def wrt_03_balanced(spark, sf_dir):
    docs = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.when(F.col("n_nationkey") % 2 == 0, "<a><b/></a>").otherwise("<a><b></a>").alias("text"))
    return writer.balanced(events.events(docs, with_attributes=False))


# ------------------------------------------------------------------ trees and paths

@query("SELECT r_regionkey::BIGINT AS doc_id, coalesce(n_name, r_name) AS value, CASE WHEN n_name IS NULL THEN 'name' ELSE 'nation' END AS parent, 2 AS depth FROM region JOIN (SELECT n_regionkey, n_name FROM nation UNION ALL SELECT r_regionkey, NULL FROM region) ON n_regionkey = r_regionkey")
def dom_01_nodes(spark, sf_dir):
    table = tree.tree(region_docs(spark, sf_dir))
    up = table.select(F.col("doc_id").alias("d"), F.col("node_id").alias("i"), F.col("name").alias("parent"))
    texts = table.filter("node_type = 'text'").select("doc_id", "parent_id", "value", "depth")
    return texts.join(up, (texts["doc_id"] == up["d"]) & (texts["parent_id"] == up["i"])).select("doc_id", "value", "parent", "depth")


@query("SELECT n_nationkey::BIGINT AS doc_id, v.name, CASE v.name WHEN 'p' THEN 'a' || n_name WHEN 'b' THEN n_name END AS text, CASE v.name WHEN 'b' THEN 'c&d' WHEN 'i' THEN n_name END AS tail, v.ord FROM nation, (VALUES ('p', 0), ('b', 0), ('i', 1)) v(name, ord)")
def dom_03_text_and_tail(spark, sf_dir):
    n = F.col("n_name")
    docs = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("<p>a<!-- x -->"), n, F.lit("<b>"), n, F.lit("</b>c&amp;d<i/>"), n, F.lit("</p>")).alias("text"))
    return tree.text_and_tail(tree.tree(docs)).select("doc_id", "name", "text", "tail", "ord")


@query("SELECT r_regionkey::BIGINT AS doc_id, r_name || (SELECT string_agg(n_name, '' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS value FROM region")
def xp_15_string_value(spark, sf_dir):
    table = tree.tree(region_docs(spark, sf_dir))
    return tree.string_values(table, table.filter("name = 'region'")).select("doc_id", F.col("string_value").alias("value"))


@query("SELECT l_orderkey AS doc_id, CAST(sum(l_quantity::INT) AS DOUBLE) AS total, count(*)::DOUBLE AS lines, count(*) FILTER (l_returnflag = 'R') > 0 AS returned FROM lineitem GROUP BY 1")
def xp_05_expressions(spark, sf_dir):
    return xpath.evaluate_all(order_docs(spark, sf_dir), {"total": ("sum(//quantity)", "number"), "lines": ("count(/order/line) * 2 div 2", "number"), "returned": ("//line/@flag = 'R'", "boolean")})


@query("SELECT n_nationkey, n_name || '-' || n_regionkey || 'x' AS joined, n_regionkey <> 0 AS truth, length(n_name) > 0 AS filled, true AS yes, false AS no FROM nation")
def xp_09_functions(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    joined = xpath.apply("concat", F.col("n_name"), F.lit("-"), F.col("n_regionkey").cast("string"), F.lit("x"))
    return n.select("n_nationkey", joined.alias("joined"), xpath.apply("not", F.col("n_regionkey") == 0).alias("truth"), xpath.apply("boolean", F.col("n_name")).alias("filled"), xpath.apply("true").alias("yes"), xpath.apply("false").alias("no"))


@query("SELECT o_orderkey, o_totalprice <> 0 AS number_is, length(o_orderstatus) > 0 AS text_is FROM orders")
def xp_14_to_boolean(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", xpath.to_boolean(F.col("o_totalprice"), "number").alias("number_is"), xpath.to_boolean(F.col("o_orderstatus"), "string").alias("text_is"))


def _axis(name: str, steps, sql: str):
    QUERIES[name] = lambda spark, sf_dir: steps(xpath.select(region_docs(spark, sf_dir))).values().select("doc_id", F.col("string_value").alias("value"))
    ORACLES[name] = sql


_NATIONS = "SELECT n_regionkey::BIGINT AS doc_id, n_name AS value FROM nation"
_axis("xp_17_child", lambda s: s.children("region").children("nation"), _NATIONS)
_axis("xp_17_descendant", lambda s: s.descendants("nation"), _NATIONS)
_axis("xp_17_following_sibling", lambda s: s.descendants("name").following_siblings("nation"), _NATIONS)
_axis("xp_17_following", lambda s: s.descendants("name").following("nation"), _NATIONS)
_axis("xp_17_preceding_sibling", lambda s: s.descendants("nation").preceding_siblings("name"), "SELECT r_regionkey::BIGINT AS doc_id, r_name AS value FROM region")
_axis("xp_17_preceding", lambda s: s.descendants("nation").preceding("name"), "SELECT r_regionkey::BIGINT AS doc_id, r_name AS value FROM region")
_axis("xp_17_parent", lambda s: s.descendants("nation").parents("region").children("name"), "SELECT r_regionkey::BIGINT AS doc_id, r_name AS value FROM region")
_axis("xp_17_ancestor", lambda s: s.descendants("text()").ancestors("region").children("name"), "SELECT r_regionkey::BIGINT AS doc_id, r_name AS value FROM region")
_axis("xp_17_self_union", lambda s: s.descendants("nation").descendants_or_self("nation").union(s.descendants("name")), "SELECT n_regionkey::BIGINT AS doc_id, n_name AS value FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
_axis("xp_17_first", lambda s: s.descendants("nation").position(1), "SELECT n_regionkey::BIGINT AS doc_id, arg_min(n_name, n_nationkey) AS value FROM nation GROUP BY 1")
_axis("xp_17_last", lambda s: s.descendants("nation").position(), "SELECT n_regionkey::BIGINT AS doc_id, arg_max(n_name, n_nationkey) AS value FROM nation GROUP BY 1")
_axis("xp_17_predicate", lambda s: s.descendants("nation").where(xpath.to_number(xpath.attribute("key")) >= 10), _NATIONS + " WHERE n_nationkey >= 10")

# The same over documents that grow with the tables: orders and their lines.
_LINES = "SELECT l_orderkey AS doc_id, l_partkey::VARCHAR AS value, row_number() OVER w AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"


def _order_axis(name: str, steps, condition: str):
    def run(spark, sf_dir):
        # Steps and string values read the nodes several times.
        nodes = written(tree.tree(order_docs(spark, sf_dir)), "order-nodes")
        return steps(xpath.Steps(nodes).descendants("line")).children("part").values().select("doc_id", F.col("string_value").alias("value"))

    QUERIES[name], ORACLES[name] = run, f"WITH l AS ({_LINES}) SELECT doc_id, value FROM l WHERE {condition}"


_order_axis("xp_17_orders_child", lambda s: s, "true")
_order_axis("xp_17_orders_following_sibling", lambda s: s.following_siblings("line"), "place > 1")
_order_axis("xp_17_orders_preceding", lambda s: s.preceding("line"), "place < n")
_order_axis("xp_17_orders_position", lambda s: s.position(2), "place = 2")


@query("SELECT n_regionkey::BIGINT AS doc_id, n_nationkey::VARCHAR AS value FROM nation")
def xp_17_attribute(spark, sf_dir):
    return xpath.select(region_docs(spark, sf_dir)).descendants("nation").attributes("key").select("doc_id", "value")


# ------------------------------------------------------------------ records

@query("SELECT p_partkey AS key, p_name AS name, p_size AS size, p_retailprice AS price, p_brand AS brand FROM part")
def de_07_round_trip(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.struct(F.col("p_partkey").alias("@key"), F.col("p_brand").alias("@brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("r"))
    x = codec.decode(codec.encode(p, "r", "part"), "struct<`@key`:bigint,`@brand`:string,name:string,size:int,price:double>")
    return p.select(x.alias("x")).select(F.col("x.@key").alias("key"), "x.name", "x.size", "x.price", F.col("x.@brand").alias("brand"))


@query("SELECT l_orderkey AS doc_id, list_aggregate(list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey), 'string_agg', ',') AS parts, count(*)::INT AS n FROM lineitem GROUP BY 1")
def de_06_sequences(spark, sf_dir):
    x = codec.decode(F.col("text"), "struct<line:array<struct<`@n`:int,part:bigint,quantity:int>>>")
    return order_docs(spark, sf_dir).select("doc_id", x.alias("x")).select("doc_id", F.array_join(F.transform("x.line", lambda a: a["part"].cast("string")), ",").alias("parts"), F.size("x.line").alias("n"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true END AS element, CASE o_orderkey % 6 WHEN 1 THEN true WHEN 3 THEN false WHEN 4 THEN true END AS attribute, CASE o_orderkey % 6 WHEN 1 THEN true WHEN 3 THEN false END AS message FROM orders")
def de_03_booleans(spark, sf_dir):
    word = choose(F.col("o_orderkey"), [" yes", "1", "off", "0\n", "true", "maybe"])
    return t(spark, sf_dir, "orders").select("o_orderkey", *[codec.boolean(word, w).alias(n) for w, n in (("element", "element"), ("attribute", "attribute"), ("rpc", "message"))])


@query("SELECT o_orderkey, CASE WHEN o_orderkey <= 127 THEN o_orderkey END::TINYINT AS as_byte, CASE WHEN o_orderkey <= 255 THEN o_orderkey END::SMALLINT AS as_ubyte, o_orderkey::INT AS as_int, -o_orderkey AS as_long, CASE WHEN o_orderkey = 0 THEN 0 END::BIGINT AS as_uint FROM orders")
def de_02_numbers(spark, sf_dir):
    text, minus = F.concat(F.lit(" +"), F.col("o_orderkey").cast("string"), F.lit("\n")), F.concat(F.lit("-"), F.col("o_orderkey").cast("string"))
    return t(spark, sf_dir, "orders").select("o_orderkey", *[codec.integer(text, k).alias(f"as_{k}") for k in ("byte", "ubyte", "int")], codec.integer(minus, "long").alias("as_long"), codec.integer(minus, "uint").alias("as_uint"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS root_ok, n_nationkey % 3 <> 0 AS adjacent FROM nation")
def de_01_root_and_order(spark, sf_dir):
    text = F.concat(F.lit("<?xml version='1.0'?><!-- a --> "), choose(F.col("n_nationkey"), ["<item/>", "<other/>"]))
    order = choose(F.col("n_nationkey"), [F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("b"))])
    return t(spark, sf_dir, "nation").select("n_nationkey", codec.root_is(text, "item").alias("root_ok"), codec.adjacent(order).alias("adjacent"))


@query("SELECT c_custkey AS doc_id, c_name AS name, c_custkey AS key FROM customer")
def de_10_any(spark, sf_dir):
    v = codec.decode_any(F.col("text"))
    return customer_docs(spark, sf_dir).select(v.alias("v")).select(F.variant_get("v", "$['@key']", "long").alias("doc_id"), F.variant_get("v", "$.name", "string").alias("name"), F.variant_get("v", "$['@key']", "long").alias("key"))


@query("SELECT n_nationkey, '<r id=\"' || n_nationkey || '\">' || CASE WHEN n_nationkey % 2 = 0 THEN '<name>' || n_name || '</name>' ELSE '' END || '<tag>a&amp;</tag><tag>' || n_regionkey || '</tag><in><f>' || n_nationkey || CASE WHEN n_nationkey % 2 = 1 THEN '.5' ELSE '' END || '</f><t>true</t></in></r>' AS xml FROM nation")
def se_05_struct(spark, sf_dir):
    k = F.col("n_nationkey")
    inner = F.struct((k + (k % 2) * 0.5).cast("double").alias("f"), F.lit(True).alias("t"))
    n = t(spark, sf_dir, "nation").select("n_nationkey", F.struct(k.alias("@id"), F.lit(None).cast("string").alias("@gone"), F.when(k % 2 == 0, F.col("n_name")).alias("name"), F.array(F.lit("a&"), F.col("n_regionkey").cast("string")).alias("tag"), inner.alias("in")).alias("r"))
    return n.select("n_nationkey", codec.encode(n, "r", "r").alias("xml"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '<A>' || n_name || '</A>' ELSE '<B>' || n_regionkey || '</B>' END AS external, CASE WHEN n_nationkey % 2 = 0 THEN '<type>A</type>' || n_name ELSE '<type>B</type>' || n_regionkey END AS internal, CASE WHEN n_nationkey % 2 = 0 THEN '<type>A</type><content>' || n_name || '</content>' ELSE '<type>B</type><content>' || n_regionkey || '</content>' END AS adjacent, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_regionkey::VARCHAR END AS untagged FROM nation")
def se_08_variants(spark, sf_dir):
    tag = choose(F.col("n_nationkey"), ["A", "B"])
    arms = {"A": escape.escape(F.col("n_name")), "B": F.col("n_regionkey").cast("string")}
    return t(spark, sf_dir, "nation").select("n_nationkey", *[codec.tagged(tag, arms, s).alias(s) for s in ("external", "internal", "adjacent", "untagged")])


# ------------------------------------------------------------------ XML-RPC

def calls(spark, sf_dir) -> DataFrame:
    o = dealt(t(spark, sf_dir, "orders")).select("o_orderkey", F.col("o_custkey").cast("int").alias("cust"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_orderkey") * 0.25).alias("share"), F.encode("o_orderpriority", "utf-8").alias("raw"))
    return o.select("o_orderkey", rpc.call(o, F.lit("order.put"), ["cust", "priority", "done", "share", "raw"]).alias("message"))


@query("SELECT o_orderkey, 'order.put' AS method, o_custkey::INT AS cust, o_orderpriority AS priority, o_orderstatus = 'F' AS done, o_orderkey * 0.25::DOUBLE AS share, o_orderpriority AS raw FROM orders")
def rpc_07_calls(spark, sf_dir):
    d = calls(spark, sf_dir).select("o_orderkey", rpc.decode_call(F.col("message")).alias("d"))
    p = lambda k: F.get("d.params", k)
    return d.select("o_orderkey", F.col("d.method").alias("method"), rpc.as_int(p(0)).alias("cust"), rpc.as_string(p(1)).alias("priority"), rpc.as_boolean(p(2)).alias("done"), rpc.as_double(p(3)).alias("share"), F.decode(rpc.as_bytes(p(4)), "utf-8").alias("raw"))


@query("SELECT o_orderkey, '<?xml version=\"1.0\"?><methodCall><methodName>order.put</methodName><params><param><value><i4>' || o_custkey || '</i4></value></param><param><value><string>' || o_orderpriority || '</string></value></param><param><value><boolean>' || (o_orderstatus = 'F')::INT || '</boolean></value></param><param><value><double>' || regexp_replace(regexp_replace(printf('%.10f', o_orderkey * 0.25::DOUBLE), '0+$', ''), '\\.$', '') || '</double></value></param><param><value><base64>' || to_base64(encode(o_orderpriority)) || '</base64></value></param></params></methodCall>' AS message FROM orders")
def rpc_13_params(spark, sf_dir):
    return calls(spark, sf_dir)


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS ok, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::INT END AS result, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey % 100)::INT END AS fault_code, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority || ' <&>' END AS fault_string FROM orders")
def rpc_08_responses(spark, sf_dir):
    o = dealt(t(spark, sf_dir, "orders")).withColumn("cust", F.col("o_custkey").cast("int"))
    message = F.when(F.col("o_orderkey") % 2 == 0, rpc.response(o, "cust")).otherwise(rpc.fault(F.col("o_orderkey") % 100, F.concat("o_orderpriority", F.lit(" <&>"))))
    d = o.select("o_orderkey", rpc.decode_response(message).alias("d"))
    return d.select("o_orderkey", "d.ok", rpc.as_int(F.get("d.params", 0)).alias("result"), "d.fault_code", "d.fault_string")


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_mktsegment AS first_item, 2 AS n_items FROM customer")
def rpc_11_struct_and_array(spark, sf_dir):
    c = dealt(t(spark, sf_dir, "customer")).select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("s"), F.array("c_mktsegment", F.lit("x")).alias("a"))
    m = c.select("c_custkey", rpc.members(rpc.value(F.col("s"), c.schema["s"].dataType)).alias("m"), rpc.items(rpc.value(F.col("a"), c.schema["a"].dataType)).alias("i"))
    return m.select("c_custkey", rpc.as_string(F.col("m")["name"]).alias("name"), rpc.as_int(F.col("m")["nation"]).alias("nation"), rpc.as_string(F.get("i", 0)).alias("first_item"), F.size("i").alias("n_items"))


@query("SELECT l_orderkey AS doc_id, 'order.put' AS method, count(*)::INT AS n_lines, l_orderkey::INT AS key, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey))::INT AS first_part, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS last_flag FROM lineitem GROUP BY 1")
def rpc_04_nested(spark, sf_dir):
    """A call for each order: its key, and an array of structs, one for each line."""
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("l_partkey").cast("int").alias("part"), F.col("l_returnflag").alias("flag")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line"))), lambda x: x["line"])
    orders = li.groupBy("l_orderkey").agg(lines.alias("lines")).withColumn("key", F.col("l_orderkey").cast("int"))
    d = orders.select("l_orderkey", rpc.decode_call(rpc.call(orders, F.lit("order.put"), ["key", "lines"])).alias("d"))
    d = d.select("l_orderkey", "d.method", F.get("d.params", 0).alias("key"), F.variant_get(F.get("d.params", 1)["value"], "$", "array<struct<part:int,flag:string>>").alias("lines"))
    return d.select(F.col("l_orderkey").alias("doc_id"), "method", F.size("lines").alias("n_lines"), rpc.as_int(F.col("key")).alias("key"), F.get("lines", 0)["part"].alias("first_part"), F.element_at("lines", -1)["flag"].alias("last_flag"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'down' END AS tag FROM orders")
def rpc_06_enumerations(spark, sf_dir):
    v = choose(F.col("o_orderkey"), ["<value><int>0</int></value>", "<value>down</value>", "<value><struct><member><name>down</name><value><i4>5</i4></value></member></struct></value>", "<value>left</value>"])
    return dealt(t(spark, sf_dir, "orders")).select("o_orderkey", rpc.enumerated(rpc.scalar(v), ["up", "down"])["tag"].alias("tag"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' END AS tag, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority END AS content FROM orders")
def de_09_choices(spark, sf_dir):
    text = choose(F.col("o_orderkey"), [F.concat(F.lit("<state><open>"), F.col("o_orderpriority"), F.lit("</open></state>")), F.lit("<state>closed</state>"), F.lit("<state><lost/></state>")])
    return dealt(t(spark, sf_dir, "orders")).select("o_orderkey", codec.choice(text, ["open", "closed"]).alias("c")).select("o_orderkey", "c.tag", "c.content")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS cust, CASE o_orderkey % 4 WHEN 1 THEN 'Int' WHEN 2 THEN 'EndOfArrayExpected' WHEN 3 THEN 'RootStruct' END AS code, CASE o_orderkey % 4 WHEN 1 THEN 5 + length(o_orderpriority) WHEN 2 THEN 18 + length(o_orderpriority) WHEN 3 THEN 0 END::BIGINT AS start FROM orders")
def de_13_errors(spark, sf_dir):
    """Records that are right, and such as are not, with the place of what is wrong."""
    p, c = F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    text = choose(F.col("o_orderkey"), [
        F.concat(F.lit("<o><cust>"), c, F.lit("</cust></o>")), F.concat(F.lit("<o>"), p, F.lit("é<cust>"), p, F.lit("</cust></o>")),
        F.concat(F.lit("<o><p>"), p, F.lit("</p><q>x</q><p/></o>")), F.concat(F.lit("<other>"), p, F.lit("</other>")),
    ])
    x = dealt(t(spark, sf_dir, "orders")).select("o_orderkey", codec.decode_strict(text, "struct<cust:bigint,p:array<string>>", "o").alias("x"))
    return x.select("o_orderkey", F.col("x.value.cust").alias("cust"), F.col("x.error.code").alias("code"), F.col("x.error.offset").alias("start"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'i4' WHEN 1 THEN 'string' WHEN 2 THEN 'string' WHEN 3 THEN 'nil' WHEN 4 THEN 'dateTime.iso8601' END AS type, CASE n_nationkey % 5 WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN n_name WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '20260102T03:04:05' END AS text, CASE WHEN n_nationkey % 5 = 4 THEN TIMESTAMP '2026-01-02 03:04:05' END AS at FROM nation")
def rpc_01_values(spark, sf_dir):
    k = F.col("n_nationkey")
    wrap = lambda x: F.concat(F.lit("<value>"), x, F.lit("</value>"))
    v = choose(k, [wrap(F.concat(F.lit("<int>"), k.cast("string"), F.lit("</int>"))), wrap(F.col("n_name")), wrap(F.lit("")), wrap(F.lit("<nil/>")), wrap(F.lit("<dateTime.iso8601>20260102T03:04:05</dateTime.iso8601>"))])
    d = t(spark, sf_dir, "nation").select("n_nationkey", rpc.scalar(v).alias("v"))
    return d.select("n_nationkey", "v.type", "v.text", rpc.as_timestamp(F.col("v")).alias("at"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Status' WHEN 1 THEN 'ContentType' END AS error, CASE WHEN n_nationkey % 4 = 3 THEN 'iso-8859-1' END AS charset, CASE WHEN n_nationkey % 4 >= 2 THEN n_nationkey END AS result FROM nation")
def rpc_15_receive(spark, sf_dir):
    k = F.col("n_nationkey")
    n = t(spark, sf_dir, "nation")
    kind = choose(k, ["text/xml", "text/html", "text/xml", "Text/XML; charset=\"ISO-8859-1\""])
    d = n.select("n_nationkey", rpc.receive(F.when(k % 4 == 0, 500).otherwise(200), kind, rpc.response(n, "n_nationkey")).alias("r"), rpc.charset(kind).alias("charset"))
    return d.select("n_nationkey", "r.error", "charset", rpc.as_int(F.get("r.response.params", 0)).alias("result"))


# ------------------------------------------------------------------ reports

@query("SELECT tag AS name, count(*) AS n_elements FROM (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)[\\s/>]', 1)) AS tag FROM pages) GROUP BY ALL")
def agg_01_tags(spark, sf_dir):
    return events.tag_counts(dealt(t(spark, sf_dir, "pages")), "page_id", "html")


@query("SELECT v.name, count(*) AS n_attributes FROM customer, (VALUES ('key'), ('segment')) v(name) GROUP BY ALL")
def agg_01_attributes(spark, sf_dir):
    return events.attribute_counts(customer_docs(spark, sf_dir))


@query("SELECT o_orderkey % 4 AS k, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS success, count(*) AS n FROM orders GROUP BY ALL")
def agg_03_verdicts(spark, sf_dir):
    key = F.col("o_orderkey")
    docs = t(spark, sf_dir, "orders").select(key.alias("doc_id"), choose(key, ["<e/>", "<e>", "<e/>", "<e/>"]).cast("string").alias("text"))
    found = events.check(docs).select(F.col("doc_id"), "ok")
    expected = choose(F.col("doc_id"), ["valid", "not-wf", "not-wf", "error"])
    return counted(found.select((F.col("doc_id") % 4).alias("k"), conformance.verdict(expected, F.col("ok")).alias("success")), "k", "success")


def results(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return d.select("lang", "source", F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("success"))


_COUNTERS = "count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success IS NULL) AS skipped"
_RESULTS = "WITH r AS (SELECT lang, source, CASE WHEN toxic = 0 THEN quality = 1 END AS success FROM labels JOIN documents USING (doc_id))"


@query(f"{_RESULTS} SELECT lang, source, {_COUNTERS}, grouping(lang, source)::BIGINT AS grouping FROM r GROUP BY ROLLUP (lang, source)")
def agg_05_roll_up(spark, sf_dir):
    return conformance.roll_up(results(spark, sf_dir), "lang", "source")


@query(f"{_RESULTS}, c AS (SELECT lang, source, {_COUNTERS}, grouping(lang, source)::BIGINT AS grouping FROM r GROUP BY CUBE (lang, source)) SELECT *, round(100 * passed / nullif(passed + failed, 0), 2) AS pct FROM c")
def agg_06_breakdown(spark, sf_dir):
    return conformance.breakdown(results(spark, sf_dir), "lang", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

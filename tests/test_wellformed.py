"""Well-formedness: what documents are refused for, in both dialects, and what events they give."""

import itertools
import xml.parsers.expat

import pytest
from pyspark.sql import functions as F

from xmlframe.functions.arrays import running_sums
from xmlframe.operators import events, writer
from xmlframe.plans import xpath

# By production of the XML recommendation: document, code and detail in the full dialect. The codes are fixed values.
WRONG = {
    "STag, Attribute": [
        ("<doc id='1' lang='en' id='2'>t</doc>", "NonUniqueAttribute", "id"),
        ("<doc path='x<y'>t</doc>", "IllegalAttributeValue", None),
        ("<doc checked>t</doc>", "ExpectToken", "="),
        ("<doc width=12>t</doc>", "ExpectToken", "quote or single quote"),
        ("<doc title='open\">t</doc>", "IllegalAttributeValue", None),
        ("<doc a='1'b='2'/>", "ExpectToken", ">"),
        ("<7up/>", "IllegalNameStartChar", "7"),
    ],
    "element, ETag": [
        ("<list><item>one</item>", "OpenElementAtEof", None),
        ("<list><item>one</list></item>", "WrongETagName", "item"),
        ("<list></list></list>", "ExpectedDocumentEnd", None),
        ("</list>", "ETagAfterRootElement", None),
        ("<list></list more>", "ExpectToken", ">"),
    ],
    "document, prolog, Misc": [
        ("<one/><two/>", "ExpectedDocumentEnd", None),
        ("<one>1</one>\n<two>2</two>", "ExpectedDocumentEnd", None),
        ("text first<one/>", "UnexpectedCharacter", "t"),
        ("<one/>\n  text last", "UnexpectedCharacter", "t"),
        ("<one/><?xml version='1.0'?>", "InvalidPITarget", None),
        ("<?xml version='1.0'?>\n<?xml version='1.0'?><one/>", "InvalidPITarget", None),
        ("\n<?xml version='1.0'?><one/>", "InvalidPITarget", None),
        ("<!DOCTYPE one><?xml version='1.0'?><one/>", "InvalidPITarget", None),
        ("<?xml encoding='utf-8'?><one/>", "ExpectToken", "?>"),
    ],
    "doctypedecl, intSubset": [
        ("<!DOCTYPE one><!DOCTYPE one><one/>", "UnexpectedDocType", None),
        ("<one/><!DOCTYPE one>", "UnexpectedDocType", None),
        ("<one><!DOCTYPE one></one>", "UnexpectedDocType", None),
        ("<!DOCTYPE one [ words ]><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one [<!ELEMENT one (two|>]><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one [<!ELEMENT one (two,three|four)>]><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one [<!ELEMENT one ((two,three)>]><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one [<!ELEMENT one (two three)>]><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one [<!ELEMENT one (#PCDATA|two)>]><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one [<!ATTLIST one two TEXT #IMPLIED>]><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one [<!ENTITY two three>]><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one [<!-- -- -->]><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one PUBLIC '{}' 'x'><one/>", "ExpectToken", ">"),
        ("<!DOCTYPE one [<!ELEMENT one ANY>", "ExpectToken", ">"),
    ],
    "Char, CharRef, EntityRef": [
        *[(f"<p>{chr(c)}</p>", "InvalidCharacter", chr(c)) for c in (0x02, 0x0E, 0x1B, 0xFFFE, 0xFFFF)],
        *[(f"<p>&#{n};</p>", "InvalidCharacterReference", n) for n in ("2", "27", "55296", "A0")],
        *[(f"<p>&#x{n};</p>", "InvalidCharacterReference", n) for n in ("2", "DC00", "FFFE", "120000", "GG")],
        ("<p>&amp</p>", "ExpectToken", ";"),
        ("<p>fish & chips</p>", "IllegalNameStartChar", " "),
        ("<p>&copyright;</p>", "UnknownEntity", "copyright"),
        ("<p q='&copyright;'/>", "UnknownEntity", "copyright"),
    ],
    "Comment, PI, CDSect": [
        ("<p><!-- one -- two --></p>", "CommentColonColon", None),
        ("<p><!-- one ---></p>", "CommentColonColon", None),
        ("<p><!-- one </p>", "UnexpectedEof", None),
        ("<?xml version='1.0'?><?XML two?><p/>", "InvalidPITarget", None),
        ("<p><?two three</p>", "ExpectToken", "?>"),
        ("<p><?two,three?></p>", "ExpectToken", "?>"),
        ("<p><![CDATA[one]></p>", "UnexpectedEof", None),
    ],
}
RIGHT = [
    "", "<p/>", "<p\n\tq = 'r'\r\n s=\"t\" />", "<p q='&lt;&#33;&#x21;' r=\"it's\"/>", "<p/>\r\n\t ", "<?xml version=\"1.0\" encoding='latin1' standalone=\"no\" ?><p/>", "<?xml version='1.1'\n?><p/>",
    "<!-- one --><p/><!-- two --><?three four?>", "<p><![CDATA[<&]] >]]></p>", "<p>&#128512;&#x41;</p>", "<p>one\rtwo\r\n</p>", "<p><q>]]></q></p>", "<ñ:ö.1-·/>", "<?xml-stylesheet href='x'?><p/>", "<!DOCTYPE p><p/>",
    "<?xml version='1.0'?><!DOCTYPE p SYSTEM 'p.dtd' [<!-- isn't --><?one it's?> <!ELEMENT p (q, (r | s+)*, ((t | u)?, v))><!ELEMENT q (#PCDATA | r)* ><!ELEMENT r EMPTY>%more;<!ATTLIST p a CDATA #IMPLIED b (c | d) 'c' e NOTATION (f) #REQUIRED><!NOTATION f PUBLIC 'g'><!ENTITY h 'i &#60; &j;'><!ENTITY % k SYSTEM 'l'><!ENTITY m SYSTEM 'n' NDATA f>]><p/>",
]
FULL = [case for cases in WRONG.values() for case in cases] + [(x, None, None) for x in RIGHT]
SIMPLE = [
    ("", "Expected"), ("<!-- only -->", "Expected"), ("<p>]]></p>", "IllegalCDataSectionEnd"), ("<!DOCTYPE p><p/>", "DtdError"), ("<p/><q/>", "Expected"), ("<p></p></p>", "Expected"), ("<p/>\n<?xml version='1.0'?>", "InvalidPITarget"),
    ("&gt;<p/>", "Expected"), ("<p/><![CDATA[q]]>", "Expected"), ("<p q></p>", "ExpectToken"), ("<p/>", None), ("<?xml-stylesheet?><p/>", None), ("<p>&gt;<![CDATA[q]]></p>", None),
]
DOM = [
    ("<!-- only -->", "UnexpectedEof"), ("<p>", "UnexpectedEof"), ("one<p/>", "PrologCharacters"), ("<![CDATA[one]]><p/>", "PrologCharacters"), ("<p/><!-- one -->", "TrailingContent"), ("<p/><q/>", "TrailingContent"), ("<p/> \n", None), ("</p>", "EndEventMismatch"),
    ("<!-- one --><?xml version='1.0'?><p/>", None), ("<?xml version='1.0'?><?xml version='1.0'?><p/>", "UnexpectedDecl"), ("<!DOCTYPE p><?xml version='1.0'?><p/>", "UnexpectedDecl"), ("<p><?xml version='1.0'?></p>", "UnexpectedDecl"),
    ("<!DOCTYPE p><!DOCTYPE p><p/>", "UnexpectedDocType"), ("<p><!DOCTYPE p></p>", "UnexpectedDocType"), ("<?xml version='1.0'?><!DOCTYPE p><p>q</p>", None), ("<p></q>", "WrongETagName"),
]


def checked(spark, texts, dialect):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in events.check(docs, dialect=dialect).collect()}


def test_full_dialect(spark):
    found = checked(spark, [c[0] for c in FULL], "full")
    for k, (text, code, detail) in enumerate(FULL):
        error = found[k]["error"]
        assert (error["code"], error["detail"]) == (code, detail) if code else found[k]["ok"], (text, found[k])


@pytest.mark.parametrize(("dialect", "cases"), [("simple", SIMPLE), ("dom", DOM)])
def test_other_dialects(spark, dialect, cases):
    found = checked(spark, [c[0] for c in cases], dialect)
    for k, (text, code) in enumerate(cases):
        assert (found[k]["error"]["code"] if found[k]["error"] else None) == code, (text, found[k])


def test_offsets_and_nulls(spark):
    docs = spark.createDataFrame([(1, "<é>ü<b></é>"), (2, None), (None, "<a>"), (None, "<a/>"), (3, "<a/>"), (3, "<a>")], "doc_id long, text string")
    found = sorted(events.check(docs.withColumns({c: F.lit(7) for c in ("ok", "error", "_some", "token")})).collect(), key=str)
    assert len(found) == 6 and sorted(r["ok"] for r in found if r["doc_id"] == 3) == [False, True]
    assert [r["error"]["offset"] for r in found if r["doc_id"] == 1] == [9] and [r["ok"] for r in found if r["doc_id"] == 2] == [None]
    assert {r["error"]["code"] if r["error"] else None for r in found if r["doc_id"] is None} == {"OpenElementAtEof", None}
    with pytest.raises(ValueError):
        events.first_error(F.col("text"), "none")


def test_a_third_opinion(spark):
    """What this check accepts or refuses, expat does, but for the liberties of the full dialect."""
    texts = [c[0] for c in FULL if c[0] and "<!DOCTYPE" not in c[0] and "latin1" not in c[0] and "1.1" not in c[0]] + ["<a b='1'c='2'/>", "<a><b></a></b>", "<1/>", "<a/ >", "< a/>", "<a></a >", "<a b = '>'/>", "<a>&amp</a>", "<a>&;</a>", "<!-- -- --><a/>"]
    found = checked(spark, texts, "simple")
    for k, text in enumerate(texts):
        try:
            xml.parsers.expat.ParserCreate().Parse(text.encode("utf-8", "surrogatepass"), True)
            ok = True
        except xml.parsers.expat.ExpatError:
            ok = False
        assert found[k]["ok"] == ok, (text, found[k]["error"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<void />", [("STAG", "void", None), ("ETAG", "void", None)]),
        ("<p>one&#45;two</p>", [("STAG", "p", None), ("CHARACTERS", None, "one"), ("CHARACTERS", None, "-"), ("CHARACTERS", None, "two"), ("ETAG", "p", None)]),
        ("<p>1\r\n2\r</p>", [("STAG", "p", None), ("CHARACTERS", None, "1\n2\n"), ("ETAG", "p", None)]),
        ("<p><![CDATA[x]]]></p>", [("STAG", "p", None), ("CHARACTERS", None, "x]"), ("ETAG", "p", None)]),
        ("<?p  d ?><!-- c --><e/>", [("PI", "p", "d "), ("COMMENT", None, " c "), ("STAG", "e", None), ("ETAG", "e", None)]),
    ],
)
def test_events(spark, text, want):
    rows = events.with_end_tags(events.events(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("pos").collect()
    assert [(r["kind"], r["name"], r["text"]) for r in rows] == want


def test_attributes(spark):
    row = events.events(spark.createDataFrame([(1, "<e a='a&quot;b' n:b=\"&#x20;'\" c=''/>")], "doc_id long, text string")).first()
    assert [(a["name"], a["value"]) for a in row["attrs"]] == [("a", 'a"b'), ("n:b", " '"), ("c", "")]


def test_tokens_cover_documents(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    size = events.tokenize(pages, "page_id", "html").groupBy("doc_id").agg(F.sum(F.char_length("token")).alias("n"))
    assert size.join(pages, F.col("doc_id") == F.col("page_id")).filter(F.col("n") != F.char_length("html")).isEmpty()
    assert events.check(pages, "page_id", "html").count() == pages.count()


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        numbers = [(k * 37) % 11 - 3 for k in range(n)]
        got = spark.createDataFrame([(numbers,)], "n array<int>").select(running_sums(F.col("n"))).first()[0]
        assert got == list(itertools.accumulate(numbers)), n


def test_offsets_and_depth_of_many_tokens(spark):
    text = "<r>" + "".join(f"<é n='{k}'>x<b/>ü</é>" for k in range(300)) + "</r>"
    rows = events.events(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    raw, at = text.encode(), 0
    for r in rows:
        assert raw[r["start_offset"] : r["end_offset"]].decode() == r["token"] and r["start_offset"] == at
        at = r["end_offset"]
        assert r["depth"] == {"r": 1, "é": 2, "b": 3}.get(r["name"], 2)
    assert at == len(raw)


def test_events_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "<a/>")], "doc_id long, text string")
    for df in (events.events(docs), events.check(docs), docs.select(writer.rewritten(F.col("text")))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert events.check(none).count() == 0 and events.events(none).count() == 0 and events.tag_counts(none).count() == 0


def test_plain_documents_are_not_walked_and_are_good(spark):
    """Documents put together at random: those that need no walk are those in which a walk finds nothing."""
    import random

    random.seed(7)
    parts = ["<a>", "</a>", "<b x='1'>", "</b>", "<b/>", "<a x='1' y=\"2\"/>", "<a x='1' x='2'/>", "<a x='<b/>'/>", "<a x='>'>", "<a&amp;/>", "<a &lt;='1'/>", "</a >", "</a&gt;>", "t", "&amp;", "&x;", "&#65;", "]]>", ">", "\x01", "\x02", "$", " ", "\n", "'", '"', "<!--c-->", "<?p?>", "<", "&", "<a\x0bx='1'/>", "<1/>", "<a x='1'y='2'/>", "<é ü='ß'>", "</é>"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 7))) for _ in range(3000)]
    texts += [f"<a>{''.join(random.choice(parts) for _ in range(random.randint(1, 3)))}</a>" for _ in range(3000)] + ["<a>" * n + "</a>" * n for n in (1, 8, 9, 40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    walked = [events._first_error(F.col("t"), d).isNull().alias(d) for d in ("full", "simple", "dom")]
    rows = df.select("t", events._surely_good(F.col("t")).alias("plain"), *walked).collect()
    assert [r["t"] for r in rows if r["plain"] and not (r["full"] and r["simple"] and r["dom"])] == []
    plain = {r["t"] for r in rows if r["plain"]}
    assert len(plain) > 100 and "<a>" * 8 + "</a>" * 8 in plain and "<a>" * 40 + "</a>" * 40 not in plain


def test_expressions_read_a_document_once(spark):
    df = spark.createDataFrame([(1, "<a b='x'><c>1</c><c>2.5</c></a>"), (2, "<a"), (3, None)], "doc_id long, text string")
    asked = {"n": ("sum(//c)", "number"), "none": ("//d", "number"), "t": ("/a/@b", "string"), "e": ("//d", "string"), "y": ("//c = 1 or false()", "boolean"), "all": ("//c/text()", "strings"), "no": ("//d | //e", "boolean")}
    got = xpath.evaluate_all(df, asked)
    rows = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    assert rows[1][:1] + rows[1][2:] == (3.5, "x", "", True, ["1", "2.5"], False) and rows[1][1] != rows[1][1]
    assert rows[2] == rows[3] == (None,) * 7
    made = got._jdf.queryExecution().analyzed().toString()
    assert made.count("xpath_number(") + made.count("xpath_boolean(") + made.count("xpath_string(") == 1

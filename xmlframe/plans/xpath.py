"""XPath the Spark way. Whole expressions over single documents are Spark's own xpath functions, behind
a check of the documents; steps over many documents are joins of node tables, chained like a path.

    Steps(tree).children("region").descendants("nation").where(F.col("name") == "nation").rows()

A path is a set of (doc_id, node_id): each step makes its nodes distinct, as XPath does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import XML_URI
from ..operators.events import first_error
from ..operators.tree import string_values, tree


class Steps:
    """A node set of a node table (operators.tree). It begins above the documents' top nodes."""

    def __init__(self, table: DataFrame, context: DataFrame | None = None):
        self.table, self.context = table, context

    def _test(self, test: str | None) -> Column:
        """A name, `*` (elements), `text()`, `comment()`, `processing-instruction()` or `node()` (None)."""
        kinds = {"text()": "text", "comment()": "comment", "processing-instruction()": "pi", "*": "element"}
        if test is None or test == "node()":
            return F.lit(True)
        return F.col("node_type") == kinds[test] if test in kinds else (F.col("node_type") == "element") & (F.col("name") == test)

    def _step(self, test: str | None, on: Callable[[DataFrame, DataFrame], Column], *by: str, **of: Column) -> Steps:
        """The nodes that pass the test and have one in the context as `on` says. Where one number tells of many
        context nodes, such as the least position among those of a parent, `by` and `of` make one row of them."""
        ctx = self.context.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_node"), F.col("parent_id").alias("_parent"), F.col("end_id").alias("_end"))
        if of:
            ctx = ctx.groupBy("_doc", *by).agg(*[c.alias(k) for k, c in of.items()])
        got = self.table.filter(self._test(test)).alias("t").join(ctx, F.col("t.doc_id").eqNullSafe(F.col("_doc")) & on(ctx, self.table), "left_semi")
        return Steps(self.table, got)

    def children(self, test: str | None = "*") -> Steps:
        if self.context is None:
            return Steps(self.table, self.table.filter(F.col("parent_id").isNull() & self._test(test)))
        return self._step(test, lambda c, t: F.col("t.parent_id") == F.col("_node"))

    def descendants(self, test: str | None = "*") -> Steps:
        if self.context is None:
            return Steps(self.table, self.table.filter(self._test(test)))
        return self._step(test, lambda c, t: (F.col("t.node_id") > F.col("_node")) & (F.col("t.node_id") <= F.col("_end")))

    def descendants_or_self(self, test: str | None = "*") -> Steps:
        return self._step(test, lambda c, t: (F.col("t.node_id") >= F.col("_node")) & (F.col("t.node_id") <= F.col("_end")))

    def selves(self, test: str | None = "*") -> Steps:
        """The nodes themselves, as far as they pass the test."""
        return Steps(self.table, self.context.filter(self._test(test)))

    def namespaces(self) -> DataFrame:
        """(doc_id, node_id, prefix, uri): the namespaces in scope at each element, the predeclared `xml` among them.
        prefix is empty for the default; where that is taken back, it has no row."""
        bound_to = self.table.filter("node_type = 'element'").select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_from"), F.col("end_id").alias("_to"), F.explode("attrs").alias("a")).filter(F.col("a.name").rlike("\\Axmlns(?::|\\z)"))
        bound_to = bound_to.select("_doc", "_from", "_to", F.regexp_replace("a.name", "\\Axmlns:?", "").alias("prefix"), F.col("a.value").alias("uri"))
        elements = self.context.filter("node_type = 'element'").select("doc_id", "node_id")
        seen = elements.join(bound_to, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("node_id") >= F.col("_from")) & (F.col("node_id") <= F.col("_to")))
        inner = seen.groupBy("doc_id", "node_id", "prefix").agg(F.max_by("uri", "_from").alias("uri")).filter("uri <> '' and prefix <> 'xml'")
        return inner.unionByName(elements.select("doc_id", "node_id", F.lit("xml").alias("prefix"), F.lit(XML_URI).alias("uri")))

    def parents(self, test: str | None = "*") -> Steps:
        return self._step(test, lambda c, t: F.col("t.node_id") == F.col("_parent"))

    def ancestors(self, test: str | None = "*") -> Steps:
        return self._step(test, lambda c, t: (F.col("t.node_id") < F.col("_node")) & (F.col("t.end_id") >= F.col("_end")) & (F.col("t.node_type") == "element"))

    def ancestors_or_self(self, test: str | None = "*") -> Steps:
        return self.ancestors(test).union(Steps(self.table, self.context.filter(self._test(test))))

    def following(self, test: str | None = "*") -> Steps:
        return self._step(test, lambda c, t: F.col("t.node_id") > F.col("_end"), _end=F.min("_end"))

    def preceding(self, test: str | None = "*") -> Steps:
        return self._step(test, lambda c, t: F.col("t.end_id") < F.col("_node"), _node=F.max("_node"))

    def following_siblings(self, test: str | None = "*") -> Steps:
        return self._step(test, lambda c, t: (F.col("t.parent_id") == F.col("_parent")) & (F.col("t.node_id") > F.col("_node")), "_parent", _node=F.min("_node"))

    def preceding_siblings(self, test: str | None = "*") -> Steps:
        return self._step(test, lambda c, t: (F.col("t.parent_id") == F.col("_parent")) & (F.col("t.node_id") < F.col("_node")), "_parent", _node=F.max("_node"))

    def attributes(self, name: str | None = None) -> DataFrame:
        """(doc_id, node_id, name, value) of the attributes of the nodes."""
        got = self.context.select("doc_id", "node_id", F.explode("attrs").alias("a")).select("doc_id", "node_id", "a.name", "a.value").filter(~F.col("name").rlike("\\Axmlns(?::|\\z)"))
        return got if name is None else got.filter(F.col("name") == name)

    def where(self, condition: Column) -> Steps:
        """A predicate over the node's columns; `attribute("x")` reads an attribute."""
        return Steps(self.table, self.context.filter(condition))

    def position(self, n: int | None = None) -> Steps:
        """The n-th node (None: the last) among those with one parent."""
        w = Window.partitionBy("doc_id", "parent_id")
        at = F.row_number().over(w.orderBy(F.desc("node_id") if n is None else "node_id"))
        return Steps(self.table, self.context.withColumn("_at", at).filter(F.col("_at") == (1 if n is None else n)).drop("_at"))

    def union(self, other: Steps) -> Steps:
        return Steps(self.table, self.context.unionByName(other.context).dropDuplicates(["doc_id", "node_id"]))

    def rows(self) -> DataFrame:
        return self.context

    def values(self) -> DataFrame:
        """(doc_id, node_id, string_value)."""
        elements = string_values(self.table, self.context.filter("node_type = 'element'"))
        return elements.unionByName(self.context.filter("node_type <> 'element'").select("doc_id", "node_id", F.col("value").alias("string_value")))


def attribute(name: str) -> Column:
    return F.get(F.transform(F.filter("attrs", lambda a: a["name"] == name), lambda a: a["value"]), 0)


def select(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Steps:
    return Steps(tree(docs, doc_id, text))


KINDS = {"string": F.xpath_string, "number": F.xpath_number, "boolean": F.xpath_boolean, "strings": F.xpath}


def evaluate_all(docs: DataFrame, expressions: dict[str, tuple[str, str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a column for each expression) of XPath 1.0 expressions over each well-formed document; null
    for others. expressions: the column's name, to the expression and its kind - string, number, boolean or
    strings. A document is read and checked once. Those with a DOCTYPE are not evaluated, so no entity is
    expanded. Prefixes are not bound: use Steps for namespaces."""
    checked = docs.select(F.col(doc_id).alias("_id"), F.when(F.col(text).isNotNull() & first_error(F.col(text), "simple").isNull(), F.col(text)).alias("_good"))
    # What fails the check is replaced before the functions see it.
    read = lambda kind, x: F.when(F.col("_good").isNotNull(), KINDS[kind](F.coalesce("_good", F.lit("<e/>")), F.lit(x)))
    # Each function parses the document anew, so scalars come from one, put together; \x01 is in no document.
    scalars = [name for name, (_, kind) in expressions.items() if kind != "strings"]
    if len(scalars) < 2:
        return checked.select(F.col("_id").alias("doc_id"), *[read(kind, x).alias(name) for name, (x, kind) in expressions.items()])
    texts = [f"string({x})" if kind == "string" else f"string({kind}({x}))" for x, kind in (expressions[name] for name in scalars)]
    checked = checked.withColumn("_all", F.split(read("string", "concat(" + ", '\x01', ".join(texts) + ")"), "\x01", -1))

    def value(name: str) -> Column:
        x, kind = expressions[name]
        if kind == "strings":
            return read(kind, x)
        return F.get("_all", scalars.index(name)).cast({"string": "string", "number": "double", "boolean": "boolean"}[kind])

    return checked.select(F.col("_id").alias("doc_id"), *[value(name).alias(name) for name in expressions])


def evaluate(docs: DataFrame, expression: str, kind: str = "string", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, result) of one expression; see `evaluate_all`."""
    return evaluate_all(docs, {"result": (expression, kind)}, doc_id, text)


# Coercions and the function library, as columns. Arity and types are checked when the plan is made.

def to_boolean(value: Column, kind: str) -> Column:
    return (value != 0) & ~F.isnan(value) if kind == "number" else F.char_length(value) > 0


def to_number(text: Column) -> Column:
    bare = F.trim(text)
    return F.coalesce(F.when(bare.rlike(r"\A-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), bare.try_cast("double")), F.lit(float("nan")))


FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "concat": (2, None, lambda *a: F.concat(*a)),
    "boolean": (1, 1, lambda a: F.char_length(a) > 0),
    "not": (1, 1, lambda a: ~a),
    "true": (0, 0, lambda: F.lit(True)),
    "false": (0, 0, lambda: F.lit(False)),
}


def register(name: str, low: int, high: int | None, make: Callable[..., Column]) -> None:
    """Add a function of low to high arguments (None: any number)."""
    FUNCTIONS[name] = (low, high, make)


def apply(name: str, *arguments: Column) -> Column:
    if name not in FUNCTIONS:
        raise ValueError(f"call to undefined function {name}")
    low, high, make = FUNCTIONS[name]
    if len(arguments) < low or high is not None and len(arguments) > high:
        raise ValueError(f"{name} takes {low}{'' if high == low else f' to {high}' if high is not None else ' or more'} arguments, not {len(arguments)}")
    return make(*arguments)

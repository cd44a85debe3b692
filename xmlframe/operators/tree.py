"""Node tables: parents, children, text and tail, and string values, within rows and by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, running_sums
from ..functions.names import split_name
from .events import attributes, is_empty, kind_of, name_of, text_of, tokens
from .namespaces import element_ranges


#: What a tree has no node for: declarations, DOCTYPEs, and characters that cannot be read.
_NODES = ("STAG", "ETAG", "CHARACTERS", "COMMENT", "PI")


def _runs(tokens: Column) -> Column:
    """array<struct<pos, token, rest>> of a document's tokens, a run of character data being one: rest are all
    its tokens, null where it is one token, which it always is in texts without references and CDATA."""
    is_text = lambda x: (~x.startswith("<") & (x != "&")) | x.startswith("<![CDATA[")
    item = lambda pos, token, rest: F.struct(pos.alias("pos"), token.alias("token"), rest.cast("array<string>").alias("rest"))

    def joined(t: Column) -> Column:
        first = lambda i: (i == 0) | ~is_text(F.get(t, i)) | ~is_text(F.get(t, i - 1))
        starts = F.when(F.size(t) > 0, F.filter(F.sequence(F.lit(0), F.size(t) - 1), first))
        until = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(t))
        return bound(starts, lambda s: F.transform(s, lambda i, k: item(i, F.get(t, i), F.when(until(s, k) - i > 1, F.slice(t, i + 1, until(s, k) - i)))))

    several = lambda t: F.exists(t, lambda x: x.startswith("&") | x.startswith("<![CDATA["))
    return bound(tokens, lambda t: F.when(several(t), joined(t)).otherwise(F.transform(t, lambda x, i: item(i, x, F.lit(None)))))


def _placed(text: Column) -> Column:
    """`_runs` of a text as array<struct<r, depth>>, depth being the number of elements open behind a token."""

    def step(r: Column) -> Column:
        x = r["token"]
        opens = x.startswith("<") & ~x.startswith("<!") & ~x.startswith("<?") & ~x.endswith("/>") & (F.char_length(x) > 1)
        return F.when(x.startswith("</"), -1).when(opens, 1).otherwise(0)

    return bound(_runs(tokens(text)), lambda rows: F.arrays_zip(rows.alias("r"), running_sums(F.transform(rows, step)).alias("depth")))


def tree(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node_id, parent_id, end_id, node_type, depth, name, prefix, local, attrs, value) of documents, which
    should be well-formed: elements, texts (runs of character data are one text), comments and PIs. node_id is the
    position of the first event (see `events`), end_id that of an element's end tag, parent_id null at the top.

    (explode_outer, since Spark would look before a plain explode whether there is something, and so read it twice.)
    One pass and one window: of what stands at one level of a document, in order, an element's end tag comes next
    to its start tag, and its content's parent is the last that opened the level."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode_outer(_placed(F.col(text))).alias("x")).filter("x is not null").select("doc_id", "x.r.pos", "x.r.token", "x.r.rest", F.col("x.depth").cast("int").alias("after"))
    kind, token, tag = F.col("kind"), F.col("token"), F.col("kind").isin("STAG", "ETAG")
    rows = rows.withColumn("kind", kind_of(token)).filter(kind.isin(*_NODES)).withColumn("empty", (kind == "STAG") & is_empty(token))
    # Tags stand at the level around their element, all else at the level it is in.
    rows = rows.withColumn("depth", F.when((kind == "STAG") & ~F.col("empty"), F.col("after") - 1).otherwise(F.col("after"))).filter((kind != "CHARACTERS") | (F.col("depth") > 0))
    at = lambda level, opens: F.struct(level.alias("level"), F.lit(opens).alias("opens"))
    opener = (kind == "STAG") & ~F.col("empty")
    rows = rows.withColumn("_r", F.explode(F.when(opener, F.array(at(F.col("depth"), False), at(F.col("after"), True))).otherwise(F.array(at(F.col("depth"), False)))))
    # An opening row is there for its position alone.
    rows = rows.select("doc_id", "pos", "kind", "empty", "depth", F.col("_r.level").alias("_level"), F.col("_r.opens").alias("_opens"), *[F.when(~F.col("_r.opens") & (kind != "ETAG"), F.col(c)).alias(c) for c in ("token", "rest")])
    level = Window.partitionBy("doc_id", "_level").orderBy("pos")
    up = F.last(F.when(F.col("_opens"), F.col("pos")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"parent_id": up, "_next": F.lead("pos").over(level)}).filter(~F.col("_opens") & (kind != "ETAG"))
    name = name_of(kind, token)
    rows = rows.withColumn("name", F.when(kind.isin("STAG", "PI"), name))
    split = F.when(kind == "STAG", split_name(F.col("name")))
    one = lambda x: text_of(F.lit("CHARACTERS"), x)
    value = F.when(F.col("rest").isNotNull(), F.array_join(F.transform("rest", one), "")).otherwise(text_of(kind, token))
    return rows.select(
        "doc_id", F.col("pos").alias("node_id"), "parent_id", F.when((kind == "STAG") & ~F.col("empty"), F.coalesce("_next", "pos")).otherwise(F.col("pos")).alias("end_id"),
        F.when(kind == "STAG", "element").when(kind == "CHARACTERS", "text").otherwise(F.lower("kind")).alias("node_type"), "depth",
        "name", split["prefix"].alias("prefix"), split["local"].alias("local"), F.when(kind == "STAG", attributes(token)).alias("attrs"), value.alias("value"),
    )


def nodes(rows: DataFrame) -> DataFrame:
    """The node table of `tree`, of events at hand, such as filtered or changed ones: (doc_id, node_id, parent_id, end_id, node_type, depth, name, prefix, local, attrs, value) of events:
    elements, texts (runs of character data are one text), comments and PIs. node_id is the position of
    the first event, end_id that of an element's end tag, parent_id null at the top."""
    kept = element_ranges(rows).filter("kind in ('STAG', 'ETAG', 'CHARACTERS', 'COMMENT', 'PI')")
    order = Window.partitionBy("doc_id").orderBy("pos")
    is_text = F.col("kind") == "CHARACTERS"
    kept = kept.withColumn("_run", F.sum((~(is_text & (F.lag("kind").over(order).eqNullSafe("CHARACTERS")))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A run of texts is one row: pieces are put together in order.
    texts = kept.filter(is_text).groupBy("doc_id", "_run").agg(F.min("pos").alias("pos"), F.min("depth").alias("depth"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("value"))
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    shape = "array<struct<name:string,value:string>>"
    texts = texts.select("doc_id", F.col("pos").alias("node_id"), F.col("pos").alias("end_id"), F.lit("text").alias("node_type"), "depth", null("name", "string"), null("prefix", "string"), null("local", "string"), null("attrs", shape), "value")
    others = kept.filter("kind in ('STAG', 'COMMENT', 'PI')").select(
        "doc_id", F.col("pos").alias("node_id"), F.coalesce("end_pos", "pos").alias("end_id"),
        F.when(F.col("kind") == "STAG", "element").otherwise(F.lower("kind")).alias("node_type"),
        # An element stands in its parent's depth; depth of what stands at the top is 0.
        F.when(F.col("kind") == "STAG", F.col("depth") - 1).otherwise(F.col("depth")).alias("depth"),
        "name", "prefix", "local", "attrs", F.col("text").alias("value"),
    )
    flat = others.unionByName(texts).filter("node_type <> 'text' or depth > 0")
    # A node opens the level below it (if it is an element) and looks up the level it stands in.
    both = flat.withColumn("_r", F.explode(F.when(F.col("node_type") == "element", F.array(F.struct((F.col("depth") + 1).alias("at"), F.lit(True).alias("opens")), F.struct(F.col("depth").alias("at"), F.lit(False).alias("opens")))).otherwise(F.array(F.struct(F.col("depth").alias("at"), F.lit(False).alias("opens"))))))
    level = Window.partitionBy("doc_id", "_r.at").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    up = F.last(F.when(F.col("_r.opens"), F.col("node_id")), ignorenulls=True).over(level)
    return both.withColumn("parent_id", up).filter(~F.col("_r.opens")).select("doc_id", "node_id", "parent_id", "end_id", "node_type", "depth", "name", "prefix", "local", "attrs", "value")


def text_and_tail(table: DataFrame) -> DataFrame:
    """Elements with `text`, the text before the first child element, and `tail`, the text behind the
    element; several texts that only comments or PIs part are put together. ord counts siblings."""
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    kept = table.filter("node_type in ('element', 'text')")
    owner = F.last(F.when(F.col("node_type") == "element", F.col("node_id")), ignorenulls=True).over(siblings.rowsBetween(Window.unboundedPreceding, 0))
    texts = kept.withColumn("_owner", owner).filter("node_type = 'text'").withColumn("_as", F.when(F.col("_owner").isNull(), "text").otherwise("tail")).withColumn("_id", F.coalesce("_owner", "parent_id"))
    joined = texts.groupBy("doc_id", "_id", "_as").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "value"))), lambda x: x["value"]), "").alias("v"))
    pairs = joined.groupBy("doc_id", "_id").agg(F.max(F.when(F.col("_as") == "text", F.col("v"))).alias("text"), F.max(F.when(F.col("_as") == "tail", F.col("v"))).alias("tail"))
    elements = table.filter("node_type = 'element'").withColumn("ord", F.row_number().over(siblings) - 1)
    p = pairs.select(F.col("doc_id").alias("_doc"), "_id", "text", "tail")
    return elements.join(p, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("node_id") == F.col("_id")), "left").drop("_doc", "_id")


def string_values(table: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, string_value) of elements: the texts within, in order. `of` narrows the elements."""
    e = (of if of is not None else table.filter("node_type = 'element'")).select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_node"), F.col("end_id").alias("_end"))
    t = table.filter("node_type = 'text'").select("doc_id", "node_id", "value")
    got = e.join(t, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("node_id") > F.col("_node")) & (F.col("node_id") <= F.col("_end")), "left")
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "value"))), lambda x: x["value"]), "")
    return got.groupBy(F.col("_doc").alias("doc_id"), F.col("_node").alias("node_id")).agg(value.alias("string_value"))

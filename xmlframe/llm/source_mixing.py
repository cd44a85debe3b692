"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

1. Each source gets a target: its weight's share of the budget, at most `most` times its size, the
   excess going to the others by weight.
2. A target is a number of whole passes over the source and a rest. The rests are paid in blocks of
   `block` words: the seats of one apportionment, given to the sources by highest quotients.
3. A source is dealt into shards by a hash of the id, so many that a shard stays small; its seats go
   down a tree of shards, at each node to at most FAN children by highest quotients.
4. In a shard the documents lie end to end in a seeded order. The shard's quota are the blocks with the smallest
   seeded hashes; a document's share is what the picked blocks cover of it, besides the passes.

Only totals by source reach the driver: a row for each source. A shard holds about SHARD_WORDS words or SHARD_ROWS
rows of one source, so a source with a third of all rows is many groups; the hash that deals rows into shards is
of id and text, so rows without an id, or with one id, spread too, unless they are wholly equal.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, materialize, word_array

#: Words in a shard and rows in a shard, on average; children of a node in the tree of shards.
SHARD_WORDS, SHARD_ROWS, FAN = 65_536, 256, 256
#: The table of sources is broadcast up to this length.
FEW_SOURCES = 10_000


def apportion(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Sainte-Laguë: seats go one by one to the highest quotient votes / (2 * seats so far + 1), lower
    index first among equals, never beyond a cap. Starts from the seats that a divisor just above the
    right one gives to all, so that about one step for each party is left."""
    total, n = math.fsum(votes), len(votes)
    got = [0] * n
    if seats > n / 2 and total > 0:
        divisor = total / (seats - n / 2)
        got = [min(c, math.floor(v / divisor + 0.5)) for v, c in zip(votes, caps, strict=True)]
    left = seats - sum(got)
    heap = [(-v / (2 * g + 1), k) for k, (v, g, c) in enumerate(zip(votes, got, caps, strict=True)) if g < c and v > 0]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < caps[k]:
            heapq.heappush(heap, (-votes[k] / (2 * got[k] + 1), k))
    return got


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """The target of each source: weights share `share` times all sizes; no target above `most` times its
    source's size, what is above being shared again by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = math.fsum(weights[k] for k in open_)
        over = [k for k in sorted(open_) if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(most * sizes[k])
        open_ -= set(over)
        left -= math.fsum(most * sizes[k] for k in over)
    return out


def _seats_of_children(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node", ignore_index=True)
    group["seats"] = apportion(group["words"].tolist(), int(group["parent_seats"].iloc[0]), group["blocks"].tolist())
    return group[["k", "node", "seats"]]


def shard_quotas(shards: DataFrame, top: DataFrame, depth: int) -> DataFrame:
    """(k, node, seats) for each shard. shards: k, node, words, blocks. top: k, parent_seats. Each level
    shares a node's seats among its children; no group has more than FAN rows."""
    level = top.withColumn("parent", F.lit(0).cast("long"))
    for up in range(depth - 1, -1, -1):
        unit = FAN**up
        nodes = shards.groupBy("k", F.floor(F.col("node") / unit).alias("node")).agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"))
        given = nodes.withColumn("parent", F.floor(F.col("node") / FAN)).join(level, ["k", "parent"])
        level = given.groupBy("k", "parent").applyInPandas(_seats_of_children, "k int, node long, seats long").withColumnRenamed("node", "parent").withColumnRenamed("seats", "parent_seats")
    return level.select("k", F.col("parent").alias("node"), F.col("parent_seats").alias("seats"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 16, seed: int = 42) -> DataFrame:
    """(row_id, doc_id, source, size, source_size, target, passes, picks, taken) of each row of docs.

    Sources stand in code point order, null last, and weigh `weights` again and again. size is the number
    of words, 0 for null text. passes is the number of times that the mix takes the whole text; picks are
    the word ranges [from, to) that it takes once more; taken is the number of words of both. Rows with
    equal ids are rows of their own; reruns agree, also over other partitions, but for which of wholly equal rows
    is which. Documents without words are taken with 0 words; an empty table gives an empty result. Columns of
    docs other than doc_id, source and text are not looked at."""
    sized = docs.select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row_id"))
    return mix_sized(materialize(sized, "mix-sizes"), weights, share, most, block, seed)


def mix_texts(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 16, seed: int = 42) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass over a document, and one more with
    the picked words of its text, white space behind them included, if there are some. Documents of which
    nothing is taken go; those without words, of which there is nothing to take, stay once. Columns of any names
    are kept, and n_chars is counted anew."""
    own = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    whole = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()], F.size(word_array(F.col("text"))).cast("long").alias("size"), F.monotonically_increasing_id().alias("row_id"))
    whole = materialize(whole, "mix-rows")
    text = F.col(own["text"])
    sized = whole.select(F.col(own["doc_id"]).alias("doc_id"), F.col(own["source"]).alias("source"), "size", F.xxhash64(text).alias("h"), "row_id")
    rows = whole.join(mix_sized(sized, weights, share, most, block, seed).select("row_id", "passes", "picks"), "row_id")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = lambda w: F.flatten(F.transform("picks", lambda p: F.slice(w, p["from"].cast("int") + 1, (p["to"] - p["from"]).cast("int"))))
    part = F.array_join(bound(words, cut), "")
    texts = F.concat(
        F.array_repeat(text, F.when(F.col("size") > 0, F.col("passes")).otherwise(1)),
        F.when(F.size("picks") > 0, F.array(part)).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.withColumn("taken_text", F.explode(texts))
    made = {"text": F.col("taken_text")} | ({"n_chars": F.length("taken_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[made.get(c, F.col(name)).alias(c) for c, name in own.items()])


def mix_sized(sized: DataFrame, weights: tuple[float, ...], share: float, most: int, block: int, seed: int) -> DataFrame:
    """`mix` of a written table (row_id, doc_id, source, size, h), h being a hash of the text."""
    spark = sized.sparkSession
    totals = [tuple(r) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in totals]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, most)
    passes = [int(g // s) if s else 0 for g, s in zip(goal, sizes, strict=True)]
    rest = [g - p * s for g, p, s in zip(goal, passes, sizes, strict=True)]
    seats = apportion(rest, round(math.fsum(rest) / block), [-(-s // block) for s in sizes])
    shards = [max(1, -(-s // SHARD_WORDS), -(-r[2] // SHARD_ROWS)) for s, r in zip(sizes, totals, strict=True)]
    depth = max([1, *(math.ceil(math.log(n, FAN) - 1e-9) for n in shards)])
    sources = spark.createDataFrame(
        [(k, r[0], s, g, p, n, t) for k, (r, s, g, p, n, t) in enumerate(zip(totals, sizes, goal, passes, shards, seats, strict=True))],
        "k int, source string, source_size long, target double, passes int, n_shards long, parent_seats long",
    )
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1)), "h")
    few = F.broadcast(sources) if len(totals) <= FEW_SOURCES else sources
    rows = sized.join(few, sized["source"].eqNullSafe(few["source"])).drop(few["source"])
    rows = rows.withColumn("order", order).withColumn("node", F.pmod(F.xxhash64("order"), F.col("n_shards")))
    leaves = rows.groupBy("k", "node").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block))
    quota = shard_quotas(leaves.filter("words > 0"), sources.select("k", "parent_seats"), depth)
    place = Window.partitionBy("k", "node").orderBy("order", "doc_id", "h", "size", "row_id")
    whole = rows.withColumn("until", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("until") - F.col("size"))
    # The hash of the last block that a shard's quota takes; null where it takes none.
    hashes = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: _place(j, seed)))
    leaf = leaves.join(quota, ["k", "node"], "left").select("k", "node", F.when(F.col("seats") > 0, F.get(hashes, F.col("seats").cast("int") - 1)).alias("last"))
    whole = whole.join(leaf, ["k", "node"])
    picks = _picks(F.col("from"), F.col("until"), F.col("last"), block, seed)
    whole = whole.withColumn("picks", F.when(F.col("size") > 0, picks).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>")))
    extra = F.aggregate("picks", F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"])
    return whole.select("row_id", "doc_id", "source", "size", "source_size", "target", "passes", "picks", (F.col("passes") * F.col("size") + extra).alias("taken"))


def _picks(start: Column, until: Column, last: Column, block: int, seed: int) -> Column:
    """Word ranges of a document at [start, until) of its shard that the picked blocks cover: those whose
    hash is not above that of the last one picked."""
    first, end = F.floor(start / block), F.floor((until - 1) / block)
    picked = F.filter(F.sequence(first, end), lambda j: F.coalesce(_place(j, seed) <= last, F.lit(False)))
    return F.transform(picked, lambda j: F.struct((F.greatest(j * block, start) - start).alias("from"), (F.least((j + 1) * block, until) - start).alias("to")))


def _place(j: Column, seed: int) -> Column:
    """What block j of a shard is ordered by."""
    return F.xxhash64(F.lit(seed), F.col("k"), F.col("node"), j)


def mixed_taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs; see `mix` for nulls, ties and empty tables."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")

"""Connected components of an edge table by alternating star operations: groupings and
joins of the edges, which every round writes to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) for each id in edges (a, b: long), component being the smallest id that links
    reach. Each round points larger neighbours, then smaller ones, at a node's smallest neighbour; when a
    round changes nothing, every edge points at its component. Self-loops and repeats do no harm. Rounds grow with
    the logarithm of the longest path, so `rounds` is far from needed; not to be done by then is an error."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, smaller=False)
        small = _stars(large, smaller=True)
        old, now = now, materialize(small, "edges")
        discard(old)
    else:
        raise RuntimeError(f"components are not found in {rounds} rounds")
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    out._written_to = now._written_to  # so that `discard` deletes the edges that it is read from
    return out


def _stars(seen: DataFrame, smaller: bool) -> DataFrame:
    """seen: (a, b), b a neighbour of a. Each node's neighbours - the larger ones, or those not larger -
    are linked to the node's smallest neighbour or itself."""
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = seen.join(least, "a")
    if smaller:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()

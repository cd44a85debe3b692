"""Array columns: values named once, and running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that running sums are taken of at once.
BLOCK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for a row: a plain column that lambdas refer to may be
    computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def running_sums(numbers: Column) -> Column:
    """The sum of an array's elements up to each of them, as longs. Sums are taken within blocks, then the
    blocks' totals are added, so that n elements take about n * BLOCK steps, not n * n."""
    none = F.array().cast("array<bigint>")
    last = lambda sums: F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0).cast("long"))
    add = lambda sums, x: F.array_append(sums, last(sums) + x)
    starts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda at: F.aggregate(F.slice(numbers, at, F.lit(BLOCK)), none, add))

    def joined(sums: Column) -> Column:
        totals = F.aggregate(sums, none, lambda acc, block: F.array_append(acc, last(acc) + last(block)))
        return bound(totals, lambda t: F.flatten(F.transform(sums, lambda block, b: F.transform(block, lambda x: x + F.coalesce(F.get(t, b - 1), F.lit(0).cast("long"))))))

    return bound(blocks, joined)

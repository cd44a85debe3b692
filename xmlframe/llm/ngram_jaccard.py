"""N-gram Jaccard join: which documents share at least four fifths of their word 5-grams.

The heart is a tree over count vectors. A document's shingles are hashed into groups, and the counts of
the groups are a point; the sum of the coordinate minima of two points bounds the overlap of
the two sets from above. The tree's inner boxes keep the largest coordinates and size ranges below them,
so that pairs of boxes, then pairs of points, fall away before any sets are compared.

In so many dimensions boxes alone cannot keep unrelated texts apart, so a routing step deals documents
into buckets first, and each bucket gets its tree. Shingles have one global order, common ones last; sets
that are similar enough share a shingle among the first of each (the prefix). A shingle's bucket is named
by the smallest set that has it in its prefix, so buckets are few, and every pair that may link is in one.

Equal sets are one node from the start. Buckets above BLOCK sets are cut into blocks and each pair of
blocks is a group; groups return a spanning set of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, slices
from .components import components

WIDTH, PERCENT = 5, 80
#: Groups of shingles and shingles in a group, see counts_of; sets in a block of a bucket; sets in a leaf.
GROUPS, SHARE, BLOCK, LEAF = 128, 11, 128, 16
#: Common shingles that the order knows, at most; how often a task must see one; how often all must.
COMMON, LOCAL, LEAST = 200_000, 3, 32
WORDS_KEPT, SHINGLES_HELD = 500_000, 2_000_000
#: Ids up to which a list is broadcast instead of the texts' being shuffled.
FEW = 400_000


class _Words(dict):
    """The hash of a word; the latest words are kept."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


_words: dict[int, _Words] = {}


#: Odd multipliers of a shingle's words, by place.
MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, seed: int = 0) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's word 5-grams; of the whole sequence if it is
    shorter; none without words."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    known = _words.setdefault(seed, _Words(seed))
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    s = h[:n] * MULTIPLIERS[0] + np.uint64(width)
    for k in range(1, width):
        s += h[k : k + n] * MULTIPLIERS[k]
    return np.unique(_mix(s))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two longs."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def prefix_size(n: int) -> int:
    """So many first shingles of a set of n that a set linked with it has one of them among its own."""
    return n - -(-PERCENT * n // 100) + 1


def counts_of(s: np.ndarray) -> bytes:
    """The count vector of a set. Large sets have more groups, or their bounds would tell little: GROUPS
    times four until a group holds about SHARE shingles at most. Groups are leading bits of the hash, so
    that fewer of them are sums of neighbours."""
    groups = GROUPS
    while len(s) > SHARE * groups:
        groups *= 4
    return np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype(np.uint16).tobytes()


def _scan(docs: DataFrame, seed: int) -> DataFrame:
    """Rows (id, n, k1, k2, points) of documents, and rows (s, c): shingles that a task saw c >= LOCAL
    times."""
    names = ["id", "n", "k1", "k2", "points", "s", "c"]

    def common(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= LOCAL
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(none), pa.binary()), pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text"):
            sets = [shingles(t, seed) for t in part.column(1).to_pylist()]
            keys = [digest(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([counts_of(s) for s in sets], pa.binary()), none, none], names)
            held += sets
            size += sum(map(len, sets))
            if size >= SHINGLES_HELD:
                yield common(held)
                held, size = [], 0
        if held:
            yield common(held)

    return docs.mapInArrow(work, "id long, n long, k1 long, k2 long, points binary, s long, c long")


def _prefixes(docs: DataFrame, seed: int, common) -> DataFrame:
    """(s, k1, often): the prefix shingles of each set, and whether they are common ones. A task names a
    set once for its copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = common.value
        seen: set[int] = set()
        for part in slices(batches, "text"):
            out, owner, often_out = [], [], []
            for t in part.column(1).to_pylist():
                s = shingles(t, seed)
                key = digest(s)[0]
                if not len(s) or key in seen:
                    continue
                if len(seen) < WORDS_KEPT:
                    seen.add(key)
                room = prefix_size(len(s))
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    often = values[at] == s
                    rare = s[~often][:room]
                    last = s[often][np.argsort(ranks[at[often]], kind="stable")][: room - len(rare)]
                else:
                    rare, last = s[:room], s[:0]
                out += [rare, last]
                owner.append(np.full(len(rare) + len(last), key, np.int64))
                often_out += [np.zeros(len(rare), bool), np.ones(len(last), bool)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(often_out))], ["s", "k1", "often"])

    return docs.mapInArrow(work, "s long, k1 long, often boolean")


def _elements(docs: DataFrame, seed: int) -> DataFrame:
    """(k1, elements) of each row: the sorted hashes as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingles(t, seed) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["k1", "elements"])

    return docs.mapInArrow(work, "k1 long, elements binary")


class CountTree:
    """A tree over count vectors, packed from the order of size and leading counts: leaves of LEAF points,
    boxes of LEAF boxes. A box keeps the largest coordinates and the size range of what is below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        tops, low, high = [self.points], [self.sizes], [self.sizes]
        while len(tops[-1]) > 1:
            at = np.arange(0, len(tops[-1]), LEAF)
            tops.append(np.maximum.reduceat(tops[-1], at))
            low.append(np.minimum.reduceat(low[-1], at))
            high.append(np.maximum.reduceat(high[-1], at))
        self.tops, self.low, self.high = tops, low, high

    def candidates(self, other: CountTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (rows here, rows there) whose bound allows a link, from the roots down, leaf by leaf."""
        pairs = [(len(self.tops) - 1, 0, len(other.tops) - 1, 0)]
        while pairs:
            la, a, lb, b = pairs.pop()
            # The children of both boxes, bounded in one go; a point is its own child.
            xs = np.arange(a * LEAF, min((a + 1) * LEAF, len(self.tops[la - 1]))) if la else np.array([a])
            ys = np.arange(b * LEAF, min((b + 1) * LEAF, len(other.tops[lb - 1]))) if lb else np.array([b])
            da, db = max(0, la - 1), max(0, lb - 1)
            bound = np.minimum(self.tops[da][xs][:, None, :], other.tops[db][ys][None, :, :]).sum(axis=2)
            # overlap >= p / (100 + p) * (size + size), and no set below p percent of the other's size
            fits = (100 + PERCENT) * bound >= PERCENT * (self.low[da][xs][:, None] + other.low[db][ys][None, :])
            fits &= 100 * self.high[da][xs][:, None] >= PERCENT * other.low[db][ys][None, :]
            fits &= 100 * other.high[db][ys][None, :] >= PERCENT * self.low[da][xs][:, None]
            i, j = np.nonzero(fits)
            if da == 0 and db == 0:
                if len(i):
                    yield self.order[xs[i]], other.order[ys[j]]
            else:
                pairs.extend((da, int(x), db, int(y)) for x, y in zip(xs[i], ys[j], strict=True))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _candidates(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers (left, right) of a group that trees over count vectors let through. Vectors of
    different length are joined after folding the longer; only those next in length can be near."""
    sides = [np.flatnonzero(group.column(side).to_numpy()) for side in ("left", "right")]
    points, n = group.column("points").to_pylist(), group.column("n").to_numpy()
    length = np.array([len(p) // 2 for p in points])

    def tree(rows: np.ndarray, groups: int) -> CountTree:
        folded = [np.frombuffer(points[r], np.uint16).astype(np.int32).reshape(groups, -1).sum(axis=1) for r in rows]
        return CountTree(np.stack(folded), n[rows])

    for one in np.unique(length[sides[0]]):
        for other in np.unique(length[sides[1]]):
            rows = [sides[0][length[sides[0]] == one], sides[1][length[sides[1]] == other]]
            if one != other:  # only sizes that can be near at all
                lows, highs = [n[r].min() for r in rows], [n[r].max() for r in rows]
                rows = [r[(100 * n[r] >= PERCENT * lows[1 - k]) & (PERCENT * n[r] <= 100 * highs[1 - k])] for k, r in enumerate(rows)]
                if not len(rows[0]) or not len(rows[1]):
                    continue
            groups = int(min(one, other))
            first = tree(rows[0], groups)
            second = first if one == other and np.array_equal(rows[0], rows[1]) else tree(rows[1], groups)
            for i, j in first.candidates(second):
                yield rows[0][i], rows[1][j]


def _hopeful(group: pa.Table) -> pa.Table:
    """The sets of a group that the trees pair with another set."""
    keys, found = group.column("k1").to_numpy(), np.zeros(group.num_rows, bool)
    for i, j in _candidates(group):
        other = keys[i] != keys[j]
        found[i[other]] = found[j[other]] = True
    return group.filter(pa.array(found))


def _join_bucket(group: pa.Table) -> pa.Table:
    """A spanning set of the links between the two sides of a group (within it, if they are one)."""
    keys, sets = group.column("k1").to_pylist(), [np.frombuffer(e, np.uint64) for e in group.column("elements").to_pylist()]
    top, out = {k: k for k in keys}, []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for rows, others in _candidates(group):
        for i, j in zip(rows.tolist(), others.tolist(), strict=True):
            a, b = root(keys[i]), root(keys[j])
            if a != b and linked(sets[i], sets[j]):
                top[max(a, b)] = min(a, b)
                out.append((keys[i], keys[j]))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component) of each row: the size of its set of word 5-grams and the smallest id
    that links reach, where sets link when 100 * intersection >= 80 * union. Rows without words, null text
    included, have no links; nor has a null id, whose component is null. Rows with one id are one node.
    Whole texts count; other columns of docs are not looked at. An empty table gives an empty result."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    spark = docs.sparkSession
    for seed in range(8):
        scan = materialize(_scan(rows, seed), "jaccard-scan")
        info = scan.filter("n is not null").select("id", "n", "k1", "k2", "points")
        sets = info.filter("n > 0 and id is not null").groupBy("k1").agg(F.min("id").alias("rep"), F.min("k2").alias("low"), F.max("k2").alias("high"), F.min("n").alias("n"), F.min("points").alias("points"))
        sets = materialize(sets, "jaccard-sets")
        if sets.filter("low <> high").isEmpty():  # else two sets share 64 bits: hash anew
            break
    often = scan.filter("s is not null").groupBy("s").agg(F.sum("c").alias("c")).filter(F.col("c") >= LEAST).orderBy(F.desc("c"), "s").limit(COMMON)
    known = [(r["s"], r["c"]) for r in often.toLocalIterator()]
    values = np.array([s for s, _ in known], np.int64).view(np.uint64)
    ranks = np.empty(len(known), np.int64)
    ranks[np.lexsort((values, np.array([c for _, c in known], np.int64)))] = np.arange(len(known))
    place = np.argsort(values)
    common = spark.sparkContext.broadcast((values[place], ranks[place]))  # COMMON entries at most

    keyed = rows.filter("id is not null")
    prefixes = materialize(_prefixes(keyed, seed, common), "jaccard-prefixes")
    w = Window.partitionBy("s")
    rare = prefixes.filter("not often").select("s", "k1").select("k1", F.min("k1").over(w).alias("bucket"), F.max("k1").over(w).alias("last")).filter("bucket < last").select("bucket", "k1")
    hot = prefixes.filter("often").select("s", "k1")
    first = hot.groupBy("s").agg(F.min("k1").alias("bucket"), F.max("k1").alias("last")).filter("bucket < last").select("s", "bucket")
    hot = hot.join(F.broadcast(first), "s").select("bucket", "k1")  # a row for each common shingle at most
    members = materialize(rare.unionByName(hot).distinct(), "jaccard-buckets")
    discard(prefixes)

    large = materialize(members.groupBy("bucket").count().filter(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "jaccard-large")
    cut = members.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y")))
    cut = cut.select("bucket", "k1", mine.alias("block"), F.explode(pairs).alias("p"))
    cut = cut.select("bucket", "k1", "p.x", "p.y", (F.col("block") == F.col("p.x")).alias("left"), (F.col("block") == F.col("p.y")).alias("right"))

    # First the trees alone: sets without a candidate go before any set's elements are fetched.
    dealt = cut.join(sets.select("k1", "n", "points"), "k1")
    kept = "bucket long, k1 long, x int, y int, left boolean, right boolean, n long, points binary"
    hopeful = materialize(dealt.groupBy("bucket", "x", "y").applyInArrow(_hopeful, kept), "jaccard-hopeful")
    # Equal sets are equal bytes whichever copy gives them, so the smallest id's text is read.
    wanted = materialize(hopeful.select("k1").distinct().join(sets.select("k1", F.col("rep").alias("id")), "k1").select("id"), "jaccard-wanted")
    few = wanted.limit(FEW + 1).count() <= FEW
    elements = materialize(_elements(keyed.join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), seed), "jaccard-elements")
    groups = hopeful.join(elements, "k1").groupBy("bucket", "x", "y").applyInArrow(_join_bucket, "a long, b long")
    links = materialize(groups, "jaccard-links")
    discard(members, large, hopeful, wanted, elements)
    rep = sets.select("k1", "rep")
    edges = links.join(rep.select(F.col("k1").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("k1").alias("b"), F.col("rep").alias("rb")), "b")
    return _answer(info, sets, edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def _answer(info: DataFrame, sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of one id with several sets join these, as links of the id with each set's smallest id."""
    several = info.filter("n > 0 and id is not null").groupBy("id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x < y").select("id")
    more = info.join(several, "id", "left_semi").filter("n > 0").join(sets.select("k1", "rep"), "k1").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(more))
    labels = materialize(sets.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("k1", F.coalesce("component", "rep").alias("component")), "jaccard-components")
    discard(found)
    # Rows that have no links do not meet in one join key: they are no part of the join.
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    out = info.filter(linked).join(labels, "k1").select("id", F.col("n").alias("n_shingles"), "component")
    return out.unionAll(info.filter(~linked).select("id", "n", "id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    out = similar_groups(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that are not their component's smallest id. Of equal ids all rows stay
    or go. Null ids stay."""
    gone = similar_groups(docs).filter("id is not null and component < id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

"""Line dedup over all documents, exact and near, in DataFrame operations only.

A line that is not blank stays where it occurs first - in the document with the smallest id, and there at
its first place - and goes everywhere else. A line of at least LEAST characters also goes if a line of an
earlier document that has as many is within EDITS edits; of two such lines of one document the longer goes, or else the
one later in code point order.

Near lines are found by a segment-partition join. A line is cut into EDITS + 1 even segments. Two lines
within EDITS edits have a segment of the one whole in the other, at a place that the lengths and the
segment's number confine to a few; so the longer line is probed with its substrings at those places for
each length that the other may have. A segment under which one line stands gives a pair. Lines that meet
under a segment of several are read again: what is left of a line beside the segment is itself cut into
segments, one more than the edits that may be there, and so on while more than CROWD lines share all that is
looked at; so families that share segments are told apart, not paired. Of a part with no more characters than
edits, the key takes in those that have to be the same; lines that still meet then are near, and each is paired
with the earliest only. The lines travel with these keys, and Spark's bounded `levenshtein` is a condition of the
join: only pairs that it does not rule out come out. They are verified by a banded bit-parallel automaton: bit k of
R_d says that the two prefixes whose lengths differ by k - EDITS are within d edits.

Lines travel as hashes wherever possible; whole texts are shuffled once. Groups of equal lines are
aggregated before they are joined, and the join back is one that Spark can split where a line is hot.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, discard, free, materialize

EDITS, LEAST = 2, 32
#: Lines that share a key and are compared with all that meet them there; where there are more, the key gets longer.
CROWD = 128
#: Hashes of near lines, or drops, up to which a table is broadcast instead of the texts' being shuffled.
FEW = 400_000
LAST_ID = (1 << 63) - 1


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\r\x0b\x0c")) == ""


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _without(lines: Column, drops: Column) -> Column:
    """The lines that stay. In the order of hash and place, with a drop before the lines it names, a line
    stays if it begins its group."""
    entry = lambda x, i: F.struct(F.when(_blank(x), i.cast("long")).otherwise(F.xxhash64(x)).alias("h"), i.alias("at"), x.alias("line"))
    drop = lambda h: F.struct(h.alias("h"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("line"))
    ordered = F.array_sort(F.concat(F.transform(drops, drop), F.transform(lines, entry)))

    def kept(group: Column) -> Column:
        first = F.filter(group, lambda e, i: (e["at"] >= 0) & ((i == 0) | (F.get(group, i - 1)["h"] != e["h"])))
        return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["at"].alias("at"), e["line"].alias("line")))), lambda e: e["line"])

    return bound(ordered, kept)


def _stays(lines: Column) -> Column:
    """Whether no line that is not empty comes twice: without drops, `_without` then takes nothing away."""
    some = F.array_remove(lines, "")
    return F.size(F.array_distinct(some)) == F.size(some)


def _drop_lines(docs: DataFrame, drops: DataFrame, few: bool) -> DataFrame:
    """docs (row columns, id, text) without the lines that drops (id, h) name and without repeats."""
    listed = drops.groupBy("id").agg(F.collect_set("h").alias("_drops"))
    none = F.array().cast("array<bigint>")
    joined = docs.join(F.broadcast(listed) if few else listed, "id", "left")
    kept = F.array_join(_without(_lines(), F.coalesce("_drops", none)), "\n")
    return joined.withColumn("text", F.when(_stays(_lines()) & F.col("_drops").isNull(), F.col("text")).when(F.col("text").isNotNull(), kept)).drop("_drops")


def _exact_drops(docs: DataFrame) -> DataFrame:
    """(id, h): lines of a document that an earlier document has."""
    seen = docs.select("id", F.explode(_lines()).alias("line")).filter(~_blank(F.col("line")))
    # 128 bits name a line; 64 of them do within a document.
    seen = seen.select("id", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"))
    first = seen.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("h", "g", "first")
    return seen.join(materialize(first, "line-repeats"), ["h", "g"]).filter("id > first").select("id", "h")


def segment(length: Column, i: int | Column, edits: int | Column = EDITS) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of edits + 1 of a line; the last ones take the remainder."""
    i = F.lit(i) if isinstance(i, int) else i
    base, more = F.floor(length / (edits + 1)).cast("int"), length % (edits + 1)
    short = edits + 1 - more  # so many segments have the length `base`
    return (1 + i * base + F.greatest(F.lit(0), i - short)).cast("int"), (base + F.when(i >= short, 1).otherwise(0)).cast("int")


def _keyed(lines: DataFrame, places: list[tuple[int, int, int]]) -> DataFrame:
    """lines (line, n, and others) with a row for each place (less, i, shift): segment i of lines that are `less`
    shorter, moved by `shift`, as `key`. One key a row: code that makes all keys at once is too long to be compiled."""
    each = F.array(*[F.struct(F.lit(a).alias("less"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for a, i, s in places])
    start, size = segment(F.col("n") - F.col("_at.less"), F.col("_at.i"))
    key = F.xxhash64(F.col("n") - F.col("_at.less"), F.col("_at.i"), F.substring("line", start + F.col("_at.shift"), size))
    return lines.withColumn("_at", F.explode(each)).withColumn("key", key).drop("line", "n", "_at")


def _places() -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Under which segments a line is indexed, and those with which it probes."""
    probe = [(less, i, shift) for less in range(EDITS + 1) for i in range(EDITS + 1) for shift in range(max(-i, less - (EDITS - i)), min(i, less + (EDITS - i)) + 1)]
    return [(0, i, 0) for i in range(EDITS + 1)], probe


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def letter_counts(line: Column) -> Column:
    """The counts of eight common letters, modulo 256, in the bytes of a long."""
    count = lambda c: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(count(c).cast("long").bitwiseAND(F.lit(255)), 8 * k) for k, c in enumerate("eainorts")])


def counts_allow(a: Column, b: Column) -> Column:
    """Whether letter counts are near enough: an edit changes their sum of differences by two at most."""
    gap = [F.abs(F.shiftrightunsigned(a, 8 * k).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(b, 8 * k).bitwiseAND(F.lit(255))) for k in range(8)]
    return reduce(lambda x, y: x + y, [F.least(g, 256 - g) for g in gap]) <= 2 * EDITS


def within(a: Column, b: Column) -> Column:
    """Whether two arrays of characters are within EDITS edits. Step i of the automaton takes character i
    of a; bit k stands for the prefix of b that is k - EDITS longer than i."""
    band = (1 << 2 * EDITS + 1) - 1
    start = [F.lit((((1 << d + 1) - 1) << EDITS)) for d in range(EDITS + 1)]  # the empty prefix of a, d insertions

    def step(state: Column, i: Column) -> Column:
        char = F.get(a, i)
        match = F.lit(0)
        for k in range(2 * EDITS + 1):
            at = i + (k - EDITS)
            match = match.bitwiseOR(F.when(F.get(b, at) == char, 1 << k).otherwise(0))  # null outside of b

        def rows(m: Column) -> Column:
            new = [state["r0"].bitwiseAND(m)]
            for d in range(1, EDITS + 1):
                before = state[f"r{d - 1}"]
                r = state[f"r{d}"].bitwiseAND(m).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1))
                new.append(r.bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band)))
            return F.struct(*[r.alias(f"r{d}") for d, r in enumerate(new)])

        return bound(match, rows)

    # In band terms: bit EDITS + (length of b - length of a) of the last state.
    steps = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, F.struct(*[s.alias(f"r{d}") for d, s in enumerate(start)]), step, lambda s: s[f"r{EDITS}"])
    gap = F.size(b) - F.size(a)
    wanted = F.get(F.array(*[F.lit(1 << k) for k in range(2 * EDITS + 1)]), gap + EDITS)  # null outside the band
    return F.coalesce(last.bitwiseAND(wanted) != 0, F.lit(False))


def _opened(lines: DataFrame) -> DataFrame:
    """lines (id, h, line) as rows (and key, own, parts) that `_refined` cuts: parts are what the key does not tell
    of a line, each with its place, the length n that it has in the lines that are indexed, by how much it is longer
    here (d), and the edits that may be in it (e). The rows under which a line is indexed are its `own`."""
    n, less = F.char_length("line"), F.col("_less")
    part = F.struct(F.lit(1).alias("at"), (n - less).alias("n"), less.alias("d"), F.lit(EDITS).alias("e"))
    rows = lines.withColumn("_less", F.explode(F.sequence(F.lit(0), F.lit(EDITS))))
    return rows.select("id", "h", "line", F.xxhash64(n - less).alias("key"), (less == 0).alias("own"), F.array(part).alias("parts"))


def _spellings(own: Column, line: Column, part: Column) -> Column:
    """What the keys take in of a part of no more characters than edits, each with its place. With d characters more here, n + d - e
    have to be the same, moved by up to d, each no less than the one before; the lines that are indexed have all choices."""
    n, d, e = part["n"], part["d"], part["e"]

    def choices(size: int, more: int, same: int) -> list[Column]:
        text = lambda at, moves: F.concat(F.lit(""), *[x for i, k in zip(at, moves, strict=True) for x in (F.lit(str(i)), F.substring(line, part["at"] + (i + k), 1))])
        return [text(at, moves) for at in combinations(range(size), same) for moves in combinations_with_replacement(range(more + 1), same)]

    out = F.when(n > e, F.array(F.lit("")))
    for size in range(1, EDITS + 1):
        out = out.when(own & (n == size), F.array(*[x for same in range(size + 1) for x in choices(size, 0, same)]))
        for more in range(1, EDITS + 1):
            for same in range(1, size + 1):
                out = out.when((n == size) & (d == more) & (e == size + more - same), F.array_distinct(F.array(*choices(size, more, same))))
    return out.otherwise(F.array(F.lit("")))


def _refined(rows: DataFrame) -> DataFrame:
    """rows for each segment of their first part that may be whole, which joins the key; what is left of the part on
    either side goes behind the others. A part of no more characters than edits is done with its `_spellings`: all
    lines that are indexed under the key are near in it."""
    moves = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(s).alias("s")) for j in range(EDITS + 1) for s in range(-j, j + 1)])
    rows = rows.withColumn("_p", F.get("parts", F.lit(0))).withColumn("_m", F.explode(moves))
    at, n, d, e, j, s = (F.col(c) for c in ("_p.at", "_p.n", "_p.d", "_p.e", "_m.j", "_m.s"))
    rows = rows.filter((j <= e) & (s >= d - (e - j)) & (s <= d + (e - j)))
    start, size = segment(n, j, e)
    before, behind = start - 1, n - (start - 1) - size
    rows = rows.filter((before + s >= 0) & (behind + d - s >= 0))
    part = lambda *x: F.struct(*[c.cast("int").alias(k) for k, c in zip(("at", "n", "d", "e"), x, strict=True)])
    left = F.array(part(at, before, s, j), part(at + before + s + size, behind, d - s, e - j))
    rows = rows.select(
        "id", "h", "line",
        F.xxhash64("key", j, F.substring("line", at + before + s, size)).alias("key"),
        (F.col("own") & (s == 0)).alias("own"),
        F.concat(F.slice("parts", F.lit(2), F.size("parts")), F.filter(left, lambda x: x["n"] > x["e"])).alias("parts"),
        left.alias("_left"),
    )
    for k in range(2):
        rows = rows.withColumn("_said", F.explode(_spellings(F.col("own"), F.col("line"), F.get("_left", F.lit(k)))))
        rows = rows.withColumn("key", F.when(F.col("_said") == "", F.col("key")).otherwise(F.xxhash64("key", F.lit(k), "_said")))
    return rows.drop("_left", "_said")


def _pair(a: str | Column, b: str | Column) -> list[Column]:
    return [F.least(a, b).alias("h"), F.greatest(a, b).alias("p")]


def _order(i: str, line: str) -> Column:
    return F.struct(F.col(i).alias("id"), F.char_length(line).alias("n"), F.col(line).alias("line"))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of rows under a key that are not ruled out. Only these come out of the join, which compares each row with
    the lines that are indexed there, CROWD at most."""
    a = rows.filter("own").select("key", F.col("h").alias("a"), F.col("line").alias("la"))
    b = rows.select("key", F.col("h").alias("b"), F.col("line").alias("lb"))
    met = a.join(b, (a["key"] == b["key"]) & (F.col("a") != F.col("b")) & (F.levenshtein("la", "lb", EDITS) >= 0))
    return met.select(*_pair("a", "b"))


def _first_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of rows of which nothing is left to cut: a row is near all lines indexed under its key. The earliest line
    that is near tells of each whether an earlier one is."""
    first = lambda x: F.min(x)["h"]
    told = F.struct(_order("id", "line").alias("o"), F.col("h"))
    firsts = rows.groupBy("key").agg(first(told).alias("any"), first(F.when(F.col("own"), told)).alias("indexed"))
    return rows.join(firsts, "key").select(*_pair("h", F.when(F.col("own"), F.col("any")).otherwise(F.col("indexed")))).filter("h <> p")


def _crowded_pairs(lines: DataFrame) -> DataFrame:
    """(h, p), written: pairs of lines (id, h, line; distinct) of which those that are near are the ones that
    meet, or join both to the earliest."""
    rows, pairs = materialize(_refined(_opened(lines)), "line-rows"), []
    while True:
        counts = rows.filter("own").groupBy("key").agg(F.count("*").alias("lines"))
        crowd = materialize(counts.filter(F.col("lines") > CROWD).select("key"), "line-crowds")
        some = crowd.limit(FEW + 1).count()
        listed = F.broadcast(crowd) if some <= FEW else crowd
        calm = rows.join(listed, "key", "left_anti") if some else rows
        met = _met(calm)
        if not some:
            pairs.append(materialize(met, "line-pairs"))
            out = materialize(reduce(DataFrame.unionAll, pairs).distinct(), "line-pairs")
            discard(rows, crowd, *pairs)
            return out
        busy = rows.join(listed, "key")
        pairs.append(materialize(met.unionAll(_first_pairs(busy.filter(F.size("parts") == 0))), "line-pairs"))
        after = materialize(_refined(busy.filter(F.size("parts") > 0)), "line-rows")
        discard(rows, crowd)
        rows = after


def _near_drops(docs: DataFrame) -> DataFrame:
    """(id, h), written: lines that are near an earlier one. docs (id, text) must be exactly deduplicated and written."""
    lines = docs.select("id", F.explode(_lines()).alias("line")).withColumn("n", F.char_length("line")).filter(F.col("n") >= LEAST)
    index, probe = _places()
    h = F.xxhash64("line").alias("h")
    left = _keyed(lines.select(h, "line", "n"), index).groupBy("key").agg(F.min("h").alias("h"), F.max("h").alias("last"))
    right = _keyed(lines.select(h.alias("p"), "line", "n"), probe)
    # A row of the index is one key, however many lines share it, so what meets is no more than the probes.
    met = left.hint("shuffle_hash").join(right, (left["key"] == right["key"]) & ((F.col("h") != F.col("last")) | (F.col("h") != F.col("p"))))
    met = materialize(met.select("h", "p", (F.col("h") != F.col("last")).alias("several")), "line-met")
    single, several = met.filter("not several"), met.filter("several").select(F.col("p").alias("h"))
    known = materialize(several.unionAll(single.select("h")).unionAll(single.select("p")).distinct(), "line-known")
    few = known.limit(FEW + 1).count() <= FEW
    texts = materialize(lines.select("id", "line", h).join(F.broadcast(known) if few else known, "h").distinct(), "line-texts")
    crowded = _crowded_pairs(texts.join(several.distinct(), "h", "left_semi").groupBy("h", "line").agg(F.min("id").alias("id")))
    pairs = single.select(*_pair("h", "p")).unionAll(crowded).distinct()
    a = texts.select("h", F.col("id").alias("ia"), F.col("line").alias("la"))
    b = texts.select(F.col("h").alias("p"), F.col("id").alias("ib"), F.col("line").alias("lb"))
    both = pairs.join(a, "h").join(b, "p").filter("la <> lb")
    # Most pairs share segments and no more: Spark's bounded distance rules them out for less than the automaton.
    both = both.filter(F.levenshtein("la", "lb", EDITS) >= 0)
    near = both.filter(bound(F.struct(characters(F.col("la")).alias("a"), characters(F.col("lb")).alias("b")), lambda z: within(z["a"], z["b"])))
    drops = near.select(F.when(_order("ia", "la") < _order("ib", "lb"), F.struct(F.col("ib").alias("id"), F.col("p").alias("h"))).otherwise(F.struct(F.col("ia").alias("id"), F.col("h").alias("h"))).alias("x")).select("x.id", "x.h").distinct()
    drops = materialize(drops, "line-near")
    discard(met, known, texts, crowded)
    return drops


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", before: str = "n_lines", after: str = "n_kept") -> DataFrame:
    """docs with lines removed from the text, and the columns `before` and `after`, the numbers of lines; columns
    of docs with these names give way. Rows with one id count as one document; a null id as the last. Null and
    empty texts stay; blank lines stay, white space in other lines counts. An empty table gives an empty result."""
    own = {c: f"_in_{k}" for k, c in enumerate(docs.columns) if c not in (text, before, after)}
    rows = docs.select(F.coalesce(F.col(id_column), F.lit(LAST_ID)).cast("long").alias("id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(name) for c, name in own.items()])
    rows = rows.withColumn("_n_lines", F.when(F.col("text").isNotNull(), F.size(_lines())).otherwise(0))
    # Tells an empty text of which one blank line is left from one of which nothing is.
    rows = rows.withColumn("_has_blank", F.col("text").rlike(r"(?:^|\n)[ \t\r\x0b\x0c]*(?:\n|\z)"))
    once = _drop_lines(rows, _exact_drops(rows.select("id", "text")), few=False)
    once = materialize(once, "line-exact")
    near = _near_drops(once.select("id", "text"))
    out = _drop_lines(once, near, few=near.limit(FEW + 1).count() <= FEW)
    kept = F.when(F.col("text").isNotNull() & (F.col("text") != ""), F.size(_lines())).otherwise(F.when(F.col("text").isNull(), 0).otherwise(F.col("_has_blank").cast("int")))
    named = [F.col("text").alias(c) if c == text else F.col(own[c]).alias(c) for c in docs.columns if c == text or c in own]
    return out.select(*named, F.col("_n_lines").alias(before), kept.alias(after))


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, kept_sha256) of each row; see `dedup_lines` for nulls and repeated ids."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def unrepeated(docs: DataFrame) -> DataFrame:
    """docs with their lines deduplicated and n_chars taken anew; documents that had words and have none
    left, whole repeats of others, go."""
    before, after = free("n_lines", docs.columns), free("n_kept", docs.columns)
    out = dedup_lines(docs, before=before, after=after)
    out = out.filter(~((F.col(before) > F.col(after)) & _blank(F.regexp_replace("text", "\n", " "))))
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])

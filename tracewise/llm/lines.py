"""Op 2. Line dedup by an exact set-similarity join [native].

A line's tokens are its distinct five-word shingles (of fewer words: all of them as one).
Tokens are ordered by rarity, and two lines of similarity t share one of the first
n - ceil(t n) + 1 tokens of either; lines that share one are candidates unless their lengths
or the token's positions rule similarity out. Jaccard similarity is then verified on whole
token sets. A line goes if an earlier one (smaller doc_id, or earlier in its document) is
equal to it or similar to it.

Rarity is a count of occurrences over the lines of that table in 2^16 buckets; what a token adds to its
bucket shows as soon as it is more than the buckets differ by chance. A token carries its
rarity in its upper bits, so its number is its place in the order.

Equal lines are one class, found by aggregation, so copies are never paired; the lines that
occur most often (10,000 at most, as each is a ten-thousandth of all) enter the token table
with their first occurrence only, and most later occurrences of other lines are left out by
filters. The token table is dealt out once, by token; what no other
line shares is dropped where it arrives. It still counts: of the line whose prefix ends
earlier in the order, no token that nobody shares can be in the other line, which bounds the
overlap of two lines that differ in what they were filled in with. Kinds of entries (size,
place, that bound) that can match no kind of their token are dropped kind by kind. The
classes that are left get whole token sets and a sketch of parities, whose differing bits
bound how much two sets differ. Similar classes are looked for in two steps: each class
against the earliest of a token's classes, then what found no match against every earlier
class that shares a token; pairs are formed only where all bounds allow them.

Main path: DataFrame functions only. Filters of bounded size say which rows can matter
before rows are shuffled; an exact join follows each.

Cases: null and empty texts, and lines without a word, stay as they are. Rows that share a
doc_id are one document; rows without one keep their lines. Ties in rarity go by the token's
hash. Repeated rows stay alike. An empty table gives no rows. Extra columns pass through,
whatever their names; n_lines and n_removed replace input columns of these names.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.shared import SPACE, boxed, hits, let, quoted, release, store, unboxed, with_hit

WORDS = 5
#: Buckets of the rarity count.
BUCKETS = 1 << 16
#: Bits of a token's number that hold its rarity, 256 levels for each doubling of the count; 49 bits of its hash are below.
LEVEL_BITS = 14
#: Bits of a set's sketch.
SKETCH = 128
#: A line of which one in so many lines is a copy enters the token table once.
HEAVY = 10_000


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line of lines that have a word, with two hashes of the line."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def line_words(line: Column) -> Column:
    """Words of a line. Where blanks are its only white space, it is split without a pattern, which takes a fraction of the time."""
    other = reduce(lambda a, b: a | b, (line.contains(c) for c in "\t\x0b\x0c\r\n"))
    return F.array_remove(F.when(other, F.split(line, SPACE)).otherwise(F.split(line, " ")), "")


def shingles(line: Column, size: int = WORDS) -> Column:
    """Shingles of a line that has a word, as hashes, repeated ones included."""

    def of(w: Column) -> Column:
        n = F.size(w)
        whole = F.array(F.xxhash64(F.lit(0), F.array_join(w, " ")))
        return F.when(n < size, whole).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(size)) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))))

    return let(line_words(line), of)


def shingle_rows(lines: DataFrame, size: int = WORDS) -> DataFrame:
    """The hashes that shingles() gives, a row each (t). Rows run in generated code, which functions on arrays of a line don't."""
    words = lines.select(F.explode(F.array(line_words(F.col("line")))).alias("w"))  # so that a line is split once
    n = F.size("w")
    placed = words.select("w", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(size)) - size)).alias("i"))
    whole = F.xxhash64(F.lit(0), F.array_join("w", " "))
    return placed.select(F.when(n < size, whole).otherwise(F.xxhash64(*(F.get("w", F.col("i") + k) for k in range(size)))).alias("t"))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(lines: DataFrame) -> Column:
    """Level by bucket of tokens, from counts over these lines: BUCKETS numbers whatever the input."""
    counted = shingle_rows(lines).groupBy(bucket(F.col("t")).alias("b")).agg(F.count("*").alias("n"))
    out = [0] * BUCKETS
    for r in counted.collect():
        out[r["b"]] = min((1 << LEVEL_BITS) - 1, int(256 * math.log2(r["n"])))
    return F.from_json(F.lit(json.dumps(out, separators=(",", ":"))), "array<smallint>")


def tokens(line: Column, levels: Column) -> Column:
    """Distinct shingles of a line that has a word, as numbers: the rarity level above 49 bits of the hash."""

    def numbered(h: Column) -> Column:
        level = F.coalesce(F.get(levels, bucket(h)), F.lit(0).cast("smallint"))  # never null, so that numbers are sorted as such
        return F.shiftleft(level.cast("bigint"), 63 - LEVEL_BITS).bitwiseOR(F.shiftrightunsigned(h, LEVEL_BITS + 1))

    return F.array_distinct(F.transform(shingles(line), numbered))


def prefix_length(n: Column, per_mille: int) -> Column:
    return (n - F.ceil(n * per_mille / 1000) + 1).cast("int")


def overlap_needed(m: Column, n: Column, per_mille: int) -> Column:
    return F.ceil((m + n) * per_mille / (1000 + per_mille))


def could_match(per_mille: int) -> Column:
    """Length and positional filters on entries x and y of one token, and the bound by tokens that nobody shares."""
    m, n = F.col("x.n"), F.col("y.n")
    needed = overlap_needed(m, n, per_mille)
    left = F.least(m - F.col("x.pos"), n - F.col("y.pos"))  # tokens from the shared one on
    placed = F.least(F.col("x.pos"), F.col("y.pos")) + left >= needed
    return (1000 * F.least(m, n) >= per_mille * F.greatest(m, n)) & placed & (F.greatest("x.most", "y.most") >= needed)


def parity(tokens: Column, k: int) -> Column:
    """Word k of a set's sketch: the parities of how many tokens fall on each of its bits."""
    own = F.filter(tokens, lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(SKETCH // 64 - 1)) == k)
    bits = F.transform(own, lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), t.bitwiseAND(F.lit(63)).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def near_enough(per_mille: int) -> Column:
    """Bound on classes x and y: sketches differ in no more bits than the sets differ in tokens, and those in no more than their sizes allow."""
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SKETCH // 64)))
    return (1000 + per_mille) * apart <= (1000 - per_mille) * (F.col("x.n") + F.col("y.n"))


def entries_of(lines: DataFrame, levels: Column, per_mille: int) -> DataFrame:
    """Per line and prefix token: token, h1, and the line's size with the token's place in one number, dealt out by token."""
    cut = lines.select("h1", let(tokens(F.col("line"), levels), lambda t: F.struct(F.size(t).alias("n"), F.slice(F.sort_array(t), F.lit(1), prefix_length(F.size(t), per_mille)).alias("p"))).alias("s"))
    entries = cut.select("h1", "s.n", F.posexplode("s.p").alias("pos", "token"))
    return entries.select("token", "h1", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("pos").cast("bigint")).alias("shape")).repartition("token")


def shared_entries(entries: DataFrame, per_mille: int) -> DataFrame:
    """Entries whose token another class has: token, h1, n, pos, most (how many tokens the class can have in common with any)."""
    of_token = Window.partitionBy("token").orderBy("h1")
    before, after = F.lag("h1").over(of_token), F.lead("h1").over(of_token)
    # of a class's rows for a token the first or last has another class next to it, if there is one
    beside = F.coalesce(F.col("before") != F.col("h1"), F.lit(False)) | F.coalesce(F.col("after") != F.col("h1"), F.lit(False))
    shared = entries.withColumns({"before": before, "after": after}).where(beside).select("token", "h1", "shape").distinct()
    n, pos = F.shiftright("shape", 32).cast("int"), F.col("shape").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    shared = shared.select("token", "h1", n.alias("n"), pos.alias("pos"))
    alone = prefix_length(F.col("n"), per_mille) - F.count("*").over(Window.partitionBy("h1"))
    return shared.withColumn("most", (F.col("n") - alone).cast("int"))


def open_entries(shared: DataFrame, per_mille: int) -> DataFrame:
    """Entries of a kind (size, place, most) that could match another of their token. A token has few kinds, however many lines share it."""
    kind = ["n", "pos", "most"]
    kinds = shared.groupBy("token", *kind).agg(F.count("*").alias("m"))
    other = (F.col("y.m") > 1) | (F.struct(*(f"x.{c}" for c in kind)) != F.struct(*(f"y.{c}" for c in kind)))
    return shared.alias("x").join(kinds.alias("y"), (F.col("x.token") == F.col("y.token")) & other & could_match(per_mille), "left_semi")


def without_copies(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """lines without later ones of a class, as far as two filters of bounded size can tell; each class keeps its first.

    A line whose class may have copies stays if it may be a first place. Both sets are taken by the
    same filter, so a class that is only mistaken for one with copies has its place among the firsts.
    """
    copied = classes.where("copies > 1").select("h1")
    at = F.xxhash64("h1", "h2", "doc_id", "line_no")
    firsts = store(hits(classes, copied, "h1").select("h1", "h2", "first.*").select(at.alias("at")), "firsts")
    split = with_hit(lines, copied, "h1").withColumnRenamed("_hit", "copied").withColumn("at", at)
    return with_hit(split, firsts, "at").where("not copied or _hit").select(*lines.columns)


def later_matches(docs: DataFrame, per_mille: int = 800) -> tuple[DataFrame, DataFrame]:
    """(doc_id, line_no, h1, h2) of all lines, and the line classes of which something goes: h1, h2, first, similar."""
    lines = lines_of(docs)
    places = store(lines.select("doc_id", "line_no", "h1", "h2"), "places")
    classes = store(places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies")), "classes")
    here = F.struct("doc_id", "line_no")
    heavy = classes.where(F.col("copies") * HEAVY >= places.count()).where("copies > 1").select("h1", "h2", "first")  # HEAVY rows at most
    once = without_copies(lines, classes).join(F.broadcast(heavy), ["h1", "h2"], "left").where(F.col("first").isNull() | (F.col("first") == here))
    levels = rarity(once)
    shared = store(shared_entries(entries_of(once, levels, per_mille), per_mille), "shared")
    entries = store(open_entries(shared, per_mille), "open")
    release(shared)
    # a class is known by its first place from here on
    unplaced, entries = entries, store(entries.join(hits(classes, entries.select("h1").distinct(), "h1"), "h1").select("token", "n", "pos", "most", "h1", "h2", "first"), "open")
    release(unplaced)

    # whole sets of the classes that are left, with the parities of their tokens in SKETCH bits
    wanted = entries.select("first.doc_id", F.xxhash64("h1", "h2", "first.doc_id", "first.line_no").alias("at"), "h1", "h2", "first").distinct()
    wanted = store(wanted, "wanted")
    some = hits(lines_of(hits(docs, wanted, "doc_id")).withColumn("at", F.xxhash64("h1", "h2", "doc_id", "line_no")), wanted, "at")
    place = ["doc_id", "line_no", "h1", "h2"]  # keys of both, as they are, so that lines are shuffled once
    texts = some.join(wanted.select("first.*", "h1", "h2"), place, "left_semi").groupBy(*place).agg(F.first("line").alias("line")).withColumn("id", here)
    sets = texts.select("id", tokens(F.col("line"), levels).alias("set"))
    sets = store(sets.select("id", "set", *(parity(F.col("set"), k).alias(f"s{k}") for k in range(SKETCH // 64))), "sets")
    unsketched, entries = entries, store(entries.select(F.col("first").alias("id"), "token", "n", "pos", "most").join(sets.drop("set"), "id"), "entries")
    release(wanted, unsketched)

    def verified(pairs: DataFrame) -> DataFrame:
        """Classes x that are similar to their y."""
        pairs = store(pairs.distinct(), "pairs")
        paired = hits(sets.select("id", "set"), pairs.select(F.col("x").alias("id")).union(pairs.select("y")), "id")  # other sets needn't be shuffled
        both = pairs.join(paired.select(F.col("id").alias("x"), F.col("set").alias("a")), "x").join(paired.select(F.col("id").alias("y"), F.col("set").alias("b")), "y")
        common = F.size(F.array_intersect("a", "b"))
        return both.where(1000 * common >= per_mille * (F.size("a") + F.size("b") - common)).select(F.col("x").alias("id")).distinct()

    later = (F.col("x.token") == F.col("y.token")) & (F.col("x.id") > F.col("y.id")) & could_match(per_mille) & near_enough(per_mille)
    ends = [F.col("x.id").alias("x"), F.col("y.id").alias("y")]
    earliest = entries.groupBy("token").agg(F.min(F.struct(*(c for c in entries.columns if c != "token"))).alias("e")).select("token", "e.*")
    found = store(verified(entries.alias("x").join(earliest.alias("y"), later).select(*ends)), "similar")
    split = with_hit(entries, found, "id")
    kept = entries.columns
    rest = split.where("_hit").join(found, "id", "left_anti").select(*kept).union(split.where("not _hit").select(*kept))
    similar = store(found.union(verified(rest.alias("x").join(entries.alias("y"), later).select(*ends))), "similar")
    release(entries, sets, found)
    similar = similar.select(F.col("id").alias("first"), F.lit(True).alias("similar"))
    gone = classes.join(similar, "first", "left").withColumn("similar", F.coalesce("similar", F.lit(False)))
    return places, gone.where("copies > 1 or similar").select("h1", "h2", "first", "similar")


def dedup_lines(docs: DataFrame, per_mille: int = 800, text: str = "text") -> DataFrame:
    """docs with later matches taken out of the text, and n_lines, n_removed."""
    own = docs.select("doc_id", F.col(quoted(text)).alias("text"))
    places, gone = later_matches(own, per_mille)
    lost = places.join(gone, ["h1", "h2"]).where(F.col("similar") | (F.struct("doc_id", "line_no") != F.col("first")))
    removed = store(lost.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")), "removed")
    release(places, gone)
    lines = F.split("text", "\n")
    keep = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    plain = boxed(docs, doc_id=F.col("doc_id"), text=F.col(quoted(text)))
    split = with_hit(plain, removed, "doc_id")  # what can't lose a line needn't be shuffled
    rest = split.where("not _hit").withColumn("gone", F.lit(None).cast("array<int>"))
    out = split.where("_hit").join(removed, "doc_id", "left").unionByName(rest)
    return unboxed(
        out,
        docs.columns,
        **{text: F.when(F.col("gone").isNull(), F.col("text")).otherwise(keep)},
        n_lines=F.coalesce(F.size(lines), F.lit(0)).cast("bigint"),
        n_removed=F.coalesce(F.size("gone"), F.lit(0)).cast("bigint"),
    )

"""Op 10. N-gram Jaccard join by a blocked sparse matrix product.

Documents are rows and word shingles are columns of an incidence matrix A; pairs of
documents overlap as A A^T says. Two size-derived bounds keep the product sparse. A pair
with Jaccard similarity t shares one of the n - ceil(t n) + 1 columns that come first in
either row, columns being ordered by how many documents they are in; so candidates come
from the product over those columns alone. And a pair's sizes must be within a factor t.

Equal rows are one class (equal sets), so copies are never multiplied. Within a column the
product is taken in two steps instead of all pairs: first each class against the column's
most central class (whose shingles are shared most), and the pairs that pass are united;
then classes of different unions that still share a column, under the bound that the
histograms of two sets differ by no more than the sets may. There the product is accumulated:
a pair's count of common prefix columns bounds its overlap from above, and pairs below what
their sizes need are discarded. Both steps are verified on whole sets, block by block. No
pair within one union is formed, which loses no component; so links aren't counted.

The order of columns comes from counts of all documents in 2^22 buckets. It steers the size
of the product, not its result: any order common to all documents is exact.

Cases: null, empty or word-less text has no shingles and is its own component. Fewer words
than a shingle has are one shingle. Rows that share a doc_id are one document: the row whose
set has the smallest digest is linked, and all of them get its component; n_shingles is each
row's own.
Ties go to the smaller doc_id. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.graph import components
from tracewise.llm.shared import batches_of, hits, release, store
from tracewise.llm.shingles import mix, shingle_sets

#: Bins of a set's histogram, and bits of the filter over documents with candidates.
BINS = 64
FILTER = 1 << 24
#: Counters of how common shingles are, and how many travel in one row.
COUNTERS = 1 << 22
BLOCK = 1 << 15
#: Texts, or pairs of whole sets, that go to a worker at a time.
ROWS = 512


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("raw"))


def _parts(batches, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column("raw").to_pylist()


def key_of(grams: bytes) -> bytes | None:
    """A set's digest; None for the empty set."""
    return hashlib.blake2b(grams, digest_size=16).digest() if grams else None


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """Documents by bucket of their shingles: COUNTERS numbers over all documents, whatever the input."""

    def count(batches):
        total, group, waiting = np.zeros(COUNTERS, np.uint32), [], 0
        for _, texts in _parts(batches):
            for s in shingle_sets(texts, size):
                group.append((s & np.uint64(COUNTERS - 1)).astype(np.int32))
                waiting += len(s)
                if waiting > COUNTERS // 2:
                    total += np.bincount(np.concatenate(group), minlength=COUNTERS).astype(np.uint32)
                    group, waiting = [], 0
        if group:
            total += np.bincount(np.concatenate(group), minlength=COUNTERS).astype(np.uint32)
        blocks = total.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        for k in some.tolist():
            narrow = blocks[k].astype(np.uint8) if blocks[k].max() < 256 else blocks[k]  # a row's length tells which
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([narrow.tobytes()], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(raw, np.uint8 if len(raw) == BLOCK else np.uint32).astype(np.uint32)
                sums[k] = sums[k] + got if k in sums else got
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    out = np.zeros((COUNTERS // BLOCK, BLOCK), np.uint32)
    for r in _raw(docs).mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toLocalIterator():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def incidence(docs: DataFrame, size: int, per_mille: int, common: np.ndarray) -> DataFrame:
    """Per document: set size, key of the set, the columns it is joined on, how common its shingles are, histogram."""

    def run(batches):
        for part, texts in _parts(batches):
            n, keys, prefixes, central, bins = [], [], [], [], []
            for s in shingle_sets(texts, size):
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    prefixes.append(np.zeros(0, np.int64))
                    central.append(0.0)
                    bins.append(np.zeros(BINS // 8, np.int64))
                    continue
                keys.append(key_of(s.tobytes()))
                seen = np.maximum(common[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], 1)
                length = len(s) - -(-per_mille * len(s) // 1000) + 1
                prefixes.append(s[np.lexsort((s, seen))[:length]].view(np.int64))
                central.append(float(np.log(seen).mean()))
                histogram = np.bincount((mix(s) >> np.uint64(58)).astype(np.int64), minlength=BINS)
                bins.append(np.minimum(histogram, 255).astype(np.uint8).view("<i8"))
            edges = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * (BINS // 8)), pa.array(np.concatenate(bins) if bins else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), prefix, pa.array(central, pa.float64()), packed], ["doc_id", "n", "key", "prefix", "central", "bins"])

    return _raw(docs).mapInArrow(run, "doc_id bigint, n bigint, key binary, prefix array<bigint>, central double, bins array<bigint>")


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """doc_id and set of the wanted documents, and of a few more: a filter of fixed size tells which to compute."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))  # from 0; the bitmap functions count from 1
    rows = wanted.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    maps = np.zeros((FILTER // 32768, 4096), np.uint8)
    for r in rows:  # at most FILTER / 32768 rows of 4 KB, whatever the input
        maps[r["bucket"] - 1] = np.frombuffer(r["map"], np.uint8)
    flat = maps.ravel()

    def run(batches):
        for batch in batches:
            bits = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((flat[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1))
            for part, texts in _parts([batch], 512):
                sets = [s.tobytes() for s in shingle_sets(texts, size)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(key_of, sets), pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "key", "grams"])

    found = _raw(docs).withColumn("bit", bit).mapInArrow(run, "doc_id bigint, key binary, grams binary").where("doc_id is not null and key is not null")
    return found.groupBy("doc_id").agg(F.min_by("grams", "key").alias("grams"))


def verified(pairs: DataFrame, sets: DataFrame, per_mille: int) -> DataFrame:
    """Pairs (a, b) whose whole sets overlap enough. A block holds the documents b of one a next to each other."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("of_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("of_a"), batch.column("of_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if not len(x) or not len(y):
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                overlap = int((x[at] == y).sum())
                if 1000 * overlap >= per_mille * (len(x) + len(y) - overlap):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def sizes_fit(m: Column, n: Column, per_mille: int) -> Column:
    return 1000 * F.least(m, n) >= per_mille * F.greatest(m, n)


def enough_overlap(per_mille: int) -> Column:
    """Bound on a pair of sizes m and n that has `overlap` columns of both prefixes in common.

    Of the row whose prefix ends earlier in the order of columns, what lies behind its prefix
    is ceil(t n) - 1 columns; before that it shares the counted ones only.
    """
    behind = F.ceil(per_mille * F.greatest("m", "n") / 1000) - 1
    return F.col("overlap") + behind >= F.ceil(per_mille * (F.col("m") + F.col("n")) / (1000 + per_mille))


def near_enough(per_mille: int) -> Column:
    """Bound on rows x and y: the histograms of two sets differ by no more than the sets, and those by no more than their sizes allow.

    A histogram is eight numbers of eight bytes; a bin counts to 255, which only loosens the bound.
    """

    def bin_of(side: str, k: int) -> Column:
        return F.shiftright(F.col(f"{side}.b{k // 8}"), 8 * (k % 8)).bitwiseAND(F.lit(255))

    apart = sum((F.abs(bin_of("x", k) - bin_of("y", k)) for k in range(1, BINS)), F.abs(bin_of("x", 0) - bin_of("y", 0)))
    return (1000 + per_mille) * apart <= (1000 - per_mille) * (F.col("x.n") + F.col("y.n"))


def members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def join(docs: DataFrame, size: int = 3, per_mille: int = 900) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links of at least per_mille / 1000."""
    with batches_of(docs.sparkSession, ROWS):
        return _join(docs, size, per_mille)


def _join(docs: DataFrame, size: int, per_mille: int) -> DataFrame:
    rows = store(incidence(docs, size, per_mille, rarity(docs, size)), "incidence")
    full = rows.where("n > 0 and doc_id is not null")
    # of rows that share a doc_id, the one with the smallest digest stands for the document
    rivals = store(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("key").alias("least")).where("rows > 1 and least is not null").select("doc_id", "least"), "rivals")
    full = full.join(rivals, "doc_id", "left").where("least is null or key = least")
    classes = store(full.groupBy("key").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "central", "prefix", "bins"))), "classes")
    wide, rows = rows, store(rows.select("doc_id", "n", "key"), "rows")
    release(wide)
    several = store(classes.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("m")).where("m > 1").select("s"), "columns")
    entries = hits(classes.select("rep", "n", "central", F.explode("prefix").alias("s")), several, "s").join(several, "s", "left_semi")
    entries = store(entries, "entries")
    bins = store(classes.select("rep", "n", *(F.get("bins", F.lit(k)).alias(f"b{k}") for k in range(BINS // 8))), "bins")
    wide, classes = classes, store(classes.select("key", "rep"), "classes")
    release(wide, several)
    heads = entries.groupBy("s").agg(F.max(F.struct("central", (-F.col("rep")).alias("rep"), "n")).alias("head"))
    shared = store(entries.join(heads, "s").select("s", "rep", "n", (-F.col("head.rep")).alias("head"), F.col("head.n").alias("head_n")), "shared")
    release(entries)
    stars = shared.where((F.col("rep") != F.col("head")) & sizes_fit(F.col("n"), F.col("head_n"), per_mille)).select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.alias("p").join(bins.alias("x"), F.col("p.a") == F.col("x.rep")).join(bins.alias("y"), F.col("p.b") == F.col("y.rep")).where(near_enough(per_mille)).select("a", "b")
    stars = store(stars, "stars")
    near = store(verified(stars, whole_sets(docs, members(stars), size), per_mille), "links")
    release(stars)
    labels = components(near)
    # classes of different unions that share a column; the largest union of a column needs no pairs within itself
    marked = shared.select("s", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    marked = store(marked, "marked")
    release(shared)
    unions = marked.groupBy("s", "label").agg(F.count("*").alias("m")).groupBy("s").agg(F.count("*").alias("unions"), F.max(F.struct("m", "label"))["label"].alias("main")).where("unions > 1")
    split = store(marked.join(unions, "s").select("s", "rep", "label", "main").join(bins, "rep"), "split")
    release(marked, bins)
    x, y = split.where("label != main").alias("x"), split.alias("y")
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))  # a pair counts each column once
    rest = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label")) & once & sizes_fit(F.col("x.n"), F.col("y.n"), per_mille) & near_enough(per_mille))
    ends = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    rest = rest.select(*ends, F.least("x.n", "y.n").alias("m"), F.greatest("x.n", "y.n").alias("n")).groupBy("a", "b", "m", "n").agg(F.count("*").alias("overlap"))
    rest = rest.where(enough_overlap(per_mille)).select("a", "b")
    rest = store(rest, "rest")
    release(split)
    far = verified(rest, whole_sets(docs, members(rest), size), per_mille)
    united = components(near.union(far))
    release(rest)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "key")).otherwise(F.col("key"))
    found = rows.join(rivals, "doc_id", "left").select("doc_id", "n", own.alias("key"))
    found = found.join(classes, "key", "left").join(united.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "doc_id").alias("component_id"))

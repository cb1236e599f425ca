"""Op 12. Phrase collocation mining: merged count-min sketches say which phrases may be frequent, a second pass counts those exactly.

Sketches. Per number of words, each task hashes its phrases to two cells, one per row of the
sketch, and sends its counts of cells sparsely, in slices of 2^16 cells. The slices are added up
where they meet. A cell's count is at least that of any phrase in it, so a phrase with a cell
below `least` is not frequent, and no frequent one is lost. A phrase is put into the next
sketch only if both phrases that it consists of but one word may be frequent. A sketch has a
cell for about 32 bytes of text, MOST_CELLS at most. What the sketches leave goes to the tasks
as bits, which don't grow with the text but with what is frequent: cells are folded onto each
other as long as one bit in ROOM is set at most, and onto MOST_BITS bits in any case. So they
stay below 2 x MOST_BITS / 8 bytes per number of words; past either bound more phrases pass,
which costs counting them, not results.

Exact counts. The second pass adds up the phrases that pass, first within parts of a task's
texts, then by phrase.

Score. A phrase of a occurrences, cut after some of its words into parts with l and r, has
floor(1000000 * a * a / (l * r)) in decimals of 38 digits; its worst cut counts. A candidate is
subsumed by a longer one that holds it and has at least half its occurrences. The first `top` per
language are found in steps, so that no task sees all candidates of a language.

Cases: null texts are empty, a null lang is 'und'. Rows are texts, also where they share a doc_id
or have none. Texts are cut at line and sentence ends, and long texts are read in parts at such
ends. Ties rank by phrase in byte order. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.shared import shuffles_dropped, store
from tracewise.llm.shingles import mix
from tracewise.llm.terms import parts

LEAST, LONGEST, TOP = 10, 3, 2000
#: Bytes of text that phrases are counted in at a time, cells of a slice, bytes of text per cell of a sketch, most cells.
PART, SLICE, BYTES_PER_CELL, MOST_CELLS = 1 << 23, 1 << 16, 32, 1 << 29
#: Bits of a row of a filter for each that is set, most bits of a row.
ROOM, MOST_BITS = 64, 1 << 26
#: Groups that the first phrases of a language are found in, step by step.
STEPS = (256, 16, 1)
#: A-Z as a-z, each end of a piece as a line feed, tab as blank.
_PIECES = bytes((c + 32) if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?" or 0x0A <= c <= 0x0D else 0x20 if c == 9 else c for c in range(256))
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers from 1 on, 0 between pieces; and the words by number."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    number[b"\n"]  # 0
    words = filter(None, text.translate(_PIECES).replace(b"\n", b" \n ").split(b" "))
    out = np.fromiter(map(number.__getitem__, words), np.int32)
    return np.concatenate([out, np.zeros(1, np.int32)]), list(number)


def phrases(batches) -> Iterator[list[tuple[str, np.ndarray, list[bytes]]]]:
    """For each part of the batches: lang, numbered words and words by number."""
    for part in parts(batches, "raw", PART):
        by_lang: dict[str, list[bytes]] = {}
        for lang, raw in zip(part.column("lang").to_pylist(), part.column("raw").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(raw)
        yield [(lang, *numbered(piece)) for lang, texts in by_lang.items() for piece in _cut(b"\n".join(texts))]


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends."""
    at = 0
    while len(text) - at > 2 * PART and (end := _END.search(text, at + PART)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    return mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) ^ seed)


def cells(hashed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A phrase's cell in each of the two rows of a sketch."""
    low = np.uint64(most - 1)
    return (hashed & low).astype(np.int64), ((hashed >> np.uint64(32)) & low).astype(np.int64)


def levels(ids: np.ndarray, word: np.ndarray, bits: list[np.ndarray], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of phrases of 1, 2, ... words, of those that may be frequent by the bits of each number of words so far."""
    own = word[ids]
    place, value = np.flatnonzero(ids), own
    for size in range(1, longest + 1):
        if size > 1:
            place = place[ok[place + 1]]  # noqa: F821
            value = np.zeros(len(ids), np.uint64)
            with np.errstate(over="ignore"):
                value[place] = mix(hashed[place] * _ODD + own[place + size - 1])  # noqa: F821
        if size <= len(bits):
            row = bits[size - 1]
            a, b = cells(value[place], row.shape[1] * 8)
            place = place[(row[0][a >> 3] >> (a & 7) & 1 != 0) & (row[1][b >> 3] >> (b & 7) & 1 != 0)]
        yield place, value[place]
        ok, hashed = np.zeros(len(ids) + 1, bool), value
        ok[place] = True


def folded(bits: np.ndarray) -> np.ndarray:
    """bits for half as many cells, again and again, as long as one bit in ROOM is set at most. A cell's bit lies at its number modulo the cells that are left."""
    most = int(np.bitwise_count(bits).sum(axis=1, dtype=np.int64).max())
    while bits.shape[1] > 1 and ROOM * most <= bits.shape[1] * 4:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def sketch(texts: DataFrame, size: int, bits: list[np.ndarray], most: int, least: int) -> np.ndarray:
    """Bits of two rows, folded: whether phrases of size words that share one of most cells occur least times together."""
    folds = max(1, min(most, MOST_BITS) // SLICE)

    def run(batches):
        for part in phrases(batches):
            found = [h for lang, ids, words in part for k, (_, h) in enumerate(levels(ids, hashes(lang, words), bits, size), 1) if k == size]
            for row, cell in enumerate(cells(np.concatenate(found), most)):
                if not len(cell):
                    continue
                cell, n = np.unique(cell, return_counts=True)
                edge = np.flatnonzero(np.concatenate([[True], cell[1:] // SLICE != cell[:-1] // SLICE]))
                low, n = (cell % SLICE).astype("<u2"), np.minimum(n, least).astype(np.uint8)
                ends = np.append(edge[1:], len(cell))
                at = list(zip(edge.tolist(), ends.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), row, np.int32)), pa.array((cell[edge] // SLICE).astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in at], pa.binary()), pa.array([n[a:b].tobytes() for a, b in at], pa.binary())], ["row", "slice", "cells", "n"])

    def merge(batches):
        at, total, full = None, np.zeros(SLICE, np.int64), np.zeros(SLICE // 8, np.uint8)

        def done(key):
            """Ends a slice; and a fold, if key is of another."""
            full[:] |= np.packbits(total >= least, bitorder="little")
            total[:] = 0
            if key[:2] != at[:2]:
                if full.any():
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in at[:2]] + [pa.array([full.tobytes()], pa.binary())], ["row", "fold", "bits"])
                full[:] = 0

        for batch in batches:
            for *key, where, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    if at is not None:
                        yield from done(key)
                    at = key
                total[np.frombuffer(where, "<u2")] += np.frombuffer(n, np.uint8)  # a cell stands once in a row
        if at is not None:
            yield from done([])

    sparse = texts.mapInArrow(run, "row int, slice int, cells binary, n binary").select("row", (F.col("slice") % folds).alias("fold"), "slice", "cells", "n")
    merged = sparse.repartition("row", "fold").sortWithinPartitions("row", "fold", "slice").mapInArrow(merge, "row int, fold int, bits binary")
    out = np.zeros((2, folds * SLICE // 8), np.uint8)
    with shuffles_dropped(texts.sparkSession):
        found = merged.toArrow()  # at most 2 x MOST_BITS / 8 bytes
    for row, fold, own in zip(*(c.to_pylist() for c in found.columns), strict=True):
        out[row, fold * (SLICE // 8) : (fold + 1) * (SLICE // 8)] = np.frombuffer(own, np.uint8)
    return folded(out)


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, size, n: exact counts of all phrases of up to longest words that occur least times; size 0: all words of a lang."""
    texts = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("raw"))
    size = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    most = min(MOST_CELLS, 1 << max(SLICE.bit_length() - 1, (size // BYTES_PER_CELL).bit_length()))
    bits: list[np.ndarray] = []
    for words in range(1, longest + 1):
        bits.append(sketch(texts, words, bits, most, least))

    def run(batches):
        for part in phrases(batches):
            for lang, ids, words in part:
                sizes, texts_, ns = [0], [b""], [int((ids > 0).sum())]
                number = ids.astype(np.int64)
                for size, (place, _) in enumerate(levels(ids, hashes(lang, words), bits, longest), 1):
                    key = number[place] if size == 1 else number[place] << 32 | ids[place + size - 1]
                    _, first, same, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    number = np.zeros(len(ids), np.int64)
                    number[place] = same
                    sizes += [size] * len(n)
                    ns += n.tolist()
                    own = [[words[k] for k in ids[place[first] + j].tolist()] for j in range(size)]
                    texts_ += map(b" ".join, zip(*own, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ns), pa.string()), pa.array(texts_, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(ns, pa.int64())], ["lang", "phrase", "size", "n"])

    found = texts.mapInArrow(run, "lang string, phrase string, size int, n bigint")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where((F.col("size") == 0) | (F.col("n") >= least))


def _join(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counted: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of several words that no longer one subsumes."""
    words, one = F.split("phrase", " "), F.lit(1)
    own = counted.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cut = own.withColumn("k", F.explode(F.sequence(one, F.col("size") - 1)))
    cut = cut.withColumns({"first": _join(words, one, F.col("k")), "rest": _join(words, F.col("k") + 1, F.col("size"))})
    part = lambda name, n: counted.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    cuts = both.select("lang", "phrase", F.struct(score.alias("score"), "k", "l", "r", "a").alias("cut"), F.lit(None).cast("bigint").alias("longer"))
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(one, F.col("size") - n + 1), lambda k: _join(words, k, n))))
    longer = own.where("size > 2").select("lang", F.explode(within).alias("phrase"), F.lit(None).cast(cuts.schema["cut"].dataType).alias("cut"), F.col("a").alias("longer"))
    best = cuts.union(longer).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    return best.where("longer is null or 100 * longer < 50 * cut.a").select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    counted = store(counts(docs, least, longest), "phrases")
    found = scored(counted)
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    for groups in STEPS:
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= top)
    return found.join(counted.where("size = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

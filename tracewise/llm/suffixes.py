"""Op 5. Suffix-array dedup: repeated byte strings by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `least` bytes that covers it also starts earlier (in a smaller
doc_id, or earlier in its document). Equal strings must meet in one place although no place
holds the corpus:

1. Anchors. Each window of `least` bytes has an anchor, the leftmost smallest hash among its
   16-byte substrings, so equal windows have equal anchors at equal offsets. Windows with
   the same anchor are neighbours and form a region of the text.
2. Anchors that occur once are out: occurrences are counted, and a filter of fixed size says
   which regions to emit. False positives cost time only.
3. Equal regions are one; all but the first are repeats as a whole. Only digests travel here.
4. Different regions with one anchor meet in a task, HOT of them at most. What shares no window's hash with another
   of them is cut off, as it can't repeat. Of the rest's concatenation a suffix order is
   built to a depth beyond `least`, and from its Burrows-Wheeler transform common prefixes
   are derived by increasing value: intervals of strings of length l are extended backward to
   length l + 1, breadth first, and each right boundary seen for the first time gets l. At
   `least` the expansion stops, and boundaries without a value separate nothing: what lies
   between two others is one string of `least` bytes. Its earliest start stays.
5. An anchor with more different regions than that (a passage with many surroundings) isn't
   gathered: its windows go out one by one as in 3, equal ones meet by their digests in a
   sorted stream, and all but the first are repeats. So no task holds more than a block.

Matches never cross documents, because regions lie within one. Strings are judged on the
input, not on what is left.

Cases: null text is the empty text. Texts shorter than least lose nothing. Rows that share a
doc_id are one document. Rows without a doc_id lose nothing. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.shared import batches_of, release, shuffles_dropped, store, with_hit
from tracewise.llm.shingles import BASE, INVERSE, _powers, mix

LEAST = 100
GRAM = 16
PLACE_BITS = 28
#: Bits of the filter over anchors.
FILTER = 1 << 26
#: Bytes of text that anchors are found in, and that a transform is built of, at a time.
PART = 1 << 18
#: Bytes of one text that anchors are found in at a time; below 2^PLACE_BITS with the overlap.
SLICE = 1 << 26
BLOCK = 1 << 19
#: Rows that go to a worker at a time: whole texts, beside those that it makes of them.
ROWS = 512
#: Different regions of one anchor, of at most 2 * least bytes each, that go into one block.
HOT = 2048
#: Rows of the shuffle of texts: a region that is wanted, a region's text, a window's digest.
MARK, TEXT, WINDOW = range(3)


def _values() -> np.ndarray:
    return np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


VALUE = _values()


def rolling_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram bytes from each place on."""
    size = 1 << max(20, int(len(raw)).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(VALUE[raw] * _powers(BASE, size)[: len(raw)], out=total[1:])
        return mix((total[gram:] - total[:-gram]) * _powers(INVERSE, size)[: max(0, len(raw) - gram + 1)])


def regions(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Anchor hash, text number, first and last window start (in its text) of each region."""
    none = np.zeros(0, np.int64)
    if sum(map(len, texts)) > max(SLICE, 2 * least) and (len(texts) > 1 or len(texts[0]) > SLICE + least):
        # window by window nothing changes where a text is sliced, a region only ends there
        out = [(a, np.full(len(a), k), f + lo, t + lo) for k, text in enumerate(texts) for lo in range(0, len(text), SLICE) for a, _, f, t in [regions([text[lo : lo + SLICE + least - 1]], least)]]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none,) * 4
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < least:
        return none, none, none, none
    hashes = rolling_hashes(raw)
    place = np.uint64((1 << PLACE_BITS) - 1)
    low = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    width, have = least - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    ends = np.cumsum([len(t) for t in texts])
    lengths = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(texts)), lengths)[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + least <= ends[text])
    if not len(start):
        return none, none, none, none
    anchor = (low[start] & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(start)) - 1
    number = text[start[first]]
    shift = (ends - lengths)[number]
    return hashes[anchor[first]].view(np.int64), number, start[first] - shift, start[last] - shift


def _groups(batches) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        rows, group, size, at = batch.column("raw").to_pylist(), [], 0, 0
        for k, raw in enumerate(rows):
            group.append(raw or b"")
            size += len(group[-1])
            if size > PART or k == len(rows) - 1:
                yield batch.slice(at, len(group)), group
                group, size, at = [], 0, k + 1


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of a text of small numbers, ordered by at least depth symbols."""
    key = np.zeros(len(text), np.uint64)
    for k in range(7):  # symbols are below 2^9
        key = (key << np.uint64(9)) | np.roll(text, -k).astype(np.uint64)
    have = 7
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while have < depth and rank.max() + 1 < len(text):
        rank = np.unique(rank * (1 << 32) + np.roll(rank, -have), return_inverse=True)[1].astype(np.int64)
        have *= 2
    return np.argsort(rank, kind="stable")


def boundaries(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common-prefix lengths below least of neighbours in the order; -1 where they are least or more.

    out[i] belongs to the places i - 1 and i. Derived from the transform alone.
    """
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)
    forward[by_symbol] = np.arange(n)  # the place of the rotation that starts one symbol earlier
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    previous, following = np.full(n, -1), np.full(n, n)
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    out = np.full(n + 1, -1, np.int64)
    out[0] = out[n] = 0
    left, right = np.array([0]), np.array([n])
    for length in range(least):
        width = right - left
        total = int(width.sum())
        if not total:
            break
        at = np.arange(total) + np.repeat(left - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        a = np.sort(forward[at[previous[at] < np.repeat(left, width)]])
        b = np.sort(forward[at[following[at] >= np.repeat(right, width)]]) + 1
        new = out[b] < 0  # where a shorter string's interval ended, its extensions have set what this one's would
        out[b[new]] = length
        left, right = a[new], b[new]
    return out


def repeated_starts(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(piece, first, last) offsets of windows in a piece whose string also starts earlier in another."""
    lengths = np.array([len(p) for p in pieces])
    text = np.zeros(int(lengths.sum()) + len(pieces), np.uint16)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    offset = np.arange(len(text)) - begin[piece]
    text[offset < lengths[piece]] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    order = suffix_order(text, least)
    cut = boundaries(text, order, least)[:-1] >= 0
    kind = np.cumsum(cut)
    valid = offset[order] + least <= lengths[piece[order]]
    place, kind = order[valid], kind[valid]
    p = piece[place]
    by = np.lexsort((starts[p] + offset[place], docs[p], kind))
    place, kind = place[by], kind[by]
    again = np.concatenate([np.zeros(min(1, len(kind)), bool), kind[1:] == kind[:-1]])
    hit = np.sort(place[again])
    if not len(hit):
        return []
    edge = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
    end = np.append(edge[1:], len(hit)) - 1
    return list(zip(piece[hit[edge]].tolist(), offset[hit[edge]].tolist(), offset[hit[end]].tolist(), strict=True))


def shared_parts(pieces: list[bytes], anchors: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Piece number, offset and bytes of the parts from a piece's first to its last window whose hash occurs twice under its anchor."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    begins = ends - np.diff(ends, prepend=0)
    hashes = rolling_hashes(raw, least)
    piece = np.repeat(np.arange(len(pieces)), ends - begins)[: len(hashes)]
    at = np.flatnonzero(np.arange(len(hashes)) + least <= ends[piece])
    with np.errstate(over="ignore"):
        window = hashes[at] ^ mix(anchors[piece[at]].view(np.uint64))
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    hit = at[count[inverse] > 1]
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    number, first = np.unique(piece[hit], return_index=True)
    last = np.append(first[1:], len(hit)) - 1
    a, b = hit[first] - begins[number], hit[last] - begins[number] + least
    return number, a, [pieces[k][x:y] for k, x, y in zip(number.tolist(), a.tolist(), b.tolist(), strict=True)]


def _filter(bits: DataFrame) -> np.ndarray:
    """FILTER bits as bytes, those in the column bit set: FILTER / 8 bytes, whatever the input."""
    maps = np.zeros((FILTER // 32768, 4096), np.uint8)
    bit = F.col("bit") + 1  # the bitmap functions count from 1
    found = bits.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("map"))
    with shuffles_dropped(bits.sparkSession):
        rows = found.toArrow()
    for r in rows.to_pylist():
        maps[r["bucket"] - 1] = np.frombuffer(r["map"], np.uint8)
    return maps.ravel()


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def removed_ranges(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, begin, end of byte ranges to remove; they may overlap."""
    raw = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("raw"))

    def anchors(batches):
        for _, texts in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(regions(texts, least)[0])], ["anchor"])

    several = raw.mapInArrow(anchors, "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    def kept(batches, flat: np.ndarray, bit) -> Iterator[tuple]:
        """Regions whose bit is set: part, texts, anchor, text number, first, last."""
        for part, texts in _groups(batches):
            anchor, number, first, last = regions(texts, least)
            at = bit(anchor, part.column("doc_id").to_numpy()[number], first)
            some = np.flatnonzero((flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            yield part, texts, anchor[some], number[some], first[some], last[some]

    repeated = _filter(several.select(F.pmod("anchor", F.lit(FILTER)).alias("bit")))

    def digests(batches):
        for part, texts, anchor, number, first, last in kept(batches, repeated, lambda a, d, f: np.mod(a, FILTER)):
            keys = [_digest(texts[k][a : b + least]) for k, a, b in zip(number.tolist(), first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(keys, pa.int64()), part.column("doc_id").take(pa.array(number)), pa.array(first), pa.array(last - first)], ["anchor", "key", "doc_id", "first", "more"])

    found = store(raw.mapInArrow(digests, "anchor bigint, key bigint, doc_id bigint, first bigint, more bigint"), "regions")
    same = ["anchor", "key", "more"]
    counted = found.groupBy(*same).agg(F.min(F.struct("doc_id", "first")).alias("at"), F.count("*").alias("n"))
    unique = store(counted.withColumn("kinds", F.count("*").over(Window.partitionBy("anchor"))), "unique")
    later = found.join(unique.where("n > 1").select(*same, "at"), same).where(F.struct("doc_id", "first") != F.col("at"))
    copies = store(later.select("doc_id", F.col("first").alias("begin"), (F.col("first") + F.col("more") + least).alias("end")), "copies")
    wanted = unique.where("kinds > 1").select("anchor", "at.*", "kinds")
    hot = np.sort(wanted.where(F.col("kinds") > HOT).select("anchor").distinct().toArrow().column("anchor").to_numpy())
    place = F.pmod(F.pmod("doc_id", F.lit(FILTER)) * 40503 + F.col("first") * 9973, F.lit(FILTER))
    needed = _filter(wanted.select(place.alias("bit")))
    release(found)  # before the texts are shuffled, which takes the most disk
    layout = "anchor bigint, deal bigint, doc_id bigint, first bigint, kind tinyint, piece binary"
    names = [c.split()[0] for c in layout.split(", ")]

    def texts_of(batches):
        for part, texts, anchor, number, first, last in kept(batches, needed, lambda a, d, f: np.mod(np.mod(d, FILTER) * 40503 + f * 9973, FILTER)):
            many = np.isin(anchor, hot)
            few, some = np.flatnonzero(~many), np.flatnonzero(many)
            pieces = [texts[k][a : b + least] for k, a, b in zip(number[few].tolist(), first[few].tolist(), last[few].tolist(), strict=True)]
            windows = last[some] - first[some] + 1
            some = np.repeat(some, windows)
            at = first[some] + np.arange(len(some)) - np.repeat(np.cumsum(windows) - windows, windows)
            keys = np.array([_digest(texts[k][w : w + least]) for k, w in zip(number[some].tolist(), at.tolist(), strict=True)], np.int64)
            rows = np.concatenate([few, some])
            columns = [anchor[rows], np.concatenate([anchor[few], keys]), part.column("doc_id").to_numpy()[number[rows]], np.concatenate([first[few], at]), np.repeat(np.array([TEXT, WINDOW], np.int8), [len(few), len(some)])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(pieces + [None] * len(some), pa.binary())], names)

    # a filter lets more through as it fills, so texts go on only where a mark says that they are wanted
    marks = wanted.where(F.col("kinds") <= HOT).select("anchor", F.col("anchor").alias("deal"), "doc_id", "first", F.lit(MARK).cast("tinyint").alias("kind"), F.lit(None).cast("binary").alias("piece"))
    groups = marks.union(raw.mapInArrow(texts_of, layout)).repartition("deal").sortWithinPartitions("anchor", "deal", "doc_id", "first", "kind")

    def expand(batches):
        block: list[tuple] = []
        size, marked, earliest = 0, None, (None,) * 4

        def ranges(rows):
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "begin", "end"])

        def done():
            anchor, doc, start, pieces = zip(*block, strict=True)
            number, shift, pieces = shared_parts(list(pieces), np.array(anchor, np.int64), least)
            doc, start = np.array(doc, np.int64)[number], np.array(start, np.int64)[number] + shift
            return ranges([(int(doc[k]), int(start[k]) + a, int(start[k]) + b + least) for k, a, b in repeated_starts(pieces, doc, start, least)] if pieces else [])

        for batch in batches:
            again = []
            for anchor, deal, doc, first, kind, piece in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if kind == WINDOW:
                    if earliest[:2] != (anchor, deal):
                        earliest = (anchor, deal, doc, first)
                    elif earliest[2:] != (doc, first):
                        again.append((doc, first, first + least))
                elif kind == MARK:
                    marked = (anchor, doc, first)
                elif marked == (anchor, doc, first):
                    if size > BLOCK and anchor != block[-1][0]:
                        yield done()
                        block, size = [], 0
                    block.append((anchor, doc, first, piece))
                    size += len(piece) + 1
            if again:
                yield ranges(again)
        if block:
            yield done()

    return copies.union(groups.mapInArrow(expand, "doc_id bigint, begin bigint, end bigint"))


def dedup_bytes(docs: DataFrame, least: int = LEAST, emit: str = "digests") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, and the kept bytes' SHA-256 (emit="bytes": the kept bytes)."""
    with batches_of(docs.sparkSession, ROWS):
        ranges = store(removed_ranges(docs, least), "ranges")
    own = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    split = with_hit(base, ranges, "doc_id")
    some = split.where("_hit").join(own, "doc_id", "left")
    none = split.where("not _hit").withColumn("ranges", F.lit(None).cast("array<struct<begin: bigint, end: bigint>>"))
    last = "kept_sha256" if emit == "digests" else "kept"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for raw, spans in zip(part.column("raw").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    raw, kept, end, removed, n, open_at = raw or b"", [], 0, 0, 0, -1
                    for a, b in sorted((s["begin"], s["end"]) for s in spans or ()):
                        if a > end or open_at < 0:
                            kept.append(raw[end:a])
                            n, open_at = n + 1, a
                            removed += b - a
                        elif b > end:
                            removed += b - end
                        end = max(end, b)
                    kept = b"".join([*kept, raw[end:]])
                    rows.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest() if emit == "digests" else kept))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string() if emit == "digests" else pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", last])

    return some.unionByName(none).select("doc_id", "raw", "ranges").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'string' if emit == 'digests' else 'binary'}")

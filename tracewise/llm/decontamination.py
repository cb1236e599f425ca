"""Op 11. Benchmark decontamination: an FM-index per shard of the corpus, searched backward for every test phrase.

A phrase (window) is `size` consecutive words of an item, or a whole item that has fewer. Every
task cuts its documents into shards of bounded size. Words outside the test phrases can't take
part, so a shard's index holds only its passages: maximal runs of words of the phrases, long
enough to hold one. Backward search through wavelet ranks finds all phrases at once, sampled
places tell where they occur, and overlapping occurrences merge to spans. Documents are read
once and never shuffled.

The phrases travel to the tasks in blocks of about BLOCK bytes of items, whatever the
benchmark's size; the blocks follow one another in a chain that adds to the spans found so far.

Cases: null and empty texts have no words, and items without words no phrase. A text longer
than a shard is cut into slices that overlap by less than a phrase. Rows are documents, also
where they share a doc_id or have none. Rows of the benchmark that share an item_id are one
item; those without one count as the item ''. Empty tables give no rows, or no hits. Extra
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.fmindex import FMIndex
from tracewise.llm.terms import parts, plain_words

SIZE = 10
#: Bytes of items in a block, of texts in a shard, and words that are numbered at a time.
BLOCK, SHARD, SLICE = 1 << 22, 1 << 24, 1 << 22
_FOUND = "spans array<struct<begin: bigint, end: bigint>>, items array<string>"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Phrases:
    """The windows of a block of items: numbered words, a row per different window, and the items that each comes from."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.number: dict[bytes, int] = {}
        windows: dict[tuple, list[int]] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        for name, raw in items:
            found = [self.number.setdefault(w, len(self.number) + 1) for w in plain_words(raw)]
            for k in range(min(len(found), max(1, len(found) - size + 1))):
                windows.setdefault(tuple(found[k : k + size]), []).append(place[name])
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.rows = np.zeros((len(windows), size), np.int32)
        for k, w in enumerate(windows):
            self.rows[k, size - len(w) :] = w
        own = [sorted(set(v)) for v in windows.values()]
        self.starts = np.cumsum([0, *map(len, own)])
        self.items = np.array([x for v in own for x in v], np.int64)
        # for each length of window: which words such windows have
        self.by_size = {}
        for s in np.unique(self.sizes).tolist():
            self.by_size[s] = np.zeros(len(self.number) + 1, bool)
            self.by_size[s][self.rows[self.sizes == s, size - s :].ravel()] = True

    def passages(self, words: np.ndarray) -> np.ndarray:
        """Which words lie in a run that can hold a window: as long as one, of words of windows of that length."""
        out = np.zeros(len(words), bool)
        for s, own in self.by_size.items():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own[words], [0]]).astype(np.int8)))
            begin, end = edge[::2], edge[1::2]
            long = end - begin >= s
            step = np.zeros(len(words) + 1, np.int64)
            step[begin[long]] += 1
            step[end[long]] -= 1
            out |= np.cumsum(step[:-1]) > 0
        return out

    def occurrences(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and place of each occurrence in an array of numbered words, where 0 is none."""
        some = np.flatnonzero(self.passages(words))
        if not len(some):
            return some, some
        last = np.flatnonzero(np.concatenate([some[1:] != some[:-1] + 1, [True]]))
        text = np.insert(words[some], last + 1, 0)
        at = np.insert(some, last + 1, -1)
        index = FMIndex(text, len(self.number))
        lo, hi = index.ranges(self.rows, self.sizes)
        count = np.maximum(hi - lo, 0)
        window = np.repeat(np.arange(len(count)), count)
        row = np.arange(len(window)) + np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        return window, at[index.locate(row)]

    def search(self, texts: list[bytes | None]) -> tuple[list[int], dict[int, list], dict[int, set]]:
        """Words of each text; by text the word spans that windows cover, which may touch, and the items they come from."""
        total, spans, items = [0] * len(texts), {}, {}
        block: list[tuple[int, int, np.ndarray]] = []
        size, get, over = 0, self.number.get, self.rows.shape[1] - 1

        def done():
            ends = np.cumsum([len(w) + 1 for _, _, w in block])
            window, place = self.occurrences(np.concatenate([w for *_, own in block for w in (own, np.zeros(1, np.int32))]))
            length = self.sizes[window]
            step = np.zeros(int(ends[-1]) + 1, np.int64)
            np.add.at(step, place, 1)
            np.add.at(step, place + length, -1)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(step) > 0]).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                k = int(np.searchsorted(ends, a, "right"))
                text, first, w = block[k]
                shift = first - (int(ends[k]) - len(w) - 1)
                spans.setdefault(text, []).append((a + shift, b + shift))
            pairs = np.unique(np.searchsorted(ends, place, "right") * len(self.sizes) + window)
            for k, w in zip((pairs // len(self.sizes)).tolist(), (pairs % len(self.sizes)).tolist(), strict=True):
                items.setdefault(block[k][0], set()).update(self.items[self.starts[w] : self.starts[w + 1]].tolist())
            block.clear()

        for k, raw in enumerate(texts):
            words = plain_words(raw)
            total[k] = len(words)
            for at in range(0, max(1, len(words) - over), SLICE):
                own = words[at : at + SLICE + over] if len(words) > SLICE else words
                if own:
                    block.append((k, at, np.fromiter((get(w, 0) for w in own), np.int32, len(own))))
                    size += len(own)
                if size >= SLICE:
                    done()
                    size = 0
        if block:
            done()
        return total, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of spans, and what stands between words of one span."""
    places = [m.span() for m in _WORD.finditer(raw)]
    cut = [(places[a][0], places[b - 1][1]) for a, b in spans]
    ends = [0, *(b for _, b in cut)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in cut), len(raw)], strict=True))


def blocks(benchmark: DataFrame, most: int = BLOCK) -> list[list[tuple[str, bytes]]]:
    """The items that have a text, as lists of about `most` bytes; a longer item makes a list of its own length. Read block by block."""
    own = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("raw"))
    total = own.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(1, -(-total // most))
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    read = lambda k: own.where(part == k).toArrow()
    return [list(zip(t.column("item").to_pylist(), t.column("raw").to_pylist(), strict=True)) for t in map(read, range(n))]


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, emit: str = "spans") -> DataFrame:
    """Per document: doc_id, n_words, spans of words that test phrases cover, and the items (emit="text": also the text without them)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("binary").alias("raw"), F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(_FOUND.split(" ", 1)[1].rsplit(", ", 1)[0]).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    every = blocks(benchmark)
    for k, block in enumerate(every):
        phrases, last = Phrases(block, size), k == len(every) - 1

        def run(batches, phrases=phrases, last=last):
            for part in parts(batches, "raw", SHARD):
                texts, spans, items = (part.column(c).to_pylist() for c in ("raw", "spans", "items"))
                total, new, found = phrases.search(texts)
                spans = [merged([(s["begin"], s["end"]) for s in a or ()] + new.get(k, [])) for k, a in enumerate(spans)]
                items = [sorted({*(a or ()), *(phrases.names[i] for i in found.get(k, ()))}) for k, a in enumerate(items)]
                if last and emit == "text":
                    texts = [None if raw is None else without(raw, s) if s else raw for raw, s in zip(texts, spans, strict=True)]
                elif last:
                    texts = [None] * len(texts)
                pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                spans = [[{"begin": a, "end": b} for a, b in s] for s in spans]
                columns = [part.column("doc_id"), pa.array(texts, pa.binary()), pa.array(total, pa.int64()), pa.array(spans, pairs), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "raw", "n_words", "spans", "items"])

        out = out.mapInArrow(run, f"doc_id {kind}, raw binary, n_words bigint, {_FOUND}")
    text = [F.col("raw").cast("string").alias("text")] if emit == "text" else []
    return out.select("doc_id", "n_words", "spans", "items", *text)


def digests(found: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, the items' SHA-256, and whether any word is hit."""
    hit: Column = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )

"""Op 1. Byte-pair encoding and decoding by a pair occurrence index.

The distinct words of a group of texts, those that the worker's cache lacks, are laid end to
end. An index maps each mergeable pair to all its positions in that layout; ranks that occur are taken in ascending order from a heap,
every position of the pair is merged, and only the lists of the pairs to its left and
right are updated. A pair that contains a new symbol always has a higher rank than the
symbol's own (checked on load), so one ascending pass is exact.

Cases: null text is the empty text (no ids, empty decoding). Special tokens inside a text
become their ids, as the tokenizers library does by default. A text is cut at white
space, so its length bounds only its own row; the caches are bounded, and what has not been
used for a while leaves them. Repeated rows, ties and empty tables need no rule; extra columns are ignored unless
named in keep.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Bytes of a worker's caches of pieces and of words; see Recent.
PIECES, WORDS = 160 << 20, 96 << 20
#: Pieces, and eights of characters, that are cut before the new pieces among them are encoded in one index.
GROUP = 400_000
#: A pair of symbols as one number: the left one shifted so far, and the right one.
SHIFT = 20

# The public pre-tokenizer pattern and the control characters that
# Python counts as white space and the patterns don't.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary files: printable Latin-1 stands for itself, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairIndex:
    """A BPE vocabulary file, and encoding of many words at a time."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.byte = {c: bytes([b]) for b, c in enumerate(letters)}
        self.rank: dict[int, int] = {}
        self.merged: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for r, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]):
            x, y = vocab[a], vocab[b]
            z = vocab[(a.removesuffix(self.suffix) if self.suffix else a) + b]
            if made.get(x, -1) >= r or made.get(y, -1) >= r or z in made:
                raise ValueError(f"merge {r} uses a symbol that isn't made before it, or makes one anew")
            made[z] = r
            self.rank[x << SHIFT | y] = r
            self.merged.append((x, y, z))

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def first_ranks(self) -> np.ndarray:
        """Rank of each pair of single letters, the second of which may end a word (256 on); -1 where they don't merge."""
        out = np.full((256, 512), -1, np.int32)
        for x, a in enumerate(self.first):
            for y, b in enumerate([*self.first, *self.last]):
                out[x, y] = self.rank.get(a << SHIFT | b, -1)
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, none of them empty; words that occur many times should be given once."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        closes = np.zeros(len(raw), bool)
        closes[ends - 1] = True
        opens = np.roll(closes, 1)
        places = np.arange(len(raw))
        letters = np.where(closes, raw + np.int64(256), raw)
        found = np.where(closes[:-1], -1, self.first_ranks[raw[:-1], letters[1:]])
        at = np.flatnonzero(found >= 0)
        at = at[np.argsort(found[at], kind="stable")]
        edges = np.flatnonzero(np.diff(found[at], prepend=-1))
        lists = zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True)
        flat = at.tolist()
        index = {int(found[flat[a]]): flat[a:b] for a, b in lists}  # rank of a pair -> all its positions, in order
        symbol = np.array([*self.first, *self.last])[letters].tolist()
        after, before = np.where(closes, -1, places + 1).tolist(), np.where(opens, -1, places - 1).tolist()
        rank, merged = self.rank.get, self.merged
        active = list(index)  # ascending already, which is a heap
        while active:
            r = heapq.heappop(active)
            a, b, c = merged[r]
            positions = index.pop(r)
            for p in sorted(positions) if a == b else positions:
                if symbol[p] != a or (q := after[p]) < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = c, -1
                after[p] = nxt = after[q]
                if nxt >= 0:
                    before[nxt] = p
                    if (s := rank(c << SHIFT | symbol[nxt])) is not None:
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(active, s)
                if (prev := before[p]) >= 0 and (s := rank(symbol[prev] << SHIFT | c)) is not None:
                    if s in index:
                        index[s].append(prev)
                    else:
                        index[s] = [prev]
                        heapq.heappush(active, s)
        left = np.array(symbol)
        ids = left[left >= 0].tolist()
        upto = np.cumsum(left >= 0)[ends - 1].tolist()
        return [ids[x:y] for x, y in zip([0, *upto], upto, strict=False)]


class Recent(dict):
    """A bounded cache: at most 2 * size bytes and what came with one group. Entries in use stay.

    weight tells the bytes of entries. They are counted when they are new, so that hits cost nothing.
    """

    def __init__(self, size: int, weight):
        super().__init__()
        self.size, self.weight, self.bytes, self.older = size, weight, 0, {}

    def learn(self, entries: list[tuple]) -> None:
        self.update(entries)
        self.bytes += self.weight(entries)

    def missing(self, keys: set) -> list:
        """Of keys, those that aren't known. The others are entries from now on."""
        new = keys.difference(self)
        if self.older:
            older = self.older
            known = [k for k in new if k in older]
            self.learn([(k, older[k]) for k in known])
            new.difference_update(known)
        return list(new)

    def trim(self) -> None:
        if self.bytes > self.size:
            self.older, self.bytes = dict(self), 0
            self.clear()


def _key_chars(entries: list[tuple]) -> int:
    return sum(map(len, map(itemgetter(0), entries)))


def _piece_bytes(entries: list[tuple]) -> int:
    """About what pieces take with their forms: both grow with the number of ids, which a form begins with."""
    return 300 * len(entries) + 8 * _key_chars(entries) + 32 * sum(map(itemgetter(0), map(itemgetter(1), entries)))


def _word_bytes(entries: list[tuple]) -> int:
    return 200 * len(entries) + 4 * _key_chars(entries) + 40 * sum(map(len, map(itemgetter(1), entries)))


class Encoder:
    """Cuts texts into pieces that encode apart from one another, and keeps what it has encoded.

    A value of the cache is (number of ids, their form for joining); form makes it from ids.
    """

    def __init__(self, model: PairIndex, form):
        self.model, self.form = model, form
        self.pattern = regex.compile(WORD_PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, model.special))) if model.special else None
        self.pieces, self.words = Recent(PIECES, _piece_bytes), Recent(WORDS, _word_bytes)

    def cut(self, text: str) -> list[str]:
        """Pieces between which no token reaches. Special tokens are pieces of their own."""
        if self.marks and (found := self.marks.search(text)):
            out = []
            while found:
                out += self.cut(text[: found.start()])
                out.append(found[0])
                text = text[found.end() :]
                found = self.marks.search(text)
            return out + self.cut(text)
        return regex.findall(r"\S+", text) if any(c in text for c in SEPARATORS) else text.split()

    def tokens_of(self, piece: str) -> list[str]:
        """Words of a piece. Characters that this Python's Unicode tables lack are classed by the library itself."""
        if piece.isascii():
            return self.pattern.findall(piece.lower())
        if "Cn" in map(unicodedata.category, piece):
            library = self.model.library
            found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(piece))
            return [b"".join(self.model.byte[c] for c in word).decode("utf-8") for word, _ in found]
        piece = unicodedata.normalize("NFC", piece)
        piece = "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()
        return self.pattern.findall(piece)

    def learn(self, pieces: set[str]) -> None:
        """Make all of these pieces entries of the cache. The words that are new in them are encoded in one index."""
        special, words, form = self.model.special, self.words, self.form
        self.pieces.trim()
        words.trim()
        new = self.pieces.missing(pieces)
        cut = [self.tokens_of(p) if p not in special else [] for p in new]
        unseen = words.missing({w for t in cut for w in t})
        words.learn(list(zip(unseen, self.model.encode_words([w.encode("utf-8") for w in unseen]) if unseen else (), strict=True)))
        self.pieces.learn([(p, form(words[t[0]] if len(t) == 1 else [i for w in t for i in words[w]] if t else [special[p]])) for p, t in zip(new, cut, strict=True)])

    def texts(self, texts: list[str | None]) -> Iterator[list]:
        """For each text, the cached values of its pieces in order."""
        get = self.pieces.__getitem__
        group, size = [], 0
        for text in [*texts, None]:
            if text is not None:
                group.append(self.cut(text))
                size += len(group[-1]) + len(text) // 8
            if group and (text is None or size > GROUP):
                self.learn(set().union(*group))
                for pieces in group:
                    yield list(map(get, pieces))
                group, size = [], 0


def decode_word_ids(model: PairIndex, ids: Iterable[int]) -> str:
    """Text of ids where the file names no decoder: tokens joined by one blank."""
    return " ".join([model.tokens[i] for i in ids])


@lru_cache(maxsize=4)
def word_encoder(path: str) -> Encoder:
    """Values are (number of ids, ids in decimal, their decoding)."""
    model = PairIndex(path)
    decimal = {i: str(i) for i in model.tokens}
    return Encoder(model, lambda ids: (len(ids), " ".join([decimal[i] for i in ids]), decode_word_ids(model, ids)))


def _texts(batch: pa.RecordBatch, column: str, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts; null is the empty text."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", emit: str = "ids") -> DataFrame:
    """Encode each text with the word-ending vocabulary at path, and decode the ids again.

    emit="ids": key, ids array<int>, decoded string. emit="digests": key, n_tokens and the
    lower-case hex SHA-256 of the decimal ids joined by one blank and of the decoded text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            for part, texts in _texts(batch, text):
                counts, ids, decoded = [], [], []
                for values in encoder.texts(texts):
                    counts.append(sum(map(itemgetter(0), values)))
                    i, d = " ".join(map(itemgetter(1), values)), " ".join(map(itemgetter(2), values))
                    if emit == "ids":
                        ids.append([int(x) for x in i.split()])
                        decoded.append(d)
                    else:
                        ids.append(hashlib.sha256(i.encode()).hexdigest())
                        decoded.append(hashlib.sha256(d.encode()).hexdigest())
                if emit == "ids":
                    yield pa.RecordBatch.from_arrays([part.column(key), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [key, "ids", "decoded"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(key), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # nothing here makes reference cycles, and looking for them walks the caches over and over
        looking = gc.isenabled()
        gc.disable()
        try:
            yield from encoded(batches)
        finally:
            if looking:
                gc.enable()

    out = "ids array<int>, decoded string" if emit == "ids" else "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {out}")


"""Ops 1 and 6 against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracewise.llm import bpe, packing

WORDS, BYTES = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
ODD = [
    "", " ", "\n\n a", "a\x1cb \x1d c", "don't WE'LL ’s", "<|endoftext|>", "x<|endoftext|> y <|startoftext|>\n", "a <|endoftext|>  b", "ΑΣ ΣΑΣ İstanbul ǅ",
    "a  b   c\t\n d\n\n e \n", "é ́x ½²³ 123 x1", "aaaaaaa aaaa", "日本語テキスト", "🙂🙂 👩‍👩‍👧", "trailing   ", "\r\n\r\nx", "\u1c89 \u0558", "\x00",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encode_decode(make, texts):
    rows = [*texts, *enumerate(ODD, 1000)]
    library = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r for r in bpe.encode_decode(make(rows), WORDS, emit="digests").collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))), repr(t)[:60]


def test_encode_gives_ids(make):
    got = bpe.encode_decode(make([(1, "the cat"), (1, "the cat"), (None, None)]), WORDS).collect()
    ids = Tokenizer.from_file(WORDS).encode("the cat", add_special_tokens=False).ids
    assert [r["ids"] for r in got] == [ids, ids, []]
    assert bpe.encode_decode(make([]), WORDS).collect() == []


def test_pair_index_equals_the_library_on_every_character():
    library, own = Tokenizer.from_file(WORDS), bpe.word_encoder(WORDS)
    parts = ["a" + chr(c) + "b " + chr(c) for c in range(0, 0x3000, 3)]
    for values, e in zip(own.texts(parts), library.encode_batch(parts, add_special_tokens=False), strict=True):
        assert " ".join(v[1] for v in values) == " ".join(map(str, e.ids))


def test_caches_are_bounded_in_bytes(monkeypatch):
    """Long pieces without blanks, more than the bound: results stay those of the library, entries in use stay, old ones go."""
    import random

    monkeypatch.setattr(bpe, "PIECES", 1 << 16)
    monkeypatch.setattr(bpe, "WORDS", 1 << 16)
    monkeypatch.setattr(bpe, "GROUP", 40)
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    model = bpe.PairIndex(path)
    encoder = bpe.Encoder(model, lambda ids: (len(ids), " ".join(map(str, ids)), ""))
    texts = ["often " + "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120)) for _ in range(300)]
    library = Tokenizer.from_file(path)
    most = 0
    for text, values in zip(texts, encoder.texts(texts), strict=True):
        assert " ".join(v[1] for v in values).split() == [str(i) for i in library.encode(text, add_special_tokens=False).ids]
        most = max(most, sum(bpe._piece_bytes(list(d.items())) for d in (encoder.pieces, encoder.pieces.older)))
    assert "often" in encoder.pieces and most < 2 * (1 << 16) + 2 * 40 * 10_000
    assert len(encoder.pieces) + len(encoder.pieces.older) < 150


def test_packing(make, texts):
    rows = [*texts, *enumerate(ODD, 1000), (5000, "word " * 5000)]
    library = Tokenizer.from_file(BYTES)
    pieces = packing.pack(make(rows), BYTES).collect()
    places, own = {}, {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        own.setdefault(r["doc_id"], []).append(r)
    used = []
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        used.append(at)
    assert set(own) == {i for i, _ in rows}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(own[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = sum(1024 - n for n in used if n & (n - 1))
    assert padding < 0.1 * sum(used) + 1024
    assert packing.pack(make([]), BYTES).collect() == []


def test_plan_places_every_tail():
    rng = np.random.default_rng(3)
    lengths = np.minimum(1024, 1 + rng.integers(0, 1024, 20_000))
    have = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    p = packing.plan(have)
    fill = {}
    for length, n in have.items():
        rank = np.arange(n)
        k = np.searchsorted(p["at"], length * 2**44 + rank, "right") - 1
        for s in (p["sequence"][k] + rank - p["rank"][k]).tolist():
            fill[s] = fill.get(s, 0) + length
    assert max(fill.values()) <= 1024
    assert sum(1024 - n for n in fill.values() if n & (n - 1)) < 0.02 * lengths.sum()


def test_plan_places_repeated_lengths_as_ranges():
    for have in ({512: 200_001}, {700: 100_000}, {300: 90_000, 424: 40_000, 7: 3}, {512: 50_000, 256: 70_001, 1024: 5}):
        places = packing.plan(dict(have), 1024)
        assert len(places["at"]) < 200
        filled, total = {}, sum(have.values())
        for length, n in have.items():
            rank = np.arange(n)
            k = np.searchsorted(places["at"], length * 2**44 + rank, "right") - 1
            sequence = places["sequence"][k] + rank - places["rank"][k]
            for q, o in zip(sequence.tolist(), places["offset"][k].tolist(), strict=True):
                filled.setdefault(q, []).append((o, o + length))
        assert sum(map(len, filled.values())) == total and sorted(filled) == list(range(len(filled)))
        for spans in filled.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_long_runs_of_white_space():
    """The pattern's matcher alone gives up on these."""
    library, encode = Tokenizer.from_file(BYTES), packing.byte_encoder(BYTES)
    long = packing.LONG_RUN
    special = next(iter(library.get_added_tokens_decoder().values())).content
    for text in (" " * 2_000_000 + "x", "a" + "\n" * 1_200_000, "a \n" * 3 + " \t" * long + "\nb", "x" + " " * long, " " * long + special + " " * (long + 1) + special + "y", "\u3000" * long + "z", "\x1c" * long):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_plan_grows_with_lengths_not_with_tails():
    """A thousand million tails of three shapes; ranges cover each length's ranks without a gap."""
    rng = np.random.default_rng(9)
    shapes = [np.ones(1024), np.exp(-((np.log(np.arange(1, 1025)) - 5) ** 2)), np.bincount(rng.integers(1, 1025, 40), minlength=1025)[1:] + (np.arange(1, 1025) == 512) * 1e3]
    for shape in shapes:
        have = {k + 1: int(n) for k, n in enumerate(shape / shape.sum() * 1e9) if n >= 1}
        places = packing.plan(have)
        assert len(places["at"]) < 20_000
        length, rank = places["at"] // 2**44, places["rank"]
        assert set(length.tolist()) == set(have) and (rank[np.flatnonzero(np.diff(length, prepend=0))] == 0).all()

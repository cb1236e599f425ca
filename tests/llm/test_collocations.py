"""Phrase mining against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewise.llm import collocations

CUT = re.compile(r"[.,;:!?\x0A-\x0D]")


def brute(docs, least=10, longest=3, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in CUT.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f.update((lang or "und", tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    return judged({k: v for k, v in f.items() if v >= least}, n, top)


def judged(f, n, top=2000):
    by_lang = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or any(g == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[k : k + len(p)] == p for k in range(len(q))) for (g, q), b in f.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in by_lang.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = "aa B cé d'x E7 zz über f\x01   \U0001f600".split(" ")
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", "\n", "-", " \r"]) for _ in range(n))
    out = [(rng.choice(["en", "de", None]), text(rng.randrange(0, 50))) for _ in range(150)]
    out += [(None, "zz Q zz Q")] * 9 + [("en", None), ("en", ""), (None, " .,"), ("de", text(9000)), ("en", "one same line here")] + [("fr", "one same line, Twice the same line here")] * 12
    return out


def rows(spark, docs, **more):
    df = spark.createDataFrame([(k, t, lang, 1, "x", 5) for k, (lang, t) in enumerate(docs)], "doc_id bigint, text string, lang string, size int, phrase string, raw int")
    return sorted(tuple(r) for r in collocations.mine(df.repartition(3), **more).collect())


def test_phrases_are_those_of_brute_force(spark, docs):
    want = brute(docs)
    assert rows(spark, docs) == want and len(want) > 50 and {r[0] for r in want} == {"en", "de", "und", "fr"}


def test_crowded_sketches_and_small_parts_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_CELLS", 64)
    monkeypatch.setattr(collocations, "SLICE", 16)
    monkeypatch.setattr(collocations, "STEPS", (3, 1))
    want = brute(docs, 4, 4, 25)
    assert rows(spark, docs, least=4, longest=4, top=25) == want


def test_long_texts_are_cut_where_pieces_end(docs, monkeypatch):
    text = max((t or "" for _, t in docs), key=len).encode()
    monkeypatch.setattr(collocations, "PART", 200)
    cut = list(collocations._cut(text))
    assert b"".join(cut) == text and len(cut) > 20 and max(map(len, cut)) < 500
    assert all(k == 0 or p[:1] in b".,;:!?\n\v\f\r" for k, p in enumerate(cut))
    assert list(collocations._cut(b"a b " * 400)) == [b"a b " * 400]


def test_a_sketch_loses_nothing_frequent(spark, docs):
    texts = spark.createDataFrame([(lang or "und", bytearray((t or "").encode())) for lang, t in docs], "lang string, raw binary").repartition(4)
    bits = []
    for size in (1, 2, 3):
        bits.append(collocations.sketch(texts, size, bits, 1 << 16, 10))
    kept = {(lang, k) for lang in ("en", "de", "und", "fr") for k in range(0)}
    for lang in ("en", "de", "und", "fr"):
        ids, words = collocations.numbered("\n".join(t or "" for g, t in docs if (g or "und") == lang).encode())
        for size, (place, _) in enumerate(collocations.levels(ids, collocations.hashes(lang, words), bits, 3), 1):
            kept |= {(lang, b" ".join(words[x] for x in ids[p : p + size]).decode()) for p in place.tolist()}
    f = Counter()
    for lang, text in docs:
        for piece in CUT.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", " ".join(w[k : k + n])) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    frequent = {k for k, v in f.items() if v >= 10}
    assert frequent <= kept and len(kept) < 1.1 * len(frequent) < len(f) / 2


def test_bits_grow_with_what_is_frequent_not_with_cells(spark, docs, monkeypatch):
    texts = spark.createDataFrame([(lang or "und", bytearray((t or "").encode())) for lang, t in docs], "lang string, raw binary").repartition(4)
    few, many = (collocations.sketch(texts, 1, [], 1 << k, 10) for k in (16, 25))
    assert 1 <= np.bitwise_count(few).sum(axis=1).max() and many.nbytes == few.nbytes < 1 << 13
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 17)
    monkeypatch.setattr(collocations, "ROOM", 1 << 20)  # no fold but that of the sketch
    most = collocations.sketch(texts, 1, [], 1 << 25, 10)
    assert most.nbytes == 2 * (1 << 17) // 8
    ids, words = collocations.numbered("\n".join(t or "" for g, t in docs if g == "en").encode())
    word = collocations.hashes("en", words)
    found = [{words[ids[p]] for p in next(collocations.levels(ids, word, [row], 1))[0]} for row in (few, many, most)]
    often = {w for w, n in Counter(words[k] for k in ids.tolist() if k).items() if n >= 10}
    assert often and all(often <= f for f in found)


def test_folds_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_CELLS", 1 << 10)
    monkeypatch.setattr(collocations, "SLICE", 16)
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 7)
    monkeypatch.setattr(collocations, "BYTES_PER_CELL", 1)
    assert rows(spark, docs) == brute(docs)


def test_scores_beyond_64_bits(spark):
    f = {("x", ("a",)): 4 * 10**12, ("x", ("b",)): 3 * 10**12 + 1, ("x", ("a", "b")): 2 * 10**12 + 7, ("x", ("a", "b", "c")): 10**6, ("x", ("c",)): 10**12 - 3, ("x", ("b", "c")): 10**11 + 9}
    table = spark.createDataFrame([(lang, " ".join(p), len(p), n) for (lang, p), n in f.items()], "lang string, phrase string, size int, n bigint")
    got = sorted((r["phrase"], r["a"], r["l"], r["r"], r["score"]) for r in collocations.scored(table).collect())
    assert got == sorted((p, a, left, right, s) for _, _, p, a, left, right, _, s in judged(f, {"x": 0}))


def test_empty_tables_have_no_phrases(spark):
    assert rows(spark, []) == [] == rows(spark, [("en", None), ("en", "one")])


def test_numbers_part_pieces():
    ids, words = collocations.numbered(b"A b, a\tB\n\x0bc-d")
    assert ids.tolist()[:6] == [1, 2, 0, 1, 2, 0] and words == [b"\n", b"a", b"b", b"c-d"] and np.count_nonzero(ids) == 5

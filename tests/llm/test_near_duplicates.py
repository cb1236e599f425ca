"""Ops 2, 5 and 10 against plain statements of their rules."""

import hashlib
import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tracewise.llm import jaccard, lines, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size, lower=False):
    text = text or ""
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows, size, per_mille):
    sets = {i: shingles(t, size, lower=True) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 1000 * len(sets[a] & sets[b]) >= per_mille * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_join(make, texts):
    for size, per_mille in ((3, 900), (5, 800)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(make(texts), size, per_mille).collect()}
        assert got == components(texts, size, per_mille)


def test_jaccard_join_of_nothing(make):
    assert jaccard.join(make([])).collect() == []
    got = jaccard.join(make([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b c d"), (3, None)])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 3), (True, 0, 1)]


def test_rows_of_one_document_are_one_node(make):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a), (3, a), (5, b), (2, b), (7, None), (7, b), (9, a + " x")]
    got = {}
    for r in jaccard.join(make(rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    # document 5 stands where its row with the smaller digest does
    assert all(len(c) == 1 for c in got.values()) and got[7] == got[2] and got[3] == got[9]
    assert got[5] in (got[3], got[2])


def test_a_large_group_of_near_copies(make):
    """Lines and documents that differ in a few words each, so that few pairs pass and all share most shingles."""
    import random

    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w[rng.randrange(3) :])))
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(make(rows)).collect()} == plain_lines(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(make(rows), 5, 800).collect()} == components(rows, 5, 800)


def plain_lines(rows, per_mille=800):
    seen, sets, out = set(), [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        keep = []
        for line in (t or "").split("\n"):
            if not WORD.search(line):
                keep.append(line)
                continue
            s = shingles(line, 5)
            if line not in seen and not any(1000 * len(s & o) >= per_mille * len(s | o) for o in sets):
                keep.append(line)
            if line not in seen:
                sets.append(s)
            seen.add(line)
        out[i] = None if t is None else "\n".join(keep)
    return out


def test_shingles_are_counted_in_generated_code(make):
    """Counted as rows, shingles have the hashes of the arrays; a plan with functions on a line's array would run uncompiled."""
    odd = [(1, "a b c d e f a b c d e\ng\n\nh  i\tj"), (2, "k l m n o"), (3, "p q r s t u\x0b v \r w"), (4, None), (5, "")]
    own = lines.lines_of(make(odd, extra=False))
    rows = lines.shingle_rows(own)
    arrays = own.select(F.explode(lines.shingles(F.col("line"))).alias("t"))
    assert rows.count() == 7 + 1 + 1 + 1 + 4
    assert sorted(r["t"] for r in rows.collect()) == sorted(r["t"] for r in arrays.collect())
    assert "lambda" not in rows._jdf.queryExecution().executedPlan().toString()


def test_line_dedup(make, texts):
    done = lines.dedup_lines(make(texts))
    assert {r["doc_id"]: r["text"] for r in done.collect()} == plain_lines(texts)
    assert {"h1", "key", "pattern"} <= set(done.columns)
    assert not [x for x in re.findall(r"\w*Python\w*|\w*Pandas\w*|\w*Arrow\w*", done._jdf.queryExecution().toString())]


def test_later_copies_of_a_line_form_no_tokens(make, monkeypatch):
    """Where no line is frequent enough to be known by itself, too: each class enters the token table by its first line."""
    given, form = [], lines.entries_of
    monkeypatch.setattr(lines, "HEAVY", 1)
    monkeypatch.setattr(lines, "entries_of", lambda own, *rest: given.extend(tuple(r) for r in own.select("doc_id", "line_no").collect()) or form(own, *rest))
    words = [f"w{k}" for k in range(30)]
    base, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[:9])
    rows = [(4, f"{base}\n{other}\n{base}"), (2, f"a\n{base}"), (7, f"{near}\n{other}"), (9, near), (11, "b c")]
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(make(rows)).collect()} == plain_lines(rows)
    assert sorted(given) == [(2, 0), (2, 1), (4, 1), (7, 0), (11, 0)]


def test_line_dedup_of_nothing(make):
    assert lines.dedup_lines(make([])).collect() == []
    got = lines.dedup_lines(make([(2, "a b"), (1, "a b\n\nc"), (None, "a b"), (1, "a b\n\nc")])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "a b"), (1, "a b\n\nc"), (1, "a b\n\nc"), (2, "")]


def plain_bytes(rows, least=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - least + 1):
            if raw[s : s + least] in seen:
                gone[s : s + least] = True
            seen.add(raw[s : s + least])
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup(make, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup_bytes(make(texts)).collect()}
    assert got == plain_bytes(texts)
    assert suffixes.dedup_bytes(make([])).collect() == []


def test_anchors_of_sliced_texts(monkeypatch):
    """Each window has the anchor that it has in the whole text."""
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (3, 2500, 0, 700, 99, 100)]

    def windows():
        return {(int(k), w): int(a) for a, k, f, t in zip(*suffixes.regions(texts), strict=True) for w in range(f, t + 1)}

    whole = windows()
    assert len(whole) == sum(max(0, len(t) - 99) for t in texts)
    monkeypatch.setattr(suffixes, "SLICE", 333)
    assert windows() == whole


def test_common_prefixes_from_the_transform():
    rng = np.random.default_rng(1)
    for _ in range(40):
        pieces = [bytes(rng.choice(list(b"ab\x00"), rng.integers(0, 40)).tolist()) for _ in range(rng.integers(1, 6))]
        docs, starts, least = rng.permutation(20)[: len(pieces)], rng.integers(0, 50, len(pieces)), int(rng.choice([3, 5, 8]))
        got = {(p, o) for p, a, b in suffixes.repeated_starts(pieces, docs, starts, least) for o in range(a, b + 1)}
        seen, expected = set(), set()
        for _, _, p, o in sorted((int(docs[p]), int(starts[p]) + o, p, o) for p in range(len(pieces)) for o in range(len(pieces[p]) - least + 1)):
            w = pieces[p][o : o + least]
            expected |= {(p, o)} if w in seen else set()
            seen.add(w)
        assert got == expected


def test_regions_are_gone_from_disk_before_texts_are_shuffled(spark, monkeypatch):
    dropped, kept = [], []
    write, let_go = suffixes.store, suffixes.release
    monkeypatch.setattr(suffixes, "store", lambda df, name: kept.append(name) or write(df, name))
    monkeypatch.setattr(suffixes, "release", lambda *dfs: dropped.append((list(kept), [f for d in dfs for f in d.inputFiles()])) or let_go(*dfs))
    passage = hashlib.sha512(b"x").hexdigest() + hashlib.sha512(b"y").hexdigest()
    docs = spark.createDataFrame([(k, f"{k}" * 50 + passage + f"{k + 1}" * 60) for k in range(4)], "doc_id bigint, text string")
    assert [r["n_removed"] > 0 for r in suffixes.dedup_bytes(docs).orderBy("doc_id").collect()] == [False, True, True, True]
    (before, files), = dropped
    assert before == ["regions", "unique", "copies"] and not any(Path(f.removeprefix("file:")).exists() for f in files)


def test_a_passage_in_many_surroundings_is_not_gathered(make, monkeypatch):
    """No block holds all regions of an anchor, and a filter that is full lets no later copies into one."""
    rng = np.random.default_rng(3)
    passage, gathered = hashlib.sha512(b"x").hexdigest(), suffixes.shared_parts

    def bounded(pieces, *rest):
        assert sum(map(len, pieces)) < 12_000
        return gathered(pieces, *rest)

    monkeypatch.setattr(suffixes, "shared_parts", bounded)
    monkeypatch.setattr(suffixes, "BLOCK", 4000)
    monkeypatch.setattr(suffixes, "HOT", 20, raising=False)
    monkeypatch.setattr(suffixes, "_filter", lambda bits: np.full(suffixes.FILTER // 8, 255, np.uint8))
    around = lambda: "".join(rng.choice(list("abcd"), 30).tolist())
    few = [passage[::-1] + around() + around() for _ in range(8)]
    rows = list(enumerate([around() + passage + around() for _ in range(300)] + [passage + passage + "é" * 20 + str(k % 2) for k in range(200)] + few * 40))
    rng.shuffle(rows)
    rows = [(int(k), str(t)) for k, t in rows]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup_bytes(make(rows)).collect()}
    assert got == plain_bytes(rows)

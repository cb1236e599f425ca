"""Operators that index words, against brute force: benchmark decontamination and ranked search."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewise.llm import decontamination, ranking
from tracewise.llm.fmindex import FMIndex, suffix_order
from tracewise.llm.shared import store

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text):
    return WORD.findall(lower(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=12), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_an_index_finds_every_place(passages, phrase):
    text = np.array([x for p in passages for x in (*p, 0)], np.int32)
    order = suffix_order(text)
    assert sorted(order) == list(range(len(text)))
    index = FMIndex(text, 3)
    rows = np.zeros((1, 4), np.int32)
    rows[0, 4 - len(phrase) :] = phrase
    lo, hi = index.ranges(rows, np.array([len(phrase)]))
    want = [k for k in range(len(text)) if text[k : k + len(phrase)].tolist() == phrase]
    assert sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0])))) == want


@pytest.fixture(scope="module")
def corpus():
    """Documents and items: shared passages, short items, ties, repeats, a long text, nulls and empties."""
    rng = random.Random(4)
    word = lambda: rng.choice("aa b Cc d é E7 zz über 12 x".split())
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [("q%d" % k, text(rng.randrange(11, 25))) for k in range(12)] + [("s1", "b D, über"), ("s2", "zz"), ("e", ""), ("n", None), ("p", "--"), ("q1", text(10)), (None, "é é é")]
    docs = [(k, text(rng.randrange(0, 60)) + (rng.choice(items)[1] or "")[: rng.randrange(8, 90)] + " qq " + text(5) if k % 3 else "qq " * 40 + items[k % 12][1].upper()) for k in range(50)]
    docs += [(100, None), (101, ""), (102, " .,"), (103, text(30_000) + "qq " * 2000), (3, docs[3][1]), (None, items[0][1]), (104, docs[3][1]), (105, docs[3][1])]
    return docs, items


def occurrences(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = plain(text)
        for k in range(min(len(w), max(1, len(w) - size + 1))):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item or "")
    out = []
    for doc, text in docs:
        w, hit, found = plain(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"SHARD": 500}, {"BLOCK": 150}])
def test_hits_are_those_of_brute_force(spark, make, corpus, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(decontamination, k, v)
    docs, items = corpus
    bench = spark.createDataFrame(items, "item_id string, text string")
    blocks = decontamination.blocks(bench, decontamination.BLOCK)
    assert (len(blocks) > 3) == ("BLOCK" in limits) and sum(map(len, blocks)) == 18
    monkeypatch.setattr(decontamination, "blocks", lambda b: blocks)
    found = decontamination.find(make(docs).repartition(3), bench)
    got = [tuple(r) for r in decontamination.digests(found).collect()]
    assert sorted(got, key=str) == occurrences(docs, items)
    assert sum(r[2] > 0 for r in got) > 30 > sum(r[2] == 0 for r in got) > 3


def test_slices_of_a_text_give_what_the_whole_gives(corpus, monkeypatch):
    docs, items = corpus
    phrases = decontamination.Phrases([(i or "", t.encode()) for i, t in items if t is not None], 10)
    raw = [None if t is None else t.encode() for _, t in docs]
    total, spans, found = phrases.search(raw)
    monkeypatch.setattr(decontamination, "SLICE", 50)
    sliced = phrases.search(raw)
    flat = lambda d: {k: decontamination.merged(v) for k, v in d.items()}
    assert (total, flat(spans), found) == (sliced[0], flat(sliced[1]), sliced[2])


def test_removed_spans_leave_the_rest_as_it_was(spark, make):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Keep, this. {item.upper()}! and THIS"), (2, "nothing here"), (3, None), (4, item), (5, f"{item} x {item}")]
    bench = spark.createDataFrame([(7, item)], "item_id int, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.find(make(docs), bench, emit="text").collect()}
    assert got == {1: "Keep, this. ! and THIS", 2: "nothing here", 3: None, 4: "", 5: " x "}


def test_empty_tables_and_benchmarks(spark, make):
    none = spark.createDataFrame([], "item_id string, text string")
    got = decontamination.digests(decontamination.find(make([(1, "a b")]), none)).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(2, 0, False)]
    assert decontamination.find(make([]), none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 5), min_size=1), min_size=1, max_size=4))
def test_treaps_are_ordered_by_document_and_by_impact(terms):
    rows = [sorted(t.items()) for t in terms]
    treaps = ranking.Treaps(np.array([len(r) for r in rows]), np.array([d for r in rows for d, _ in r]), np.array([v for r in rows for _, v in r]))
    for root, own in zip(treaps.roots.tolist(), rows, strict=True):
        seen = []

        def walk(k, most, seen=seen):
            if k >= 0:
                assert treaps.impact[k] <= most
                walk(int(treaps.left[k]), treaps.impact[k])
                seen.append((int(treaps.doc[k]), int(treaps.impact[k])))
                walk(int(treaps.right[k]), treaps.impact[k])

        walk(root, 99)
        assert seen == own


def ranked(docs, items, top=10):
    tf = [(k, doc, Counter(plain(text))) for k, (doc, text) in enumerate(docs)]
    tf = [x for x in tf if x[2]]
    n_docs, n_words = len(tf), sum(sum(c.values()) for *_, c in tf)
    df = Counter(t for *_, c in tf for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for _, doc, c in tf:
            m = 25 + 75 * sum(c.values()) * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain(text) if c[t])
            scores += [(-score, doc is None, doc or 0)] if score > 0 else []
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"SHARD": 300}, {"BLOCK": 150}])
def test_ranks_are_those_of_brute_force(spark, make, corpus, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(ranking, k, v)
    docs, items = corpus
    docs = docs + [(k, docs[k - 300][1]) for k in range(300, 312)]  # ties beyond the limit
    items = [(i, t) for i, t in items if i] + [items[0], (None, "zz E7"), ("none", "nowhere")]
    got = [tuple(r) for r in ranking.search(make(docs).repartition(3), spark.createDataFrame(items, "item_id string, text string")).collect()]
    assert sorted(got, key=str) == ranked(docs, items)


def test_an_index_of_all_terms_gives_the_same(spark, make, corpus):
    docs, items = corpus
    bench = spark.createDataFrame(items[:9], "item_id string, text string")
    everything = store(ranking.index(make(docs)), "all-terms")
    words = {w for _, t in docs for w in plain(t)}
    assert {r[0] for r in everything.select(F.explode("terms")).collect()} == words
    got = [tuple(r) for r in ranking.search(make(docs), bench, top=3, indexed=everything).collect()]
    assert sorted(got, key=str) == ranked(docs, items[:9], 3)


def test_subtrees_are_pruned():
    rng = np.random.default_rng(2)
    impacts = rng.integers(1, 1000, 4000) ** 2
    treaps = ranking.Treaps(np.array([2000, 2000]), np.tile(np.arange(2000), 2), impacts)
    best = ranking.Best(1, 10)
    scored = ranking.traverse(treaps, np.arange(2000), np.zeros(2, np.int64), treaps.roots, np.array([1, 2]), best)
    want = impacts[:2000] + 2 * impacts[2000:]
    assert best.score[0].tolist() == sorted(want.tolist(), reverse=True)[:10] and 10 <= scored < 400


def test_ranking_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id string, text string")
    assert ranking.search(make([(1, "a b")]), none).collect() == []
    assert ranking.search(make([]), spark.createDataFrame([("q", "a")], "item_id string, text string")).collect() == []
    assert ranking.search(make([(1, None), (2, "--")]), spark.createDataFrame([("q", "a")], "item_id string, text string")).collect() == []

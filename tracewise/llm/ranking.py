"""Op 13. Ranked lexical search: inverted treaps per term, traversed together for the top documents of each query.

A task cuts its documents into shards of bounded size and indexes them: per term its documents
and how often it stands in each. The index is written to the shared folder; the counts that
weights need (documents, words, documents per term) are sums over it. A search reads it shard
by shard. From the postings of a term a treap is built: search order by document, heap order
by impact, the score that the term alone would give. All queries go through a shard's treaps
together: a state is a query, an interval of documents and a node per term, the top one
within the interval. The sum of their impacts bounds every score in the interval; what
can't enter the query's best so far is pruned, and the rest is split at the document with the
largest single impact. A document alone in its interval has that sum as its score. The best so
far go on from shard to shard of a task; the tasks' best are merged at the end.

Queries travel in blocks of bounded size; for each block the terms that it asks for are
indexed, unless an index of all terms is given.

Scores are 64-bit integers: a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), its impact
weight * ((10^9 tf) div (1000 tf + 8m)), m = 25 + (75 n N) div L.

Cases: null texts and those without terms are no documents. Rows are documents, also where
they share a doc_id; equal scores rank by doc_id, rows without one last. Rows of the queries
that share item and text are one query; queries without terms have no results. Empty tables
give no rows. Extra columns are ignored. doc_id is an integer. Long texts make a shard alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.shared import store
from tracewise.llm.terms import parts, plain_words

TOP = 10
#: Bytes of queries in a block, and of texts in a shard; queries that traverse a shard at a time.
BLOCK, SHARD, TOGETHER = 1 << 22, 1 << 20, 256
NO_ID = np.iinfo(np.int64).max
_SHARD = "n_docs bigint, n_words bigint, doc_ids array<bigint>, lengths array<bigint>, terms array<string>, counts array<int>, places array<int>, tfs array<int>"


def index(docs: DataFrame, terms: list[bytes] | None = None) -> DataFrame:
    """A row per shard of documents: ids and lengths in order of the ids; terms, how many postings each has, and all postings. terms: the only ones to index."""
    wanted = None if terms is None else {t: k for k, t in enumerate(terms)}

    def run(batches):
        for part in parts(batches, "raw", SHARD):
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            texts, by = part.column("raw").to_pylist(), np.argsort(ids, kind="stable")
            number, lengths, found, kept = {} if wanted is None else wanted, [], [], []
            for k in by.tolist():
                words = plain_words(texts[k])
                if words:
                    own = [number.setdefault(w, len(number)) for w in words] if wanted is None else [number.get(w, -1) for w in words]
                    found.append(np.array(own, np.int64))
                    lengths.append(len(words))
                    kept.append(k)
            if not kept:
                continue
            term, doc = np.concatenate(found), np.repeat(np.arange(len(kept)), lengths)
            key, tf = np.unique((term * len(kept) + doc)[term >= 0], return_counts=True)
            used, count = np.unique(key // len(kept), return_counts=True)
            names = terms if wanted is not None else list(number)
            row = [len(kept), sum(lengths), part.column("doc_id").take(pa.array(np.array(kept))).cast(pa.int64()), lengths, [names[t].decode() for t in used.tolist()], count, key % len(kept), tf]
            kinds = [pa.int64()] * 2 + [pa.list_(t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row[:2], kinds, strict=False)] + [_one(x, t) for x, t in zip(row[2:], kinds[2:], strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, _SHARD)


def _one(values, kind: pa.ListType) -> pa.ListArray:
    """One list, from an array or a list of values."""
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind.value_type))


class Treaps:
    """Treaps of several terms: doc, impact, left and right by node (-1: none), and each term's root."""

    def __init__(self, counts: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        place = np.arange(len(docs)) + np.repeat(np.arange(len(counts)), counts) + 1  # one wall before each term, one after the last
        size = len(docs) + len(counts) + 1
        self.doc, self.impact = np.full(size, -1, np.int64), np.full(size, np.iinfo(np.int64).max)
        self.doc[place], self.impact[place] = docs, impacts
        above, value = {}, self.impact
        for side, lower in ((-1, np.less), (1, np.less_equal)):  # of equal impacts the earlier document stands higher
            near = np.arange(size) + side
            low = place[lower(value[near[place]], value[place])]
            while len(low):
                near[low] = near[near[low]]
                low = low[lower(value[near[low]], value[low])]
            above[side] = near[place]
        before, after = above[-1], above[1]
        parent = np.where(value[before] < value[after], before, after)
        root = (self.doc[before] < 0) & (self.doc[after] < 0)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        l, r = ~root & (parent > place), ~root & (parent < place)  # noqa: E741
        self.left[parent[l]], self.right[parent[r]] = place[l], place[r]
        self.roots = place[root]

    def settle(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Down from each node to the top one whose document lies within lo and hi; -1 where there is none."""
        node, open_ = node.copy(), np.arange(len(node))
        while len(open_):
            at = node[open_]
            doc = self.doc[at]
            low, high = doc < lo[open_], doc > hi[open_]
            off = low | high
            open_, at = open_[off], np.where(low, self.right[at], self.left[at])[off]
            node[open_] = at
            open_ = open_[at >= 0]
        return node


class Best:
    """The best documents of each query so far: score and id, in order."""

    def __init__(self, queries: int, top: int):
        self.score, self.doc = np.zeros((queries, top), np.int64), np.full((queries, top), NO_ID)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        some, top = np.unique(query), self.score.shape[1]
        q = np.concatenate([np.repeat(some, top), query])
        s, d = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.doc[some].ravel(), doc])
        by = np.lexsort((d, -s, q))
        q = q[by]
        first = np.searchsorted(q, some)
        rows = by[first[:, None] + np.arange(top)]
        self.score[some], self.doc[some] = s[rows], d[rows]


def traverse(treaps: Treaps, ids: np.ndarray, query: np.ndarray, node: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Take the treaps' documents into best. query, node, times: a root per term of each query, sorted by query. Returns how many documents were scored."""
    state, first = np.unique(query, return_inverse=True)
    of, lo, hi, scored = state, np.zeros(len(state), np.int64), np.full(len(state), len(ids) - 1), 0
    state, treap_node = first, node
    while len(state):
        treap_node = treaps.settle(treap_node, lo[state], hi[state])
        live = treap_node >= 0
        state, treap_node, times = state[live], treap_node[live], times[live]
        if not len(state):
            break
        start = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
        own = state[start]
        size = np.diff(np.append(start, len(state)))
        part = times * treaps.impact[treap_node]
        bound = np.add.reduceat(part, start)
        q, a, b = of[own], lo[own], hi[own]
        last = best.score[q, -1]
        may = (bound > last) | (bound == last) & (bound > 0) & (ids[a] < best.doc[q, -1])
        alone = may & (a == b)
        scored += int(alone.sum())
        if alone.any():
            best.add(q[alone], bound[alone], ids[a[alone]])
        go = may & (a < b)
        # the document with the largest single impact parts the interval
        most = np.maximum.reduceat(part, start)
        place = np.where(part == np.repeat(most, size), np.arange(len(part)), len(part))
        pivot = treaps.doc[treap_node[np.minimum.reduceat(place, start)]][go]
        entry = np.repeat(go, size)
        width, a, b, q = size[go], a[go], b[go], q[go]
        k = len(q)
        old = np.repeat(np.arange(k), width)
        of, lo, hi = np.tile(q, 3), np.concatenate([a, pivot, pivot + 1]), np.concatenate([pivot - 1, pivot, b])
        state = np.concatenate([old, old + k, old + 2 * k])
        treap_node, times = np.tile(treap_node[entry], 3), np.tile(times[entry], 3)
    return scored


def _queries(items: DataFrame) -> Iterator[tuple]:
    """Blocks of (items, terms, query and term number and times of each pair)."""
    own = items.select("item_id", F.col("text").cast("binary").alias("raw")).where("raw is not null").distinct()
    total = own.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = -(-total // BLOCK)
    part = F.pmod(F.xxhash64("item_id", "raw"), F.lit(n))
    for k in range(n):
        t = own.where(part == k).toArrow()
        number, rows, kept = {}, [], []
        for j, raw in enumerate(t.column("raw").to_pylist()):
            found = Counter(plain_words(raw))
            rows += [(len(kept), number.setdefault(w, len(number)), c) for w, c in found.items()]
            kept += [j] if found else []
        if kept:
            yield t.column("item_id").combine_chunks().take(pa.array(kept)), list(number), np.array(rows, np.int64)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, indexed: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item with a score above 0. indexed: a stored index of all terms of docs."""
    kind = items.schema["item_id"].dataType.simpleString()
    out = []
    for names, terms, pairs in _queries(items):
        shards = store(index(docs, terms), "treaps") if indexed is None else indexed
        n_docs, n_words = shards.agg(F.sum("n_docs"), F.sum("n_words")).first()
        per_term = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
        asked = docs.sparkSession.createDataFrame([(t.decode(),) for t in terms], "terms string")  # within a block's bytes
        df = {r["terms"]: r["n"] for r in (per_term if indexed is None else per_term.join(F.broadcast(asked), "terms", "left_semi")).collect()}
        weight = {t.decode(): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t.decode()] + 1))) for t in terms if t.decode() in df}
        number = {t.decode(): k for k, t in enumerate(terms)}

        def run(batches, names=names, pairs=pairs, weight=weight, number=number, n_docs=n_docs, n_words=n_words):
            best = Best(len(names), top)
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, lengths, words, counts, places, tfs = (batch.column(c)[k].values for c in ("doc_ids", "lengths", "terms", "counts", "places", "tfs"))
                    ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
                    counts, places, tfs = (x.to_numpy().astype(np.int64) for x in (counts, places, tfs))
                    term = np.array([number.get(w, -1) for w in words.to_pylist()], np.int64)
                    value = np.array([weight.get(w, 0) for w in words.to_pylist()], np.int64)
                    m = 25 + 75 * lengths.to_numpy().astype(np.int64) * n_docs // n_words
                    impact = np.repeat(value, counts) * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[places]))
                    some = np.repeat((term >= 0) & (value > 0), counts)
                    counts, term = counts[(term >= 0) & (value > 0)], term[(term >= 0) & (value > 0)]
                    treaps = Treaps(counts, places[some], impact[some])
                    root = np.full(len(number), -1, np.int64)
                    root[term] = treaps.roots
                    node = root[pairs[:, 1]]
                    for lo in range(0, len(names), TOGETHER):
                        own = (pairs[:, 0] >= lo) & (pairs[:, 0] < lo + TOGETHER) & (node >= 0)
                        traverse(treaps, ids, pairs[own, 0], node[own], pairs[own, 2], best)
            q, place = np.nonzero(best.score)
            doc = best.doc[q, place]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), names.take(pa.array(q)), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(best.score[q, place])], ["query", "item_id", "doc_id", "score"])

        found = shards.mapInArrow(run, f"query bigint, item_id {kind}, doc_id bigint, score bigint")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        out.append(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, out) if out else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")

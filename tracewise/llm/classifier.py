"""Op 3. Quality classifier: random-indexing word vectors, a two-layer numpy network, calibrated probabilities.

Tokens are runs of letters (lower-cased) and runs of marks or digits; a token equal to the
one before it, and a word of capitals only, are tokens of their own kind. Tokens fall into
2^15 buckets. Random indexing gives each bucket a sparse random index vector, and a bucket's
word vector is the sum of its neighbours' index vectors over the training texts, scaled to
length one. A document is the mean of its tokens' word vectors and the logarithm of its
length. The network has one hidden layer; a temperature fitted on held-back training rows
calibrates its probabilities.

Only the fit uses a sample: at most SAMPLE labelled documents of at most MOST_BYTES bytes, by
a hash of their doc_id, none with crc32(doc_id) mod 5 = 0. Every whole text is scored, in one pass without a shuffle.

Cases: null text is the empty text; a text without tokens gets the network's answer for the
zero vector. Without labelled rows every score is 0.5. Labels that are null don't count, the
smaller one counts where a document has two. Repeated rows get equal scores. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.shingles import BASE, INVERSE, PLACES, _powers, mix

SAMPLE = 4000
#: Longer texts aren't learnt from, so that what the driver gathers is at most SAMPLE times this.
MOST_BYTES = 1 << 17
BUCKETS = 1 << 15
WIDTH = 64
REPEAT, CAPITALS = 0, 1
PART = 1 << 19

#: 0 white, 1 letter (ASCII letters and all bytes of longer characters), 2 digit, 3 anything else.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 1
KIND[48:58] = 2
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True


def _values() -> np.ndarray:
    v = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    v[65:91] = v[97:123]
    v[48:58] = v[48]
    return v


VALUE = _values()


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token buckets of some texts one after the other, and the first token of each text and the end."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = KIND[raw]
    edge = np.flatnonzero(np.diff(kind, prepend=0)) if len(raw) else np.zeros(0, np.int64)
    start = edge[kind[edge] > 0]
    end = np.append(edge, len(raw))[np.searchsorted(edge, start) + 1] if len(start) else start
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(start, np.concatenate([[0], ends]))
    if not len(start):
        return np.zeros(0, np.int64), first
    size = 1 << max(20, int(len(raw)).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(VALUE[raw] * _powers(BASE, size)[: len(raw)], out=total[1:])
        h = mix((total[end] - total[start]) * _powers(INVERSE, size)[start] + (end - start).astype(np.uint64) * PLACES[1])
    out = (h >> np.uint64(64 - 15)).astype(np.int64)
    capitals = np.concatenate([[0], np.cumsum(CAPITAL[raw])])
    shout = (capitals[end] - capitals[start] == end - start) & (end - start > 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (kind[start[1:]] == 1)
    again[first[:-1][first[:-1] < len(again)]] = False  # not across texts
    return np.where(again, REPEAT, np.where(shout, CAPITALS, np.maximum(out, 2))), first


class Model:
    """Word vectors, network and temperature."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], temperature: float):
        self.vectors, self.layers, self.temperature = vectors, layers, temperature

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        tokens, first = buckets(texts)
        n = np.diff(first)
        out = np.zeros((len(texts), self.vectors.shape[1] + 1), np.float32)
        some = n > 0
        if some.any():
            total = np.add.reduceat(self.vectors[tokens], first[:-1][some], axis=0)
            out[some, :-1] = total / n[some, None]
            out[some, -1] = np.log1p(n[some]) / 10
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh(x @ w + b) @ v + c

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.logits(self.pooled(texts).astype(np.float64))[:, 0] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def word_vectors(token_lists: list[np.ndarray], reach: int = 2, seed: int = 11) -> np.ndarray:
    """Random indexing: each bucket's sum of the index vectors of its neighbours up to reach places away."""
    rng = np.random.default_rng(seed)
    index = np.zeros((BUCKETS, WIDTH), np.float32)
    places = rng.integers(0, WIDTH, (BUCKETS, 4))
    np.add.at(index, (np.arange(BUCKETS)[:, None], places), rng.choice([-1.0, 1.0], (BUCKETS, 4)).astype(np.float32))
    out = index.copy()  # its own index vector tells a bucket from others with the same neighbours
    for tokens in token_lists:
        for d in range(1, reach + 1):
            if len(tokens) > d:
                pairs = np.unique(tokens[:-d] * BUCKETS + tokens[d:], return_counts=True)
                a, b = pairs[0] // BUCKETS, pairs[0] % BUCKETS
                n = pairs[1][:, None].astype(np.float32)
                np.add.at(out, a, index[b] * n)
                np.add.at(out, b, index[a] * n)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> list[np.ndarray]:
    """Full-batch Adam on the cross entropy of a tanh network."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.5, (hidden, 1)), np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for t in range(1, rounds + 1):
        w, b, v, c = layers
        h = np.tanh(x @ w + b)
        d = (1 / (1 + np.exp(-np.clip(h @ v + c, -30, 30))) - y[:, None]) / len(x)
        dh = d @ v.T * (1 - h * h)
        grads = [x.T @ dh + decay * w, dh.sum(0), h.T @ d + decay * v, d.sum(0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    lists = []
    for t in texts:
        lists.append(buckets([t])[0])
    vectors = word_vectors(lists)
    model = Model(vectors, [], 1.0)
    x = np.concatenate([model.pooled([t]) for t in texts]).astype(np.float64)
    held = np.arange(len(x)) % 5 == 0
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        held = np.zeros(len(x), bool)
    model.layers = train(x[~held], labels[~held])
    if held.any():
        z = model.logits(x[held])[:, 0]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        losses = [np.mean(np.logaddexp(0, np.where(labels[held] == 1, -z, z) / t)) for t in grid]
        model.temperature = float(max(0.5, grid[int(np.argmin(losses))]))
    return model


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, most: int = MOST_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most sample labelled documents outside the held-out fold, chosen by doc_id only. Texts over most bytes aren't learnt from; of rows that share a doc_id, the smallest text is."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the chosen ids are at most sample rows of 12 bytes, so the documents needn't be shuffled
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).where(F.octet_length("raw") <= most)
    rows = raw.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("raw").alias("raw")).toArrow().sort_by("doc_id")
    return [x or b"" for x in rows.column("raw").to_pylist()], np.array(rows.column("y").to_pylist(), np.float64)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts, y = training_rows(docs, labels, label, sample)
    model = fit(texts, y) if len(texts) and 0 < y.mean() < 1 else None

    def run(batches):
        for batch in batches:
            group, size, at = [], 0, 0
            rows = batch.column("raw").to_pylist()
            for k, raw in enumerate(rows):
                group.append(raw or b"")
                size += len(group[-1])
                if size > PART or k == len(rows) - 1:
                    part = batch.slice(at, len(group))
                    score = model.scores(group) if model else np.full(len(group), 0.5)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
                    group, size, at = [], 0, k + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

"""Op 6. Packing documents into token windows by non-negative least squares.

Each document is cut into full windows and one tail. Full windows are sequences of their
own. Tails are counted by length, which is a table of fewer rows than the window has
tokens. Combinations of two or three lengths that exactly fill a window, or a smaller power
of two, are the columns of a least-squares problem whose right side is that table; repeat
counts are its non-negative solution, rounded down, and the tails that remain are packed
greedily, longest first, each window topped up with the longest tail that still fits.

A tail's place follows from its rank among the tails of its length. Ranks are taken per
(length, salt) and offset by the counts of the salts before, so a length that a third of all
documents share is dealt to many tasks.

Cases: null text is the empty text, one piece of the single closing id 0. Documents whose
doc_id is null or occurs twice are packed each for itself. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.shared import spread, store

WINDOW = 1024
#: Characters of Unicode's property White_Space, as a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are cut out before the pattern, whose matcher gives up on long ones.
LONG_RUN = 50_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """text -> ids as numpy, from a byte-level vocabulary file and the special tokens it lists."""
    import json

    import public_tokenizers
    import tiktoken

    from tracewise.llm.bpe import byte_letters

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    coder = tiktoken.Encoding("vocabulary-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    marks = re.compile("|".join(map(re.escape, special))) if special else None
    runs = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")

    def long_runs(text: str) -> list[np.ndarray]:
        """Ids of a text without special tokens. A long run of white space is a piece for itself, but for a last character that something follows."""
        out, at = [], 0
        for run in runs.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += [coder.encode_to_numpy(text[at : run.start()], disallowed_special=()), np.array(coder._encode_single_piece(text[run.start() : end]), np.uint32)]
            at = end
        return [*out, coder.encode_to_numpy(text[at:], disallowed_special=())]

    def encode(text: str) -> np.ndarray:
        found = special.keys() if any(s in text for s in special) else ()
        if len(text) < LONG_RUN or not runs.search(text):
            return coder.encode_to_numpy(text, allowed_special=set(found), disallowed_special=())
        out, at = [], 0
        for mark in marks.finditer(text) if found else ():
            out += [*long_runs(text[at : mark.start()]), np.array([special[mark[0]]], np.uint32)]
            at = mark.end()
        return np.concatenate([*out, *long_runs(text[at:])])

    return encode


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW, close: int = 0) -> DataFrame:
    """One row per piece: full windows and the tail of each document's ids, closed by one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, starts, lengths, crcs, totals = [], [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    ids = encode(text or "").astype("<u4", copy=False).tobytes() + close.to_bytes(4, "little")
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(piece) // 4)
                        crcs.append(zlib.crc32(piece))
                        totals.append(n)
                keys = pc.take(part.column("doc_id"), pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def combinations(window: int, step: int = 16) -> list[np.ndarray]:
    """Pairs that fill the window or half or a quarter of it, and triples with one length a multiple of step."""
    out = []
    for total in (window, window // 2, window // 4):
        a = np.arange(1, total // 2 + 1)
        out.append(np.stack([a, total - a], 1))
    for c in range(step, window // 3 + 1, step):
        a = np.arange(1, (window - c) // 2 + 1, max(1, step // 4))
        out.append(np.stack([a, window - c - a, np.full_like(a, c)], 1))
    return out


def repeat_counts(have: np.ndarray, combos: list[np.ndarray], add: int = 48, rounds: int = 40) -> list[tuple[tuple[int, ...], float]]:
    """Non-negative least squares by an active set: columns are combinations, have[length] the right side.

    Up to `add` columns of the steepest gradient enter at a time; those that turn negative
    leave on the way to the unconstrained solution.
    """
    columns = [tuple(int(x) for x in row if x) for block in combos for row in block]
    width = max(len(c) for c in columns)
    index = np.zeros((len(columns), width), np.int64)
    for k, c in enumerate(columns):
        index[k, : len(c)] = c
    size = len(have)
    goal = have.astype(float)
    goal[0] = 0
    usable = np.flatnonzero(((have[index] > 0) | (index == 0)).all(1))
    if not len(usable):
        return []
    index, columns = index[usable], [columns[k] for k in usable]
    active: list[int] = []
    x = np.zeros(0)

    def matrix(cols: list[int]) -> np.ndarray:
        m = np.zeros((size, len(cols)))
        for k in range(width):
            np.add.at(m, (index[cols, k], np.arange(len(cols))), 1.0)
        m[0] = 0
        return m

    for _ in range(rounds):
        rest = goal - matrix(active) @ x if active else goal
        slope = rest[index].sum(1)
        slope[active] = 0
        order = np.argsort(-slope, kind="stable")[: 8 * add]
        taken: set[int] = set()
        fresh = []
        for k in order[slope[order] > 0.5]:
            if len(fresh) < add and not taken & set(columns[k]):
                taken |= set(columns[k])
                fresh.append(int(k))
        if not fresh:
            break
        active += fresh
        x = np.concatenate([x, np.zeros(len(fresh))])
        while active:
            m = matrix(active)
            z = np.linalg.solve(m.T @ m + 1e-7 * np.eye(len(active)), m.T @ goal)
            low = z <= 1e-9
            if not low.any():
                x = z
                break
            step = min(1.0, float(np.min(x[low] / np.maximum(x[low] - z[low], 1e-12))))
            x = x + step * (z - x)
            keep = x > 1e-9
            active, x = [c for c, k in zip(active, keep, strict=True) if k], x[keep]
    return [(columns[c], float(v)) for c, v in zip(active, x, strict=True)]


def plan(have: dict[int, int], window: int = WINDOW) -> dict[str, np.ndarray]:
    """Where the tails of each length go: ranges of ranks, each with its first sequence and its offset there."""
    left = np.zeros(window + 1, np.int64)
    for length, n in have.items():
        left[length] = n
    out: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    used = np.zeros(window + 1, np.int64)
    base = 0

    def place(combo: tuple[int, ...], times: int) -> None:
        nonlocal base
        offset = 0
        for part in combo:
            out.append((part, int(used[part]), base, offset))
            used[part] += times
            left[part] -= times
            offset += part
        base += times

    if left[window]:
        place((window,), int(left[window]))
    if left[1:].any():
        for combo, x in sorted(repeat_counts(left[:window], combinations(window)), key=lambda c: (-c[1], c[0])):
            need = {p: combo.count(p) for p in combo}
            times = min([int(x + 1e-6), *(int(left[p]) // k for p, k in need.items())])
            if times > 0:
                place(combo, times)  # a repeated length takes one range of ranks after the other
    while left.any():
        room, combo = window, []
        while room and len(fits := np.flatnonzero(left[: room + 1])):
            part = int(fits[-1])
            combo.append(part)
            left[part] -= 1
            room -= part
        for part in combo:
            left[part] += 1
        place(tuple(combo), min(int(left[p]) // combo.count(p) for p in set(combo)))
    rows = np.array(sorted(out), np.int64).reshape(-1, 4)
    return {"at": rows[:, 0] * 2**44 + rows[:, 1], "rank": rows[:, 1], "sequence": rows[:, 2], "offset": rows[:, 3]}


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    pieces = store(cut_pieces(docs, path, window), "pieces")
    salts = spread(spark)
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most window x salts rows, whatever the input
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    have = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(have, window)
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(places["at"], length * 2**44 + rank, "right") - 1
            sequence = places["sequence"][k] + rank - places["rank"][k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(places["offset"][k])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, f"{PIECES}, sequence_id bigint, offset bigint")

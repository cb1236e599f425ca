"""Sets of word shingles as sorted arrays of 64-bit hashes, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Odd multiplier of the rolling hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Odd multipliers, one per place in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of text that are hashed at a time.
PART = 1 << 20


@lru_cache(maxsize=2)
def _letters() -> np.ndarray:
    """A 64-bit value per byte; A-Z have those of a-z."""
    value = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]
    return value


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of these bytes, A-Z lower-cased."""
    byte = np.frombuffer(raw, np.uint8)
    inside = ~WHITE[byte]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = 1 << max(20, int(len(byte)).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(len(byte) + 1, np.uint64)
        np.cumsum(_letters()[byte] * _powers(BASE, size)[: len(byte)], out=total[1:])
        h = (total[end] - total[start]) * _powers(INVERSE, size)[start]
        return mix(h + (end - start).astype(np.uint64) * PLACES[1]), start


def shingle_sets(texts: list[bytes | None], size: int = 3) -> Iterator[np.ndarray]:
    """Per text, its distinct shingles, sorted. Fewer words than size: all of them as one; no words: none."""
    group, length = [], 0
    for k, raw in enumerate(texts):
        group.append(raw or b"")
        length += len(group[-1]) + 1
        if length > PART or k == len(texts) - 1:
            yield from _sets(group, size)
            group, length = [], 0


def _sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    h, start = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    edges = np.searchsorted(start, ends).tolist()
    with np.errstate(over="ignore"):
        last = max(0, len(h) - size + 1)
        total = np.full(last, np.uint64(size))
        for k in range(size):
            total = mix(total + h[k : k + last] * PLACES[k])
        first = 0
        for edge in edges:
            n = edge - first
            if n >= size:
                yield np.unique(total[first : edge - size + 1])
            elif n:
                one = np.full(1, np.uint64(n))
                for k in range(n):
                    one = mix(one + h[first + k : first + k + 1] * PLACES[k])
                yield one
            else:
                yield np.zeros(0, np.uint64)
            first = edge

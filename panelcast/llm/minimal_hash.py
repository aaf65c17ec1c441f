"""Minimal perfect hash over distinct 128-bit keys, in numpy.

Levels of bit arrays: a key sits in the first level in which no other remaining key meets its
slot; its number is the count of set bits before it. About three bits a key; the numbers are 0 to
n - 1 without gaps, so plain arrays of n entries hold whatever belongs to the keys.
"""

from __future__ import annotations

import io

import numpy as np

from panelcast.llm.words import mix64

LOAD = 2.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _slots(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix64(high ^ mix64(low + _STEP * np.uint64(level + 1)))
    return (x % np.uint64(size)).astype(np.int64)


class MinimalHash:
    """``MinimalHash.of(high, low)`` over distinct keys (two unsigned 64-bit halves)."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> MinimalHash:
        sizes, words = [], []
        while len(high):
            size = -(-max(64, int(LOAD * len(high))) // 64) * 64
            if len(sizes) > 200:
                raise ValueError("keys repeat")
            slot = _slots(high, low, len(sizes), size)
            met = np.bincount(slot, minlength=size)
            words.append(np.packbits(met == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = met[slot] != 1
            high, low = high[rest], low[rest]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's number; a key that was not indexed gets -1 or the number of another."""
        out = np.full(len(high), -1, np.int64)
        rest, base = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(rest):
                break
            at = base + _slots(high[rest], low[rest], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[rest[here]] = (self.before[at >> 6] + below)[here]
            rest, base = rest[~here], base + size
        return out


def smallest_type(values: np.ndarray) -> np.ndarray:
    """Unsigned counts in the narrowest type that holds the largest."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def to_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_bytes(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}

"""Words of a text as numpy arrays: where they stand and 64-bit hashes of them and of runs of them.

All functions take the UTF-8 bytes of whole texts.  Hashes are polynomial sums modulo 2**64 followed by a
mixing step; equal words have equal hashes on every machine.
"""
from __future__ import annotations

import numpy as np

#: Odd multipliers (any odd 64-bit numbers do).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
M64 = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside letters, digits and non-ASCII: separators for words without punctuation (lower-cased text).
SEPARATOR = np.ones(256, bool)
SEPARATOR[0x30:0x3A] = SEPARATOR[0x61:0x7B] = SEPARATOR[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept, grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(text: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word; ``gap`` marks the bytes between words."""
    if len(text) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~gap[text]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    within = np.arange(total) - np.repeat(first, sizes)
    data = text[within + np.repeat(starts, sizes)]
    values = (data.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, int(sizes.max()))[within]
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def word_hashes(text: np.ndarray, lower: bool = False, gap: np.ndarray = SPACE) -> np.ndarray:
    """Hashes of the words of a text in order; ``lower`` folds A-Z first."""
    if lower:
        text = LOWER[text]
    return hash_spans(text, *spans(text, gap))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        out = np.zeros(n, np.uint64)
        for j, p in enumerate(powers(WORD_BASE, size)):
            out += words[j : j + n] * p
        return mix(out + np.uint64(size))
    return range_hashes(words, np.arange(n), np.arange(n) + size)


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word ranges [start, end); equals ``run_hashes`` for equal content."""
    p = powers(WORD_BASE, len(words) + 1)
    back = powers(pow(WORD_BASE, -1, 1 << 64), len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: np.ndarray | None, size: int, lower: bool = True, gap: np.ndarray = SPACE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text with fewer words is one shingle, none without words."""
    if text is None:
        return np.zeros(0, np.uint64)
    words = word_hashes(text, lower, gap)
    if len(words) == 0:
        return words
    return np.unique(run_hashes(words, min(size, len(words))))

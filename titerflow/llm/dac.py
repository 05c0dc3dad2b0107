"""Directly addressable codes: a byte image of unsigned ids in which any id can be read by itself.

Image, little-endian: the fixed head (magic, level count, document count, id count), the documents' ids,
null marks and id counts, then per level the number of chunks, the chunks (8 bits each), the continuation
bitmap (bit i set: id i goes on in the next level) padded to whole blocks of 512 bits, and the rank
directory (set bits before each block).
"""
from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
HEAD = struct.Struct("<4sIQQ")
COUNT = struct.Struct("<Q")
BLOCK = 512


def build(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """The image of the concatenated ``ids`` of documents that have ``counts`` ids each."""
    value = ids.astype(np.uint32)
    levels = []
    while len(value) or not levels:
        more = value > 255
        bits = np.zeros(-(-max(len(value), 1) // BLOCK) * BLOCK, bool)
        bits[: len(value)] = more
        before = np.zeros(len(bits) // BLOCK, np.uint64)
        before[1:] = np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1))[:-1]
        levels += [COUNT.pack(len(value)), (value & 255).astype(np.uint8).tobytes(), np.packbits(bits, bitorder="little").tobytes(), before.tobytes()]
        value = value[more] >> 8
    head = HEAD.pack(MAGIC, len(levels) // 4, len(doc_ids), len(ids))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], np.int64)
    return b"".join([head, names.tobytes(), known.tobytes(), np.array(counts, np.uint64).tobytes(), *levels])


class Image:
    """Read access to an image."""

    def __init__(self, data: bytes):
        magic, n_levels, n_docs, self.n_ids = HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a directly addressable code image")
        at = HEAD.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        names, known = take(np.int64, n_docs), take(np.uint8, n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known)]
        self.counts = take(np.uint64, n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = COUNT.unpack_from(data, at)[0]
            at += COUNT.size
            blocks = -(-max(n, 1) // BLOCK)
            self.levels.append((take(np.uint8, n), take(np.uint8, blocks * BLOCK // 8), take(np.uint64, blocks)))

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set continuation bits before each position: the directory, then the rest of one block."""
        _, bits, before = self.levels[level]
        block = np.minimum(at // BLOCK, len(before) - 1)
        rank = before[block].astype(np.int64)
        left = at - block * BLOCK
        for j in range(BLOCK // 8):
            use = np.clip(left - 8 * j, 0, 8)
            mask = ((1 << use) - 1).astype(np.uint8)
            rank += np.bitwise_count(bits[block * (BLOCK // 8) + j] & mask)
        return rank

    def access(self, positions) -> np.ndarray:
        """The ids at any positions, each found by itself."""
        at = np.asarray(positions, np.int64)
        out = np.zeros(len(at), np.uint32)
        open_, shift = np.arange(len(at)), 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            if len(at) == 0:
                break
            out[open_] |= chunks[at].astype(np.uint32) << shift
            goes_on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            at = self._rank(level, at[goes_on])
            open_, shift = open_[goes_on], shift + 8
        return out

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range: two ranks give its part of each next level."""
        ends, out, shift = np.array([start, stop], np.int64), np.zeros(stop - start, np.uint32), 0
        open_ = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            a, b = int(ends[0]), int(ends[1])
            if a == b:
                break
            out[open_] |= chunks[a:b].astype(np.uint32) << shift
            inside = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
            open_, shift, ends = open_[inside == 1], shift + 8, self._rank(level, ends)
        return out

"""Spelling variants: words one edit apart, found by depth-first search of a trie over letter-group counts.

A word becomes the vector of how often each group of letters occurs in it.  One edit adds one to a count, takes one
from a count, or both, so a search walks the trie of vectors with a surplus and a deficit of one to spend, and the
words in the leaves that it reaches are compared letter by letter.  The first levels of the trie are Spark's
partitioning: a word visits the few vectors of coarse groups that one edit can lead to.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerflow.llm.common import in_slices, map_arrow, views, written
from titerflow.llm.words import hash_spans
from titerflow.operators.joins import attach

# The letters of a run, and the share of occurrences that lose a letter.
RUN = "[A-Za-zÀ-ÿ]+"
DELETE_ONE_IN = 31
LOWER = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(0xC0, 0x100)]

#: Words of a part of the trie, and visitors of it, that one group holds, about.
WORDS, VISITORS = 1 << 13, 1 << 14
#: Words below which a branch of the trie is compared as it is; letters that have a level of their own.
LEAF, LEVELS = 64, 24

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _crc_table() -> np.ndarray:
    """The remainders of all bytes for the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def _crc32(prefix: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each prefix (given by its own CRC-32) followed by the span of ``data``."""
    out = ~prefix
    order = np.argsort(-sizes, kind="stable")
    register, first, size = out[order], starts[order], sizes[order]
    for j in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -j, side="left"))  # spans longer than j
        register[:live] = _CRC[(register[:live] ^ data[first[:live] + j]) & np.uint32(255)] ^ (register[:live] >> np.uint32(8))
    out[order] = register
    return ~out


def _long_runs(column: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of a string column, and row, start, bytes and code points of its runs of ``least`` or more."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    lead = data == 0xC3  # the only first byte of U+00C0 to U+00FF
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    opens = np.zeros(len(data) + 1, bool)
    opens[at] = True  # a text's start ends the run before it
    starts = np.flatnonzero(inside & (opens[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (opens[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = (ends - starts) - (leads[ends] - leads[starts])
    keep = points >= least
    starts, ends, points = starts[keep], ends[keep], points[keep]
    return _FOLD[data], np.searchsorted(at, starts, side="right") - 1, starts, ends - starts, points


def count_words(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``word, n``: runs of letters, A-Z lower-cased, of at least ``least`` code points after one occurrence in 31, told by
    a checksum of id and run, has lost a code point.  A null id counts as the text ``null``."""

    def work(batches):
        for batch in in_slices(batches, 1024):
            data, row, start, size, points = _long_runs(batch.column(1), least)
            if not len(row):
                continue
            named = [("null" if i is None else str(i)) + ":" for i in batch.column(0).to_pylist()]
            prefix = np.array([zlib.crc32(n.encode()) for n in named], np.uint32)
            h = _crc32(prefix[row], data, start, size).astype(np.int64)
            lose = h % DELETE_ONE_IN == 0
            mask = ~lose
            _, one, n = np.unique(hash_spans(data, start[mask], start[mask] + size[mask]), return_index=True, return_counts=True)
            first, width = start[mask][one], size[mask][one]
            ends = np.cumsum(width)
            flat = data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - width), width)]
            offsets = np.concatenate([[0], ends]).astype(np.int64)
            plain = pa.LargeStringArray.from_buffers(len(width), pa.py_buffer(offsets), pa.py_buffer(flat)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([plain, pa.array(n, pa.int64())], names=["word", "n"])
            short = []
            for k in np.flatnonzero(lose & (points > least)).tolist():
                word = data[start[k] : start[k] + size[k]].tobytes().decode()
                gone = int(h[k]) % len(word)
                short.append(word[:gone] + word[gone + 1 :])
            if short:
                yield pa.RecordBatch.from_arrays([pa.array(short), pa.array([1] * len(short), pa.int64())], names=["word", "n"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letter_shares(words: DataFrame) -> list[str]:
    """The alphabet, most frequent letter first (equal ones by code point)."""

    def work(batches):
        count = np.zeros(256, np.int64)
        for batch in batches:
            raw = np.concatenate([*views(batch.column(0)), np.zeros(0, np.uint8)])
            # U+00C0 to U+00FF: the second byte tells the letter, 0x40 below its code point
            count += np.bincount(np.where(raw >= 0x80, raw.astype(np.int64) + 0x40, raw) * (raw != 0xC3), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(count)], names=["letter", "n"])

    rows = map_arrow(words.select("word"), work, "letter bigint, n bigint").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    sums = {chr(r["letter"]): r["n"] for r in rows}  # 256 rows
    return sorted(LOWER, key=lambda c: (-sums.get(c, 0), c))


def coarse_groups(letters: list[str], n: int) -> list[str]:
    """``n`` groups of letters of about equal weight: dealt out there and back by frequency."""
    groups = [""] * n
    for i, c in enumerate(letters):
        k = i % (2 * n)
        groups[k if k < n else 2 * n - 1 - k] += c
    return groups


def _count(letters: str) -> Column:
    return (F.length("word") - F.length(F.translate("word", letters, ""))).cast("int")


def _visits(n: int) -> list[list[int]]:
    """What a word adds to its coarse counts for the vectors it visits, so that each pair of near words meets once.

    The longer of two words visits the shorter one.  Words of equal length meet under equal counts, or the one
    whose counts are smaller in order visits the other.
    """
    out = [[0] * n]
    for g in range(n):
        out.append([-1 if i == g else 0 for i in range(n)])
        out += [[1 if i == g else -1 if i == k else 0 for i in range(n)] for k in range(g + 1, n)]
    return out


def _matrix(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` are exactly one edit from rows of ``b``, of equal length or one letter shorter."""
    size = a.shape[1]
    head = np.concatenate([a[:, : b.shape[1]] != b, np.ones((len(a), 1), bool)], axis=1).argmax(axis=1)
    tail = np.concatenate([a[:, size - b.shape[1] :][:, ::-1] != b[:, ::-1], np.ones((len(a), 1), bool)], axis=1).argmax(axis=1)
    return (head + tail >= size - 1) & ((head < size) if size == b.shape[1] else True)


class Trie:
    """Words of one length, sorted by their count vectors, so that a node is a range of rows."""

    def __init__(self, words: np.ndarray, level_of: np.ndarray, levels: int):
        counts = self.counts(words, level_of, levels)
        self.order = np.lexsort(counts.T[::-1])
        self.words, self.columns, self.levels = words[self.order], counts[self.order], levels
        self.signs = self.signatures(self.words)

    @staticmethod
    def counts(words: np.ndarray, level_of: np.ndarray, levels: int) -> np.ndarray:
        flat = np.arange(len(words))[:, None] * levels + level_of[words]
        return np.bincount(flat.ravel(), minlength=len(words) * levels).reshape(len(words), levels)

    @staticmethod
    def signatures(words: np.ndarray) -> np.ndarray:
        """Which letters occur an odd number of times: one edit changes two bits at most."""
        return np.bitwise_xor.reduce(np.uint64(1) << (words.astype(np.uint64) & np.uint64(63)), axis=1) if words.shape[1] else np.zeros(len(words), np.uint64)

    def search(self, words: np.ndarray, level_of: np.ndarray, surplus: int, deficit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``words``, word of the trie) that are one edit apart; the trie's word may have up to
        ``surplus`` more and ``deficit`` fewer letters of a group."""
        counts, signs = self.counts(words, level_of, self.levels), self.signatures(words)
        left, right = [], []
        ones = np.ones(len(words), np.int8)
        stack = [(0, len(self.words), 0, np.arange(len(words)), surplus * ones, deficit * ones)]
        while stack:  # depth first; a node is visited once, with all the searches that reach it
            low, high, level, q, more, less = stack.pop()
            if high - low <= LEAF or level == self.levels:
                step = max(1, (1 << 20) // (high - low))
                for at in range(0, len(q), step):
                    mine = q[at : at + step]
                    i, j = np.nonzero(np.bitwise_count(signs[mine][:, None] ^ self.signs[low:high][None, :]) <= 2)
                    i, j = mine[i], j + low
                    for part in range(0, len(i), 1 << 18):
                        a, b = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
                        hit = _near(words[a], self.words[b])
                        left.append(a[hit])
                        right.append(self.order[b[hit]])
                continue
            column = self.columns[low:high, level]
            mine = counts[q, level]
            values, starts = np.unique(column, return_index=True)
            for v, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), high - low]):
                gap = v - mine
                live = (gap == 0) | ((gap == 1) & (more > 0)) | ((gap == -1) & (less > 0))
                if live.any():
                    g = gap[live]
                    stack.append((low + a, low + b, level + 1, q[live], more[live] - (g == 1), less[live] - (g == -1)))
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)


def _tally(words: list[str], n: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, list | np.ndarray]:
    """Per word of the pairs: how many near words it met, and the one that occurs most often."""
    order = np.array(sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i])), np.int64)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    word, other = np.concatenate([a, b]), np.concatenate([b, a])
    sort = np.lexsort((place[other], word))
    word, other = word[sort], other[sort]
    one, first, count = np.unique(word, return_index=True, return_counts=True)
    top = other[first]
    return {"wid": ids[one], "n_near": count, "best": [words[i] for i in top.tolist()], "best_n": n[top]}


def near_words(words: DataFrame, per_group: int = WORDS, visitors: int = VISITORS) -> DataFrame:
    """``wid, n_near, best, best_n`` of every word (``wid, word, n``, ids and words unique) that has a near word.

    Groups are parts of the trie under one vector of coarse counts.  A frequent vector's words and visitors are
    dealt to more groups, each bounded, and what a group finds is added up per word before the shuffle.
    """
    total = words.count()
    letters = letter_shares(words)
    levels = min(LEVELS, len(letters))
    level_of = np.zeros(256, np.int64)
    for i, c in enumerate(letters):
        level_of[ord(c)] = min(i, levels - 1)
    depth = min(8, max(2, math.ceil(math.log(max(total, 1) / per_group, 8)) if total > per_group else 2))
    groups = coarse_groups(letters, depth)
    keyed = words.withColumn("key", F.array(*[_count(g) for g in groups]))
    moves = [
        F.struct(F.array(*[F.col("key")[i] + step for i, step in enumerate(move)]).alias("key"), F.lit(2 if any(move) else 1).alias("role"))
        for move in _visits(depth)
    ]
    calls = keyed.withColumn("move", F.explode(F.array(*moves))).select("wid", "word", "n", "move.key", "move.role")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    asked = calls.groupBy("key").agg(F.count(F.lit(1)).alias("asked"))
    plan = written(sizes.join(asked, "key").select("key", F.ceil(F.col("held") / per_group).cast("int").alias("w"), F.ceil(F.col("asked") / visitors).cast("int").alias("v")))

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row in one share of its own side and in all shares of the other."""
        own, copies = F.pmod(F.xxhash64("wid"), F.col(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        out = attach(rows, plan, "key", "inner").withColumn(f"_{mine}", own).withColumn(f"_{other}", copies)
        return out.select("key", "_w", "_v", "wid", "word", "n", "role")

    every = dealt(keyed.withColumn("role", F.lit(0)), "w", "v").unionByName(dealt(calls, "v", "w"))

    def search(group: pa.Table) -> pa.Table:
        role = group["role"].to_numpy()
        order = np.argsort(role, kind="stable")
        role, ids, n = role[order], group["wid"].to_numpy()[order], group["n"].to_numpy()[order]
        words = group["word"].combine_chunks().take(pa.array(order)).to_pylist()
        held = int((role == 0).sum())
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        left, right = [], []
        if held:
            trie = Trie(_matrix(words[:held]), level_of, levels)
            for width, budget in ((sizes[0], (1, 1)), (sizes[0] + 1, (0, 1))):
                rows = held + np.flatnonzero(sizes[held:] == width)
                if len(rows):
                    a, b = trie.search(_matrix([words[i] for i in rows.tolist()]), level_of, *budget)
                    left.append(rows[a])
                    right.append(b)
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        once = (role[a] == 2) | (ids[a] < ids[b])  # words at home visit each other: such a pair counts from one side
        found = _tally(words, n, ids, a[once], b[once])
        kinds = [("wid", pa.int64()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())]
        return pa.table({name: pa.array(found[name], kind) for name, kind in kinds})

    found = every.groupBy("key", "_w", "_v").applyInArrow(search, "wid bigint, n_near bigint, best string, best_n bigint")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("wid").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("wid", "n_near", F.col("top.word").alias("best"), (-F.col("top.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each ``word, form``: forms followed to the last, by pointer jumping.

    A form occurs ten times as often as its word, so chains are short whatever the number of words.
    """
    state = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while state.where("open").limit(1).count():
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = state.join(ahead, "root", "left")
        state = written(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")))
    return state.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2, ratio: int = 10, per_group: int = WORDS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``least`` code points and ``occurrences``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; one occurrence in 31, told by the CRC-32
    of ``<id>:<run>``, loses the code point at that number modulo its length.  Words are near if one inserted,
    deleted or replaced code point leads from one to the other.  A word's ``form`` is its near word of largest n
    (ties: smallest in code-point order) if that is at least ``ratio`` times its own; ``root`` follows forms.

    Null, empty and letterless texts have no words; a very long run is a word like others.  Every row counts, also
    where rows or ids repeat; a null id counts as the text ``null``.  An empty table gives no rows.
    """
    counted = count_words(docs, id_col, text_col, least).where(F.col("n") >= occurrences)
    words = written(counted.withColumn("wid", F.monotonically_increasing_id()))
    found = written(near_words(words, per_group))
    rows = attach(words, found, "wid", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    rows = written(rows.select("word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return attach(rows, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Repeated passages inside and across documents: winnowed seeds, extension both ways, maximal repeats removed."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerflow.llm.common import ID, SUB, in_slices, map_arrow, same, views, with_key, written
from titerflow.llm.words import hash_spans, mix, range_hashes, run_hashes, spans

#: Words of a seed; a window of 20 words holds 13 of them and always picks the same one.
SEED = 8


def _runs(words: np.ndarray, window: int, seed: int):
    """Seed hashes, and per selected seed: its position and the first and last window start that select it."""
    seeds = run_hashes(words, seed)
    per = window - seed + 1
    pick = np.lib.stride_tricks.sliding_window_view(seeds, per).argmin(axis=1) + np.arange(len(words) - window + 1)
    cut = np.flatnonzero(np.diff(pick)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(pick)]]) - 1
    return seeds, pick[first], first, last


def seed_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``seed, context, id, sub, at`` per selected seed of the keyed documents ``id, sub, text``.

    ``context`` is a hash of all the words of the windows that select the seed, ``at`` packs the seed's
    position and its distances from the first and last of those windows.
    """

    def work(batches):
        for batch in in_slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            subs = batch.column(1).to_numpy(zero_copy_only=False)
            out, row_of = [], []
            for k, text in enumerate(views(batch.column(2))):
                if text is None:
                    continue
                words = hash_spans(text, *spans(text))
                if len(words) < window:
                    continue
                seeds, at, first, last = _runs(words, window, seed)
                before, after = (at - first).astype(np.uint64), (at - last).astype(np.uint64)
                context = mix(range_hashes(words, first, last + window) + before * np.uint64(977) + after * np.uint64(7919))
                packed = (at.astype(np.uint64) << np.uint64(16)) | (before << np.uint64(8)) | after
                out.append((seeds[at].view(np.int64), context.view(np.int64), packed.view(np.int64)))
                row_of.append(np.full(len(at), k))
            if not out:
                continue
            rows = np.concatenate(row_of)
            columns = [pa.array(np.concatenate([o[j] for o in out])) for j in range(3)]
            doc = pa.array(np.where(known, ids, 0).astype(np.int64)[rows], mask=~known[rows])
            yield pa.RecordBatch.from_arrays(
                [columns[0], columns[1], doc, pa.array(subs.astype(np.int64)[rows]), columns[2]],
                names=["seed", "context", "id", "sub", "at"],
            )

    return map_arrow(docs, work, "seed bigint, context bigint, id bigint, sub bigint, at bigint")


def _window_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``seed, win, id, sub, start`` of all windows that select one of the listed seeds (column ``ats``)."""

    def work(batches):
        for batch in in_slices(batches, 256):
            lists = batch.column(3)
            out = []
            for k, text in enumerate(views(batch.column(2))):
                words = hash_spans(text, *spans(text))
                packed = np.array(lists[k].as_py(), np.int64)
                at, before, after = packed >> 16, (packed >> 8) & 255, packed & 255
                sizes = before - after + 1
                begin = np.repeat(at - before, sizes)
                start = begin + np.arange(len(begin)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                seeds = run_hashes(words, seed)[at]
                out.append((np.full(len(start), k), np.repeat(seeds, sizes), range_hashes(words, start, start + window), start))
            rows = pa.array(np.concatenate([o[0] for o in out]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([o[1] for o in out]).view(np.int64)),
                    pa.array(np.concatenate([o[2] for o in out]).view(np.int64)),
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(np.concatenate([o[3] for o in out])),
                ],
                names=["seed", "win", "id", "sub", "start"],
            )

    return map_arrow(docs, work, "seed bigint, win bigint, id bigint, sub bigint, start bigint")


def later_spans(keyed: DataFrame, window: int = 20, seed: int = SEED) -> DataFrame:
    """``id, sub, start, stop``: word ranges of ``keyed`` (id, sub, text) all of whose windows also start earlier."""
    if window - seed > 255:
        raise ValueError("window - seed has to be 255 at most: distances are packed into 8 bits")
    occurrences = seed_rows(keyed, window, seed)
    shared = written(occurrences.groupBy("seed").count().where("count > 1").select("seed"))
    hits = written(occurrences.join(shared, "seed", "left_semi"))
    # Occurrences with the same whole context match as far as their windows reach: all but the first repeat it.
    contexts = written(
        hits.groupBy("seed", "context").agg(F.min(F.struct("id", "at")).alias("first"))
    )
    several = contexts.groupBy("seed").count().where("count > 1").select("seed", F.lit(True).alias("several"))
    origin = contexts.join(several, "seed", "left")
    placed = written(
        hits.join(origin, ["seed", "context"])
        .withColumn("is_first", F.struct("id", "at") == F.col("first"))
        .where("not is_first or several")
        .select("id", "sub", "at", "is_first")
    )
    position = F.shiftright("at", 16)
    before, after = F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    whole = placed.where("not is_first").select(
        "id", "sub", (position - before).alias("start"), (position - after + window).alias("stop")
    )
    # Where contexts differ (a repeat ends nearby) each window is compared by itself.
    edge = placed.where("is_first").groupBy("id", "sub").agg(F.collect_list("at").alias("ats"))
    joined = keyed.join(edge, same(keyed, edge, "id", "sub")).select(keyed["id"], keyed["sub"], keyed["text"], edge["ats"])
    windows = written(_window_rows(joined, window, seed))
    first = windows.groupBy("seed", "win").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    single = (
        windows.join(first, ["seed", "win"])
        .where(F.struct("id", "start") != F.col("first"))
        .select("id", "sub", "start", (F.col("start") + window).alias("stop"))
    )
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, repeats`` for every row of ``docs``.

    A word is removed when a window of ``window`` consecutive words of its document covers it and the same
    words also start earlier: in a document with a smaller id, or before it in the same one.  ``kept`` is the
    remaining words joined by one space, ``repeats`` the maximal removed word ranges ``[start, stop)``.

    Every window picks one seed of ``seed`` words from its own content (winnowing), so all copies of a window
    share the seed and its place; seeds that occur twice join their documents, whole contexts and then single
    windows extend them both ways.  All counts are minima and sums per key that combine before the shuffle:
    a passage in a third of all documents is not gathered anywhere.

    Words are maximal runs without ASCII white space, unchanged.  A null text has no words (``kept`` is
    empty).  A null id sorts before all others; rows that repeat an id do not precede each other, so equal rows
    get equal results.  Extra columns are ignored.
    """
    keyed = with_key(docs, id_col, text_col).select(
        F.col(ID).alias("id"), F.col(SUB).alias("sub"), F.col(text_col).alias("text")
    )
    pack = F.shiftleft(F.col("start"), 31).bitwiseOR(F.col("stop"))
    removed = later_spans(keyed, window, seed).groupBy("id", "sub").agg(F.collect_list(pack).alias("cut"))
    joined = keyed.join(removed, same(keyed, removed, "id", "sub"), "left").select(keyed["id"], keyed["text"], removed["cut"])

    def work(batches):
        for batch in in_slices(batches, 256):
            cuts = batch.column(2)
            n_words, n_removed, kept, repeats = [], [], [], []
            for k, text in enumerate(views(batch.column(1))):
                text = np.zeros(0, np.uint8) if text is None else text
                starts, ends = spans(text)
                ranges = np.zeros((0, 2), np.int64)
                keep = np.ones(len(starts), bool)
                if cuts[k].is_valid:
                    packed = cuts[k].values.to_numpy()
                    depth = np.zeros(len(starts) + 1, np.int64)
                    np.add.at(depth, packed >> 31, 1)
                    np.add.at(depth, packed & ((1 << 31) - 1), -1)
                    keep = np.cumsum(depth)[:-1] == 0
                    edge = np.diff(np.concatenate([[0], ~keep, [0]]).astype(np.int8))
                    ranges = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
                n_words.append(len(starts))
                n_removed.append(int((~keep).sum()))
                kept.append(_joined(text, starts[keep], ends[keep]))
                repeats.append([{"start": int(a), "stop": int(b)} for a, b in ranges])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(repeats, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_removed", "kept", "repeats"],
            )

    return map_arrow(
        joined, work,
        "doc_id bigint, n_words bigint, n_removed bigint, kept string, repeats array<struct<start:bigint,stop:bigint>>",
    )


def _joined(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    if len(starts) == 0:
        return b""
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
    padded = np.append(text, np.uint8(32))
    out = padded[at]
    out[first + sizes - 1] = 32
    return out[:-1].tobytes()

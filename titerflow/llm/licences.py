"""Licence notices in documents, found by a positional index of rare licence words."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerflow.llm.common import in_slices, map_arrow, views
from titerflow.llm.words import SEPARATOR, word_hashes


@dataclass(frozen=True)
class Template:
    """A notice: its label, its words, and the key phrase without which it does not count."""

    label: str
    text: str
    key: str
    base: bool = False


#: The phrases that are always looked for.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)
#: Notices with labels of their own.
NOTICES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    Template("isc", "released under the isc license", "isc license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def _hashes(text: str) -> np.ndarray:
    return word_hashes(np.frombuffer(text.encode(), np.uint8), lower=True, gap=SEPARATOR)


def _vocabulary(templates) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t.text) for t in templates]))


def _licence_words(text: np.ndarray | None, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word of the text its number in the vocabulary (-1: not in it), and the positions of those that are."""
    words = np.zeros(0, np.uint64) if text is None else word_hashes(text, lower=True, gap=SEPARATOR)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    number = np.where(vocabulary[at] == words, at, -1)
    return number, np.flatnonzero(number >= 0)


def licence_word_frequency(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each licence word stands, over all of them, and the number of documents."""

    def work(batches):
        count = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in in_slices(batches):
            for text in views(batch.column(0)):
                number, where = _licence_words(text, vocabulary)
                count[np.unique(number[where])] += 1
            count[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count)], names=["w", "n"])

    rows = map_arrow(docs.select(text_col), work, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:  # one row per licence word
        out[r["w"]] = r["n"]
    return out[:-1], int(out[-1])


@dataclass
class Index:
    """Postings ``(template, position)`` of the rarest words of each template."""

    words: list[np.ndarray]
    keys: list[tuple[int, int]]
    need: list[int]
    postings: dict[int, list[tuple[int, int]]]


def build_index(templates, vocabulary: np.ndarray, frequency: np.ndarray, rare: int) -> Index:
    """A template's postings are ``rare`` of its words: the two rarest of its key phrase, then those of highest IDF.

    A base phrase has one: each of its places holds that word.  Others need two at the same relative place, which
    every place of the key phrase has, whatever the other words are.
    """
    words, keys, need, postings = [], [], [], {}
    for t, template in enumerate(templates):
        w = np.searchsorted(vocabulary, _hashes(template.text))
        k = np.searchsorted(vocabulary, _hashes(template.key))
        start = next(i for i in range(len(w)) if np.array_equal(w[i : i + len(k)], k))
        in_key = sorted(range(start, start + len(k)), key=lambda i: (frequency[w[i]], i))
        others = sorted((i for i in range(len(w)) if i not in in_key[:2]), key=lambda i: (frequency[w[i]], i))
        used = in_key[:1] if template.base else in_key[:2] + others[: max(rare - 2, 0)]
        for i in used:
            postings.setdefault(int(w[i]), []).append((t, i))
        words.append(w)
        keys.append((start, start + len(k)))
        need.append(1 if template.base else min(2, len(k)))
    return Index(words, keys, need, postings)


def _found(number: np.ndarray, where: np.ndarray, index: Index) -> dict[int, list[tuple[int, float]]]:
    """Per template the starts of its verified places and the share of its words that stand there."""
    out: dict[int, list[tuple[int, float]]] = {}
    if len(where) == 0:
        return out
    votes: dict[int, list[np.ndarray]] = {}
    present = number[where]
    for w in np.unique(present).tolist():
        for t, i in index.postings.get(w, ()):
            votes.setdefault(t, []).append(where[present == w] - i)
    for t, starts in votes.items():
        start, count = np.unique(np.concatenate(starts), return_counts=True)
        start = start[count >= index.need[t]]
        a, b = index.keys[t]
        start = start[(start + a >= 0) & (start + b <= len(number))]
        for i in range(a, b):  # the key phrase has to stand there word by word
            start = start[number[start + i] == index.words[t][i]]
        if len(start):
            size = len(index.words[t])
            at = start[:, None] + np.arange(size)
            inside = (at >= 0) & (at < len(number))
            same = (number[np.clip(at, 0, len(number) - 1)] == index.words[t]) & inside
            out[t] = list(zip(start.tolist(), same.mean(axis=1).tolist()))
    return out


def licence_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Template, ...] = NOTICES, rare: int = 4
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places`` per row.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  The document frequency of
    every licence word is counted over all documents; the rarest words of each template are its postings in a
    positional index.  A document's licence words are looked up, postings that agree on the relative position
    make a candidate place, and its mandatory key phrase is verified word by word.  Base phrases are indexed
    by their rarest word alone, so every place of theirs is found; ``first_word`` and ``last_word`` are their
    smallest and largest start.  ``labels`` adds the notices' labels, ``places`` lists label and start of
    every place, and ``score`` is the best share of a template's words standing at a verified place.

    A null, empty or punctuation-only text has no words: counts 0, labels empty, score 0, starts null.
    Repeated rows get equal results; ids may be null.
    """
    templates = BASE + tuple(notices)
    vocabulary = _vocabulary(templates)
    frequency, _ = licence_word_frequency(docs, text_col, vocabulary)
    index = build_index(templates, vocabulary, frequency, rare)
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))

    def work(batches):
        for batch in in_slices(batches):
            columns: list[list] = [[] for _ in range(8)]
            for text in views(batch.column(1)):
                number, where = _licence_words(text, vocabulary)
                found = _found(number, where, index)
                base = sorted(s for t, hits in found.items() if templates[t].base for s, _ in hits)
                own = sorted({templates[t].label for t in found if templates[t].base})
                every = sorted({templates[t].label for t in found})
                places = sorted((s, templates[t].label) for t, hits in found.items() for s, _ in hits)
                row = (
                    len(number), len(base), base[0] if base else None, base[-1] if base else None, ",".join(own), ",".join(every),
                    max((share for hits in found.values() for _, share in hits), default=0.0),
                    [{"label": label, "start": s} for s, label in places],
                )
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), place]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
            )

    return map_arrow(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), work,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, places array<struct<label:string,start:bigint>>",
    )

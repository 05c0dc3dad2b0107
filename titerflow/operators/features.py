"""Hashed features of text and folding of unbounded counts."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerflow.functions.columns import as_col
from titerflow.session import ship

#: Characters, and texts, that a task counts at a time; n-grams whose index it remembers.
CHARS, TEXTS, REMEMBERED = 1_000_000, 1_000, 1_000_000
#: Numbers up to this are told apart by a table, larger ones by sorting.
TABLE = 4_000_000


def char_ngrams(col: Column | str, n: int = 3) -> Column:
    """All overlapping character n-grams of the whole text, in one linear pass."""
    return F.regexp_extract_all(as_col(col), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _indices(grams: np.ndarray, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Feature index of every row of code points: the first eight hex digits of the n-gram's md5, modulo ``size``."""
    if len(known) > REMEMBERED:
        known.clear()
    out = np.empty(len(grams), "int64")
    for i, gram in enumerate(grams):
        key = gram.tobytes()
        if key not in known:
            digest = hashlib.md5(key.decode("utf-32-le").encode()).digest()
            known[key] = int.from_bytes(digest[:4], "big") % size
        out[i] = known[key]
    return out


def _distinct(values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order and each value's place among them; all are below ``end``."""
    if end > TABLE:
        found, at = np.unique(values, return_inverse=True)
        return found, at.ravel()
    seen = np.zeros(end, bool)
    seen[values] = True
    found = np.flatnonzero(seen)
    place = np.empty(end, "int32")
    place[found] = np.arange(len(found))
    return found, place[values]


def _pieces(texts: list[str], n: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts in parts of about ``CHARS`` characters, as one string with each part's text and length.

    Parts of one text share ``n - 1`` characters, so that each of its n-grams lies in one part.
    """
    parts, rows, total = [], [], 0
    for row, text in enumerate(texts):
        for start in range(0, max(len(text) - n + 1, 0), CHARS):
            parts.append(text[start : start + CHARS + n - 1])
            rows.append(row)
            total += len(parts[-1])
            if total >= CHARS:
                yield "".join(parts), np.array(rows), np.array([len(p) for p in parts])
                parts, rows, total = [], [], 0
    if parts:
        yield "".join(parts), np.array(rows), np.array([len(p) for p in parts])


def _counted(texts: list[str], n: int, size: int, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature index and number of n-grams, in this order; only different n-grams are hashed."""
    cells, counts = [np.empty(0, "int64")], [np.empty(0, "int64")]
    for joined, rows, lengths in _pieces(texts, n):
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        part = np.repeat(np.arange(len(rows)), lengths)
        last = len(codes) - n + 1
        inside = part[:last] == part[n - 1 :]
        # code points by their rank: n-grams are whole numbers, as long as these fit
        letters, rank = _distinct(codes, 0x110000)
        if len(letters) ** n < 2**62:
            gram = sum(rank[i : last + i].astype("int64") * len(letters) ** (n - 1 - i) for i in range(n))[inside]
            different, at = _distinct(gram, len(letters) ** n)
            spelled = np.stack([letters[different // len(letters) ** (n - 1 - i) % len(letters)] for i in range(n)], 1)
        else:
            spelled, at = np.unique(np.lib.stride_tricks.sliding_window_view(codes, n)[inside], axis=0, return_inverse=True)
        first = int(rows[0])
        cell = (rows - first)[part[:last][inside]] * size + _indices(np.ascontiguousarray(spelled.astype("<u4")), size, known)[at.ravel()]
        found, at = _distinct(cell, (int(rows[-1]) - first + 1) * size)
        cells.append(found + first * size)
        counts.append(np.bincount(at, minlength=len(found)))
    cell, total = np.concatenate(cells), np.concatenate(counts)
    if len(cell) > 1 and (np.diff(cell) <= 0).any():  # a text has several parts
        cell, at = np.unique(cell, return_inverse=True)
        total = np.bincount(at, total, len(cell)).astype("int64")
    return cell // size, (cell % size).astype("int32"), total


def _gram_lists(texts: Iterator[pa.Array], n: int, size: int, counts: bool) -> Iterator[pa.Array]:
    """Per text the sorted feature indices, with ``counts`` as structs (feature, x); NULL stays NULL."""
    known: dict[bytes, int] = {}
    for batch in texts:
        done = []
        for low in range(0, len(batch), TEXTS):
            some = batch.slice(low, TEXTS)
            row, feature, x = _counted([t or "" for t in some.to_pylist()], n, size, known)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)))]).astype("int32")
            values = pa.StructArray.from_arrays([pa.array(feature), pa.array(x)], ["feature", "x"]) if counts else pa.array(feature)
            done.append(pa.ListArray.from_arrays(pa.array(ends), values, mask=some.is_null()))
        yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.struct({"feature": pa.int32(), "x": pa.int64()}) if counts else pa.int32()))


def gram_features(col: Column | str, n: int, size: int, counts: bool = False) -> Column:
    """``_gram_lists`` of a text column, by md5, which other engines can repeat."""

    def lists(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _gram_lists(texts, n, size, counts)

    lists.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(lists, "array<struct<feature:int,x:bigint>>" if counts else "array<int>")(as_col(col))


def bucket_of(gram: Column, size: int) -> Column:
    """Feature index of an n-gram by Spark's own hash."""
    return F.pmod(F.xxhash64(gram), F.lit(size)).cast("int")


def hash_features(
    df: DataFrame, col: str, n: int = 3, size: int = 2048, on_invalid: str = "drop", valid: Column | None = None,
    portable: bool = False, name: str = "bits",
) -> DataFrame:
    """Sorted on-bit indices of the text's n-grams.

    Invalid rows (NULL text, or ``valid`` false) are dropped for training or get no bits for scoring.  ``portable``
    hashes by md5, each different n-gram of a batch once, in vectorised tasks; else Spark hashes every n-gram.
    """
    ok = F.col(col).isNotNull() if valid is None else F.col(col).isNotNull() & valid
    if portable:
        ship(df.sparkSession)
        on = gram_features(F.when(ok, F.col(col)), n, size)
    else:
        grams = F.array_distinct(char_ngrams(col, n))
        on = F.array_sort(F.array_distinct(F.transform(grams, lambda g: bucket_of(g, size))))
    if on_invalid == "drop":
        return df.where(ok).withColumn(name, on)
    if on_invalid == "zero":
        return df.withColumn(name, F.when(ok, on).otherwise(F.array().cast("array<int>")))
    raise ValueError(f"unknown rule {on_invalid!r} for invalid rows")


def count_features(
    df: DataFrame, col: str, entity: str = "entity", n: int = 3, size: int = 2048, portable: bool = False
) -> DataFrame:
    """Long ``(entity, feature, x)`` with the number of n-grams per index.

    Counting happens per task before the shuffle, so a long text sends at most ``size`` rows.
    """
    known = df.where(F.col(col).isNotNull())
    if portable:
        ship(df.sparkSession)
        counted = known.select(entity, F.explode(gram_features(col, n, size, counts=True)).alias("_c"))
        return counted.groupBy(entity, F.col("_c.feature").alias("feature")).agg(F.sum("_c.x").alias("x"))
    grams = known.select(entity, F.explode(char_ngrams(col, n)).alias("_g"))
    return grams.groupBy(entity, bucket_of(F.col("_g"), size).alias("feature")).agg(
        F.count(F.lit(1)).alias("x")
    )


def fold_counts(df: DataFrame, n_bits: int, entity: str = "entity", feature: str = "feature", x: str = "x") -> DataFrame:
    """Sum counts of an unbounded index space at ``index mod n_bits``."""
    return df.groupBy(entity, F.pmod(F.col(feature), F.lit(n_bits)).cast("int").alias(feature)).agg(F.sum(x).alias(x))


def custom_features(df: DataFrame, col: str, featurizer: Callable[[Column], Column], name: str = "bits") -> DataFrame:
    """Plug in a pandas UDF ``string -> array<int>``; it is called once per distinct text."""
    from titerflow.operators.joins import map_distinct

    return map_distinct(df, col, featurizer, name)

"""Quality scores by regularised quadratic discriminant analysis of document statistics."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerflow.llm.common import ID, SUB, arrow_lists, in_slices, map_arrow, same, views, with_key, written
from titerflow.llm.words import LOWER, hash_spans, spans

#: Names of the statistics, in order.  All are made from the text alone.
STATISTICS = (
    "log words", "mean word length", "deviation of word lengths", "capital share", "digit share", "sign share",
    "odd sign share", "full-capital words", "words ending in a sign", "words starting with a capital", "distinct words",
    "largest word share", "repeated neighbours", "distinct lines", "words per line", "non-ASCII share", "byte entropy",
    "signs alone", "words ending in an odd sign",
)
_CLASS = np.zeros((256, 6))
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c, 2] = 1
        if chr(_c) not in ".,'-\"":
            _CLASS[_c, 3] = 1
_CLASS[128:, 4] = 1
_CLASS[[32, 9, 10, 11, 12, 13], 5] = 1
CAPITAL, DIGIT, SIGN, ODD, HIGH, _ = (_CLASS[:, k] == 1 for k in range(6))


def statistics(text: np.ndarray | None) -> np.ndarray:
    """The transformed statistics of one whole text: logs of sizes, logits of shares."""
    out = np.zeros(len(STATISTICS))
    if text is None or len(text) == 0:
        return out
    counts = np.bincount(text, minlength=256)
    capital, digit, sign, odd, high, blank = counts @ _CLASS
    starts, ends = spans(text)
    n = len(starts)
    if n == 0:
        return out
    letters = len(text) - blank
    sizes = ends - starts
    last, first = text[ends - 1], text[starts]
    capitals = np.add.reduceat(CAPITAL[text], starts, dtype=np.int64)
    signs = np.add.reduceat(SIGN[text], starts, dtype=np.int64)
    hashes = hash_spans(LOWER[text], starts, ends)
    _, often = np.unique(hashes, return_counts=True)
    lines = text.tobytes().split(b"\n")
    lines = [x for x in lines if x.strip()]
    p = counts[counts > 0] / len(text)

    def logit(share: float, of: float) -> float:
        return float(np.log((share + 0.5) / (of - share + 0.5)))

    out[:] = (
        np.log(n), np.log(sizes.mean()), np.log1p(sizes.std()), logit(capital, letters), logit(digit, letters),
        logit(sign, letters), logit(odd, letters), logit(((capitals >= sizes - signs) & (sizes - signs > 1)).sum(), n),
        logit(SIGN[last].sum(), n), logit(CAPITAL[first].sum(), n), logit(len(often), n), logit(often.max(), n),
        logit((hashes[1:] == hashes[:-1]).sum(), n), logit(len(set(lines)), len(lines)), np.log(n / len(lines)),
        logit(high, letters), -(p * np.log(p)).sum(), logit((signs == sizes).sum(), n), logit(ODD[last].sum(), n),
    )
    return out


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunk covariances, log determinants and log priors."""

    mean: np.ndarray
    factor: np.ndarray
    offset: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row: the logistic of the log-density difference."""
        d = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            d.append(self.offset[c] - 0.5 * (z * z).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(d[0] - d[1], -60, 60)))


def fit_discriminant(n: np.ndarray, total: np.ndarray, outer: np.ndarray, shrink: float, ridge: float) -> Discriminant:
    """From counts, sums and sums of outer products per class (0, 1).

    Each class covariance moves by ``shrink`` towards the covariance of both classes, and that by ``ridge``
    towards a multiple of the unit matrix.  A class without rows takes the other's moments.
    """
    k = total.shape[1]
    n = n.astype(float)
    if n.sum() == 0:
        return Discriminant(np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2))
    mean = np.stack([total[c] / n[c] if n[c] else total[1 - c] / n[1 - c] for c in (0, 1)])
    scatter = [outer[c] - n[c] * np.outer(mean[c], mean[c]) if n[c] else np.zeros((k, k)) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    pooled = (1 - ridge) * pooled + ridge * np.eye(k) * max(np.trace(pooled) / k, 1e-6)
    factor, offset = [], []
    for c in (0, 1):
        weight = shrink if n[c] > 1 else 1.0
        cov = (1 - weight) * scatter[c] / max(n[c], 1) + weight * pooled
        low = np.linalg.cholesky(cov)
        factor.append(np.linalg.inv(low))
        offset.append(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(mean, np.stack(factor), np.array(offset))


def document_statistics(keyed: DataFrame) -> DataFrame:
    """``id, sub, x`` for documents ``id, sub, text``."""

    def work(batches):
        for batch in in_slices(batches):
            x = [statistics(t) for t in views(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), arrow_lists(x, pa.float64())], names=["id", "sub", "x"]
            )

    return map_arrow(keyed.select("id", "sub", "text"), work, "id bigint, sub bigint, x array<double>")


def class_moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of outer products of ``x`` per ``label`` over all rows.

    Tasks add up their rows; what reaches the driver has a fixed size.
    """
    k = len(STATISTICS)

    def work(batches):
        sums = np.zeros((2, 1 + k + k * k))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column(0).values.to_numpy().reshape(-1, k) if batch.column(0).offset == 0 else np.array(batch.column(0).to_pylist())
            y = batch.column(1).to_numpy()
            for c in (0, 1):
                part = x[y == c]
                sums[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], names=["at", "v"])

    parts = map_arrow(rows.select("x", F.col("label").cast("int").alias("label")), work, "at bigint, v double")
    got = np.zeros(2 * (1 + k + k * k))
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        got[r["at"]] = r["v"]
    got = got.reshape(2, -1)
    return got[:, 0], got[:, 1 : 1 + k], got[:, 1 + k :].reshape(2, k, k)


def held_out(id_col: str) -> F.Column:
    """Whether an id is kept from learning: crc32 of its decimal text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, shrink: float = 0.7, ridge: float = 1e-3,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A quadratic discriminant with shrinkage covariances is fitted to transformed statistics of the labelled
    documents that are not held out, all of them; labels other than 0 and 1 are ignored, each label row
    counts.  The score is the logistic of the difference of Mahalanobis log densities, made with the cached
    Cholesky factors, and ``predicted`` is 1 from ``threshold`` on.

    Null, empty and blank texts have all statistics 0 and are scored like any other.  Rows are independent:
    repeated rows get equal scores, rows without an id are never learned from.  Without any usable label all
    scores are 0.5.
    """
    keyed = with_key(docs, id_col, text_col).select(F.col(ID).alias("id"), F.col(SUB).alias("sub"), F.col(text_col).alias("text"))
    stats = written(document_statistics(keyed))
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label")).where("label in (0, 1)")
    train = stats.where(~held_out("id")).join(known, "id")
    model = fit_discriminant(*class_moments(train), shrink, ridge)
    k = len(STATISTICS)

    def work(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x)), batch.column(2)], names=["id", "score", "sub"])

    scored = map_arrow(stats.select("id", "x", "sub"), work, "id bigint, score double, sub bigint")
    return scored.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "sub",
    )


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    scores = quality_scores(docs, labels, id_col, text_col, **options).where("predicted = 1")
    good = scores.select(F.col("doc_id").alias(ID), F.col("sub").alias(SUB)).dropDuplicates()
    keyed = with_key(docs, id_col, text_col)
    return keyed.join(good, same(keyed, good, ID, SUB), "left_semi").select(*docs.columns)

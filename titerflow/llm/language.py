"""Language of documents by error-correcting output codes over n-gram classifiers."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerflow.llm.common import arrow_lists, in_slices, map_arrow, views, written
from titerflow.llm.quality import held_out

#: Hash buckets of the n-grams of 2 to 4 bytes.
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and numerals such as superscripts
#: Languages that can be learned; more are taken for a mistake in the column.
MAX_LANGUAGES = 512


def grams(text: np.ndarray) -> np.ndarray:
    """Buckets of all byte n-grams; ASCII other than letters counts as a blank, the ends as blanks too."""
    b = np.concatenate([[32], _FOLD[text], [32]]).astype(np.uint32)
    out = []
    run = b
    for n, odd in ((2, 0x9E3779B1), (3, 0x85EBCA77), (4, 0xC2B2AE3D)):
        run = (run[:-1] << np.uint32(8)) | b[n - 1 :]
        out.append(((run + np.uint32(n)) * np.uint32(odd)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


def has_letter(text: np.ndarray | None) -> bool:
    if text is None or len(text) == 0:
        return False
    if (_FOLD[text] != 32)[text < 128].any():
        return True
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text.tobytes().decode("utf-8")))


def code_words(n: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per language.

    Up to seven languages get the exhaustive code (every split of the languages once); more get the random
    code of 10 log2(n) columns, of 200 drawn, whose closest rows differ most.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1 if j == 0 or (c >> (j - 1)) & 1 else -1 for j in range(n)] for c in range((1 << (n - 1)) - 1)]
        return np.array(columns, float).T
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        distance = (code.shape[1] - code @ code.T) / 2
        least = distance[~np.eye(n, dtype=bool)].min()
        split = (np.abs(code.sum(axis=0)) < n).all()
        if split and least > far:
            best, far = code, least
    return best


def gram_counts(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram counts over all training documents ``text, lang``.

    Tasks add up their documents; a table of languages x buckets reaches the driver, whatever the input.
    """

    def work(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in in_slices(batches):
            for text, lang in zip(views(batch.column(0)), batch.column(1).to_pylist()):
                if text is not None and len(text):
                    have = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    have += np.bincount(grams(text), minlength=BUCKETS)
                else:
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
        for lang, have in counts.items():
            at = np.flatnonzero(have) if have.any() else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(have[at])], names=["lang", "at", "n"]
            )

    rows = map_arrow(train.select("text", "lang"), work, "lang string, at bigint, n bigint")
    got = rows.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(np.array(langs, object), got["lang"].to_numpy()) if langs else [], got["at"]] = got["n"]
    return langs, counts


def bit_weights(counts: np.ndarray, code: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Per bucket and bit the log odds of the n-gram among the languages with that bit against the others.

    Every language weighs the same, however many documents it has.
    """
    profile = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * BUCKETS)
    out = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        yes, no = profile[code[:, b] > 0], profile[code[:, b] < 0]
        if len(yes) and len(no):
            out[:, b] = np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0))
    return out


def bit_margins(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """``id, lang, letters, margins``: each bit's summed log odds over the square root of the number of n-grams."""
    bits = weights.shape[1]

    def work(batches):
        for batch in in_slices(batches, 256):
            margins, letters = [], []
            for text in views(batch.column(1)):
                letters.append(has_letter(text))
                if not letters[-1]:
                    margins.append(np.zeros(bits))
                    continue
                g = grams(text)
                total = np.zeros(bits)
                for at in range(0, len(g), 8192):
                    total += weights[g[at : at + 8192]].sum(axis=0, dtype=np.float64)
                margins.append(total / np.sqrt(len(g)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(letters), arrow_lists(margins, pa.float64())],
                names=["id", "lang", "letters", "margins"],
            )

    return map_arrow(texts.select("id", "text", "lang"), work, "id bigint, lang string, letters boolean, margins array<double>")


def language_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ambiguous_below: float = 0.6
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous, runner_up`` for every row of ``docs``.

    Learned from text and language of all documents that are not held out and have a language: each bit of
    the languages' code words gets a classifier of byte n-gram log odds.  Its margins on the training
    documents give each language and bit a weight, the share it gets right beyond chance.  A document's bits
    are decoded by the weighted logistic loss to each code word: ``lang_pred`` has the least, ``score`` is its
    share of exp(-loss), and a document under ``ambiguous_below`` is flagged.

    More than ``MAX_LANGUAGES`` different languages are refused.  A null text or one without a letter (a character of
    Unicode's category L) is ``und`` with score 0, as is everything when nothing could be
    learned.  Repeated rows get equal results; ids may be null (then never learned from).  Ties go to the
    first language in order.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = texts.where(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull())
    many = train.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if many > MAX_LANGUAGES:  # a table of counts per language passes through the driver
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col!r}")
    langs, counts = gram_counts(train)
    code = code_words(len(langs))
    weights = bit_weights(counts, code) if langs else np.zeros((BUCKETS, 1), np.float32)
    margins = written(bit_margins(texts, weights))
    bits = weights.shape[1]
    learned = margins.where(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("letters"))
    signs = learned.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("margins")[b] > 0).cast("bigint")).alias(f"b{b}") for b in range(bits)]
    ).collect()  # a row per language
    trust = np.full(code.shape, 1.0)
    for r in signs:
        k = langs.index(r["lang"])
        plus = np.array([r[f"b{b}"] for b in range(bits)]) / r["n"]
        right = np.where(code[k] > 0, plus, 1 - plus)
        trust[k] = np.maximum(2 * right - 1, 0.01)
    trust = trust / trust.sum(axis=1, keepdims=True) if langs else trust

    def work(batches):
        for batch in in_slices(batches, 4096):
            n = batch.num_rows
            m = np.array(batch.column(2).to_pylist(), float).reshape(n, -1)
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            name, score, second = ["und"] * n, np.zeros(n), [None] * n
            if langs:
                loss = np.stack([(np.logaddexp(0, -m * code[k]) * trust[k]).sum(axis=1) for k in range(len(langs))], axis=1)
                share = np.exp(loss.min(axis=1, keepdims=True) - loss)
                share = share / share.sum(axis=1, keepdims=True)
                order = np.argsort(loss, axis=1, kind="stable")
                name = [langs[order[i, 0]] if letters[i] else "und" for i in range(n)]
                second = [langs[order[i, 1]] if letters[i] and len(langs) > 1 else None for i in range(n)]
                score = np.where(letters, share[np.arange(n), order[:, 0]], 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string())],
                names=["id", "lang_pred", "score", "runner_up"],
            )

    out = map_arrow(margins.select("id", "letters", "margins"), work, "id bigint, lang_pred string, score double, runner_up string")
    return out.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score",
        (F.col("score") < ambiguous_below).alias("ambiguous"), "runner_up",
    )

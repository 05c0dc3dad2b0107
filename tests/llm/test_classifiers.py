import zlib

import numpy as np
import pytest

from tests.llm.conftest import prose
from titerflow.llm import language
from titerflow.llm.language import code_words, has_letter, language_id
from titerflow.llm.quality import STATISTICS, accepted, class_moments, document_statistics, fit_discriminant, quality_scores, statistics

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = label.sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / pos / (len(label) - pos)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = quality_scores(docs, labels)
    assert got.count() == docs.count()
    rows = [r for r in got.join(labels, "doc_id").collect() if r.held_out]
    assert all(held(r.doc_id) for r in rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert auc(np.array([r.score for r in rows]), np.array([r.quality for r in rows])) > 0.97


def test_quality_does_not_learn_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality_scores(docs, x).collect()} for x in (labels, turned))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(0)
    x = {0: rng.standard_normal((80, 3)) * [1, 2, 3], 1: rng.standard_normal((200, 3)) + 1}
    n = np.array([len(x[c]) for c in (0, 1)])
    model = fit_discriminant(n, np.stack([x[c].sum(0) for c in (0, 1)]), np.stack([x[c].T @ x[c] for c in (0, 1)]), 0.1, 1e-3)
    cov = [np.cov(x[c].T, bias=True) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    pooled = 0.999 * pooled + 0.001 * np.eye(3) * np.trace(pooled) / 3
    test = rng.standard_normal((50, 3))
    d = []
    for c in (0, 1):
        s = 0.9 * cov[c] + 0.1 * pooled
        z = test - x[c].mean(0)
        d.append(np.log((n[c] + 1) / (n.sum() + 2)) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    assert np.allclose(model.scores(test), 1 / (1 + np.exp(d[0] - d[1])))


def test_quality_tricky_rows(spark, tricky):
    schema = "doc_id long, quality int, label string, x string"
    labels = spark.createDataFrame([(1, 1, "", ""), (1, 1, "", ""), (8, 0, "", ""), (12, None, "", ""), (None, 0, "", ""), (6, 7, "", "")], schema)
    got = quality_scores(tricky, labels).collect()
    assert len(got) == tricky.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in quality_scores(tricky, labels.limit(0)).collect())
    assert quality_scores(tricky.limit(0), labels).collect() == []
    assert accepted(tricky, labels.limit(0)).count() == tricky.count() and accepted(tricky, labels).columns == tricky.columns


def test_statistics_of_texts_without_words():
    for text in (None, b"", b" \n"):
        assert not statistics(None if text is None else np.frombuffer(text, np.uint8)).any()
    assert np.isfinite(statistics(np.frombuffer("é".encode(), np.uint8))).all() and len(STATISTICS) == 19


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id(docs)
    assert got.count() == docs.count()
    rows = [r for r in got.join(docs.select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_tricky_rows(spark, tricky):
    got = [tuple(r) for r in language_id(tricky).select("doc_id", "lang_pred", "score").collect()]
    assert len(got) == tricky.count()
    und = [i for i, lang, _ in got if lang == "und"]
    assert sorted(und, key=str) == sorted([3, 4, 5, None, 13], key=str)
    assert language_id(tricky.limit(0)).collect() == []
    nothing = language_id(tricky.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


def test_letters_are_unicode_letters():
    held = lambda text: has_letter(np.frombuffer(text.encode(), np.uint8))
    assert not any(map(held, ("²", "½", "12 ½", "Ⅷ", "①", "_", "٣", "…", "")))
    assert all(map(held, ("a", "²é", "½ 語", "ʰ", "ª", "12 ½ ñ")))


def test_language_of_long_texts_and_wrong_columns(spark, monkeypatch):
    docs = [(i, "the of and thing " * n, "en") for i, n in ((0, 3), (1, 5000), (2, 40))] + [(i, "der die und nicht " * n, "de") for i, n in ((3, 3), (4, 5000), (6, 40))]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert all(r.lang_pred == dict((d[0], d[2]) for d in docs)[r.doc_id] for r in language_id(frame).collect())
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id(frame)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 40])
def test_code_words_differ(n):
    code = code_words(n)
    assert len({tuple(r) for r in code}) == n and (n < 2 or (np.abs(code.sum(axis=0)) < n).all())

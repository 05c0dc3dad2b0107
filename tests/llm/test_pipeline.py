import corpus_pipeline as pipeline
from tests.llm.conftest import prose
from tests.llm.test_neardup import plain
from tests.llm.test_search import grams
from titerflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r.asDict() for r in docs.collect()]
        seen[k] = (before, after)
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    by_id = lambda rows: {r["doc_id"] for r in rows}
    quality = {r.doc_id: r.predicted for r in QUERIES["op4_quality_classifier"](spark, SF).collect()}
    assert by_id(seen[0][1]) == {i for i, p in quality.items() if p == 1}
    want = plain([(r["doc_id"], r["text"]) for r in seen[1][0]], 5, 80)
    assert by_id(seen[1][1]) == {i for i, _, _, kept in want if kept}
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in seen[2][0] if any(len(g & grams(r["text"])) * 5 >= 4 * len(g) for g in items)}
    assert by_id(seen[2][1]) == by_id(seen[2][0]) - leaks
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words(seen[3][1]) - words(seen[3][0])) <= 64 * 20
    final = sorted(seen[4][1], key=lambda r: r["start"])
    assert [r["doc_id"] for r in final] == sorted(r["doc_id"] for r in seen[4][0])
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(final, final[1:]))


def test_stages_keep_rows_without_ids_and_empty_tables(spark, tricky):
    kept = pipeline.near_dedup(spark, tricky, SF).collect()
    assert sum(r.doc_id is None for r in kept) == 2
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 11, 12, 13, 14]
    for _, stage in pipeline.STAGES:
        assert stage(spark, tricky.limit(0).select("doc_id", "text", "lang", "source", "n_chars"), SF).collect() == []
        assert stage(spark, tricky, SF).count() > 0


def test_row_that_stays_of_a_repeated_id(spark, documents):
    rows = [(12, prose(50, 5), "es", "b"), (12, prose(50, 5), "es", "a"), (12, prose(40, 6), "en", "a"), (12, None, "en", "a"), (14, "", "en", "a"), (14, None, "en", "a")]
    for given in (rows, rows[::-1]):
        kept = pipeline.near_dedup(spark, documents(given).coalesce(1), SF).collect()
        assert sorted((r.doc_id, r.text, r.source) for r in kept) == [(12, prose(50, 5), "a"), (14, "", "a")]

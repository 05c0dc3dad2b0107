"""Jobs without a SQL form: properties that must hold."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from titerflow.operators.candidates import diversity_cap

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(contract.queries()) - set(contract.oracle_sql()))


@pytest.mark.parametrize("name", ["fit_random_forest", "fit_boosted_trees", "fit_logistic", "fit_linear_svm"])
def test_probabilities(spark, name):
    rows = contract.queries()[name](spark, SF).collect()
    assert rows and all(0.0 <= r["p"] <= 1.0 for r in rows)
    assert {r["side"] for r in rows} == {"train", "test"}


def test_grid_isolates_failures(spark):
    rows = contract.queries()["run_grid"](spark, SF).collect()
    failed = [r for r in rows if r["error"]]
    assert len(failed) == 4 and all("unknown" in r["error"] for r in failed)
    for model in ("gaussian_nb", "knn", "logit", "linear_svm"):
        done = {r["split"] for r in rows if r["model"] == model}
        assert done == {"Train_Test", *(f"Fold_{k}" for k in range(1, 6))} | ({"Train_Train"} if model != "knn" else set())


def test_saved_models_score(spark):
    rows = contract.queries()["save_list_score_models"](spark, SF).collect()
    assert {r["target"] for r in rows} == {"even", "low"} and {r["predicted"] for r in rows} <= {0, 1}


def test_similarity_split_does_not_leak(spark):
    audit = contract.queries()["similarity_split_audit"](spark, SF).first()
    assert audit["n_leaking"] == 0 and audit["n_test"] > 0 and audit["n_train"] > 0


def test_reduced_split_and_search(spark):
    rows = contract.queries()["reduced_cluster_split"](spark, SF)
    assert rows.groupBy("cluster").agg(F.countDistinct("side").alias("n")).where("n > 1").count() == 0
    search = contract.queries()["random_search"](spark, SF).collect()
    assert len(search) == 20 and len({(r["alpha"], r["l1_ratio"]) for r in search}) == 20


def test_elastic_net_fits(spark):
    rows = contract.queries()["fit_elastic_net"](spark, SF).toPandas()
    assert rows["truth"].corr(rows["predicted"]) > 0.8


def test_imbalance_strategies(spark):
    rows = contract.queries()["imbalance_strategies"](spark, SF).collect()
    plain = {r["target"]: r["n"] for r in rows if r["strategy"] == "none"}
    for r in rows:
        if r["strategy"] == "class_weight" and r["model"] == "rf":
            assert r["weight"] == pytest.approx(plain[r["target"]])
        if r["strategy"] != "upsample":
            assert r["n"] == plain[r["target"]]


def test_report(spark):
    rows = contract.queries()["diagnostic_report"](spark, SF).collect()
    assert len(rows) == 12 and all(r["statistic"] and r["interpretation"] for r in rows)


def test_stream_cap_equals_batch(spark):
    got = {r["event_type"]: (r["n"], r["n_admitted"], r["n_over"]) for r in contract.queries()["stream_diversity_cap"](spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", (F.col("value") / 100.0).alias("score"))
    batch = diversity_cap(events, "event_type", cap=100, order=("event_id",)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("score") >= 0.4) & (F.col("capped_score") > 0)).alias("a"),
        F.count_if((F.col("score") >= 0.4) & (F.col("capped_score") == 0)).alias("o"),
    )
    assert got == {r["event_type"]: (r["n"], r["a"], r["o"]) for r in batch.collect()}


def test_youden_evaluation_sides(spark):
    from titerflow.models.estimators import evaluate

    rows = [("t", i, i % 2, "train" if i < 40 else "test", 0.3 + 0.2 * (i % 2) + (i % 7) / 100) for i in range(60)]
    scored = spark.createDataFrame(rows, "target string, entity int, label int, side string, p double")
    for side in ("train", "test"):
        got = {r["split"]: r for r in evaluate(scored, cutoff="youden", threshold_on=side).collect()}
        assert got["Train_Train"]["accuracy"] == got["Train_Test"]["accuracy"] == 1.0
        assert got["Train_Test"]["auc"] == got["Train_Test"]["auprc"] == 1.0


def test_grid_reports_untrainable_targets(spark):
    from titerflow.models.estimators import dense_vectors, run_grid

    rows = [("ok", i, [float(i % 2), 1.0], i % 2) for i in range(30)] + [("one", i, [0.0, 1.0], 1) for i in range(30)]
    data = dense_vectors(spark.createDataFrame(rows, "target string, entity int, v array<double>, label int"))
    side = F.when(F.col("entity") % 5 == 0, "test").otherwise("train")
    got = run_grid({"v": data}, ["gaussian_nb"], {"fixed": lambda df: df.withColumn("side", side)}).collect()
    assert {(r["target"], r["auc"] is None) for r in got} == {("ok", False), ("one", True)}

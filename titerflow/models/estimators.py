"""Per-target models from Spark ML, random search, full grids, saving and scoring.

A Spark ML estimator's own training is distributed; its targets are looped over on the driver by a few threads that
share one cached feature table.  The models in ``native``, ``linear`` and ``elastic`` fit all targets in shared jobs.
"""
from __future__ import annotations

import itertools
import json
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerflow.functions.columns import clip_probability, link_probability, safe_id
from titerflow.models import elastic
from titerflow.models.crossval import fold_predictions, split_metrics, untrained, with_folds
from titerflow.models.linear import KINDS as LINEAR
from titerflow.models.linear import fit_linear, score_linear
from titerflow.models.native import MIN_ROWS, fit_gaussian_nb, knn_probability, score_gaussian_nb, trainable_targets
from titerflow.operators.metrics import average_precision, by_side, confusion_metrics, rank_auc
from titerflow.operators.cutoffs import youden_probability
from titerflow.operators.joins import attach
from titerflow.operators.scaling import imbalance
from titerflow.session import materialize, pin, settled

CLASSIFIERS = ("rf", "gbt", "logit", "linear_svm")
NATIVE = ("gaussian_nb", "knn")
#: Deepest tree that Spark grows; forests are not limited further.
MAX_DEPTH = 30


def dense_vectors(df: DataFrame, col: str = "v", name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(col).cast("array<double>")))


def sparse_vectors(df: DataFrame, bits: str = "bits", size: int = 2048, name: str = "features") -> DataFrame:
    """On-bit indices ``0 .. size - 1`` as a sparse vector, built in the JVM from a fixed vocabulary."""
    words = df.withColumn("_words", F.col(bits).cast("array<string>"))
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="_words", outputCol=name)
    return model.setBinary(True).transform(words).drop("_words")


def make_estimator(model: str, n_rows: float = 1.0, seed: int = 42, c: float = 1.0, **params):
    """A Spark ML estimator by short name, with the usual defaults (100 trees, L2 strength 1 / (c * n))."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    ridge = 1.0 / (c * max(n_rows, 1.0))
    makers = {
        "rf": lambda: RandomForestClassifier(**common, seed=seed, **{"numTrees": 100, "maxDepth": MAX_DEPTH, **params}),
        "gbt": lambda: GBTClassifier(**common, seed=seed, **{"maxIter": 100, "maxDepth": 6, **params}),
        "logit": lambda: LogisticRegression(
            **common, **{"standardization": False, "regParam": ridge, "maxIter": 1000, **params}
        ),
        "linear_svm": lambda: LinearSVC(**common, **{"standardization": False, "regParam": ridge, "maxIter": 100, **params}),
        "rf_regressor": lambda: RandomForestRegressor(**common, seed=seed, **{"numTrees": 100, "maxDepth": MAX_DEPTH, **params}),
        "gbt_regressor": lambda: GBTRegressor(**common, seed=seed, **{"maxIter": 100, "maxDepth": 6, **params}),
        "elastic_net": lambda: LinearRegression(
            **common, **{"standardization": False, "regParam": 1.0, "elasticNetParam": 0.5, **params}
        ),
    }
    if model not in makers:
        raise ValueError(f"unknown model {model!r}; known: {sorted(makers)}")
    return makers[model]()


def positive_probability(scored: DataFrame, name: str = "p") -> DataFrame:
    """Positive-class probability; margin models go through the logistic link."""
    if "probability" in scored.columns:
        return scored.withColumn(name, clip_probability(vector_to_array("probability")[1]))
    return scored.withColumn(name, link_probability(vector_to_array("rawPrediction")[1]))


def fit_targets(
    rows: DataFrame, model: str, strategy: str = "none", min_rows: int = MIN_ROWS, seed: int = 42, only: str | None = None,
    threads: int = 4, target: str = "target", **params,
) -> tuple[dict, DataFrame | None]:
    """Train one model per target and score all its rows.

    ``rows`` holds ``(target, entity, label, side, features)``.  Returns the fitted pipelines and the rows
    with ``p``; a target with too few rows or one class has no model (see ``grid_metrics`` for its row).
    """
    rows = pin(rows if only is None else rows.where(F.col(target) == only))
    usable = [r[0] for r in trainable_targets(rows.where("side = 'train'"), target, min_rows=min_rows).orderBy(target).collect()]

    def train(name):
        mine = rows.where(F.col(target) == name)
        weighted = imbalance(mine.where("side = 'train' AND label IS NOT NULL"), strategy, model, target)
        total = weighted.agg(F.sum("weight").alias("w")).first()["w"]  # the L2 strength follows the weights
        estimator = make_estimator(model, total, seed, **params)
        return name, Pipeline(stages=[estimator]).fit(weighted.withColumn("label", F.col("label").cast("double")))

    with ThreadPoolExecutor(max(1, min(threads, len(usable) or 1))) as pool:
        models = dict(pool.map(train, usable))
    scored = None
    for name, fitted in models.items():
        part = positive_probability(fitted.transform(rows.where(F.col(target) == name).withColumn("weight", F.lit(1.0))))
        part = part.select(target, "entity", "label", "side", "p")
        scored = part if scored is None else scored.unionByName(part)
    return models, scored


def score_rows(rows: DataFrame, model: str, ml: bool = False, **kw) -> DataFrame | None:
    """Probabilities of all rows for any model kind.

    The closed-form and linear ones need ``v`` and fit all targets together; ``ml`` asks for Spark ML's linear models,
    one per target in a driver loop.
    """
    if model in LINEAR and not ml:
        strategy = kw.pop("strategy", "none")
        data = _weighed(rows, model, strategy)
        fitted = materialize(fit_linear(data, model, strategy="none" if strategy == "upsample" else strategy, **kw))
        return score_linear(fitted, rows).select("target", "entity", "label", "side", "p")
    if model in NATIVE:
        known = rows.where("side = 'train' AND label IS NOT NULL")
        usable = trainable_targets(known, min_rows=kw.get("min_rows", MIN_ROWS)).select("target")
        train = imbalance(known.join(usable, "target", "left_semi"), kw.get("strategy", "none"), model)
    if model == "gaussian_nb":
        fitted = fit_gaussian_nb(train, smoothing=kw.get("smoothing", 1e-9), weight="weight")
        return score_gaussian_nb(fitted, rows).select("target", "entity", "label", "side", "p")
    if model == "knn":
        near = knn_probability(train, rows.where("side = 'test'"), kw.get("k", 5))
        return near.join(rows.select("target", "entity", "label", "side"), ["target", "entity"])
    return fit_targets(rows, model, **kw)[1]


def evaluate(scored: DataFrame, by=("target",), cutoff: float | str = 0.5, threshold_on: str = "test") -> DataFrame:
    """All classification metrics per group and side, at a fixed cutoff or at each group's Youden cutoff.

    ``threshold_on`` names the side the Youden cutoff is chosen on.  Choosing it on the test side scores a
    cutoff on the rows that picked it; ``"train"`` avoids that.
    """
    keys = [*by]
    if cutoff == "youden":
        cut = youden_probability(scored.where(F.col("side") == threshold_on), keys, "label", "p", "clipped")
        judged = attach(scored, cut.select(*keys, "threshold"), keys, "left")
        judged = judged.fillna(0.5, ["threshold"])
    else:
        judged = scored.withColumn("threshold", F.lit(float(cutoff)))
    voted = judged.withColumn("predicted", (F.col("p") >= F.col("threshold")).cast("int"))
    counts = by_side(voted, [*keys, "threshold"], confusion_metrics)
    auc = by_side(scored, keys, lambda df, k: rank_auc(df, k, "label", "p").select(*k, "auc"))
    auprc = by_side(scored, keys, lambda df, k: average_precision(df, k, "label", "p"))
    on = [*keys, "split"]
    return counts.join(auc, on, "left").join(auprc, on, "left")


def ml_predictions(rows: DataFrame, model: str, folds: int, strategy: str = "none", **kw) -> DataFrame:
    """``fold_predictions`` for Spark ML's models: each (target, held) pair is one target of ``fit_targets``.

    The driver loops over these pairs; unscaled, as trees do not need it.
    """
    wide = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds))))
    trains = F.when(F.col("held") == 0, F.col("side") == "train").otherwise(F.col("fold") != F.col("held"))
    judged = (F.col("held") == 0) | trains | (F.col("fold") == F.col("held"))
    wide = wide.where(judged).withColumn("side", F.when(trains, "train").otherwise("test"))
    wide = wide.withColumn("_of", F.col("target")).withColumn("target", F.concat_ws("|", F.col("held").cast("string"), "target"))
    scored = fit_targets(wide, model, strategy=strategy, **kw)[1]
    if scored is None:
        raise ValueError("no target can be trained")
    names = wide.select("target", F.col("_of").alias("_name"), "held").distinct()
    scored = attach(scored, names, "target", "inner").drop("target").withColumnRenamed("_name", "target")
    split = F.when(F.col("held") == 0, F.when(F.col("side") == "train", "Train_Train").otherwise("Train_Test")).otherwise(F.concat(F.lit("Fold_"), F.col("held").cast("string")))
    scored = scored.where((F.col("held") == 0) | (F.col("side") == "test"))
    return scored.withColumn("split", split).select("target", "entity", "label", "split", "held", "p")


def run_grid(
    feature_sets: dict[str, DataFrame], models: list[str], splits: dict, strategy: str = "none", cutoff: float | str = 0.5, threshold_on: str = "test",
    folds: int = 0, scaler: str | None = None, **kw,
) -> DataFrame:
    """Features x models x splits; one combination that fails yields one row with its ``error``.

    ``feature_sets`` maps a name to ``(target, entity, label, v)`` rows (``features`` besides for Spark ML's models rf
    and gbt) and ``splits`` a name to a function adding ``side``.  ``split`` is Train_Train, Train_Test and, with
    ``folds``, Fold_1 .. Fold_k; ``scaler`` is fitted on each training set.  Targets that cannot be trained have rows
    without metrics.  Each (features, split) is computed once and shared by all models.  Models of folds do not know
    ``side``: splits that leave the same rows and folds share them.
    """
    keys = ["features", "model", "split_method"]
    predictions, skipped, failures = None, None, None
    folded = {}  # predictions of folds by (features, model, rows without side)

    def failed(names, problem):
        nonlocal failures
        row = next(iter(feature_sets.values())).sparkSession.range(1).select(F.lit(f"{type(problem).__name__}: {problem}").alias("error")).withColumns(names)
        failures = row if failures is None else failures.unionByName(row)

    for (fname, rows), (sname, split) in itertools.product(feature_sets.items(), splits.items()):
        names = {m: dict(zip(keys, (F.lit(fname), F.lit(m), F.lit(sname)))) for m in models}
        try:
            sided = materialize(with_folds(split(rows), folds))
        except Exception as problem:
            for m in models:
                failed(names[m], problem)
            continue
        missing = materialize(untrained(sided, folds))
        same = _digest(sided) if folds and len(splits) > 1 else None
        for m in models:
            try:
                ml = m not in NATIVE and m not in LINEAR
                known = folded.get((fname, m, same))

                def predicted():
                    got = ml_predictions(sided, m, folds, strategy, **kw) if ml else fold_predictions(sided, m, folds if known is None else 0, scaler, strategy, **kw)
                    return got.select("target", "entity", "label", "split", "p").withColumns(names[m])

                # written here, so that a failure stays with its combination
                part = materialize(predicted()) if ml else settled(sided.sparkSession, predicted)
                if known is not None:
                    part = part.unionByName(known.withColumns(names[m]))
                elif same is not None and not ml:
                    folded[fname, m, same] = part.where("split like 'Fold%'")
                predictions = part if predictions is None else predictions.unionByName(part)
            except Exception as problem:
                failed(names[m], problem)
                continue
            empty = missing.select("target", "split", "n_train", *[F.lit(None).cast("double").alias(x) for x in ("accuracy", "f1", "auc", "auprc", "mcc")]).withColumns(names[m])
            skipped = empty if skipped is None else skipped.unionByName(empty)
    out = None
    if predictions is not None:
        # one evaluation job over the predictions of every combination
        if cutoff == "youden" and threshold_on != "test":
            sides = predictions.where("split like 'Train%'").withColumn("side", F.when(F.col("split") == "Train_Train", "train").otherwise("test"))
            folded = predictions.where("split like 'Fold%'")
            out = evaluate(sides, (*keys, "target"), cutoff, threshold_on).unionByName(split_metrics(folded, (*keys, "target"), 0.5), allowMissingColumns=True)
        else:
            out = split_metrics(predictions, (*keys, "target"), cutoff)
        out = out.withColumn("error", F.lit(None).cast("string")).unionByName(skipped, allowMissingColumns=True)
    if failures is not None:
        out = failures if out is None else out.unionByName(failures, allowMissingColumns=True)
    return out.withColumn("imbalance", F.lit(strategy))


def _digest(rows: DataFrame) -> tuple:
    """The same for the same rows in any order, copies counted, by the columns that models of folds use."""
    used = [c for c in ("target", "entity", "label", "fold", "v", "features") if c in rows.columns]
    columns = [vector_to_array(c) if rows.schema[c].dataType.typeName() == "vectorudt" else F.col(c) for c in used]
    hashes = [F.xxhash64(F.lit(seed), *[F.isnull(c) for c in used], *columns).cast("decimal(38,0)") for seed in (1, 2)]
    return (*rows.select(*used).dtypes, *rows.agg(F.count(F.lit(1)), *[F.sum(h) for h in hashes]).first())


def _weighed(rows: DataFrame, model: str, strategy: str) -> DataFrame:
    """Upsampled training rows where that is the strategy; class weights are the models' own."""
    if strategy != "upsample":
        return rows
    test, train = rows.where("side <> 'train' or label is null"), rows.where("side = 'train' and label is not null")
    return imbalance(train, strategy, model).drop("weight").unionByName(test)


def skipped_targets(rows: DataFrame, min_rows: int = MIN_ROWS, target: str = "target") -> DataFrame:
    """Targets that cannot be trained, as metric rows with NULL metrics."""
    used = (F.col("side") == "train") & F.col("label").isin(0, 1)
    stats = rows.groupBy(target).agg(
        F.count_if(used).alias("n_train"), F.countDistinct(F.when(used, F.col("label"))).alias("classes")
    )
    return stats.where((F.col("n_train") < min_rows) | (F.col("classes") < 2)).select(
        target, "n_train", *[F.lit(None).cast("double").alias(m) for m in ("accuracy", "f1", "auc", "auprc", "mcc")]
    )


# Ranges that whole-number settings are drawn from, both ends included.
SEARCH_SPACE = {
    "rf_regressor": {"numTrees": (200, 400), "maxDepth": (10, 20), "minInstancesPerNode": (2, 6)},
    "gbt_regressor": {"maxIter": (20, 100), "maxDepth": (3, 6), "stepSize": (0.01, 0.1)},
}


def draw_params(space: dict[str, tuple], n_iter: int, seed: int) -> list[dict]:
    """``n_iter`` settings: whole numbers or reals drawn uniformly between the two ends of each range."""
    drawn = random.Random(seed)
    return [{n: drawn.randint(*space[n]) if isinstance(space[n][0], int) else drawn.uniform(*space[n]) for n in sorted(space)} for _ in range(n_iter)]


def random_search(
    train: DataFrame, model: str, n_iter: int = 20, folds: int = 5, seed: int = 42, parallelism: int = 4, space: dict | None = None, **kw
):
    """Cross-validate ``n_iter`` random settings by R2; returns the best model fitted on all rows and a result table.

    ``elastic_net`` is searched on Gram matrices (``elastic.search_elastic_net``; its model is a row of coefficients);
    the tree models are Spark ML's, fitted once per setting and fold.
    """
    if model == "elastic_net":
        best, table, _ = elastic.search_elastic_net(train, n_iter, folds, seed, **kw)
        return best, table
    drawn = draw_params(space or SEARCH_SPACE[model], n_iter, seed)
    estimator = make_estimator(model, seed=seed)
    maps = [{estimator.getParam(n): v for n, v in one.items()} for one in drawn]
    evaluator = RegressionEvaluator(metricName="r2", labelCol="label", predictionCol="prediction")
    weighted = pin(train if "weight" in train.columns else train.withColumn("weight", F.lit(1.0)))
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, seed=seed, parallelism=parallelism
    ).fit(weighted)
    results = [(i, json.dumps(one), float(mean), float(std)) for i, (one, mean, std) in enumerate(zip(drawn, search.avgMetrics, search.stdMetrics))]
    table = train.sparkSession.createDataFrame(results, "draw int, params string, cv_r2_mean double, cv_r2_std double")
    return search.bestModel, table


def fit_elastic_net(train: DataFrame, alpha: float = 1.0, l1_ratio: float = 0.5):
    """Spark ML's elastic net; ``elastic.elastic_net`` needs no iterations over the rows."""
    return make_estimator("elastic_net", regParam=alpha, elasticNetParam=l1_ratio).fit(
        train if "weight" in train.columns else train.withColumn("weight", F.lit(1.0))
    )


def save_models(spark: SparkSession, models: dict, path: str, metadata: dict[str, dict]) -> None:
    """Write each pipeline below ``path`` and append its metadata to ``path/_index``."""
    rows = []
    for name, fitted in models.items():
        meta = {"target": str(name), **metadata.get(name, {})}
        rows.append((str(name), json.dumps(meta, sort_keys=True), float(meta.get("threshold", 0.5))))
    index = spark.createDataFrame(rows, "target string, metadata string, threshold double")
    index = index.withColumn("model_id", safe_id(F.lit("model"), "target"))
    places = {r["target"]: r["model_id"] for r in index.collect()}
    for name, fitted in models.items():
        fitted.write().overwrite().save(f"{path}/{places[str(name)]}")
    index.write.mode("append").parquet(f"{path}/_index")


def list_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_index")


def load_model(spark: SparkSession, path: str, model_id: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/{model_id}")


def score(rows: DataFrame, fitted: PipelineModel, cutoff: float = 0.5) -> DataFrame:
    """Probability and 0/1 call of new rows, batch or stream."""
    ready = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
    scored = positive_probability(fitted.transform(ready)).withColumn("predicted", (F.col("p") >= cutoff).cast("int"))
    return scored.drop("rawPrediction", "probability", "prediction", "weight")


def kmeans_groups(df: DataFrame, k: int, seed: int = 42, features: str = "features") -> DataFrame:
    """Rows with a ``cluster`` from k-means."""
    kept = pin(df)
    fitted = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(kept)
    return fitted.transform(kept)


def reduced_cluster_split(
    df: DataFrame, k: int = 10, frac: float = 0.2, seed: int = 42, features: str = "features", entity: str = "entity"
) -> DataFrame:
    """Two principal components, k-means with ``k`` groups on them, then the group split.

    ``k`` centres pass through the driver: choose it by the groups wanted, not by the number of rows.
    """
    from titerflow.operators.splits import group_split

    kept = pin(df)
    flat = PCA(k=2, inputCol=features, outputCol="reduced").fit(kept).transform(kept)
    groups = kmeans_groups(flat, k, seed, "reduced").drop("reduced")
    return group_split(groups, "cluster", frac, entity)

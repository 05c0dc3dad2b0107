"""Evaluation metrics per group: classification, ranking and regression."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titerflow.functions.columns import correlation, safe_ratio
from titerflow.operators.ordering import (
    CHUNK,
    _keys,
    _within,
    range_chunks,
    roc_points,
    spearman,
    value_points,
)


def confusion_metrics(df: DataFrame, by, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Counts and rates; precision, recall, F1, MCC and specificity are 0 where undefined."""
    by = _keys(by)
    y, p = F.col(label), F.col(predicted)
    counts = df.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns(
        {
            "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
            "precision": safe_ratio(tp, tp + fp),
            "recall": safe_ratio(tp, tp + fn),
            "f1": safe_ratio(2.0 * tp, 2.0 * tp + fp + fn),
            "mcc": safe_ratio(tp * tn - fp * fn, spread),
            "specificity": safe_ratio(tn, tn + fp),
        }
    )


def auc_of_points(points: DataFrame, by, score: str, single_class: float | None = None) -> DataFrame:
    """ROC AUC from distinct scores with ``hits`` positives among ``n`` rows.

    The Mann-Whitney count splits into pairs inside a chunk and pairs between chunks, so chunk totals are
    all that meets: no second pass over the points is needed.
    """
    by = _keys(by)
    chunked = range_chunks(points, by, [F.col(score)])
    local = _within(by, CHUNK).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("n") - F.col("hits")
    parts = (
        chunked.withColumn("_neg", neg)
        .withColumn("_below", F.coalesce(F.sum("_neg").over(local), F.lit(0)))
        .groupBy(*by, CHUNK)
        .agg(
            F.sum(F.col("hits").cast("double") * (F.col("_below") + F.col("_neg") / 2.0)).alias("wins"),
            F.sum("hits").alias("pos"),
            F.sum("_neg").alias("neg"),
        )
    )
    earlier = _within(by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        parts.withColumn("_lower", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
        .groupBy(*by)
        .agg(
            F.sum(F.col("wins") + F.col("pos").cast("double") * F.col("_lower")).alias("u"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
        )
    )
    pairs = F.col("pos").cast("double") * F.col("neg")
    return totals.select(
        *by, "pos", "neg", F.when(pairs > 0, F.col("u") / pairs).otherwise(F.lit(single_class).cast("double")).alias("auc")
    )


def rank_auc(
    df: DataFrame, by, label: str = "label", score: str = "score", single_class: float | None = None
) -> DataFrame:
    """Exact ROC AUC; a one-class group gets ``single_class`` (NULL, or 0.5 where that is the convention)."""
    points = value_points(df.where(F.col(label).isNotNull()), by, score, {"hits": F.col(label)})
    return auc_of_points(points, by, score, single_class)


def average_precision(
    df: DataFrame, by, label: str = "label", score: str = "score", single_class: float | None = None
) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    by = _keys(by)
    roc = roc_points(df, by, label, score)
    step = F.col("hits").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))
    agg = roc.groupBy(*by).agg(F.sum(step).alias("s"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return agg.select(
        *by, F.when(both, F.col("s") / F.col("pos")).otherwise(F.lit(single_class).cast("double")).alias("auprc")
    )


def regression_metrics(df: DataFrame, by, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """R2, RMSE, MAE, Pearson and Spearman per group."""
    by = _keys(by)
    known = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    err = F.col(truth) - F.col(predicted)
    moments = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(err * err).alias("_sse"),
        F.var_pop(truth).alias("_var"),
        F.avg(F.abs(err)).alias("mae"),
        correlation(truth, predicted).alias("pearson"),
    )
    rank_corr = spearman(known, truth, predicted, by).drop("n")
    rows = moments.join(rank_corr, by, "left") if by else moments.join(rank_corr)
    sst = F.col("_var") * F.col("n")
    return rows.select(
        *by,
        "n",
        F.when(sst > 0, 1.0 - F.col("_sse") / sst).alias("r2"),
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        "mae",
        "pearson",
        "spearman",
    )


def cv_stats(df: DataFrame, by, metric: str, ddof: int = 0) -> DataFrame:
    """Mean and standard deviation over folds: ``ddof`` 0 for the population form, 1 for the sample form."""
    std = F.stddev_pop(metric) if ddof == 0 else F.stddev_samp(metric)
    return df.groupBy(*_keys(by)).agg(
        F.count(metric).alias("n_folds"), F.avg(metric).alias("cv_mean"), std.alias("cv_std")
    )


def by_side(df: DataFrame, by, metric_fn, side: str = "side", **kw) -> DataFrame:
    """The same metrics for the training and the test rows, as ``Train_Train`` and ``Train_Test``."""
    named = df.withColumn("split", F.when(F.col(side) == "train", "Train_Train").otherwise("Train_Test"))
    return metric_fn(named, [*_keys(by), "split"], **kw)


def bin_stats(
    df: DataFrame, col: str, value: str, edges: tuple[float, ...] = (0.0, 0.3, 0.5, 0.7, 1.01), min_rows: int = 11
) -> DataFrame:
    """Rows and mean value per fixed bin of ``col``; bins with too few rows are left out."""
    which = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        which = F.when((F.col(col) >= edges[i]) & (F.col(col) < edges[i + 1]), i).otherwise(which)
    return (
        df.withColumn("bin", which)
        .where("bin IS NOT NULL")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
        .where(F.col("n") >= min_rows)
    )

"""Summaries of a metrics table: leaderboards, cross-validation, best rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titerflow.operators.ordering import _keys


def leaderboard(metrics: DataFrame, metric: str, by, k: int = 10, split: str = "split") -> DataFrame:
    """The ``k`` best combinations by mean test metric, with spread, count and rank (ties by key).

    ``limit`` keeps ``k`` rows per task first, so the ranking window sees only ``k`` rows.
    """
    by = _keys(by)
    means = (
        metrics.where(F.col(split) == "Train_Test")
        .groupBy(*by)
        .agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))
    )
    order = [F.col("mean").desc(), *[F.col(b) for b in by]]
    return means.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def cv_summary(metrics: DataFrame, metric: str, target: str, by, fold: str = "fold") -> DataFrame:
    """Mean over folds per target, then mean and sample spread over the targets."""
    by = _keys(by)
    folds = metrics.groupBy(*by, target, fold).agg(F.avg(metric).alias("_f"))
    per_target = folds.groupBy(*by, target).agg(F.avg("_f").alias("_t"))
    return per_target.groupBy(*by).agg(
        F.avg("_t").alias("mean"), F.stddev_samp("_t").alias("std"), F.count("_t").alias("n_targets")
    )


def split_summary(metrics: DataFrame, cols: list[str], by, split: str = "split") -> DataFrame:
    """Mean test metrics per split method."""
    return metrics.where(F.col(split) == "Train_Test").groupBy(*_keys(by)).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in cols], F.count(F.lit(1)).alias("n")
    )


def target_means(metrics: DataFrame, metric: str, target: str = "target", name: str = "mean_metric") -> DataFrame:
    return metrics.groupBy(target).agg(F.avg(metric).alias(name))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """First ``k`` rows of an order."""
    return df.orderBy(*order).limit(k)


def best_row(df: DataFrame, metric: str, ties: list[str], by=None) -> DataFrame:
    """The row with the largest metric, overall or per group; ties by the given columns."""
    best = F.min_by(F.struct(*df.columns), F.struct(-F.col(metric), *[F.col(t) for t in ties]))
    return df.where(F.col(metric).isNotNull()).groupBy(*_keys(by)).agg(best.alias("_b")).select("_b.*")


def distinct_by(df: DataFrame, key, order: list) -> DataFrame:
    """One row per key, the first in the given order."""
    keys = _keys(key)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")

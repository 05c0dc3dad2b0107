"""Elastic net regression and its random search on Gram matrices: the rows are read twice, whatever the search."""
from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerflow.models.partials import add_up, array_column, matrix
from titerflow.operators.splits import kfold
from titerflow.session import materialize, ship

# The ranges that settings are drawn from.
ALPHA = (0.001, 1.0)
L1_RATIO = (0.1, 0.9)


def gram_parts(rows: DataFrame, vector: str = "v", label: str = "label", weight: str | None = None, by: str = "fold") -> DataFrame:
    """``by, sums, centre``: per part the products of all columns of ``[1, vector, label]``, weighted, as one matrix.

    Values are centred first by the mean over all rows (``centre``, the label's last), so that no product is the small
    difference of large ones.  Parts add up: a training set is the total less the held-out part.  Rows without a
    vector, label or weight take no part.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = rows.select(F.col(by).cast("int").alias("part"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"), w.alias("w"))
    known = known.where("v is not null and y is not null and w is not null")
    ship(rows.sparkSession)

    def columns(batch: pa.RecordBatch) -> np.ndarray:
        return np.hstack([np.ones((batch.num_rows, 1)), matrix(batch, "v"), batch["y"].to_numpy()[:, None]])

    def totals(batches):
        sums = None
        for batch in batches:
            if batch.num_rows:
                one = batch["w"].to_numpy() @ columns(batch)
                sums = one if sums is None else sums + one
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), array_column([sums])], names=["part", "_task", "sums"])

    schema = "part int, _task bigint, sums array<double>"
    centre = add_up(known.mapInArrow(totals, schema), ["part"]).select(F.transform(F.slice("sums", F.lit(2), F.size("sums") - 1), lambda s: s / F.col("sums")[0]).alias("centre"))
    centre = materialize(centre)
    row = centre.first()  # as long as a vector
    middle = np.concatenate([[0.0], row["centre"]]) if row else np.zeros(0)

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, w, part = columns(batch) - middle, batch["w"].to_numpy(), batch["part"].to_numpy()
            for p in np.unique(part).tolist():
                mine = part == p
                one = (z[mine] * w[mine, None]).T @ z[mine]
                sums[p] = sums[p] + one if p in sums else one
        if sums:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([task] * len(sums), pa.int64()), array_column([*sums.values()])], names=["part", "_task", "sums"])

    parts = add_up(known.mapInArrow(products, schema), ["part"])
    return parts.crossJoin(F.broadcast(centre)).withColumnRenamed("part", by)  # one row beside a row per part


def coordinate_descent(gram: np.ndarray, target: np.ndarray, alpha: float, l1_ratio: float, max_sweeps: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, int]:
    """Minimises ``w'Gw / 2 - t'w + alpha * (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2)`` one coefficient at a time."""
    d = len(target)
    w, rest = np.zeros(d), target.copy()  # rest = t - G w
    bend, soft = np.diag(gram) + alpha * (1.0 - l1_ratio), alpha * l1_ratio
    for sweep in range(1, max_sweeps + 1):
        moved = 0.0
        for j in range(d):
            pull = rest[j] + gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - soft, 0.0) / bend[j] if bend[j] > 0 else 0.0
            if new != w[j]:
                rest -= gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * np.sqrt(bend[j]))
                w[j] = new
        if moved <= tol * max(1.0, np.sqrt(abs(target @ w))):
            return w, sweep
    return w, max_sweeps


def _solve(total: np.ndarray, held: np.ndarray | None, centre: np.ndarray, alpha: float, l1_ratio: float, scaled: bool) -> dict:
    """Fit on ``total`` less ``held``: raw coefficients, intercept, R2 on both sides, all from the products."""
    train = total if held is None else total - held
    n = train[0, 0]
    mean = train[0, 1:] / n
    cov = train[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0)) if scaled else np.ones(len(mean) - 1)
    spread = np.where(spread > 1e-12, spread, 1.0)
    gram, pull = cov[:-1, :-1] / np.outer(spread, spread), cov[:-1, -1] / spread
    w, sweeps = coordinate_descent(gram, pull, alpha, l1_ratio)
    raw = w / spread
    shift = mean[-1] - mean[:-1] @ raw  # the intercept for centred values

    def r2(m: np.ndarray) -> float | None:
        size = m[0, 0]
        error = np.concatenate([[-shift], -raw, [1.0]])
        spread_y = m[-1, -1] - m[0, -1] ** 2 / size
        return float(1.0 - error @ m @ error / spread_y) if size > 0 and spread_y > 0 else None

    return {
        "coefficients": raw, "intercept": float(shift + centre[-1] - centre[:-1] @ raw), "n_train": float(n), "n_test": float(held[0, 0]) if held is not None else 0.0,
        "sweeps": sweeps, "train_r2": r2(train), "test_r2": r2(held) if held is not None else None,
    }


FITTED = "coefficients array<double>, intercept double, n_train double, n_test double, sweeps int, train_r2 double, test_r2 double"


def fit_on_grams(parts: DataFrame, settings: DataFrame, by: str = "fold", scaled: bool = True, whole: bool = False) -> DataFrame:
    """One fit per setting (``draw, alpha, l1_ratio``) and part held out (``whole``: nothing held out): the setting,
    ``by`` and what ``FITTED`` lists.  Each fit is a row of its own, so Spark deals them to tasks."""
    total = add_up(parts.select(F.lit(0).alias("_one"), F.lit(0).cast("bigint").alias("_task"), "sums"), ["_one"]).select(F.col("sums").alias("total"))
    held = parts.select(by, "centre", "sums") if not whole else parts.limit(1).select(F.lit(0).alias(by), "centre", F.lit(None).cast("array<double>").alias("sums"))
    jobs = held.crossJoin(total).crossJoin(settings)  # parts x settings, both parameters of the search

    def work(batches):
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                full = np.asarray(one["total"].flatten())
                size = int(np.sqrt(len(full)))
                out = None if one["sums"][0].as_py() is None else np.asarray(one["sums"].flatten()).reshape(size, size)
                rows.append(_solve(full.reshape(size, size), out, np.asarray(one["centre"].flatten()), one["alpha"][0].as_py(), one["l1_ratio"][0].as_py(), scaled))
            names = [f.split()[0] for f in FITTED.split(", ")]
            made = [array_column([x[n] for x in rows]) if n == "coefficients" else pa.array([x[n] for x in rows], pa.int32() if n == "sweeps" else pa.float64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch["draw"], batch["alpha"], batch["l1_ratio"], batch[by], *made], names=["draw", "alpha", "l1_ratio", by, *names])

    spread = jobs.repartition(F.col("draw"), F.col(by))
    return spread.mapInArrow(work, f"draw int, alpha double, l1_ratio double, `{by}` int, {FITTED}")


def draw_settings(n_iter: int = 20, seed: int = 42, alpha: tuple[float, float] = ALPHA, l1_ratio: tuple[float, float] = L1_RATIO) -> list[tuple[int, float, float]]:
    """``n_iter`` settings drawn uniformly from the ranges: draw, alpha, l1_ratio."""
    drawn = random.Random(seed)
    return [(i, drawn.uniform(*alpha), drawn.uniform(*l1_ratio)) for i in range(n_iter)]


def _settings(spark: SparkSession, rows: list[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "draw int, alpha double, l1_ratio double")


def elastic_net(train: DataFrame, alpha: float = 1.0, l1_ratio: float = 0.5, scaled: bool = False, weight: str | None = None, **names) -> DataFrame:
    """One row with raw coefficients, intercept and training R2 of the net that minimises
    ``|y - Xw - b|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2)``; ``scaled`` standardises columns first."""
    parts = materialize(gram_parts(train.withColumn("fold", F.lit(0)), weight=weight, **names))
    fit = fit_on_grams(parts, _settings(train.sparkSession, [(0, alpha, l1_ratio)]), scaled=scaled, whole=True)
    return fit.drop("draw", "fold", "n_test", "test_r2")


def search_elastic_net(
    train: DataFrame, n_iter: int = 20, folds: int = 5, seed: int = 42, scaled: bool = True, weight: str | None = None, entity: str = "entity", settings: list | None = None, **names,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Random search by mean R2 over folds: the best fit on all rows, the result per draw, and every (draw, fold) fit.

    Folds (the column ``fold``, or the hash order of the entities) have their products added up in one pass; each
    fold's training products, its scaler among them, are the total less the fold, so no setting reads rows again.
    The result has ``draw, params, cv_r2_mean, cv_r2_std`` (population); the best draw has the largest mean, ties to
    the earlier one.  A fold whose labels are all equal has no R2.
    """
    spark = train.sparkSession
    drawn = _settings(spark, settings or draw_settings(n_iter, seed))
    rows = train if "fold" in train.columns else kfold(train, folds, seed, entity)
    parts = materialize(gram_parts(rows, weight=weight, **names))
    fits = materialize(fit_on_grams(parts, drawn, scaled=scaled))
    params = F.to_json(F.struct("alpha", "l1_ratio"))
    table = fits.groupBy("draw", params.alias("params"), "alpha", "l1_ratio").agg(F.avg("test_r2").alias("cv_r2_mean"), F.stddev_pop("test_r2").alias("cv_r2_std"))
    table = materialize(table)
    best = table.where("cv_r2_mean is not null").orderBy(F.desc("cv_r2_mean"), "draw").limit(1).select("draw", "alpha", "l1_ratio")
    return fit_on_grams(parts, best, scaled=scaled, whole=True).drop("fold", "n_test", "test_r2"), table, fits


def predict(models: DataFrame, rows: DataFrame, vector: str = "v", name: str = "predicted") -> DataFrame:
    """``rows`` with the prediction of the one model in ``models``."""
    one = models.select(F.col("coefficients").alias("_b"), F.col("intercept").alias("_i"))
    value = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "_b", lambda x, b: x * b), F.lit(0.0), lambda a, b: a + b) + F.col("_i")
    return rows.crossJoin(F.broadcast(one)).withColumn(name, value).drop("_b", "_i")  # one row


def settings_json(settings: list[tuple[int, float, float]]) -> list[str]:
    return [json.dumps({"alpha": a, "l1_ratio": r}) for _, a, r in settings]

"""From labelled vectors to certainty curves: models, out-of-fold predictions, consensus, reliability."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerflow.models.crossval import fold_predictions, nb_statistics
from titerflow.models.native import MIN_ROWS
from titerflow.operators.joins import attach
from titerflow.operators.reliability import certainty_curves, consensus, coverage_comparison, coverage_grid
from titerflow.session import materialize
from titerflow.sources.tables import path_exists

STORE = "target string, entity bigint, label int, model string, fold int, digest string, p double"


def training_digests(rows: DataFrame, scaler: str | None) -> DataFrame:
    """``target, data``: a digest of everything a target's models are trained on.

    Hashes of rows are combined by exclusive or and by sum, so neither order nor partitioning matters.  A scaler is
    fitted on the vectors of all targets, so these count too.
    """
    def digest(*cols):
        h = F.xxhash64(*cols)
        return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.hex(F.bit_xor(h)), F.hex(F.sum(h.cast("decimal(38,0)")).cast("string")))

    own = rows.groupBy("target").agg(digest("entity", "label", "side", "fold", "v").alias("data"))
    if not scaler:
        return own
    vectors = rows.select("entity", "v", "fold", "side").distinct().agg(digest("entity", "v", "fold", "side").alias("_all"))
    return own.join(vectors).select("target", F.concat_ws("/", "data", "_all").alias("data"))  # one row


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The stored predictions, each key once; an empty table where there is no store yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORE)
    return spark.read.schema(STORE).parquet(path).dropDuplicates(["target", "entity", "model", "fold", "digest"])


def update_predictions(
    rows: DataFrame, models: dict[str, tuple[str, dict]], path: str, folds: int = 5, scaler: str | None = "standard", min_rows: int = MIN_ROWS
) -> dict[str, int]:
    """Fill the store at ``path`` with the out-of-fold predictions that it lacks; returns how many targets each model was
    fitted for.

    ``rows`` are ``target, entity, label, side, fold, v``; ``models`` maps a name to a kind of ``fold_predictions`` and
    its options.  A key is (target, model, fold) with a digest of the training data and the options: changed rows or
    options are new keys, known keys are not computed again.  Each model's rows are appended by one Spark write, which
    appears whole or not at all, so a job that was cut short goes on where it stopped; a key written twice counts
    once.  Targets that cannot be trained are tried again by every call.
    """
    spark = rows.sparkSession
    known = rows.where(F.col("label").isin(0, 1))
    asked = attach(known.select("target", "fold").distinct(), _asked(rows, models, folds, scaler, min_rows), "target", "inner")
    stored = read_predictions(spark, path).select("target", "model", "fold", "digest").distinct()
    missing = materialize(asked.join(stored, ["target", "model", "fold", "digest"], "left_anti"))
    name = F.xxhash64("target")
    todo = missing.select("model", "target").distinct().groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(name).alias("x"), F.sum(name.cast("decimal(38,0)")).alias("s"))
    todo = {r["model"]: r for r in todo.collect()}  # a row per model
    shared = {}
    for model, (kind, options) in models.items():
        if model not in todo:
            continue
        own = missing.where(F.col("model") == model)
        mine = rows.join(own.select("target").distinct(), "target", "left_semi")
        extra = {}
        if kind == "gaussian_nb" and options.get("strategy") != "upsample":  # one pass serves every smoothing of the same targets
            strategy = options.get("strategy", "none")
            at = (strategy, *todo[model][1:])
            if at not in shared:
                shared[at] = nb_statistics(mine, folds, scaler, strategy, min_rows=min_rows)
            extra["statistics"] = shared[at]
        out = fold_predictions(mine, kind, folds, scaler, min_rows=min_rows, **options, **extra).where("held > 0 and label is not null")
        out = out.withColumnRenamed("held", "fold").join(own, ["target", "fold"])
        out = out.select("target", F.col("entity").cast("bigint").alias("entity"), F.col("label").cast("int").alias("label"), "model", F.col("fold").cast("int").alias("fold"), "digest", "p")
        out.write.mode("append").parquet(path)
    return {m: todo[m]["n"] if m in todo else 0 for m in models}


def _asked(rows: DataFrame, models: dict[str, tuple[str, dict]], folds: int, scaler: str | None, min_rows: int) -> DataFrame:
    """``target, model, digest`` of every target and model."""
    settings = [(n, f"{kind} {sorted(options.items())!r} {folds} {scaler} {min_rows}") for n, (kind, options) in models.items()]
    named = F.broadcast(rows.sparkSession.createDataFrame(settings, "model string, settings string"))  # a row per model
    data = training_digests(rows.where(F.col("label").isin(0, 1)), scaler).crossJoin(named)
    return data.select("target", "model", F.md5(F.concat_ws("|", "settings", "data")).alias("digest"))


def current_predictions(rows: DataFrame, models: dict[str, tuple[str, dict]], path: str, folds: int = 5, scaler: str | None = "standard", min_rows: int = MIN_ROWS) -> DataFrame:
    """The store's predictions for exactly these rows and options: ``target, entity, label, model, fold, p``."""
    asked = _asked(rows, models, folds, scaler, min_rows)
    return attach(read_predictions(rows.sparkSession, path), asked, ["target", "model", "digest"], "inner").drop("digest")


def certain_predictions(predictions: DataFrame, min_models: int = 8) -> DataFrame:
    """Consensus of the models per (target, entity) with its certainty scores."""
    return consensus(predictions, ("target", "entity"), min_models=min_models)


def applicability(
    rows: DataFrame, models: dict[str, tuple[str, dict]], path: str, folds: int = 5, scaler: str | None = "standard", min_models: int = 8, fine: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models to coverage comparison as one plan: missing predictions are made and stored, then ``consensus`` rows, the
    AUC ``curves`` per target and certainty score, and their comparison over targets."""
    update_predictions(rows, models, path, folds, scaler)
    certain = certain_predictions(current_predictions(rows, models, path, folds, scaler), min_models)
    curves = certainty_curves(certain, "target", coverage_grid(fine))
    return certain, curves, coverage_comparison(curves)

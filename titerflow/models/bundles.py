"""Bundles of linear models as rows: coefficients, scaler, threshold and feature settings, for batches and streams."""
from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from titerflow.models.linear import score_linear
from titerflow.operators.cutoffs import youden_probability
from titerflow.operators.joins import attach
from titerflow.sources.tables import path_exists

COLUMNS = "target string, kind string, coefficients array<double>, intercept double, centre array<double>, scale array<double>, threshold double, n_pos bigint, n_neg bigint, features string"


def make_bundle(models: DataFrame, judged: DataFrame | None = None, features: dict | None = None, target: str = "target") -> DataFrame:
    """One row per target from ``fit_linear`` models of the split (``held`` 0).

    ``judged`` holds ``target, label, p`` rows that choose each target's threshold by Youden's index; without it, or
    where one class is missing, the threshold is 0.5.  ``features`` are the settings that the vectors were made with;
    scoring compares them with its own.  Coefficients apply to raw vectors: the scaler is kept for the record.
    """
    kept = models.where("held = 0").withColumnRenamed(target, "target").withColumn("target", F.col("target").cast("string"))
    if judged is not None:
        best = youden_probability(judged.withColumnRenamed(target, "target"), ["target"], "label", "p", "clipped")
        kept = attach(kept, best.select(F.col("target").cast("string").alias("target"), "threshold"), "target", "left", null_safe=True).fillna(0.5, ["threshold"])
    else:
        kept = kept.withColumn("threshold", F.lit(0.5))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return kept.withColumn("features", F.lit(json.dumps(features or {}, sort_keys=True))).select(*names)


def save_bundle(bundle: DataFrame, path: str, name: str) -> int:
    """Write the bundle as the next version of ``name`` below ``path`` in one Spark job and return its number.

    All targets go in one write.  A version appears with Spark's ``_SUCCESS`` mark, so readers never see half of one.
    """
    spark = bundle.sparkSession
    version = (latest_version(spark, path, name) or 0) + 1
    bundle.write.mode("overwrite").parquet(_place(path, name, version))
    return version


def _place(path: str, name: str, version: int) -> str:
    return os.path.join(path, f"bundle={name}", f"version={version}")


def latest_version(spark: SparkSession, path: str, name: str) -> int | None:
    """The newest complete version, None where there is none."""
    top = os.path.join(path, f"bundle={name}")
    if not path_exists(spark, top):
        return None
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(top)
    found = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    done = [int(n.split("=")[1]) for n in found if n.startswith("version=") and path_exists(spark, os.path.join(top, n, "_SUCCESS"))]
    return max(done, default=None)


def list_bundles(spark: SparkSession, path: str) -> DataFrame:
    """``bundle, version`` and the models' descriptions, without coefficients."""
    return spark.read.parquet(path).select("bundle", "version", "target", "kind", "threshold", "n_pos", "n_neg", "features")


def load_bundle(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    version = version or latest_version(spark, path, name)
    if version is None:
        raise FileNotFoundError(f"no bundle {name!r} below {path}")
    return spark.read.schema(COLUMNS).parquet(_place(path, name, version))


def score_bundle(rows: DataFrame, bundle: DataFrame, features: dict | None = None, vector: str = "v") -> DataFrame:
    """``rows`` with ``p``, the target's ``threshold`` and the 0/1 call ``predicted``.

    ``rows`` have ``target`` and the raw vector.  Rows of targets that the bundle lacks go; a row without a vector has no
    call.  A bundle made with other feature settings than ``features`` fails the job.
    """
    own = bundle.withColumn("held", F.lit(0))
    if features is not None:
        text = json.dumps(features, sort_keys=True)
        stop = F.raise_error(F.concat(F.lit("the bundle's features are "), "features", F.lit(f", not {text}")))
        own = own.withColumn("intercept", F.when(F.col("features") == text, F.col("intercept")).otherwise(stop.cast("double")))
    plain = rows.drop(*[c for c in ("threshold", "p", "held", "margin", "predicted") if c in rows.columns])
    scored = score_linear(own, plain, "target", vector).drop("held", "margin")
    scored = attach(scored, bundle.select("target", "threshold"), "target", "inner", null_safe=True)
    return scored.withColumn("predicted", F.when(F.col("p").isNotNull(), (F.col("p") >= F.col("threshold")).cast("int")))


def score_stream(
    stream: DataFrame, path: str, name: str, out: str, state: str, features: dict | None = None, vector: str = "v", **trigger,
) -> StreamingQuery:
    """Score a stream of rows with the newest version of a bundle as of each micro-batch, into parquet below ``out``.

    A batch is written to a folder of its own number, which a replay overwrites, so every row is scored once in the end.
    ``version`` tells which models scored a row.  Batches without rows write nothing.
    """
    spark = stream.sparkSession

    def score(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        version = latest_version(own, path, name)
        scored = score_bundle(batch, load_bundle(own, path, name, version), features, vector)
        scored.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    if latest_version(spark, path, name) is None:
        raise FileNotFoundError(f"no bundle {name!r} below {path}")
    writer = stream.writeStream.foreachBatch(score).option("checkpointLocation", state)
    return (writer.trigger(**trigger) if trigger else writer).start()

"""Reading and writing measurement, matrix, result and feature tables."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titerflow.functions.columns import finite
from titerflow.operators.joins import attach

# Canonical column order of a classification result.
RESULT_COLUMNS = (
    "features model target n_features scaling hyperparameters threshold split_method split accuracy precision recall f1 "
    "auc auprc mcc tp tn fp fn n_train n_test imbalance error"
).split()
INT_RESULTS = {"n_features", "tp", "tn", "fp", "fn", "n_train", "n_test"}
TEXT_RESULTS = {"features", "model", "target", "scaling", "hyperparameters", "split_method", "split", "imbalance", "error"}


def plain_name(name: str) -> str:
    """Column names are matched ignoring case and spaces."""
    return "".join(name.lower().split())


def read_measurements(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", **options) -> DataFrame:
    """Read a table that must have the columns of ``schema``; others are ignored.

    No type inference: CSV is read as text from the header's names and cast, parquet is cast where needed.
    Only the named columns reach the scan.
    """
    if fmt == "csv":
        raw = spark.read.options(header=True, escape='"', **options).csv(path)
    else:
        raw = spark.read.options(**options).format(fmt).load(path)
    present = {plain_name(c): c for c in raw.columns}
    missing = [f.name for f in schema if plain_name(f.name) not in present]
    if missing:
        raise ValueError(f"missing required columns: {missing}")

    def typed(field):
        source = F.col(f"`{present[plain_name(field.name)]}`")
        return (source.try_cast(field.dataType) if fmt == "csv" else source.cast(field.dataType)).alias(field.name)

    return raw.select(*[typed(f) for f in schema])


def melt_matrix(df: DataFrame, id_cols: list[str], drop: tuple[str, ...] = (), target: str = "target", value: str = "value") -> DataFrame:
    """Wide matrix to long cells; text that is not a number, NaN and empty cells disappear."""
    skip = {*id_cols, *drop}
    targets = [c for c in df.columns if c not in skip]
    kinds = dict(df.dtypes)
    numbers = df.select(
        *id_cols,
        *[(F.col(f"`{c}`").try_cast("double") if kinds[c] == "string" else F.col(f"`{c}`").cast("double")).alias(c) for c in targets],
    )
    long = numbers.unpivot(id_cols, [f"`{c}`" for c in targets], target, value)
    return long.withColumn(value, finite(value)).where(F.col(value).isNotNull())


def export_matrix(
    long: DataFrame, dims: DataFrame | None = None, entity: str = "entity", target: str = "target", value: str = "value",
    targets: list[str] | None = None,
) -> DataFrame:
    """Long cells to a wide matrix with the entity attributes in front.

    Give ``targets`` to fix the columns.  Without it Spark looks them up and refuses more than
    ``spark.sql.pivotMaxValues``.
    """
    wide = long.groupBy(entity).pivot(target, targets).agg(F.max(value))
    if dims is None:
        return wide
    columns = [c for c in wide.columns if c != entity]
    joined = wide.join(dims, entity, "left")
    return joined.select(entity, *[c for c in dims.columns if c != entity], *[f"`{c}`" for c in columns])


def canonical_results(df: DataFrame) -> DataFrame:
    """Result rows in canonical columns and types; absent ones are NULL."""
    out = []
    for name in RESULT_COLUMNS:
        kind = "bigint" if name in INT_RESULTS else "string" if name in TEXT_RESULTS else "double"
        source = F.col(name) if name in df.columns else F.lit(None)
        out.append(source.cast(kind).alias(name))
    return df.select(*out)


def append_results(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append canonical rows; a failed job leaves no partial rows behind."""
    writer = canonical_results(df).write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_parts(spark: SparkSession, *paths: str, fmt: str = "parquet") -> DataFrame:
    """All part files of a glob or list as one table, columns united by name."""
    if fmt == "parquet":
        return spark.read.option("mergeSchema", True).parquet(*paths)
    parts = [spark.read.option("header", True).format(fmt).load(p) for p in paths]
    parts = [p for p in parts if p.columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def cache_gap(ids: DataFrame, cached: DataFrame, key: str = "entity") -> DataFrame:
    """Ids only wanted and ids only cached; the cache is valid when both are empty."""
    missing = ids.select(key).distinct().join(cached.select(key), key, "left_anti").withColumn("state", F.lit("missing"))
    stale = cached.select(key).distinct().join(ids.select(key), key, "left_anti").withColumn("state", F.lit("stale"))
    return missing.unionByName(stale)


def cached_features(rows: DataFrame, path: str, compute, key: str = "entity", parameters: dict | None = None, content: list[str] | None = None) -> DataFrame:
    """Features of exactly the wanted ids; only what the cache at ``path`` lacks is computed and added.

    ``compute`` maps rows to a DataFrame with ``key`` and the feature columns.  Cached rows are found by key and by a
    digest of ``content`` (by default all other columns, maps aside) and ``parameters``, so a changed text or setting is
    computed again for just its rows, and going back to an earlier one finds its old row.  Of rows that repeat a key,
    the one whose digest sorts first counts.  Null keys have no features.
    """
    spark = rows.sparkSession
    fields = content if content is not None else [c for c, kind in rows.dtypes if c != key and "map<" not in kind and "variant" not in kind]
    settings = json.dumps(parameters or {}, sort_keys=True, default=str)
    text = F.to_json(F.struct(F.lit(settings).alias("_settings"), *fields), {"ignoreNullFields": "false"})
    named = rows.where(F.col(key).isNotNull()).withColumn("_digest", F.sha2(text, 256))
    asked = named.groupBy(key).agg(F.min("_digest").alias("_digest"))
    if path_exists(spark, path):
        asked_new = asked.join(spark.read.parquet(path).select(key, "_digest"), [key, "_digest"], "left_anti")
    else:
        asked_new = asked
    new = named.join(asked_new, [key, "_digest"], "left_semi").dropDuplicates([key])
    made = compute(new.drop("_digest")).join(asked_new, key)
    made.write.mode("append").parquet(path)
    return spark.read.parquet(path).dropDuplicates([key, "_digest"]).join(asked, [key, "_digest"], "left_semi").drop("_digest")


def to_metric_value(df: DataFrame) -> DataFrame:
    """A one-row summary as ``(metric, value)`` text rows."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in df.columns]
    return df.select(F.inline(F.array(*pairs)))


def parse_summary(kv: DataFrame, pattern: str = r"(\d+)%") -> DataFrame:
    """Key/value rows whose name holds a percentage, as ``(metric, pct, number)``."""
    pct = F.regexp_extract("metric", pattern, 1)
    return kv.where(pct != "").select("metric", pct.cast("int").alias("pct"), F.col("value").try_cast("double").alias("number"))

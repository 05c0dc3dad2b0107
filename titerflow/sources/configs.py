"""Nested scoring configurations."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSFORM = "transformation STRUCT<low: DOUBLE, high: DOUBLE, k: DOUBLE, transformation_type: STRING>"
COMPONENT = (
    f"STRUCT<component_type: STRING, name: STRING, weight: DOUBLE, specific_parameters: STRUCT<{TRANSFORM}, smiles: ARRAY<STRING>>>"
)
CONFIG_SCHEMA = (
    "parameters STRUCT<diversity_filter: STRUCT<name: STRING, minscore: DOUBLE, minsimilarity: DOUBLE, nbmax: INT, bucket_size: INT>, "
    "inception: STRUCT<memory_size: INT, sample_size: INT, smiles: ARRAY<STRING>>, "
    f"scoring_function: STRUCT<name: STRING, parameters: ARRAY<{COMPONENT}>>>"
)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """One row per configuration file, with its path as ``config``."""
    return spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path).withColumn("config", F.input_file_name())


def parse_configs(df: DataFrame, col: str, key: str) -> DataFrame:
    """The same from a text column; ``key`` becomes ``config``."""
    return df.select(F.col(key).alias("config"), F.from_json(col, CONFIG_SCHEMA).alias("_c")).select("config", "_c.*")


def flatten_components(configs: DataFrame) -> DataFrame:
    """One row per scoring component."""
    exploded = configs.select(
        "config",
        F.col("parameters.scoring_function.name").alias("scoring"),
        F.posexplode("parameters.scoring_function.parameters").alias("position", "c"),
    )
    change = F.col("c.specific_parameters.transformation")
    return exploded.select(
        "config",
        "scoring",
        "position",
        F.col("c.component_type").alias("component_type"),
        F.col("c.name").alias("name"),
        F.col("c.weight").alias("weight"),
        F.coalesce(change["transformation_type"], F.lit("none")).alias("kind"),
        change["low"].alias("low"),
        change["high"].alias("high"),
        change["k"].alias("k"),
        F.coalesce(F.size("c.specific_parameters.smiles"), F.lit(0)).alias("n_patterns"),
    )


def diversity_settings(configs: DataFrame) -> DataFrame:
    """Diversity filter and seed memory settings, one row per configuration."""
    d, i = F.col("parameters.diversity_filter"), F.col("parameters.inception")
    return configs.select(
        "config",
        d["name"].alias("filter_name"),
        d["minscore"].alias("minscore"),
        F.coalesce(d["nbmax"], d["bucket_size"]).alias("cap"),
        i["memory_size"].alias("memory_size"),
    )

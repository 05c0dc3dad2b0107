"""Merge entities that share a structure key across source versions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titerflow.operators.joins import attach
from titerflow.session import materialize


def choose_names(
    df: DataFrame, key: str, name: str, version: str, preferred: str, target: str = "target"
) -> DataFrame:
    """Per structure key: the kept name, how many names compete and which kind of merge it is.

    A name seen in the preferred version wins over one that is not, then the name covering most targets,
    then the smaller name.
    """
    per_name = (
        df.where(F.col(key).isNotNull())
        .groupBy(key, name)
        .agg(
            F.countDistinct(target).alias("coverage"),
            F.max((F.col(version) == preferred).cast("int")).alias("in_preferred"),
        )
    )
    rank = F.struct(-F.col("in_preferred"), -F.col("coverage"), F.col(name))
    chosen = per_name.groupBy(key).agg(
        F.min_by(name, rank).alias("chosen"),
        F.count(F.lit(1)).alias("n_names"),
        F.max("in_preferred").alias("in_preferred"),
    )
    kind = F.when(F.col("n_names") == 1, "single").when(F.col("in_preferred") == 1, "cross").otherwise("same")
    return chosen.select(key, "chosen", "n_names", kind.alias("kind"))


def resolve_sources(
    df: DataFrame,
    key: str,
    name: str,
    version: str,
    preferred: str,
    other: str,
    order: list[str],
    target: str = "target",
) -> DataFrame:
    """One name per structure key.

    All rows of the kept name stay.  Where the preferred version is involved, targets the kept name lacks
    are filled with the first row (in ``order``) of the other version, renamed.  Rows without a key go.
    """
    df = materialize(df)  # read for the choice and for the rows
    named = materialize(attach(df, choose_names(df, key, name, version, preferred, target), key, "inner"))
    primary = named.where(F.col(name) == F.col("chosen"))
    covered = primary.where("kind = 'cross'").select(key, target).distinct()
    spare = named.where((F.col("kind") == "cross") & (F.col(name) != F.col("chosen")) & (F.col(version) == other))
    first = Window.partitionBy(key, target).orderBy(*order)
    fill = (
        spare.join(covered, [key, target], "left_anti")
        .withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .withColumn(name, F.col("chosen"))
        .drop("_rn")
    )
    merged = primary.withColumn("filled", F.lit(0)).unionByName(fill.withColumn("filled", F.lit(1)))
    return merged.drop("chosen", "n_names", "kind")


def merge_counts(choices: DataFrame) -> DataFrame:
    """Number of keys merged across versions and within one version."""
    return choices.agg(
        F.count_if(F.col("kind") == "cross").alias("n_cross_merges"),
        F.count_if(F.col("kind") == "same").alias("n_same_merges"),
        F.count_if(F.col("kind") == "single").alias("n_single"),
    )

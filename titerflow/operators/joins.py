"""Joins between fact rows and per-key tables.

No broadcast hints: Catalyst and adaptive execution broadcast a side whose measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and use a shuffled join beyond it, whose hot keys adaptive execution
splits over many tasks.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def attach(facts: DataFrame, dim: DataFrame, on, how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join each fact row to at most one ``dim`` row; with ``null_safe`` a NULL key finds the NULL row."""
    on = [on] if isinstance(on, str) else list(on)
    if not null_safe:
        return facts.join(dim, on, how)
    other = dim.withColumnsRenamed({k: f"_of_{k}" for k in on})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in on])
    return facts.join(other, same, how).drop(*[f"_of_{k}" for k in on])


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Attributes of the key; a key that is not listed keeps NULLs."""
    return attach(df, dim, key, "left")


def align(features: DataFrame, labels: DataFrame, key: str = "entity") -> DataFrame:
    """Feature rows and label rows of the entities that have both."""
    return labels.join(features, key, "inner")


def keep_in(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys, on, "left_semi")


def not_covered(df: DataFrame, covered: DataFrame, keys) -> DataFrame:
    """Rows whose key combination is not covered yet."""
    return df.join(covered, keys, "left_anti")


def in_all(df: DataFrame, entity: str, group_col: str, n_required: int) -> DataFrame:
    """Entities that occur in at least ``n_required`` different groups."""
    counts = df.groupBy(entity).agg(F.countDistinct(group_col).alias("n_groups"))
    return counts.where(F.col("n_groups") >= n_required)


def join_thresholds(df: DataFrame, thresholds: DataFrame, target: str = "target") -> DataFrame:
    """Values of the targets that have a threshold."""
    return attach(df, thresholds, target, "inner")


def join_metrics(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two per-key tables side by side, keys present in both."""
    return a.join(b, key, "inner")


def expand_grid(df: DataFrame, name: str, values: list) -> DataFrame:
    """Repeat each row once per grid value, inside the row's own task."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def check_against(
    df: DataFrame, claimed: DataFrame, key: str, value: str, claim: str, tol: float = 5e-4, close: float = 1e-2
) -> DataFrame:
    """Grade computed values against claimed ones: EXACT, PASS, CLOSE, FAIL or MISSING."""
    both = df.select(key, value).join(claimed.select(key, claim), key, "full")
    gap = F.abs(F.col(value) - F.col(claim))
    grade = (
        F.when(gap.isNull(), "MISSING")
        .when(gap == 0, "EXACT")
        .when(gap <= tol, "PASS")
        .when(gap <= close, "CLOSE")
        .otherwise("FAIL")
    )
    return both.withColumn("gap", gap).withColumn("grade", grade)


def map_distinct(df: DataFrame, col: str, fn, name: str) -> DataFrame:
    """Evaluate ``fn`` once per distinct value of ``col`` and give every row its result."""
    mapped: Column = fn(F.col(col))
    values = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn(name, mapped)
    return attach(df, values, col, "left")


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def minus_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_anti")


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Bag union by name; a column missing from a part is NULL there."""
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def missing_outputs(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Each expected item with whether it is there."""
    flagged = present.select(key).distinct().withColumn("present", F.lit(1))
    return expected.select(key).distinct().join(flagged, key, "left").select(
        key, F.coalesce("present", F.lit(0)).alias("present")
    )

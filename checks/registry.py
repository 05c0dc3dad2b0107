"""Registry of checked queries: a Spark callable and, where SQL can say it, the same result in SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def r(col: Column | str, digits: int = DIGITS) -> Column:
    """Round at the edge so that both engines print the same digits; adding 0.0 removes a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def shaped(df: DataFrame, *plain: str, **kinds: str) -> DataFrame:
    """Select columns: ``plain`` as they are, keyword columns as ``int`` (bigint) or ``num`` (rounded double)."""
    out = [F.col(c) for c in plain]
    for name, kind in kinds.items():
        out.append((F.col(name).cast("bigint") if kind == "int" else r(F.col(name).cast("double"))).alias(name))
    return df.select(*out)

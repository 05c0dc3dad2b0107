"""Scoring, alerts and diversity of candidates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerflow.functions.columns import desirability, weighted_product
from titerflow.operators.joins import attach
from titerflow.operators.ordering import first_rows


def score_components(df: DataFrame, components: list[dict], prefix: str = "score_") -> DataFrame:
    """One desirability column per component ``{name, column, kind, low, high, k}``."""
    return df.withColumns(
        {
            prefix + c["name"]: desirability(
                c["column"], c.get("kind", "none"), float(c.get("low", 0)), float(c.get("high", 1)), float(c.get("k", 0.25))
            )
            for c in components
        }
    )


def total_score(df: DataFrame, components: list[dict], name: str = "score", prefix: str = "score_") -> DataFrame:
    """Weighted geometric product of the component scores."""
    cols = [F.col(prefix + c["name"]) for c in components]
    return df.withColumn(name, weighted_product(cols, [float(c.get("weight", 1)) for c in components]))


def alert_flag(col: Column | str, patterns: list[str]) -> Column:
    """True if any pattern matches: one regular expression, no join."""
    text = F.col(col) if isinstance(col, str) else col
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def alert_filter(df: DataFrame, col: str, patterns: list[str], score: str | None = None) -> DataFrame:
    """Drop rows with an alert or, if a score column is named, set their score to 0."""
    hit = alert_flag(col, patterns)
    return df.withColumn(score, F.when(hit, 0.0).otherwise(F.col(score))) if score else df.where(~hit)


def diversity_cap(
    df: DataFrame, group: str, score: str = "score", minscore: float = 0.4, cap: int = 25, order: tuple[str, ...] = ("entity",),
    name: str = "capped_score",
) -> DataFrame:
    """Within a group the first ``cap`` rows of at least ``minscore`` (in ``order``) keep their score, later ones get 0.

    Only the first ``cap`` rows per task and group are shuffled to find each group's last admitted row;
    all rows are then compared with that mark.
    """
    key = F.struct(*[F.col(c) for c in order])
    good = df.where(F.col(score) >= minscore)
    head = first_rows(good, group, order, cap, "_rn")
    marks = head.groupBy(group).agg(F.max(key).alias("_last"), F.count(F.lit(1)).alias("_held"))
    joined = attach(df, marks, group, "left")
    over = (F.col(score) >= minscore) & (F.col("_held") >= cap) & (key > F.col("_last"))
    return joined.withColumn(name, F.when(over, 0.0).otherwise(F.col(score))).drop("_last", "_held")


def seed_memory(df: DataFrame, size: int, score: str = "score", key: str = "entity") -> DataFrame:
    """The ``size`` best distinct candidates."""
    best = df.where(F.col(score).isNotNull()).groupBy(key).agg(F.max(score).alias(score))
    return best.orderBy(F.col(score).desc(), F.col(key)).limit(size)


def stage_filter(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Add ``stage_reached``: the number of filters passed in a row."""
    passed = F.lit(0)
    alive = F.lit(True)
    for _, test in stages:
        alive = alive & F.coalesce(test, F.lit(False))
        passed = passed + F.when(alive, 1).otherwise(0)
    return df.withColumn("stage_reached", passed)


def stage_report(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows left and percentage removed per filter stage, from one aggregation."""
    names = ["input", *[name for name, _ in stages]]
    marked = stage_filter(df, stages)
    wide = marked.agg(*[F.count_if(F.col("stage_reached") >= i).alias(f"_{i}") for i in range(len(names))])
    left = [F.col(f"_{i}") for i in range(len(names))]
    rows = [
        F.struct(
            F.lit(i).alias("stage_no"),
            F.lit(name).alias("stage"),
            left[i].alias("n"),
            (F.when(left[i - 1] > 0, 100.0 * (left[i - 1] - left[i]) / left[i - 1]) if i else F.lit(None).cast("double")).alias(
                "pct_removed"
            ),
        )
        for i, name in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))

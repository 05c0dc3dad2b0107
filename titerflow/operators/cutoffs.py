"""Cutoff selection per target: on measured values and on predicted probabilities."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titerflow.functions.columns import binary_label
from titerflow.operators.joins import attach
from titerflow.operators.ordering import _keys, _within, group_quantiles, roc_points, value_points

MIN_VALUES = 10


def median_cutoff(df: DataFrame, value: str = "value", target: str = "target", exact: bool = True) -> DataFrame:
    """Median per target; ``exact=False`` uses a sketch instead of a sort."""
    if exact:
        return group_quantiles(df, target, value, {"threshold": 0.5}).select(target, "n", "threshold")
    return df.groupBy(target).agg(
        F.count(value).alias("n"), F.percentile_approx(value, 0.5, 10_000).alias("threshold")
    )


def youden_cutoff(
    df: DataFrame, value: str = "value", target: str = "target", min_values: int = MIN_VALUES
) -> DataFrame:
    """Cutoff with the best Youden index against pseudo-labels ``value > median``.

    The labels come from the score itself, so the best cutoff is the smallest value above the median.  If
    nothing lies above the median the median is returned; the labels are all 0 either way.
    """
    q = group_quantiles(df, target, value, {"median": 0.5}, keep_next=True)
    return q.where(F.col("n") >= min_values).select(
        target, "n", "median", F.coalesce("median_above", "median").alias("threshold")
    )


def balanced_cutoff(
    df: DataFrame,
    value: str = "value",
    target: str = "target",
    extra: tuple[float, ...] = (6.0, 7.0),
    min_values: int = MIN_VALUES,
    low: float = 0.1,
    high: float = 0.9,
) -> DataFrame:
    """The candidate (median, 60th and 75th percentile, fixed values) whose positive share is nearest one half.

    A candidate must lie inside the value range and give a share inside [low, high]; the first one wins
    ties and the median is the fallback.
    """
    q = group_quantiles(df, target, value, {"c0": 0.5, "c1": 0.6, "c2": 0.75}).where(F.col("n") >= min_values)
    fixed = [f"c{i + 3}" for i in range(len(extra))]
    q = q.withColumns({name: F.lit(float(v)) for name, v in zip(fixed, extra, strict=True)})
    names = ["c0", "c1", "c2", *fixed]
    pts = value_points(df, target, value)
    joined = attach(pts, q.withColumnRenamed("n", "total"), target, "inner")
    shares = joined.groupBy(target).agg(
        F.max("total").alias("n"),
        F.max("lo").alias("lo"),
        F.max("hi").alias("hi"),
        *[F.max(c).alias(c) for c in names],
        *[(F.sum(F.when(F.col(value) > F.col(c), F.col("n")).otherwise(0)) / F.sum("n")).alias(f"share_{c}") for c in names],
    )
    options = F.array(
        *[
            F.when(
                F.col(c).between(F.col("lo"), F.col("hi")) & F.col(f"share_{c}").between(low, high),
                F.struct(
                    F.abs(F.col(f"share_{c}") - 0.5).alias("gap"),
                    F.lit(i).alias("i"),
                    F.col(c).alias("threshold"),
                    F.col(f"share_{c}").alias("share"),
                ),
            )
            for i, c in enumerate(names)
        ]
    )
    best = F.array_min(F.filter(options, lambda o: o.isNotNull()))
    return shares.withColumn("best", best).select(
        target,
        "n",
        F.coalesce("best.threshold", "c0").alias("threshold"),
        F.coalesce("best.share", "share_c0").alias("positive_share"),
        F.coalesce("best.i", F.lit(0)).alias("candidate"),
    )


def youden_probability(
    df: DataFrame, by, label: str = "label", score: str = "score", variant: str = "with_start"
) -> DataFrame:
    """Probability cutoff with the largest tpr - fpr; ties go to the highest cutoff.

    ``with_start`` also considers the curve's starting point (nothing predicted positive): it wins when no
    cutoff beats J = 0, and the cutoff is then above every score: the largest score plus one.  ``clipped`` skips that point and clips the cutoff to [0, 1].  A one-class group gets 0.5.
    """
    by = _keys(by)
    roc = roc_points(df, by, label, score).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = F.max_by(F.struct(score, "j", "tpr", "fpr"), F.struct("j", score))
    agg = roc.groupBy(*by).agg(
        best.alias("b"), F.max(score).alias("top"), F.max("pos").alias("pos"), F.max("neg").alias("neg")
    )
    one_class = (F.col("pos") == 0) | (F.col("neg") == 0)
    start = (F.col("b.j") <= 0) if variant == "with_start" else F.lit(False)
    cut = F.when(start, F.col("top") + 1.0).otherwise(F.col(f"b.{score}"))
    if variant == "clipped":
        cut = F.least(F.greatest(cut, F.lit(0.0)), F.lit(1.0))
    zero = F.lit(0.0)
    return agg.select(
        *by,
        "pos",
        "neg",
        F.when(one_class, 0.5).otherwise(cut).alias("threshold"),
        F.when(one_class, zero).when(start, zero).otherwise(F.col("b.j")).alias("j"),
        F.when(one_class, None).when(start, zero).otherwise(F.col("b.tpr")).alias("sensitivity"),
        F.when(one_class, None).when(start, 1.0).otherwise(1.0 - F.col("b.fpr")).alias("specificity"),
    )


def f1_cutoff(
    df: DataFrame, by, label: str = "label", score: str = "score", lo: float = 0.1, hi: float = 0.9, steps: int = 50
) -> DataFrame:
    """Grid cutoff with the best F1 per group; the lowest cutoff wins ties.

    A row is positive at grid points ``0..g``, so counts per highest such ``g`` are enough: one small
    histogram per group instead of one copy of the row per grid point.
    """
    by = _keys(by)
    width = (hi - lo) / (steps - 1)
    cuts = [lo + width * i for i in range(steps)]
    # the largest grid index whose cutoff is not above the score
    level = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(score))) - 1
    hist = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, level.alias("level")).agg(
        F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    # at most steps + 1 rows per group from here on
    down = _within(by).orderBy(F.col("level").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f1 = 2.0 * F.col("tp") / (F.col("pp") + F.col("total_pos"))
    scored = hist.select(
        *by,
        F.sum("pos").over(so_far).alias("tp"),
        F.sum("n").over(so_far).alias("pp"),
        F.sum("pos").over(_within(by)).alias("total_pos"),
        "level",
        # every cutoff above the next lower level gives the same counts: the lowest of them stands for all
        (F.coalesce(F.lead("level").over(down), F.lit(-1)) + 1).alias("i"),
    ).withColumn("f1", F.when(F.col("level") >= 0, f1))
    best = scored.groupBy(*by).agg(F.max(F.when(F.col("f1") > 0, F.struct("f1", (-F.col("i")).alias("i")))).alias("b"))
    index = F.coalesce(-F.col("b.i"), F.lit(0))
    return best.select(
        *by, (F.lit(lo) + F.lit(width) * index).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1")
    )


def operating_point(
    df: DataFrame, by, label: str = "label", score: str = "score", cutoff: float = 0.3, min_rows: int = 50
) -> DataFrame:
    """Rates of the rule "retain if score <= cutoff", next to the Youden cutoff of the same group."""
    by = _keys(by)
    active, inactive = F.col(label) == 1, F.col(label) == 0
    kept = F.col(score) <= cutoff

    def share(of, among):
        return F.avg(F.when(among, of.cast("double")))

    rates = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(active).alias("n_active"),
        share(kept, inactive).alias("specificity_at"),
        share(~kept, inactive).alias("false_exclusion_at"),
        share(inactive, kept).alias("npv_at"),
        share(~kept, active).alias("sensitivity_at"),
    )
    youden = youden_probability(df, by, label, score).select(*by, "threshold", "j", "sensitivity", "specificity")
    joined = rates.where(F.col("n") >= min_rows).join(youden, by, "inner")
    return joined.withColumn("is_conservative", (F.lit(cutoff) <= F.col("threshold")).cast("int"))


def cutoff_summary(points: DataFrame) -> DataFrame:
    """Spread of the Youden cutoffs over the targets and the mean rates of the fixed cutoff."""
    return points.agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.avg("threshold").alias("mean_threshold"),
        F.stddev_samp("threshold").alias("std_threshold"),
        F.min("threshold").alias("min_threshold"),
        F.max("threshold").alias("max_threshold"),
        F.count_if(F.col("is_conservative") == 1).alias("n_conservative"),
        F.avg("sensitivity_at").alias("mean_sensitivity"),
        F.avg("specificity_at").alias("mean_specificity"),
        F.avg("npv_at").alias("mean_npv"),
    )


def binarize(
    df: DataFrame, thresholds: DataFrame | float, op: str = ">", value: str = "value", target: str = "target",
    entity: str = "entity",
) -> DataFrame:
    """Add a 0/1 ``label``: one cutoff for all targets, or a threshold table joined on target."""
    if isinstance(thresholds, (int, float)):
        return df.withColumn("label", binary_label(value, float(thresholds), op))
    joined = attach(df, thresholds.select(target, "threshold"), target, "inner")
    return joined.withColumn("label", binary_label(value, F.col("threshold"), op))

"""Applicability domain: how good is a model on the rows it is most certain about."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerflow.functions.columns import class_lag, std_prob
from titerflow.operators.joins import attach
from titerflow.operators.metrics import auc_of_points, rank_auc
from titerflow.operators.ordering import _keys, first_rows, row_numbers, running_totals
from titerflow.session import materialize

SCORES = ("class_lag", "cons_std", "cons_std_prob")


def coverage_grid(fine: bool = False) -> list[int]:
    """Coverage levels in whole percent: 10..100 in tens, with 1..9 added by ``fine``."""
    return [*(range(1, 10) if fine else ()), *range(10, 101, 10)]


def consensus(preds: DataFrame, by=("target", "entity"), p: str = "p", min_models: int = 8, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """Mean and sample spread of the model probabilities per row, with the three certainty scores.

    Rows with fewer than ``min_models`` models are left out.
    """
    agg = preds.groupBy(*by).agg(
        F.count(p).alias("n_models"),
        F.avg(p).alias("p_mean"),
        F.stddev_samp(p).alias("p_std"),
        *[F.max(c).alias(c) for c in keep],
    )
    return agg.where(F.col("n_models") >= min_models).withColumns(
        {
            "class_lag": class_lag("p_mean"),
            "cons_std": F.col("p_std"),
            "cons_std_prob": std_prob("p_mean", "p_std"),
        }
    )


def keep_count(percent: Column, n: Column) -> Column:
    """max(2, ceil(percent / 100 * n)), in whole numbers."""
    return F.greatest(F.lit(2), F.floor((percent * n + 99) / 100))


def keep_lowest(df: DataFrame, by, score: str, n: int, entity: str = "entity") -> DataFrame:
    """The ``n`` rows with the lowest score per group."""
    return first_rows(df, by, [score, entity], n, "rank")


def auc_at_coverage(
    df: DataFrame, by, score: str, p: str = "p", label: str = "label", entity: str = "entity", grid: list[int] | None = None
) -> DataFrame:
    """AUC of the most certain rows per group and coverage level; NULL where only one class is left.

    Rows get the first level that keeps them, are reduced to (group, level, probability) counts, and only
    these counts are repeated for the higher levels.
    """
    by = _keys(by)
    grid = sorted(grid or coverage_grid())
    slim = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, entity, score, p, label)
    ranked = row_numbers(slim, by, [score, entity], "_rank", "_n")
    counts = ranked.groupBy(*by, p, _first_level(grid).alias("_level")).agg(
        F.sum(label).alias("hits"), F.count(F.lit(1)).alias("n")
    )
    return _auc_of_levels(counts, by, p, grid)


def _first_level(grid: list[int]) -> Column:
    """Number of the first level of ``grid`` that keeps row ``_rank`` of ``_n``; NULL where none does."""
    level = F.lit(None).cast("int")
    for i in reversed(range(len(grid))):
        level = F.when(F.col("_rank") <= keep_count(F.lit(grid[i]), F.col("_n")), i).otherwise(level)
    return level


def _auc_of_levels(counts: DataFrame, by: list[str], p: str, grid: list[int]) -> DataFrame:
    """AUC per coverage level from ``hits`` and ``n`` per group, probability and first ``_level``."""
    counts = counts.where("_level IS NOT NULL")
    levels = F.slice(F.array(*[F.lit(g) for g in grid]), F.col("_level") + 1, len(grid))
    points = (
        counts.withColumn("coverage", F.explode(levels))
        .groupBy(*by, "coverage", p)
        .agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    )
    out = auc_of_points(points, [*by, "coverage"], p)
    return out.select(*by, "coverage", (F.col("pos") + F.col("neg")).alias("n_kept"), "auc")


def certainty_curves(rows: DataFrame, by, grid: list[int] | None = None, scores: tuple[str, ...] = SCORES, p: str = "p_mean",
                     label: str = "label", entity: str = "entity") -> DataFrame:
    """``auc_at_coverage`` for several scores in one job, as rows ``(by, score, coverage, auc)``."""
    by = _keys(by)
    pairs = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("certainty")) for s in scores])
    long = rows.select(*by, entity, p, label, F.explode(pairs).alias("_s")).select(
        *by, entity, p, label, "_s.score", "_s.certainty"
    )
    return auc_at_coverage(long, [*by, "score"], "certainty", p, label, entity, grid)


def eligible_targets(rows: DataFrame, by, label: str = "label", min_rows: int = 20) -> DataFrame:
    """Groups with enough rows and both classes."""
    by = _keys(by)
    stats = rows.groupBy(*by).agg(
        F.count(label).alias("n_rows"), F.count_if(F.col(label) == 1).alias("n_pos")
    )
    return stats.where((F.col("n_rows") >= min_rows) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_rows")))


def reliability_by_target(
    rows: DataFrame, by="target", score: str = "class_lag", p: str = "p", label: str = "label", entity: str = "entity",
    grid: list[int] | None = None, cuts: tuple[float, ...] = (0.2, 0.3), min_rows: int = 20,
) -> DataFrame:
    """One row per target: sizes, positive share, AUC, certainty statistics and one AUC column per coverage."""
    by = _keys(by)
    grid = grid or coverage_grid()
    ok = eligible_targets(rows, by, label, min_rows)
    kept = materialize(attach(rows, ok.select(*by), by, "inner"))  # read by five branches
    from titerflow.operators.ordering import group_quantiles

    stats = kept.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (100.0 * F.avg(F.col(label).cast("double"))).alias("pct_positive"),
        F.avg(score).alias("mean_score"),
        *[(100.0 * F.avg((F.col(score) < c).cast("double"))).alias(f"pct_below_{round(100 * c)}") for c in cuts],
    )
    median = group_quantiles(kept, by, score, {"median_score": 0.5}).select(*by, "median_score")
    overall = rank_auc(kept, by, label, p).select(*by, F.col("auc").alias("overall_auc"))
    curve = auc_at_coverage(kept, by, score, p, label, entity, grid)
    wide = curve.groupBy(*by).agg(
        *[F.max(F.when(F.col("coverage") == c, F.col("auc"))).alias(f"auc_cov{c:03d}") for c in grid]
    )
    return stats.join(median, by).join(overall, by).join(wide, by)


def coverage_table(curves: DataFrame, by=None, coverage: str = "coverage", auc: str = "auc") -> DataFrame:
    """Mean AUC per coverage level over the targets that have one, and how many those are."""
    return curves.groupBy(*_keys(by), coverage).agg(F.avg(auc).alias("mean_auc"), F.count(auc).alias("n_valid"))


def best_coverage(table: DataFrame, by=None, coverage: str = "coverage") -> DataFrame:
    """Best level (the lowest wins ties), its mean AUC, the full-coverage baseline and the gain.

    Means that agree to twelve digits count as tied: the last bits depend on the order of summation.
    """
    by = _keys(by)
    out = table.groupBy(*by).agg(
        # a level without any valid target has no mean and cannot be the best
        F.min_by(coverage, F.when(F.col("mean_auc").isNotNull(), F.struct(-F.round("mean_auc", 12), F.col(coverage)))).alias(
            "best_coverage"
        ),
        F.max("mean_auc").alias("best_auc"),
        F.max(F.when(F.col(coverage) == 100, F.col("mean_auc"))).alias("baseline_auc"),
    )
    return out.withColumn("max_gain", F.col("best_auc") - F.col("baseline_auc"))


def coverage_comparison(curves: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """Mean AUC and valid targets of each score side by side, one row per coverage level."""
    return curves.groupBy("coverage").agg(
        *[F.avg(F.when(F.col("score") == s, F.col("auc"))).alias(f"auc_{s}") for s in scores],
        *[F.count(F.when(F.col("score") == s, F.col("auc"))).alias(f"valid_{s}") for s in scores],
    )


def coverage_gain(curves: DataFrame, score: str) -> DataFrame:
    """Best mean AUC of one certainty score against full coverage."""
    return best_coverage(coverage_table(curves.where(F.col("score") == score)))


def share_below(df: DataFrame, col: str, cuts: tuple[float, ...], by=None) -> DataFrame:
    """Percentage of values under each cut, mean and exact median."""
    from titerflow.operators.ordering import group_quantiles

    by = _keys(by)
    keyed = df if by else df.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    known = keyed.where(F.col(col).isNotNull())
    stats = known.groupBy(*keys).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        *[(100.0 * F.avg((F.col(col) < c).cast("double"))).alias(f"pct_below_{round(100 * c)}") for c in cuts],
    )
    median = group_quantiles(known, keys, col, {"median": 0.5}).select(*keys, "median")
    return stats.join(median, keys).drop("_all")


def reliability_sweep(
    values: DataFrame, preds: DataFrame, cutoffs: tuple[float, ...] = (0.0, -0.5, -0.75, -1.0), op: str = "<=",
    by="target", entity: str = "entity", value: str = "value", p: str = "p", grid: list[int] | None = None,
    min_rows: int = 20,
) -> DataFrame:
    """Coverage table for every cutoff on the measured value, in one job.

    ``preds`` holds ``(by, entity, p)``; with a ``cutoff`` column in it, the predictions differ by cutoff.  Without one
    the rows and their order are those of every cutoff: they are joined and ranked once, and only their counts per
    (group, level, probability) are repeated for the cutoffs.
    """
    from titerflow.functions.columns import binary_label, finite
    from titerflow.operators.joins import expand_grid

    by = _keys(by)
    keys = ["cutoff", *by]
    if "cutoff" not in preds.columns:
        grid = sorted(grid or coverage_grid())
        rows = values.select(*by, entity, value).where(finite(value).isNotNull()).join(preds.select(*by, entity, p), [*by, entity])
        # rows without a score count for their group's size and have no rank
        scored = rows.withColumn("class_lag", class_lag(p)).withColumn("_one", F.col("class_lag").isNotNull().cast("int"))
        ranked = running_totals(scored, by, [F.col("class_lag").asc_nulls_last(), entity], ["_one"])
        ranked = ranked.withColumns({"_rank": F.when(F.col("_one") == 1, F.col("cum__one")), "_n": F.col("tot__one")})
        hits = [F.sum(binary_label(value, c, op)).alias(f"_hits{i}") for i, c in enumerate(cutoffs)]
        counts = materialize(ranked.groupBy(*by, p, _first_level(grid).alias("_level")).agg(F.count(F.lit(1)).alias("n"), *hits))
        pairs = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"_hits{i}").alias("hits")) for i, c in enumerate(cutoffs)])
        counts = counts.withColumn("_c", F.explode(pairs)).select(*by, p, "_level", "n", "_c.cutoff", "_c.hits")
        sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.sum("hits").alias("n_pos"))
        ok = sizes.where((F.col("n_rows") >= min_rows) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_rows"))).select(*keys)
        return coverage_table(_auc_of_levels(attach(counts, ok, keys, "inner"), keys, p, grid), "cutoff")
    labelled = expand_grid(values, "cutoff", [float(c) for c in cutoffs]).withColumn(
        "label", binary_label(value, F.col("cutoff"), op)
    )
    rows = labelled.join(preds, [*by, entity, "cutoff"]).withColumn("class_lag", class_lag(p))
    ok = eligible_targets(rows, keys, "label", min_rows).select(*keys)
    kept = attach(rows, ok, keys, "inner")
    return coverage_table(auc_at_coverage(kept, keys, "class_lag", p, "label", entity, grid), "cutoff")

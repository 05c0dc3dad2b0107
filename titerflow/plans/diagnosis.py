"""The full set of performance diagnostics as one report."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerflow.operators import diagnostics as X
from titerflow.operators.reliability import coverage_gain
from titerflow.operators.summaries import target_means
from titerflow.session import materialize


def diagnose_metrics(
    metrics: DataFrame, cells: DataFrame, configuration: str = "default", mu: float = 0.5, active_at: float = 0.0,
    band: tuple[float, float] = (40.0, 60.0), curves: DataFrame | None = None, curve_target: str = "target",
    similarities: Mapping[str, tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Findings on algorithm, reliability, data amount, balance, ranking and features, one row each.

    ``metrics`` holds ``(model, target, metric, split)`` and ``cells`` the measured matrix, whose targets are sized
    by their cells and by the percentage of values up to ``active_at``; targets inside ``band`` are balanced.
    ``curves``, as ``certainty_curves`` gives them, adds the two findings on reliability; each entry of
    ``similarities``, ``name: (pair similarity, response similarity)``, adds one on features.  A statistic that its
    rows do not allow, such as a comparison with an empty group, is ``n/a``.
    """
    tests = metrics.where(F.col("split") == "Train_Test")
    means = target_means(tests, "metric", name="mean_metric")
    known = cells.where(F.col("value").isNotNull())
    sizes = known.groupBy("target").agg(
        F.count(F.lit(1)).cast("double").alias("n_cells"),
        (100.0 * F.avg((F.col("value") <= active_at).cast("double"))).alias("pct_active"),
    )
    sized = materialize(means.join(sizes, "target").withColumn("balanced", F.col("pct_active").between(*band)))

    def row(df, *args, **kw):
        return X.report_row(df, configuration, *args, **kw)

    parts = [
        row(
            X.kruskal(tests, "model", "metric"), "H1 - algorithm", "Kruskal-Wallis of the metric across models",
            X.finding("H=%.4f; range=%.4f", "h", "mean_range"), F.col("p"),
            X.finding("Mean metrics of the models lie within %.4f of each other.", "mean_range"),
        )
    ]
    if curves is not None:
        curves = materialize(curves)
        ends = curves.where(F.col("score") == "class_lag").groupBy(curve_target).agg(
            *[F.max(F.when(F.col("coverage") == c, F.col("auc"))).alias(f"auc_{c}") for c in (10, 100)]
        )
        parts.append(row(
            X.wilcoxon_paired(ends, "auc_10", "auc_100"), "H1 - reliability", "Paired Wilcoxon of AUC at 10 % and at full coverage",
            X.finding("W=%.1f; gain=%.4f", "w", "mean_gain"), F.col("p"),
            "A large gain means that the most certain predictions are the good ones.",
        ))
    parts += [
        row(
            X.pearson(sized, "n_cells", "mean_metric"), "H2 - data amount", "Pearson r of cells and mean metric",
            X.finding("r=%.4f", "r"), F.col("p"), "Do targets with more data score higher?",
        ),
        row(
            X.pearson(sized, "pct_active", "mean_metric"), "H2 - balance", "Pearson r of percentage active and mean metric",
            X.finding("r=%.4f", "r"), F.col("p"), "Does the share of actives explain the metric?",
        ),
        row(
            X.mann_whitney(sized, "balanced", "mean_metric"), "H2 - balance, two groups", "Mann-Whitney of balanced and other targets",
            X.finding("U=%.1f; balanced=%.4f; other=%.4f", "u", "mean1", "mean2"), F.col("p"),
            X.finding("%d balanced targets against %d others.", "n1", "n2"),
        ),
        row(
            X.ttest_1samp(means, "mean_metric", mu), "H3 - ranking", "One-sample t of the target means",
            X.finding("t=%.4f; mean=%.4f; CI=[%.4f,%.4f]", "t", "mean", "ci_low", "ci_high"), F.col("p"),
            "AUC needs no cutoff: a low one is weak ranking, not poor calibration alone.",
        ),
    ]
    if curves is not None:
        parts.append(row(
            coverage_gain(curves, "cons_std_prob"), "Reliability - consensus", "Best coverage by consensus certainty against full coverage",
            X.finding("best=%.4f at %d%%; full=%.4f; gain=%.4f", "best_auc", "best_coverage", "baseline_auc", "max_gain"),
            interpretation="Does agreement of the models pick entities that are predicted better?",
        ))
    parts.append(row(
        X.variance_parts(cells), "H4 - features, variance", "Additive variance decomposition",
        X.finding("entity=%.1f%%; target=%.1f%%; residual=%.1f%%", "pct_entity", "pct_target", "pct_residual"),
        interpretation="Features of an entity alone reach its own share at most.",
    ))
    for name, (similarity, response) in (similarities or {}).items():
        parts.append(row(
            X.similarity_vs_response(similarity, response), f"H4 - features, similarity by {name}",
            "Rank correlation of pair similarity and response similarity", X.finding("rs=%.4f; pairs=%d", "spearman", "n"), F.col("p"),
            X.finding("Similarity explains %.2f%% of the ranks of response similarity.", "r_squared_pct"),
        ))
    parts.append(row(
        X.within_variance(cells), "H4 - features, within", "Mean variance inside entities and targets",
        X.finding("entity=%.4f; target=%.4f", "mean_entity_variance", "mean_target_variance"),
        interpretation="High variance inside entities: the target decides what an entity does.",
    ))
    return X.diagnostic_report(*parts)

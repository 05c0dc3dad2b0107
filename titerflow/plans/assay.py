"""Whole jobs on assay tables, composed from the operators."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerflow.operators.cleaning import collapse, neg_log10_molar, parse_values, target_summary
from titerflow.operators.cutoffs import binarize, youden_cutoff
from titerflow.session import materialize


def measurements_to_cells(df: DataFrame, raw: str = "raw_value", digits: int = 9) -> DataFrame:
    """Censored nanomolar text to one p-value per (entity, target).

    The mean is rounded so that a cutoff equal to a data value compares the same way in every run.
    """
    values = neg_log10_molar(parse_values(df, raw), "value")
    return collapse(values, value="p_value").select("entity", "target", F.round("p_value", digits).alias("value"))


def labelled_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels by the per-target Youden cutoff, and the cutoffs."""
    thresholds = youden_cutoff(cells)
    return binarize(cells, thresholds), thresholds


def summarise_assay(df: DataFrame) -> DataFrame:
    """Measurements to one row per target: cutoff, totals, actives, active percentage."""
    # the cutoffs and the labels both read the cells: collapse the replicates once
    labels, thresholds = labelled_cells(materialize(measurements_to_cells(df)))
    return target_summary(labels).join(thresholds.select("target", "threshold"), "target")

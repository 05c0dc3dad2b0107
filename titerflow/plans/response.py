"""Response tables from several source versions to labelled target summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame

from titerflow.operators.cleaning import collapse, target_summary
from titerflow.operators.cutoffs import binarize
from titerflow.operators.resolve import resolve_sources


def response_cells(
    df: DataFrame, key: str, name: str, version: str, preferred: str, other: str, order: list[str], target: str = "target"
) -> DataFrame:
    """One name per structure key, then the first value (in ``order``) of each (name, target)."""
    merged = resolve_sources(df, key, name, version, preferred, other, order, target)
    return collapse(merged, "first", "value", name, target, order=order)


def summarise_response(
    df: DataFrame, cutoff: float, op: str, key: str, name: str, version: str, preferred: str, other: str, order: list[str],
    target: str = "target",
) -> DataFrame:
    """Merged response values, labelled by one cutoff for all targets, counted per target."""
    cells = response_cells(df, key, name, version, preferred, other, order, target)
    return target_summary(binarize(cells, float(cutoff), op, "value", target, name), target)

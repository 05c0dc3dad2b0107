"""From raw measurements to a clean long matrix, with a count for every step."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerflow.functions.columns import as_col, parse_censored
from titerflow.operators.ordering import row_numbers

SMALLEST_MOLAR = 1e-15  # stands in when no positive concentration exists


def parse_values(df: DataFrame, raw: str = "raw_value") -> DataFrame:
    """Add ``value`` and ``flag`` parsed from a possibly censored text."""
    parsed = df.withColumn("_parsed", parse_censored(raw))
    return parsed.withColumns({"value": F.col("_parsed.value"), "flag": F.col("_parsed.flag")}).drop("_parsed")


def neg_log10_molar(df: DataFrame, col: str, name: str = "p_value") -> DataFrame:
    """``-log10`` of a nanomolar column; non-positive values count as the smallest positive one of the table."""
    molar = F.col(col) / F.lit(1e9)
    smallest = F.coalesce(F.min(F.when(molar > 0, molar)), F.lit(SMALLEST_MOLAR))
    floor = df.agg(smallest.alias("m")).scalar()
    return df.withColumn(name, -F.log10(F.when(molar <= 0, floor).otherwise(molar)))


def invalid_text(col: Column | str, wildcard: str = "*") -> Column:
    return F.coalesce(as_col(col).contains(wildcard), F.lit(True))


def drop_invalid(df: DataFrame, col: str, wildcard: str = "*", valid: str | None = None) -> DataFrame:
    """Rows whose text has no wildcard and, if a validity column is given, is valid."""
    ok = ~invalid_text(col, wildcard)
    return df.where(ok & F.col(valid) if valid else ok)


def invalid_counts(df: DataFrame, col: str, wildcard: str = "*", valid: str | None = None) -> DataFrame:
    """One row: rows with a wildcard, rows invalid for another reason, rows kept."""
    has_wildcard = F.coalesce(F.col(col).contains(wildcard), F.lit(False))
    other = ~F.col(valid) if valid else F.col(col).isNull()
    return df.agg(
        F.count_if(has_wildcard).alias("n_wildcard"),
        F.count_if(other & ~has_wildcard).alias("n_invalid"),
        F.count_if(~other & ~has_wildcard).alias("n_kept"),
    )


def exact_dedup(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key combination; with ``order`` the first row in that order."""
    if order is None or set(df.columns) == set(keys):
        return df.dropDuplicates(keys)
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def dedup_removals(df: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """Rows, distinct rows and removed rows per target, in one aggregation over the distinct keys."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.groupBy(target).agg(
        F.sum("copies").alias("n_before"),
        F.count(F.lit(1)).alias("n_after"),
        (F.sum("copies") - F.count(F.lit(1))).alias("n_removed"),
    )


def unique_baseline(df: DataFrame, entity: str = "entity", target: str = "target") -> DataFrame:
    """Distinct entities and rows per entity, per target and for the whole table (``target`` NULL)."""
    return df.rollup(target).agg(
        F.countDistinct(entity).alias("n_unique"),
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) / F.countDistinct(entity)).alias("rows_per_entity"),
    )


def stage_counts(
    df: DataFrame, stage: str, entity: str = "entity", target: str = "target", by: str = "entity", approx: bool = False
) -> DataFrame:
    """``(stage, target, n)`` with a NULL-target total that counts each entity once."""
    if by == "rows":
        measure = F.count(F.lit(1))
    else:
        measure = F.approx_count_distinct(entity) if approx else F.countDistinct(entity)
    return df.rollup(target).agg(measure.alias("n")).select(F.lit(stage).alias("stage"), target, "n")


def attrition_report(stages: DataFrame, order: list[str], target: str = "target") -> DataFrame:
    """Count and percentage removed per target and stage; a target missing from a stage counts as 0.

    ``stages`` holds ``(stage, target, n)`` rows, the total having a NULL target.  The report is small:
    one row per target and stage.
    """
    named = stages.withColumn(target, F.coalesce(target, F.lit("TOTAL")))
    wide = named.groupBy(target).pivot("stage", order).agg(F.max("n"))
    long = wide.select(
        target,
        F.posexplode(
            F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias("n")) for s in order])
        ).alias("stage_no", "_s"),
    ).select(target, "stage_no", "_s.stage", "_s.n")
    return stage_delta(long, target)


def stage_delta(counts: DataFrame, target: str = "target") -> DataFrame:
    """Percentage removed against the previous stage; NULL for the first stage or after an empty one."""
    previous = F.lag("n").over(Window.partitionBy(target).orderBy("stage_no"))
    return counts.withColumn("previous", previous).withColumn(
        "pct_removed", F.when(F.col("previous") > 0, 100.0 * (F.col("previous") - F.col("n")) / F.col("previous"))
    )


def collapse(
    df: DataFrame, how: str = "mean", value: str = "value", entity: str = "entity", target: str = "target", order=None
) -> DataFrame:
    """One value per cell: the mean of the replicates, or the first non-missing one in ``order``."""
    if how == "mean":
        # filter after the mean: before it, the whole value expression would be evaluated twice per row
        return df.groupBy(entity, target).agg(F.avg(value).alias(value)).where(F.col(value).isNotNull())
    if not order:
        raise ValueError("how='first' needs an explicit order")
    rank = F.struct(*[F.col(c) for c in order])
    return df.where(F.col(value).isNotNull()).groupBy(entity, target).agg(F.min_by(value, rank).alias(value))


def modal_value(df: DataFrame, key: str, col: str) -> DataFrame:
    """Most frequent value per key, ties by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(col, F.struct(-F.col("n"), F.col(col))).alias(col), F.max("n").alias("n"))


def collect_ids(df: DataFrame, key: str, col: str, sep: str = ";", part_size: int = 10_000) -> DataFrame:
    """Distinct ids per key as delimited text.

    A key with more than ``part_size`` ids gets several rows (``part`` 0, 1, ...), so no list outgrows a task.
    """
    ids = df.select(key, F.col(col).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    ranked = row_numbers(ids, key, ["_id"])
    part = F.floor((F.col("rank") - 1) / part_size).cast("int")
    return ranked.groupBy(key, part.alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list("_id")), sep).alias("ids"), F.count(F.lit(1)).alias("n_ids")
    )


def first_attribute(df: DataFrame, key: str, col: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(col, F.struct(*[F.col(c) for c in order])).alias(col))


def variant_groups(df: DataFrame, key: str, col: str) -> DataFrame:
    """Keys that occur with more than one variant."""
    return df.groupBy(key).agg(F.countDistinct(col).alias("n_variants")).where("n_variants > 1")


def entity_code(df: DataFrame, key: str, name: str = "code") -> DataFrame:
    """Dense code 0, 1, ... of the distinct keys in sorted order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return row_numbers(keys, None, [key], name).withColumn(name, F.col(name) - 1)


def target_summary(labels: DataFrame, target: str = "target", label: str = "label") -> DataFrame:
    """Labelled, active and inactive counts per target and the active percentage (0 for an empty target)."""
    active, known = F.count_if(F.col(label) == 1), F.count(label)
    return labels.groupBy(target).agg(
        known.alias("n_total"),
        active.alias("n_active"),
        (known - active).alias("n_inactive"),
        F.when(known > 0, 100.0 * active / known).otherwise(F.lit(0.0)).alias("pct_active"),
    )


def matrix_profile(df: DataFrame, value: str = "value", entity: str = "entity", target: str = "target") -> DataFrame:
    """Shape, sparsity and moments of a long matrix."""
    shape = df.agg(
        F.countDistinct(entity).alias("n_entities"),
        F.countDistinct(target).alias("n_targets"),
        F.count(value).alias("n_cells"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    full = F.col("n_entities") * F.col("n_targets")
    return shape.withColumn("sparsity_pct", 100.0 * (1.0 - F.col("n_cells") / full))


def missing_by_target(df: DataFrame, entity: str = "entity", target: str = "target", value: str = "value") -> DataFrame:
    """Filled and missing cells per target against all entities of the table."""
    n_entities = df.agg(F.countDistinct(entity).alias("n")).scalar()
    filled = df.groupBy(target).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(entity))).alias("n_filled"))
    return filled.withColumn("n_missing", n_entities - F.col("n_filled")).withColumn(
        "pct_missing", 100.0 * F.col("n_missing") / n_entities
    )

"""Ordered aggregates per group without ever placing a whole group in one task.

A window partitioned by target sorts one target in one task, and a single target may hold a third of all
rows.  Everything here therefore works on *points* (one row per group and distinct value, pre-aggregated
map-side), cut into chunks that are contiguous in the sort order:

* Spark's range partitioner balances the chunks whatever the group sizes are;
* windows run inside ``(group, chunk)``;
* chunk totals, a small table, give the offsets that make the local sums global.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerflow.functions.columns import as_col, finite
from titerflow.session import materialize, shuffle_partitions

CHUNK = "_chunk"


def _keys(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _within(by: list[str], *extra: str):
    cols = [*by, *extra]
    return Window.partitionBy(*cols) if cols else Window.partitionBy(F.lit(0))


def range_chunks(points: DataFrame, by: list[str], order: Sequence[Column], chunks: int | None = None) -> DataFrame:
    """Tag rows with the id of their range partition over (by, order)."""
    n = chunks or shuffle_partitions(points.sparkSession)
    return points.repartitionByRange(n, *[F.col(b) for b in by], *order).withColumn(CHUNK, F.spark_partition_id())


def value_points(df: DataFrame, by, value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per group and distinct non-missing value, with ``n`` rows and further sums."""
    by = _keys(by)
    clean = finite(value) if dict(df.dtypes)[value] in ("double", "float") else F.col(value)
    kept = df.where(clean.isNotNull())
    aggs = [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    return kept.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *aggs)


def running_totals(
    points: DataFrame,
    by,
    order: Sequence[Column | str],
    sums: Sequence[str],
    *,
    chunk: Column | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Add ``cum_<s>`` (up to and including the row) and ``tot_<s>`` (whole group) for each sum.

    ``order`` must identify a row within its group.  Pass ``chunk`` when a monotone, data-independent
    chunk key exists (a hash prefix, say); otherwise the rows are range-partitioned and
    materialized, because the offsets and the local sums must see the same cuts.
    """
    by = _keys(by)
    order = [as_col(o) for o in order]
    if chunk is None:
        keyed = materialize(range_chunks(points, by, order, chunks))
    else:
        keyed = points.withColumn(CHUNK, chunk)
    before = _within(by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = _within(by)
    per_chunk = keyed.groupBy(*by, CHUNK).agg(*[F.sum(s).alias(f"_part_{s}") for s in sums])
    offsets = per_chunk.select(
        *by,
        CHUNK,
        *[F.coalesce(F.sum(f"_part_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_part_{s}").over(whole).alias(f"tot_{s}") for s in sums],
    )
    local = _within(by, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.withColumns({f"cum_{s}": F.sum(s).over(local) for s in sums})
    # null-safe: rows of a NULL group are a group like any other
    keys = [*by, CHUNK]
    offsets = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    joined = summed.join(offsets, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]))
    return joined.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_before_{s}") for s in sums}).drop(
        CHUNK, *[f"_before_{s}" for s in sums], *[f"_of_{k}" for k in keys]
    )


def row_numbers(df: DataFrame, by, order, name: str = "rank", size: str | None = None, **kw) -> DataFrame:
    """``row_number`` that scales with the group, optionally with the group size."""
    out = running_totals(df.withColumn("_one", F.lit(1)), by, order, ["_one"], **kw)
    out = out.withColumn(name, F.col("cum__one").cast("bigint"))
    if size:
        out = out.withColumn(size, F.col("tot__one").cast("bigint"))
    return out.drop("_one", "cum__one", "tot__one")


def first_rows(df: DataFrame, by, order, n: int, name: str) -> DataFrame:
    """The first ``n`` rows per group, with their number.

    Spark trims each task to ``n`` rows before the shuffle as long as n is below its window limit (1,000);
    from there on rows are numbered over range partitions, so no group is sorted in one task either way.
    """
    if n < 1000:
        numbered = df.withColumn(name, F.row_number().over(_within(_keys(by)).orderBy(*order)))
    else:
        numbered = row_numbers(df, by, list(order), name)
    return numbered.where(F.col(name) <= n)


def hash_rank(df: DataFrame, by, key: str, name: str = "rank", size: str | None = None, digits: int | None = None) -> DataFrame:
    """``row_number`` in the order of a hex hash column; its leading digits are the chunks.

    By default there are at least as many chunks as shuffle partitions, so a hot group fills the cluster.
    """
    digits = digits or max(2, math.ceil(math.log(shuffle_partitions(df.sparkSession), 16)))
    return row_numbers(df, by, [key], name, size, chunk=F.substring(key, 1, digits))


def ranked_points(df: DataFrame, by, value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values with ``n``, the further sums, ``avg_rank`` (ties share their mean rank) and ``tot_n``."""
    points = running_totals(value_points(df, by, value, sums), by, [value], ["n"])
    return points.withColumn("avg_rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0)


def avg_rank(df: DataFrame, value: str, by=None, name: str = "avg_rank") -> DataFrame:
    """Rows with the mean rank of their value inside the group (missing values get NULL)."""
    from titerflow.operators.joins import attach

    by = _keys(by)
    ranks = ranked_points(df, by, value).select(*by, value, F.col("avg_rank").alias(name))
    return attach(df, ranks, [*by, value])


def group_quantiles(df: DataFrame, by, value: str, probs: dict[str, float], keep_next: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    Also returns ``n``, ``lo`` and ``hi`` (smallest and largest value).  With ``keep_next`` every quantile
    ``q`` gets ``q_above``: the smallest value strictly above it.
    """
    by = _keys(by)
    pts = running_totals(value_points(df, by, value), by, [value], ["n"])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    aggs = [F.max("tot_n").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")]
    for name, q in probs.items():
        at = (F.col("tot_n") - 1) * F.lit(float(q))
        below, above = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((first <= below) & (last >= below), F.col(value))).alias(f"_{name}_a"),
            F.max(F.when((first <= above) & (last >= above), F.col(value))).alias(f"_{name}_b"),
            F.min(F.when(first > above, F.col(value))).alias(f"_{name}_c"),
        ]
    wide = pts.groupBy(*by).agg(*aggs)
    out = [*by, F.col("n").cast("bigint").alias("n"), "lo", "hi"]
    for name, q in probs.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        quantile = a + (b - a) * (at - F.floor(at))
        out.append(quantile.alias(name))
        if keep_next:
            out.append(F.when(b > quantile, b).otherwise(F.col(f"_{name}_c")).alias(f"{name}_above"))
    return wide.select(*out)


def roc_points(df: DataFrame, by, label: str, score: str) -> DataFrame:
    """Per group and distinct score, from the highest down: ``tp, fp`` so far, ``pos, neg`` in all, tpr and fpr."""
    by = _keys(by)
    pts = value_points(df.where(F.col(label).isNotNull()), by, score, {"hits": F.col(label)})
    run = running_totals(pts, by, [F.col(score).desc()], ["hits", "n"])
    tp, pos = F.col("cum_hits"), F.col("tot_hits")
    fp, neg = F.col("cum_n") - tp, F.col("tot_n") - pos
    return run.select(
        *by,
        score,
        tp.alias("tp"),
        fp.alias("fp"),
        pos.alias("pos"),
        neg.alias("neg"),
        F.col("hits"),
        F.col("n"),
        F.when(pos > 0, tp / pos).alias("tpr"),
        F.when(neg > 0, fp / neg).alias("fpr"),
    )


def spearman(df: DataFrame, x: str, y: str, by=None, name: str = "spearman") -> DataFrame:
    """Rank correlation per group, with ``n``.  Works on distinct (x, y) pairs with their counts."""
    by = _keys(by)
    # read once per ranking and once for the sums
    pairs = materialize(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, x, y)
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    for col, rank in ((x, "_rx"), (y, "_ry")):
        pts = pairs.groupBy(*by, col).agg(F.sum("_w").alias("n"))
        ranks = running_totals(pts, by, [col], ["n"]).select(
            *by, col, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias(rank)
        )
        from titerflow.operators.joins import attach

        pairs = attach(pairs, ranks, [*by, col], how="inner")
    return weighted_corr(pairs, "_rx", "_ry", "_w", by, name)


def weighted_corr(df: DataFrame, x: str, y: str, w: str, by: list[str], name: str) -> DataFrame:
    """Pearson correlation of weighted rows."""
    wx, wy, weight = F.col(x).cast("double"), F.col(y).cast("double"), F.col(w).cast("double")
    sums = df.groupBy(*by).agg(
        F.sum(weight).alias("n"),
        F.sum(weight * wx).alias("sx"),
        F.sum(weight * wy).alias("sy"),
        F.sum(weight * wx * wx).alias("sxx"),
        F.sum(weight * wy * wy).alias("syy"),
        F.sum(weight * wx * wy).alias("sxy"),
    )
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    return sums.select(
        *by,
        n.cast("bigint").alias("n"),
        F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy)).alias(name),
    )

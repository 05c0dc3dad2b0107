"""Reproducible train/test splits.

Shuffles are replaced by the md5 order of (seed, entity): the same rows give the same split whatever the
partitioning.  Hash digits are uniform, so they also serve as evenly filled chunks for exact ranks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerflow.functions.columns import hash_key
from titerflow.operators.joins import attach
from titerflow.operators.ordering import _keys, _within, hash_rank, running_totals

TEST = "test"
TRAIN = "train"


def _side(is_test: Column) -> Column:
    return F.when(is_test, TEST).otherwise(TRAIN)


def random_split(
    df: DataFrame, frac: float = 0.2, seed: int = 42, entity: str = "entity", by=None, stratify: str | None = None,
    min_per_class: int = 2, exact: bool = True,
) -> DataFrame:
    """Add ``side``: the first ``ceil(frac * n)`` entities in hash order are the test rows.

    ``by`` splits each group on its own; a NULL group is a group, rows without a class are a class.  With ``stratify`` every class is cut separately, unless a group
    has a class with fewer than ``min_per_class`` rows; such a group is split as a whole.
    ``exact=False`` compares the hash with ``frac`` directly: no shuffle, the share is only approximate.
    """
    by = _keys(by)
    keyed = df.withColumn("_h", hash_key(seed, *by, entity))
    if not exact:
        limit = f"{int(frac * 16**8):08x}"
        return keyed.withColumn("side", _side(F.substring("_h", 1, 8) < limit)).drop("_h")
    groups = list(by)
    if stratify:
        known = df.where(F.col(stratify).isNotNull())
        smallest = known.groupBy(*by, stratify).agg(F.count(F.lit(1)).alias("_c")).groupBy(*by).agg(
            F.min("_c").alias("_smallest")
        )
        if by:
            keyed = attach(keyed, smallest, by, "left", null_safe=True)
        else:
            keyed = keyed.withColumn("_smallest", smallest.scalar())
        keyed = keyed.withColumn(
            "_stratum", F.when(F.col("_smallest") >= min_per_class, F.col(stratify).cast("string")).otherwise(F.lit("all"))
        )
        groups.append("_stratum")
    ranked = hash_rank(keyed, groups, "_h", "_rank", "_size")
    out = ranked.withColumn("side", _side(F.col("_rank") <= F.ceil(F.lit(frac) * F.col("_size"))))
    return out.drop("_h", "_rank", "_size", "_smallest", "_stratum")


def repeated_split(df: DataFrame, seeds: list[int], **kw) -> DataFrame:
    """One random split per seed, stacked with a ``seed`` column."""
    out = None
    for seed in seeds:
        part = random_split(df, seed=seed, **kw).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out


def kfold(df: DataFrame, k: int = 5, seed: int = 42, entity: str = "entity", by=None) -> DataFrame:
    """Add ``fold`` 1..k over the hash order; fold sizes differ by at most one, larger folds first."""
    by = _keys(by)
    ranked = hash_rank(df.withColumn("_h", hash_key(seed, *by, entity)), by, "_h", "_rank", "_size")
    base, extra = F.floor(F.col("_size") / k), F.col("_size") % k
    head = extra * (base + 1)
    pos = F.col("_rank") - 1
    fold = F.when(pos < head, F.floor(pos / (base + 1))).otherwise(extra + F.floor((pos - head) / F.greatest(base, F.lit(1))))
    return ranked.withColumn("fold", (fold + 1).cast("int")).drop("_h", "_rank", "_size")


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def group_cumsum(sizes: DataFrame, group: str) -> DataFrame:
    """Rows in the groups that come before, largest group first, ties by name."""
    order = [F.col("size").desc(), F.col(group)]
    return running_totals(sizes, None, order, ["size"]).select(
        group, "size", (F.col("cum_size") - F.col("size")).alias("before"), F.col("tot_size").alias("total")
    )


def group_split(
    df: DataFrame, group: str, frac: float = 0.2, entity: str = "entity", unmatched: str = "group",
    test_name: str | None = None,
) -> DataFrame:
    """Whole groups to one side: the largest groups fill the test side until it holds ``int(frac * n)`` rows.

    One very large group overshoots the share; that is part of the rule, see ``split_audit``.
    ``unmatched`` says what happens to rows without a group: one shared ``group``, all ``train``, or
    ``half`` and half.
    """
    filled, loose = _separate(df, group, unmatched)
    order = group_cumsum(group_sizes(filled, group), group)
    sides = order.select(group, _side(F.col("before") < F.floor(F.col("total") * F.lit(frac))).alias("side"))
    return _rejoin(filled, sides, loose, group, entity)


def group_sample_split(
    df: DataFrame, group: str, frac: float = 0.2, seed: int = 42, rounding: str = "int", entity: str = "entity",
    unmatched: str = "group",
) -> DataFrame:
    """A random share of the groups is the test side: ``int`` gives max(1, int(frac * g)), ``ceil`` rounds up."""
    filled, loose = _separate(df, group, unmatched)
    names = filled.select(group).distinct().withColumn("_h", hash_key(seed, group))
    ranked = hash_rank(names, None, "_h", "_rank", "_size")
    share = F.lit(frac) * F.col("_size")
    take = F.greatest(F.lit(1), F.floor(share)) if rounding == "int" else F.ceil(share)
    sides = ranked.select(group, _side(F.col("_rank") <= take).alias("side"))
    return _rejoin(filled, sides, loose, group, entity)


def _separate(df: DataFrame, group: str, unmatched: str) -> tuple[DataFrame, DataFrame | None]:
    if unmatched == "group":
        return df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("NONE"))), None
    if unmatched not in ("train", "half"):
        raise ValueError(f"unknown rule {unmatched!r} for rows without a group")
    loose = df.where(F.col(group).isNull()).withColumn("_rule", F.lit(unmatched))
    return df.where(F.col(group).isNotNull()), loose


def _rejoin(filled: DataFrame, sides: DataFrame, loose: DataFrame | None, group: str, entity: str) -> DataFrame:
    # a group may hold a large share of the rows: salt by entity
    out = attach(filled, sides, group, "inner")
    if loose is None:
        return out
    ranked = hash_rank(loose.withColumn("_h", hash_key("loose", entity)), None, "_h", "_rank", "_size")
    half = (F.col("_rule") == "half") & (F.col("_rank") > F.floor(F.col("_size") / 2))
    return out.unionByName(ranked.withColumn("side", _side(half)).select(*out.columns))


def split_audit(df: DataFrame, group: str, label: str | None = None) -> DataFrame:
    """One row: groups on both sides, rows per side, real test share and positive share per side."""
    per_group = df.groupBy(group).agg(
        F.countDistinct("side").alias("sides"),
        F.count_if(F.col("side") == TEST).alias("n_test"),
        F.count_if(F.col("side") == TRAIN).alias("n_train"),
        *(
            [
                F.count_if((F.col("side") == TEST) & (F.col(label) == 1)).alias("p_test"),
                F.count_if((F.col("side") == TRAIN) & (F.col(label) == 1)).alias("p_train"),
            ]
            if label
            else []
        ),
    )
    test, train = F.sum("n_test"), F.sum("n_train")
    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("sides") > 1).alias("n_leaking"),
        test.alias("n_test"),
        train.alias("n_train"),
        (test / (test + train)).alias("test_share"),
        *(
            [(F.sum("p_test") / test).alias("positive_test"), (F.sum("p_train") / train).alias("positive_train")]
            if label
            else []
        ),
    )

"""Streaming forms: a per-group admission counter and stateless scoring."""
from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from titerflow.functions.columns import binary_label
from titerflow.operators.joins import attach
from titerflow.session import materialize
from titerflow.sources.tables import path_exists


def stream_diversity_cap(
    stream: DataFrame, group: str, score: str = "score", minscore: float = 0.4, cap: int = 25, order: str = "arrival"
) -> DataFrame:
    """Keep the score of the first ``cap`` good rows per group, give later good rows 0.

    The state is one counter per group.  Rows below ``minscore`` never enter the grouping: they keep their
    score and pass by, so a hot group shuffles only rows that can still be admitted or zeroed.  Rows of one
    micro-batch are admitted in ``order``.
    """
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in stream.columns) + ", capped_score double"

    def admit(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        # only the rows that can still be admitted are held; everything later in the order gets 0 at once
        best = None
        for rows in batches:
            rows = rows.assign(capped_score=0.0)
            pool = rows if best is None else pd.concat([best, rows])
            pool = pool.sort_values(order, kind="stable")
            best, rest = pool.iloc[: cap - used], pool.iloc[cap - used :]
            if len(rest):
                yield rest
        if best is not None and len(best):
            yield best.assign(capped_score=best[score].astype(float))
            used += len(best)
        state.update((used,))

    good = stream.where(F.col(score) >= minscore)
    low = stream.where(F.coalesce(F.col(score) < minscore, F.lit(True))).withColumn(
        "capped_score", F.col(score).cast("double")
    )
    capped = good.groupBy(group).applyInPandasWithState(
        admit, schema, "used int", "append", GroupStateTimeout.NoTimeout
    )
    return capped.unionByName(low)


#: Good rows of a group that one task numbers, about; batches after which all counters are written together.
SHARE, COMPACT = 100_000, 50


def admit_batch(
    batch: DataFrame, used: DataFrame, group: str, order: list[str], score: str = "score", minscore: float = 0.4, cap: int = 25, share: int = SHARE
) -> tuple[DataFrame, DataFrame]:
    """One batch against the counters ``used`` (group, used): its rows with ``capped_score``, and the new counters of its
    groups.

    Admission has two levels.  A group's good rows are dealt to shares of about ``share`` rows and numbered in
    ``order`` inside each; only the first ``cap`` of every share are then numbered over the group.  No task sees a
    whole group.  Rows below ``minscore`` keep their score and are not grouped; a null score stays null; rows with a
    null group share one counter.  Ties in ``order`` go by the hash of the whole row.
    """
    columns = batch.columns
    good = F.coalesce(F.col(score) >= minscore, F.lit(False))
    rows = materialize(batch.select(*columns, good.alias("_good"), F.xxhash64(*columns).alias("_tie")))
    taken = rows.where("_good")
    sizes = taken.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_shares"))
    left = attach(sizes, used, group, "left", null_safe=True).select(group, "_shares", (F.lit(cap) - F.coalesce("used", F.lit(0))).alias("_left"))
    first = [*map(F.col, order), F.col("_tie")]
    dealt = attach(taken, left, group, "inner", null_safe=True).withColumn("_share", F.pmod(F.col("_tie"), F.col("_shares")))
    dealt = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_share").orderBy(*first)))
    heads, over = dealt.where(F.col("_n") <= F.col("_left")), dealt.where(F.col("_n") > F.col("_left"))
    heads = heads.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*first)))
    kept = F.when(F.col("_n") <= F.col("_left"), F.col(score).cast("double")).otherwise(0.0)
    done = heads.select(*columns, kept.alias("capped_score")).unionByName(over.select(*columns, F.lit(0.0).alias("capped_score")))
    low = rows.where("not _good").select(*columns, F.col(score).cast("double").alias("capped_score"))
    counts = taken.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    now = attach(counts, used, group, "left", null_safe=True).select(group, F.least(F.lit(cap), F.coalesce("used", F.lit(0)) + F.col("_rows")).cast("bigint").alias("used"))
    return done.unionByName(low), now


def _counters(spark: SparkSession, path: str, before: int, group: str, kind: str) -> DataFrame:
    """The counters as of the batch ``before``: the largest per group since the last batch that wrote all of them."""
    start = (before - 1) // COMPACT * COMPACT
    schema = f"`{group}` {kind}, used bigint"
    places = [p for p in (os.path.join(path, f"batch={b}") for b in range(max(start, 0), before)) if path_exists(spark, p)]
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*places).groupBy(group).agg(F.max("used").alias("used"))


def cap_stream(
    stream: DataFrame, out: str, state: str, group: str, order: list[str], score: str = "score", minscore: float = 0.4, cap: int = 25, share: int = SHARE, **trigger,
) -> StreamingQuery:
    """``stream_diversity_cap`` without state in tasks: every micro-batch goes through ``admit_batch``.

    A batch reads the counters that earlier batches wrote below ``state``, writes its rows below ``out`` and its counters,
    each to a folder of its own number.  A batch that is replayed reads the same counters and overwrites its folders,
    so it comes out the same.  Every ``COMPACT``-th batch writes all counters.
    """
    kind = dict(stream.dtypes)[group]
    place = os.path.join(state, "used")

    def admit(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        used = materialize(_counters(own, place, number, group, kind))
        rows, now = admit_batch(batch, used, group, order, score, minscore, cap, share)
        if number % COMPACT == 0:
            now = now.unionByName(used).groupBy(group).agg(F.max("used").alias("used"))
        rows.write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))
        now.write.mode("overwrite").parquet(os.path.join(place, f"batch={number}"))

    writer = stream.writeStream.foreachBatch(admit).option("checkpointLocation", os.path.join(state, "progress"))
    return (writer.trigger(**trigger) if trigger else writer).start()


def stream_labels(stream: DataFrame, thresholds: DataFrame, op: str = ">", value: str = "value", target: str = "target") -> DataFrame:
    """Label a stream with a static threshold table."""
    joined = stream.join(thresholds.select(target, "threshold"), target, "inner")
    return joined.withColumn("label", binary_label(value, F.col("threshold"), op))

"""Streaming queries: the event table replayed as a file stream until it is drained."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.bindings import table
from checks.q_models import LOGIT, rows
from checks.registry import query, shaped
from titerflow.models.bundles import make_bundle, save_bundle, score_stream
from titerflow.models.linear import fit_linear
from titerflow.operators.cutoffs import median_cutoff
from titerflow.session import materialize, temp_table_path
from titerflow.streaming.diversity import cap_stream, stream_diversity_cap, stream_labels


def replay(spark, sf):
    """Events as several parquet files in arrival order, read back as a stream of one file per batch."""
    path = temp_table_path(spark, f"events-{uuid.uuid4().hex}")
    events = table(spark, sf, "events")
    events.repartitionByRange(4, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream):
    out = temp_table_path(spark, f"out-{uuid.uuid4().hex}")
    run = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(out)


@query("stream_diversity_cap", """
SELECT event_type, count(*) AS n, least(100, count(*) FILTER (value / 100.0 >= 0.4)) AS n_admitted,
       greatest(0, count(*) FILTER (value / 100.0 >= 0.4) - 100) AS n_over FROM events GROUP BY 1""")
def _(spark, sf):
    stream = replay(spark, sf).select("event_id", "event_type", (F.col("value") / 100.0).alias("score"))
    got = drain(spark, stream_diversity_cap(stream, "event_type", cap=100, order="event_id"))
    return got.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("score") >= 0.4) & (F.col("capped_score") > 0)).alias("n_admitted"),
        F.count_if((F.col("score") >= 0.4) & (F.col("capped_score") == 0)).alias("n_over"),
    )


@query("stream_diversity_cap_rows", """
SELECT event_id, event_type, score, CASE WHEN score >= 0.4 AND rk > 100 THEN 0 ELSE score END AS capped_score FROM (
  SELECT event_id, event_type, round(value / 100.0, 6) AS score, row_number() OVER (PARTITION BY event_type, value / 100.0 >= 0.4 ORDER BY event_id % 4, event_id) AS rk FROM events)""")
def _(spark, sf):
    """A quarter of the events at a time, each one micro-batch; the cap counts over all of them."""
    place = {k: temp_table_path(spark, f"{k}-{uuid.uuid4().hex}") for k in ("in", "out", "state")}
    events = table(spark, sf, "events").select("event_id", "event_type", (F.col("value") / 100.0).alias("score"))
    for part in range(4):
        events.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(place["in"])
        stream = spark.readStream.schema(events.schema).parquet(place["in"])
        cap_stream(stream, place["out"], place["state"], "event_type", ["event_id"], cap=100, share=2_000, availableNow=True).awaitTermination()
    return shaped(spark.read.parquet(place["out"]), "event_id", "event_type", score="num", capped_score="num")


@query("stream_labels", """
WITH cut AS (SELECT event_type, quantile_cont(value, 0.5) AS threshold FROM events GROUP BY 1)
SELECT event_type AS target, count(*) AS n, CAST(sum(CAST(value > threshold AS INT)) AS BIGINT) AS n_active FROM events JOIN cut USING (event_type) GROUP BY 1""")
def _(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("event_type", "target")
    cut = median_cutoff(events)
    stream = replay(spark, sf).withColumnRenamed("event_type", "target")
    got = drain(spark, stream_labels(stream, cut))
    return got.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_active"))


@query("stream_scores", f"SELECT target, entity, p, CAST(p >= 0.5 AS INT) AS predicted, CAST(1 + CAST(entity % 4 >= 2 AS INT) AS INT) AS version FROM ({LOGIT})")
def _(spark, sf):
    """Four files of vectors, one per micro-batch; the bundle's second version is saved between the two halves."""
    place = {k: temp_table_path(spark, f"{k}-{uuid.uuid4().hex}") for k in ("in", "models", "out", "state")}
    every = rows(spark, sf)
    settings = {"source": "embedding", "width": 64}
    fitted = materialize(fit_linear(every, "logit", strategy="class_weight"))
    for half in (0, 2):
        save_bundle(make_bundle(fitted, features=settings), place["models"], "logit")
        for part in (half, half + 1):
            every.where(F.col("entity") % 4 == part).coalesce(1).write.mode("append").parquet(place["in"])
        stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(place["in"])
        score_stream(stream, place["models"], "logit", place["out"], place["state"], settings, availableNow=True).awaitTermination()
    return shaped(spark.read.parquet(place["out"]), "target", "entity", "predicted", "version", p="num")

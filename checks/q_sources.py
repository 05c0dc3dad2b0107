"""Source and sink queries: each writes tables Spark derives from the inputs and reads them back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.bindings import ASSAY, METRICS, assay, cells, metrics, table, with_cte
from checks.registry import query, r, shaped
from titerflow.operators import metrics as M
from titerflow.operators.features import hash_features
from titerflow.session import temp_table_path
from titerflow.sources import tables as S

A = with_cte(ASSAY)


def fresh(spark, name):
    return temp_table_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("read_measurements", A + "SELECT target, count(*) AS n, count(DISTINCT entity) AS n_entities, max(raw_value) AS top FROM assay GROUP BY target")
def _(spark, sf):
    path = fresh(spark, "measurements")
    named = assay(spark, sf).select(F.col("entity").alias("Entity Id"), F.col("target").alias("Target"), F.col("raw_value").alias("RAW value"), "line")
    named.write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("entityid", T.LongType()), T.StructField("target", T.StringType()), T.StructField("rawvalue", T.StringType())])
    rows = S.read_measurements(spark, path, schema)
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entityid").alias("n_entities"), F.max("rawvalue").alias("top"))


@query("matrix_round_trip", A + "SELECT entity, target, value FROM cells")
def _(spark, sf):
    path = fresh(spark, "matrix")
    dims = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))
    S.export_matrix(cells(spark, sf), dims).write.parquet(path)
    return S.melt_matrix(spark.read.parquet(path), ["entity"], drop=("name",))


NATIONS = [f"NATION_{k}" for k in range(25)]


@query("export_matrix", A + "SELECT entity, p_name AS name, "
       + ", ".join(f"max(value) FILTER (target = '{n}') AS {n}" for n in NATIONS)
       + " FROM cells LEFT JOIN part ON entity = p_partkey GROUP BY ALL")
def _(spark, sf):
    dims = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))
    return S.export_matrix(cells(spark, sf), dims, targets=NATIONS)


RESULTS = """
c AS (SELECT model, target, count(*) FILTER (metric > 10 AND event_id % 2 = 1) AS tp, count(*) FILTER (metric <= 10 AND event_id % 2 = 0) AS tn FROM metrics GROUP BY ALL)"""


@query("append_results", with_cte(METRICS) + "," + RESULTS + "SELECT model, CAST(target AS VARCHAR) AS target, tp, tn FROM c")
def _(spark, sf):
    path = fresh(spark, "results")
    rows = metrics(spark, sf).withColumns({"label": (F.col("event_id") % 2).cast("int"), "predicted": (F.col("metric") > 10).cast("int")})
    for part in ("model < 'e'", "model >= 'e'"):
        S.append_results(M.confusion_metrics(rows.where(part), ["model", "target"]), path)
    return spark.read.parquet(path).select("model", "target", "tp", "tn")


@query("read_parts", with_cte(METRICS) + "SELECT model, count(*) AS n, count(CASE WHEN event_id % 2 = 0 THEN fold END) AS n_fold FROM metrics GROUP BY model")
def _(spark, sf):
    path = fresh(spark, "parts")
    m = metrics(spark, sf)
    m.where("event_id % 2 = 0").select("model", "fold").write.parquet(f"{path}/part=1")
    m.where("event_id % 2 = 1").select("model").write.parquet(f"{path}/part=2")
    m.where("false").select("model").write.parquet(f"{path}/part=3")
    return S.read_parts(spark, f"{path}/part=*").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("fold").alias("n_fold"))


@query("cached_features", "SELECT count(*) AS n_first, count(*) AS n_all, count(DISTINCT doc_id) AS n_distinct FROM documents WHERE length(text) >= 0")
def _(spark, sf):
    path = fresh(spark, "features")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("entity"), "text")
    compute = lambda rows: hash_features(rows, "text", size=256).select("entity", "bits")
    S.cached_features(docs.where("entity % 2 = 0"), path, compute)
    S.cached_features(docs, path, compute)
    got = S.cached_features(docs, path, compute)
    stored = spark.read.parquet(path)
    return got.agg(F.count(F.lit(1)).alias("n_all"), F.countDistinct("entity").alias("n_distinct")).withColumn(
        "n_first", stored.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("cached_features_change", """
WITH t AS (SELECT doc_id AS entity, CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' changed' ELSE text END AS text FROM documents WHERE text IS NOT NULL)
SELECT entity, length(text) AS n, 128 AS size, (SELECT 2 * count(*) + count(*) FILTER (doc_id % 10 = 0) FROM documents WHERE text IS NOT NULL) AS n_stored FROM t""")
def _(spark, sf):
    path = fresh(spark, "features")
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("entity"), "text")
    changed = docs.withColumn("text", F.when(F.col("entity") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))

    def features(rows, size):
        made = lambda new: new.select("entity", F.length("text").cast("bigint").alias("n"), F.lit(size).alias("size"))
        return S.cached_features(rows, path, made, parameters={"size": size})

    for rows, size in ((docs, 256), (docs, 256), (docs, 128), (changed, 128)):  # all, nothing, all, and the changed tenth are computed
        got = features(rows, size)
    return got.withColumn("n_stored", spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).scalar())


@query("cache_gap", """
SELECT doc_id AS entity, 'missing' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
SELECT doc_id, 'stale' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("entity"))
    return S.cache_gap(ids, table(spark, sf, "labels").select(F.col("doc_id").alias("entity")))


SUMMARY = """
kv AS (SELECT 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM events UNION ALL
       SELECT 'mean 10% level', CAST(CAST(sum(value > 10) AS BIGINT) AS VARCHAR) FROM events UNION ALL
       SELECT 'mean 50% level', CAST(CAST(sum(value > 50) AS BIGINT) AS VARCHAR) FROM events)"""


def _summary(spark, sf):
    e = table(spark, sf, "events")
    return S.to_metric_value(e.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value") > 10).alias("mean 10% level"),
                                   F.count_if(F.col("value") > 50).alias("mean 50% level")))


@query("to_metric_value", "WITH " + SUMMARY.strip() + "SELECT metric, value FROM kv")
def _(spark, sf):
    return _summary(spark, sf)


@query("parse_summary", "WITH " + SUMMARY.strip() + """
SELECT metric, CAST(regexp_extract(metric, '([0-9]+)%', 1) AS BIGINT) AS pct, CAST(value AS DOUBLE) AS number FROM kv WHERE metric LIKE '%!%%' ESCAPE '!'""")
def _(spark, sf):
    return shaped(S.parse_summary(_summary(spark, sf)), "metric", "number", pct="int")

"""Assay-shaped views of the driver tables, once in Spark and once as SQL text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerflow.functions.columns import hash_number
from titerflow.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- long assay table: part x nation, censored text values ------------------------------------------------

ASSAY = """
assay AS (
  SELECT l_partkey AS entity, n_name AS target,
         CASE WHEN l_discount >= 0.09 THEN '>' WHEN l_discount <= 0.01 THEN '<' ELSE '' END
           || CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) AS raw_value,
         l_orderkey AS alt_id, l_linenumber AS line, l_linestatus AS status
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
parsed AS (
  SELECT *, CASE WHEN raw_value[1] IN ('>', '<') THEN raw_value[1] ELSE '=' END AS flag,
         TRY_CAST(ltrim(raw_value, '<>') AS DOUBLE) AS value
  FROM assay
),
molar AS (
  SELECT *, -log10((CASE WHEN value / 1e9 <= 0 THEN (SELECT min(value / 1e9) FROM parsed WHERE value > 0)
                    ELSE value / 1e9 END)) AS p_value
  FROM parsed
),
cells AS (
  SELECT entity, target, round(avg(p_value), 9) AS value FROM molar WHERE p_value IS NOT NULL GROUP BY ALL
)"""


def assay(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_discount", "l_extendedprice", "l_linestatus"
    )
    nations = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "n_name")
    )
    mark = F.when(F.col("l_discount") >= 0.09, ">").when(F.col("l_discount") <= 0.01, "<").otherwise("")
    return items.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("entity"),
        F.col("n_name").alias("target"),
        F.concat(mark, F.round("l_extendedprice").cast("bigint").cast("string")).alias("raw_value"),
        F.col("l_orderkey").alias("alt_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_linestatus").alias("status"),
    )


def molar(spark, sf_dir) -> DataFrame:
    from titerflow.operators.cleaning import neg_log10_molar, parse_values

    return neg_log10_molar(parse_values(assay(spark, sf_dir)), "value")


def cells(spark, sf_dir) -> DataFrame:
    """Collapsed matrix; rounded so that equality-sensitive cutoffs agree between engines."""
    from titerflow.operators.cleaning import collapse

    means = collapse(molar(spark, sf_dir), value="p_value")
    return materialize(means.select("entity", "target", F.round("p_value", 9).alias("value")))


# --- response table: standardised price, two source versions, shared structure keys ------------------------

RESPONSE = """
priced AS (
  SELECT l_partkey, n_name AS target, l_extendedprice AS price, l_orderkey AS ord, l_linenumber AS line, l_linestatus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
moments AS (SELECT target, avg(price) AS m, stddev_samp(price) AS s FROM priced GROUP BY target),
response AS (
  SELECT p_type || '|' || p_brand || '|' || p_size AS skey, l_partkey AS entity, target,
         round((price - m) / s, 9) AS value,
         CASE WHEN l_linestatus = 'F' AND l_partkey % 3 <> 0 THEN 'V2' ELSE 'V1' END AS version, ord, line
  FROM priced JOIN moments USING (target) JOIN part ON l_partkey = p_partkey
),
grid AS (
  SELECT entity, target, value FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, target ORDER BY ord, line, value, version) AS rn FROM response)
  WHERE rn = 1
)"""


def response(spark, sf_dir) -> DataFrame:
    from titerflow.operators.joins import attach

    nations = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("target"))
    )
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_linestatus"
    )
    priced = items.join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    moments = priced.groupBy("target").agg(
        F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("s")
    )
    scored = attach(priced, moments, "target", "inner")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("|", "p_type", "p_brand", F.col("p_size").cast("string")).alias("skey")
    )
    in_v2 = (F.col("l_linestatus") == "F") & (F.col("l_partkey") % 3 != 0)
    return scored.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "skey",
        F.col("l_partkey").alias("entity"),
        "target",
        F.round((F.col("l_extendedprice") - F.col("m")) / F.col("s"), 9).alias("value"),
        F.when(in_v2, "V2").otherwise("V1").alias("version"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
    )


def grid(spark, sf_dir) -> DataFrame:
    from titerflow.operators.cleaning import collapse

    return materialize(collapse(response(spark, sf_dir), "first", order=["ord", "line", "value", "version"]))


# --- predictions: documents with labels, twelve model scores from hashes -----------------------------------

MODELS = 12

PREDICTIONS = f"""
base AS (
  SELECT documents.doc_id AS entity, source AS target, lang, quality AS label, n_chars / (n_chars + 4000.0) AS size_part
  FROM documents JOIN labels USING (doc_id)
),
scores AS (
  SELECT entity, target, lang, label, m AS model,
         round((0.7 * (CAST('0x' || substr(md5(concat_ws('|', 'm' || CAST(m AS VARCHAR), CAST(entity AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0)
               + 0.2 * label + 0.1 * size_part), 4) AS p
  FROM base CROSS JOIN range(0, {MODELS}) AS models(m)
),
scored AS (SELECT entity, target, lang, label, round(p, 2) AS p FROM scores WHERE model = 0)"""


def model_scores(spark, sf_dir, models: int = MODELS) -> DataFrame:
    """Long ``(entity, target, lang, label, model, p)`` with four-decimal scores."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id")
    noise = hash_number(F.md5(F.concat_ws("|", F.concat(F.lit("m"), F.col("model")), F.col("doc_id")))) / F.lit(
        4294967296.0
    )
    size_part = F.col("n_chars") / (F.col("n_chars") + F.lit(4000.0))
    return docs.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1)))).select(
        F.col("doc_id").alias("entity"),
        F.col("source").alias("target"),
        "lang",
        F.col("quality").alias("label"),
        "model",
        F.round(F.lit(0.7) * noise + F.lit(0.2) * F.col("quality") + F.lit(0.1) * size_part, 4).alias("p"),
    )


def scored(spark, sf_dir) -> DataFrame:
    """One model, two-decimal scores with many ties."""
    return model_scores(spark, sf_dir, 1).withColumn("p", F.round("p", 2)).drop("model")


# --- bits: sign bits of the embeddings ----------------------------------------------------------------------

BITS = """
bits AS (
  SELECT vec_id AS entity, label, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings
)"""


def bits(spark, sf_dir) -> DataFrame:
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.element_at("embedding", (i + 1).cast("int")) > 0)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity"), "label", on.alias("bits"))


# --- metrics: events as model results per target ------------------------------------------------------------

METRICS = """
metrics AS (
  SELECT event_type AS model, user_id AS target, value AS metric, event_id,
         CASE WHEN event_id % 4 = 0 THEN 'Train_Train' ELSE 'Train_Test' END AS split,
         CASE WHEN event_id % 3 = 0 THEN 'bits' ELSE 'counts' END AS features,
         event_id % 5 AS fold
  FROM events
)"""


def metrics(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.col("user_id").alias("target"),
        F.col("value").alias("metric"),
        "event_id",
        F.when(e % 4 == 0, "Train_Train").otherwise("Train_Test").alias("split"),
        F.when(e % 3 == 0, "bits").otherwise("counts").alias("features"),
        (e % 5).alias("fold"),
    )


def with_cte(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"

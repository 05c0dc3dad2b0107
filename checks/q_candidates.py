"""Candidate scoring queries and nested configurations."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import table, with_cte
from checks.registry import query, r, shaped
from titerflow.functions import columns as C
from titerflow.operators import candidates as K
from titerflow.sources import configs as G

COMPONENTS = [
    {"name": "price", "column": "p_retailprice", "kind": "sigmoid", "low": 900.0, "high": 1100.0, "k": 0.25, "weight": 5},
    {"name": "size", "column": "p_size", "kind": "reverse_sigmoid", "low": 10, "high": 40, "k": 0.25, "weight": 1},
    {"name": "range", "column": "p_size", "kind": "step", "low": 3, "high": 45, "weight": 1},
]
ALERTS = ["^red", "bolt$", "g[aeiou]ar", "small.*ring"]

SCORED = """
comp AS (SELECT p_partkey AS entity, p_name, p_brand, p_size, p_retailprice,
  1 / (1 + pow(10, 10 * 0.25 / (900.0 - 1100.0) * (p_retailprice - 1000.0))) AS s1,
  1 / (1 + pow(10, -10 * 0.25 / (10.0 - 40.0) * (p_size - 25.0))) AS s2,
  CASE WHEN p_size BETWEEN 3 AND 45 THEN 1.0 ELSE 0.0 END AS s3 FROM part),
scored AS (SELECT *, round(CASE WHEN s1 <= 0 OR s2 <= 0 OR s3 <= 0 THEN 0 ELSE exp((5 * ln(s1) + ln(s2) + ln(CASE WHEN s3 > 0 THEN s3 ELSE 1 END)) / 7) END, 6) AS score FROM comp)"""
W = "WITH " + SCORED.strip()


def candidates(spark, sf):
    rows = table(spark, sf, "part").withColumn("entity", F.col("p_partkey"))
    return K.total_score(K.score_components(rows, COMPONENTS), COMPONENTS).withColumn("score", F.round("score", 6))


@query("desirability", W + "SELECT entity, round(s1, 6) AS score_price, round(s2, 6) AS score_size, CAST(s3 AS DOUBLE) AS score_range FROM comp")
def _(spark, sf):
    return shaped(candidates(spark, sf), "entity", score_price="num", score_size="num", score_range="num")


@query("weighted_product", W + "SELECT entity, score + 0.0 AS score FROM scored")
def _(spark, sf):
    return candidates(spark, sf).select("entity", (F.col("score") + F.lit(0.0)).alias("score"))


HIT = "regexp_matches(p_name, '(?:^red)|(?:bolt$)|(?:g[aeiou]ar)|(?:small.*ring)')"


@query("alert_filter", W + f"SELECT entity, p_name FROM scored WHERE NOT {HIT}")
def _(spark, sf):
    return K.alert_filter(candidates(spark, sf), "p_name", ALERTS).select("entity", "p_name")


@query("alert_zeroes_score", W + f"SELECT entity, CASE WHEN {HIT} THEN 0.0 ELSE score END AS score FROM scored")
def _(spark, sf):
    return K.alert_filter(candidates(spark, sf), "p_name", ALERTS, "score").select("entity", "score")


@query("diversity_cap", W + """
SELECT entity, p_brand, CASE WHEN score >= 0.4 AND row_number() OVER (PARTITION BY p_brand, score >= 0.4 ORDER BY entity) > 10 THEN 0.0 ELSE score END AS capped_score FROM scored""")
def _(spark, sf):
    return K.diversity_cap(candidates(spark, sf), "p_brand", cap=10).select("entity", "p_brand", "capped_score")


@query("seed_memory", W + "SELECT p_name AS name, max(score) AS score FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    rows = candidates(spark, sf).withColumn("name", F.col("p_name"))
    return K.seed_memory(rows, 20, key="name").select("name", "score")


@query("stage_filter_report", W + f""",
f AS (SELECT CASE WHEN NOT score >= 0.3 THEN 0 WHEN NOT p_size <= 40 THEN 1 WHEN {HIT} THEN 2 ELSE 3 END AS reached FROM scored),
n AS (SELECT i AS stage_no, ['input', 'score', 'size', 'alerts'][i + 1] AS stage, (SELECT count(*) FROM f WHERE reached >= i) AS n FROM range(0, 4) AS t(i))
SELECT stage_no, stage, n, CASE WHEN lag(n) OVER (ORDER BY stage_no) > 0 THEN round(100.0 * (lag(n) OVER (ORDER BY stage_no) - n) / lag(n) OVER (ORDER BY stage_no), 6) END AS pct_removed FROM n""")
def _(spark, sf):
    stages = [("score", F.col("score") >= 0.3), ("size", F.col("p_size") <= 40), ("alerts", ~K.alert_flag("p_name", ALERTS))]
    return shaped(K.stage_report(candidates(spark, sf), stages), "stage", stage_no="int", n="int", pct_removed="num")


@query("flatten_components", """
SELECT event_id AS config, 'custom_product' AS scoring, 'value' AS component_type, event_type AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS weight,
       'sigmoid' AS kind, value AS low, value + 5 AS high, 0.25::DOUBLE AS k FROM events
UNION ALL
SELECT event_id, 'custom_product', 'custom_alerts', event_type || '_alerts', 1.0, 'none', NULL, NULL, NULL FROM events""")
def _(spark, sf):
    change = F.struct(F.col("value").alias("low"), (F.col("value") + 5).alias("high"), F.lit(0.25).alias("k"),
                      F.lit("sigmoid").alias("transformation_type"))
    main = F.to_json(F.struct(
        F.lit("value").alias("component_type"), F.col("event_type").alias("name"),
        F.get_json_object("props", "$.k").cast("double").alias("weight"),
        F.struct(change.alias("transformation")).alias("specific_parameters")))
    alerts = F.to_json(F.struct(
        F.lit("custom_alerts").alias("component_type"), F.concat("event_type", F.lit("_alerts")).alias("name"), F.lit(1.0).alias("weight"),
        F.struct(F.array(F.col("event_type")).alias("smiles")).alias("specific_parameters")))
    text = F.concat(F.lit('{"parameters": {"scoring_function": {"name": "custom_product", "parameters": ['), main, F.lit(","), alerts, F.lit("]}}}"))
    rows = table(spark, sf, "events").withColumn("doc", text)
    return G.flatten_components(G.parse_configs(rows, "doc", "event_id")).drop("position", "n_patterns")

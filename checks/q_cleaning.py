"""Cleaning, matrix and cutoff queries on the assay and response bindings."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import ASSAY, RESPONSE, assay, cells, grid, molar, response, table, with_cte
from checks.registry import query, r, shaped
from titerflow.functions import columns as C
from titerflow.operators import cleaning, cutoffs, joins, resolve
from titerflow.operators.ordering import avg_rank
from titerflow.plans.assay import summarise_assay
from titerflow.plans.response import summarise_response

A = with_cte(ASSAY)
R = with_cte(RESPONSE)

YOUDEN = """
med AS (SELECT target, count(*) AS n, quantile_cont(value, 0.5) AS median FROM cells GROUP BY target HAVING count(*) >= 10),
cut AS (
  SELECT med.target, any_value(n) AS n, any_value(median) AS median,
         coalesce(min(CASE WHEN value > median THEN value END), any_value(median)) AS threshold
  FROM med JOIN cells USING (target) GROUP BY med.target
)"""


@query("flagship_target_summary", A + "," + YOUDEN + """
SELECT target, count(value) AS n_total, count(*) FILTER (value > threshold) AS n_active,
       count(*) FILTER (value <= threshold) AS n_inactive, round(100.0 * count(*) FILTER (value > threshold) / count(*), 6) AS pct_active,
       round(any_value(threshold), 6) AS threshold
FROM cells JOIN cut USING (target) GROUP BY target""")
def _(spark, sf):
    return shaped(summarise_assay(assay(spark, sf)), "target", n_total="int", n_active="int", n_inactive="int",
                  pct_active="num", threshold="num")


@query("parse_censored", A + """
SELECT flag, count(*) AS n, count(value) AS n_valid, min(value) AS lo, max(value) AS hi, sum(value) AS total FROM parsed GROUP BY flag
""")
def _(spark, sf):
    return cleaning.parse_values(assay(spark, sf)).groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"), F.min("value").alias("lo"),
        F.max("value").alias("hi"), F.sum("value").alias("total"))


@query("neg_log10_molar", A + """
SELECT entity, target, alt_id, line, round(p_value, 6) + 0.0 AS p_value FROM molar""")
def _(spark, sf):
    return molar(spark, sf).select("entity", "target", "alt_id", "line", r("p_value").alias("p_value"))


@query("drop_invalid_text", """
SELECT doc_id, n_chars FROM documents WHERE NOT contains(text, '*')""")
def _(spark, sf):
    return cleaning.drop_invalid(table(spark, sf, "documents"), "text").select("doc_id", "n_chars")


@query("invalid_text_counts", """
SELECT count(*) FILTER (contains(text, '*')) AS n_wildcard, count(*) FILTER (text IS NULL) AS n_invalid,
       count(*) FILTER (NOT contains(text, '*')) AS n_kept FROM documents""")
def _(spark, sf):
    return cleaning.invalid_counts(table(spark, sf, "documents"), "text")


@query("key_block", """
SELECT split_part(replace(p_type, ' ', '-') || '-' || p_brand, '-', 1) AS block, count(*) AS n FROM part GROUP BY 1""")
def _(spark, sf):
    full = F.concat(F.regexp_replace("p_type", " ", "-"), F.lit("-"), F.col("p_brand"))
    return table(spark, sf, "part").groupBy(C.key_block(full).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("map_distinct", """
SELECT doc_id, md5(text) AS head FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    mapped = joins.map_distinct(docs, "text", F.md5, "head")
    return mapped.select("doc_id", "head")


@query("binarize_fixed", A + """
SELECT target, count(*) FILTER (value > 4.5) AS n_active, count(*) FILTER (value <= 4.5) AS n_inactive FROM cells GROUP BY target""")
def _(spark, sf):
    return cutoffs.binarize(cells(spark, sf), 4.5).groupBy("target").agg(
        F.count_if(F.col("label") == 1).alias("n_active"), F.count_if(F.col("label") == 0).alias("n_inactive"))


@query("binarize_by_target", A + "," + YOUDEN + """
SELECT entity, target, CAST(value > threshold AS BIGINT) AS label FROM cells JOIN cut USING (target)""")
def _(spark, sf):
    c = cells(spark, sf)
    return shaped(cutoffs.binarize(c, cutoffs.youden_cutoff(c)), "entity", "target", label="int")


@query("safe_id", """
SELECT DISTINCT regexp_replace(p_name || '_' || p_brand || '_' || p_type, '[^A-Za-z0-9_.-]', '_', 'g') AS model_id FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(C.safe_id("p_name", "p_brand", "p_type").alias("model_id")).distinct()


@query("lookup_missing_null", A + """
SELECT target, p_name AS name, count(*) AS n FROM cells LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON entity = p_partkey GROUP BY ALL""")
def _(spark, sf):
    dim = table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))
    return joins.lookup(cells(spark, sf), dim, "entity").groupBy("target", "name").agg(F.count(F.lit(1)).alias("n"))


@query("align_features_labels", A + """
SELECT entity, target, value, p_size AS size FROM cells JOIN part ON entity = p_partkey""")
def _(spark, sf):
    feats = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_size").alias("size"))
    return shaped(joins.align(feats, cells(spark, sf)), "entity", "target", "size", "value")


@query("keep_in_set", A + """
SELECT target, count(*) AS n FROM cells WHERE entity IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4') GROUP BY target""")
def _(spark, sf):
    keys = table(spark, sf, "part").where("p_brand = 'Brand#4'").select(F.col("p_partkey").alias("entity"))
    return joins.keep_in(cells(spark, sf), keys, "entity").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("not_covered_cells", A + """
SELECT c.entity, c.target FROM cells c WHERE NOT EXISTS (
  SELECT 1 FROM assay a WHERE a.status = 'F' AND a.entity = c.entity AND a.target = c.target)""")
def _(spark, sf):
    covered = assay(spark, sf).where("status = 'F'").select("entity", "target")
    return joins.not_covered(cells(spark, sf), covered, ["entity", "target"]).select("entity", "target")


@query("in_all_groups", A + """
SELECT entity, count(DISTINCT status) AS n_groups FROM assay GROUP BY entity HAVING count(DISTINCT status) >= 2""")
def _(spark, sf):
    return joins.in_all(assay(spark, sf), "entity", "status", 2)


@query("join_thresholds", A + "," + YOUDEN + """
SELECT entity, target, value, round(threshold, 6) AS threshold FROM cells JOIN cut USING (target)""")
def _(spark, sf):
    c = cells(spark, sf)
    cut = cutoffs.youden_cutoff(c).select("target", "threshold")
    return shaped(joins.join_thresholds(c, cut), "entity", "target", "value", threshold="num")


@query("exact_dedup", A + """
SELECT target, count(*) AS n FROM (SELECT DISTINCT target, raw_value, entity FROM assay) GROUP BY target""")
def _(spark, sf):
    rows = assay(spark, sf).select("target", "raw_value", "entity")
    return cleaning.exact_dedup(rows, ["target", "raw_value", "entity"]).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("exact_dedup_first", A + """
SELECT entity, target, alt_id, line FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, target ORDER BY alt_id, line) AS rn FROM assay) WHERE rn = 1""")
def _(spark, sf):
    return cleaning.exact_dedup(assay(spark, sf), ["entity", "target"], ["alt_id", "line"]).select(
        "entity", "target", "alt_id", "line")


@query("dedup_removals", A + """
SELECT target, CAST(count(*) AS BIGINT) AS n_before, count(DISTINCT (entity, status)) AS n_after,
       count(*) - count(DISTINCT (entity, status)) AS n_removed FROM assay GROUP BY target""")
def _(spark, sf):
    return cleaning.dedup_removals(assay(spark, sf), ["target", "entity", "status"])


@query("unique_baseline", A + """
SELECT target, count(DISTINCT entity) AS n_unique, count(*) AS n_rows,
       round(count(*) / count(DISTINCT entity), 6) AS rows_per_entity FROM assay GROUP BY ROLLUP (target)""")
def _(spark, sf):
    return shaped(cleaning.unique_baseline(assay(spark, sf)), "target", n_unique="int", n_rows="int", rows_per_entity="num")


STAGES = """
stages AS (
  SELECT 'raw' AS stage, target, count(DISTINCT entity) AS n FROM assay GROUP BY ROLLUP (target)
  UNION ALL SELECT 'final_only', target, count(DISTINCT entity) FROM assay WHERE status = 'F' GROUP BY ROLLUP (target)
  UNION ALL SELECT 'late', target, count(DISTINCT entity) FROM assay WHERE status = 'F' AND line = 7 AND target < 'R' GROUP BY ROLLUP (target)
)"""


def _stages(spark, sf):
    a = assay(spark, sf)
    return joins.union_all(
        cleaning.stage_counts(a, "raw"),
        cleaning.stage_counts(a.where("status = 'F'"), "final_only"),
        cleaning.stage_counts(a.where("status = 'F' AND line = 7 AND target < 'R'"), "late"),
    )


@query("stage_counts", A + "," + STAGES + "SELECT stage, target, n FROM stages")
def _(spark, sf):
    return _stages(spark, sf)


@query("attrition_report", A + "," + STAGES + """,
names AS (SELECT DISTINCT coalesce(target, 'TOTAL') AS target FROM stages),
ord AS (SELECT * FROM (VALUES (0, 'raw'), (1, 'final_only'), (2, 'late')) AS t(stage_no, stage)),
filled AS (
  SELECT names.target, ord.stage_no, ord.stage, coalesce(s.n, 0) AS n FROM names CROSS JOIN ord
  LEFT JOIN stages s ON coalesce(s.target, 'TOTAL') = names.target AND s.stage = ord.stage),
lagged AS (SELECT *, lag(n) OVER (PARTITION BY target ORDER BY stage_no) AS previous FROM filled)
SELECT target, CAST(stage_no AS BIGINT) AS stage_no, stage, n, coalesce(previous, -1) AS previous,
       CASE WHEN previous > 0 THEN round(100.0 * (previous - n) / previous, 6) + 0.0 END AS pct_removed FROM lagged""")
def _(spark, sf):
    report = cleaning.attrition_report(_stages(spark, sf), ["raw", "final_only", "late"]).fillna(-1, ["previous"])
    return shaped(report, "target", "stage", stage_no="int", n="int", previous="int", pct_removed="num")


@query("collapse_mean", A + "SELECT entity, target, value FROM cells")
def _(spark, sf):
    return shaped(cells(spark, sf), "entity", "target", "value")


@query("collapse_first", R + "SELECT entity, target, value + 0.0 AS value FROM grid")
def _(spark, sf):
    return shaped(grid(spark, sf), "entity", "target", "value")


@query("modal_value", """
SELECT key, col AS p_name, n FROM (
  SELECT p_brand AS key, p_name AS col, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS rn
  FROM part GROUP BY 1, 2) WHERE rn = 1""")
def _(spark, sf):
    return cleaning.modal_value(table(spark, sf, "part").withColumn("key", F.col("p_brand")), "key", "p_name").select(
        "key", "p_name", "n")


@query("collect_ids", A + """
SELECT entity, CAST((rk - 1) // 20 AS BIGINT) AS part, string_agg(CAST(alt_id AS VARCHAR), ';' ORDER BY alt_id) AS ids, count(*) AS n_ids
FROM (SELECT entity, alt_id, row_number() OVER (PARTITION BY entity ORDER BY alt_id) AS rk FROM (SELECT DISTINCT entity, alt_id FROM assay))
GROUP BY 1, 2""")
def _(spark, sf):
    return shaped(cleaning.collect_ids(assay(spark, sf), "entity", "alt_id", part_size=20), "entity", "ids", part="int", n_ids="int")


@query("first_attribute", A + """
SELECT entity, target FROM (SELECT entity, target, row_number() OVER (PARTITION BY entity ORDER BY alt_id, line) AS rn FROM assay) WHERE rn = 1""")
def _(spark, sf):
    return cleaning.first_attribute(assay(spark, sf), "entity", "target", ["alt_id", "line"])


@query("variant_groups", """
SELECT p_brand, count(DISTINCT p_name) AS n_variants FROM part GROUP BY p_brand HAVING count(DISTINCT p_name) > 1""")
def _(spark, sf):
    return cleaning.variant_groups(table(spark, sf, "part"), "p_brand", "p_name")


@query("target_summary", A + "," + YOUDEN + """
SELECT target, count(*) AS n_total, count(*) FILTER (value > threshold) AS n_active, count(*) FILTER (value <= threshold) AS n_inactive,
       round(100.0 * count(*) FILTER (value > threshold) / count(*), 6) AS pct_active
FROM cells JOIN cut USING (target) GROUP BY target""")
def _(spark, sf):
    c = cells(spark, sf)
    labels = cutoffs.binarize(c, cutoffs.youden_cutoff(c))
    return shaped(cleaning.target_summary(labels), "target", n_total="int", n_active="int", n_inactive="int", pct_active="num")


@query("matrix_profile", A + """
SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT target) AS n_targets, count(value) AS n_cells,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(100.0 * (1.0 - count(value) / (count(DISTINCT entity) * count(DISTINCT target))), 6) AS sparsity_pct FROM cells""")
def _(spark, sf):
    return shaped(cleaning.matrix_profile(cells(spark, sf)), n_entities="int", n_targets="int", n_cells="int", mean="num",
                  std="num", min="num", max="num", sparsity_pct="num")


@query("missing_by_target", A + """
SELECT target, count(DISTINCT entity) AS n_filled, (SELECT count(DISTINCT entity) FROM cells) - count(DISTINCT entity) AS n_missing,
       round(100.0 * ((SELECT count(DISTINCT entity) FROM cells) - count(DISTINCT entity)) / (SELECT count(DISTINCT entity) FROM cells), 6) AS pct_missing
FROM cells GROUP BY target""")
def _(spark, sf):
    return shaped(cleaning.missing_by_target(cells(spark, sf)), "target", n_filled="int", n_missing="int", pct_missing="num")


@query("entity_code", "SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)")
def _(spark, sf):
    return cleaning.entity_code(table(spark, sf, "part"), "p_name")


@query("median_cutoff", A + """
SELECT target, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS threshold FROM cells GROUP BY target""")
def _(spark, sf):
    return shaped(cutoffs.median_cutoff(cells(spark, sf)), "target", n="int", threshold="num")


@query("youden_cutoff", A + "," + YOUDEN + "SELECT target, n, round(median, 6) AS median, round(threshold, 6) AS threshold FROM cut")
def _(spark, sf):
    return shaped(cutoffs.youden_cutoff(cells(spark, sf)), "target", n="int", median="num", threshold="num")


@query("balanced_cutoff", A + """,
q AS (SELECT target, count(*) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS c0,
             quantile_cont(value, 0.6) AS c1, quantile_cont(value, 0.75) AS c2 FROM cells GROUP BY target HAVING count(*) >= 10),
cand AS (
  SELECT target, n, lo, hi, c0, i, CASE i WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN 4.4 ELSE 4.6 END AS c
  FROM q CROSS JOIN range(0, 5) AS t(i)),
share AS (SELECT cand.target, i, any_value(cand.n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(c) AS c,
                 avg(CAST(value > c AS DOUBLE)) AS s FROM cand JOIN cells USING (target) GROUP BY cand.target, i),
ok AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(s - 0.5), i) AS rn FROM share
       WHERE c BETWEEN lo AND hi AND s BETWEEN 0.1 AND 0.9)
SELECT q.target, q.n, round(coalesce(ok.c, q.c0), 6) AS threshold,
       round(coalesce(ok.s, (SELECT s FROM share WHERE share.target = q.target AND i = 0)), 6) AS positive_share,
       coalesce(ok.i, 0) AS candidate
FROM q LEFT JOIN ok ON ok.target = q.target AND ok.rn = 1""")
def _(spark, sf):
    got = cutoffs.balanced_cutoff(cells(spark, sf), extra=(4.4, 4.6))
    return shaped(got, "target", n="int", threshold="num", positive_share="num", candidate="int")


@query("avg_rank", A + """
SELECT entity, target, rank() OVER (PARTITION BY target ORDER BY v) + (count(*) OVER (PARTITION BY target, v) - 1) / 2.0 AS avg_rank
FROM (SELECT *, round(value, 2) AS v FROM cells)""")
def _(spark, sf):
    c = cells(spark, sf).withColumn("v", F.round("value", 2))
    return avg_rank(c, "v", "target").select("entity", "target", "avg_rank")


RESOLVED = """
per_name AS (
  SELECT skey, entity, count(DISTINCT target) AS cov, max(CAST(version = 'V2' AS INT)) AS pref FROM response WHERE skey IS NOT NULL GROUP BY 1, 2),
choice AS (
  SELECT skey, entity AS chosen, n_names, CASE WHEN n_names = 1 THEN 'single' WHEN p = 1 THEN 'cross' ELSE 'same' END AS kind FROM (
    SELECT *, row_number() OVER (PARTITION BY skey ORDER BY pref DESC, cov DESC, entity) AS rn, count(*) OVER (PARTITION BY skey) AS n_names,
           max(pref) OVER (PARTITION BY skey) AS p FROM per_name) WHERE rn = 1),
named AS (SELECT response.*, chosen, kind FROM response JOIN choice USING (skey)),
prim AS (SELECT skey, entity, target, value, version, ord, line, 0 AS filled FROM named WHERE entity = chosen),
fill AS (
  SELECT skey, chosen AS entity, target, value, version, ord, line, 1 AS filled FROM (
    SELECT *, row_number() OVER (PARTITION BY skey, target ORDER BY ord, line, entity, value) AS rn FROM named n
    WHERE kind = 'cross' AND entity <> chosen AND version = 'V1'
      AND NOT EXISTS (SELECT 1 FROM prim WHERE prim.skey = n.skey AND prim.target = n.target)) WHERE rn = 1)"""


@query("resolve_sources", R + "," + RESOLVED + """
SELECT entity, target, filled, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM (SELECT * FROM prim UNION ALL SELECT * FROM fill) GROUP BY ALL""")
def _(spark, sf):
    merged = resolve.resolve_sources(response(spark, sf), "skey", "entity", "version", "V2", "V1", ["ord", "line", "entity", "value"])
    return merged.groupBy("entity", "target", "filled").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


@query("response_target_summary", R + "," + RESOLVED + """,
one AS (SELECT *, row_number() OVER (PARTITION BY entity, target ORDER BY ord, line, value) AS rn FROM (SELECT * FROM prim UNION ALL SELECT * FROM fill) WHERE value IS NOT NULL)
SELECT target, count(*) AS n_total, count(*) FILTER (value <= 0.5) AS n_active, count(*) FILTER (value > 0.5) AS n_inactive,
       round(100.0 * count(*) FILTER (value <= 0.5) / count(*), 6) AS pct_active FROM one WHERE rn = 1 GROUP BY target""")
def _(spark, sf):
    got = summarise_response(response(spark, sf), 0.5, "<=", "skey", "entity", "version", "V2", "V1", ["ord", "line", "entity", "value"])
    return shaped(got, "target", n_total="int", n_active="int", n_inactive="int", pct_active="num")


@query("resolve_merge_counts", R + "," + RESOLVED + """
SELECT count(*) FILTER (kind = 'cross') AS n_cross_merges, count(*) FILTER (kind = 'same') AS n_same_merges, count(*) FILTER (kind = 'single') AS n_single FROM choice""")
def _(spark, sf):
    return resolve.merge_counts(resolve.choose_names(response(spark, sf), "skey", "entity", "version", "V2"))

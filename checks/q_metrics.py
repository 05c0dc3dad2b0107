"""Ranking, cutoff and evaluation queries on the prediction and metrics bindings."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import METRICS, PREDICTIONS, metrics, model_scores, scored, table, with_cte
from checks.registry import query, r, shaped
from titerflow.functions import columns as C
from titerflow.operators import cutoffs, joins
from titerflow.operators import metrics as M
from titerflow.operators import summaries as S
from titerflow.operators.ordering import roc_points

P = with_cte(PREDICTIONS)
T = with_cte(METRICS)

ROC = """
tot AS (SELECT target, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg FROM scored GROUP BY target),
pts AS (SELECT target, p, CAST(sum(label) AS BIGINT) AS hits, count(*) AS n FROM scored GROUP BY 1, 2),
roc AS (
  SELECT pts.target, p, hits, n, CAST(sum(hits) OVER w AS BIGINT) AS tp, CAST(sum(n - hits) OVER w AS BIGINT) AS fp, pos, neg,
         CASE WHEN pos > 0 THEN sum(hits) OVER w / CAST(pos AS DOUBLE) END AS tpr, CASE WHEN neg > 0 THEN sum(n - hits) OVER w / CAST(neg AS DOUBLE) END AS fpr
  FROM pts JOIN tot USING (target) WINDOW w AS (PARTITION BY pts.target ORDER BY p DESC ROWS UNBOUNDED PRECEDING)
),
jmax AS (
  SELECT * FROM (SELECT *, tpr - fpr AS j, max(p) OVER (PARTITION BY target) AS top,
    row_number() OVER (PARTITION BY target ORDER BY tpr - fpr DESC NULLS LAST, p DESC) AS rn FROM roc) WHERE rn = 1
),
auc AS (
  SELECT target, CASE WHEN any_value(pos) > 0 AND any_value(neg) > 0 THEN
    sum(hits * ((neg - fp) + (n - hits) / 2.0)) / (CAST(any_value(pos) AS DOUBLE) * any_value(neg)) END AS auc FROM roc GROUP BY target
)"""


@query("roc_points", P + "," + ROC + "SELECT target, p, tp, fp, pos, neg, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def _(spark, sf):
    return shaped(roc_points(scored(spark, sf), "target", "label", "p"), "target", "p", tp="int", fp="int", pos="int",
                  neg="int", tpr="num", fpr="num")


@query("youden_with_start", P + "," + ROC + """
SELECT target, pos, neg, round(CASE WHEN pos = 0 OR neg = 0 THEN 0.5 WHEN j <= 0 THEN top + 1 ELSE p END, 6) AS threshold,
       round(CASE WHEN pos = 0 OR neg = 0 OR j <= 0 THEN 0 ELSE j END, 6) AS j FROM jmax""")
def _(spark, sf):
    return shaped(cutoffs.youden_probability(scored(spark, sf), "target", "label", "p"), "target", pos="int", neg="int",
                  threshold="num", j="num")


@query("youden_clipped", P + "," + ROC + """
SELECT target, round(CASE WHEN pos = 0 OR neg = 0 THEN 0.5 ELSE least(greatest(p, 0), 1) END, 6) AS threshold,
       round(CASE WHEN pos = 0 OR neg = 0 THEN NULL ELSE tpr END, 6) AS sensitivity,
       round(CASE WHEN pos = 0 OR neg = 0 THEN NULL ELSE 1 - fpr END, 6) AS specificity FROM jmax""")
def _(spark, sf):
    return shaped(cutoffs.youden_probability(scored(spark, sf), "target", "label", "p", "clipped"), "target",
                  threshold="num", sensitivity="num", specificity="num")


@query("f1_cutoff", P + """,
g AS (SELECT i, 0.1 + ((0.9 - 0.1) / 49) * i AS c FROM range(0, 50) AS t(i)),
f AS (SELECT target, i, any_value(c) AS c, 2.0 * count(*) FILTER (p >= c AND label = 1) AS tp2,
             count(*) FILTER (p >= c) + sum(label) AS den FROM scored CROSS JOIN g GROUP BY target, i),
s AS (SELECT target, i, c, CASE WHEN den > 0 THEN tp2 / den ELSE 0 END AS f1 FROM f)
SELECT target, round(c, 6) AS threshold, round(f1, 6) AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY f1 DESC, i) AS rn FROM s) WHERE rn = 1""")
def _(spark, sf):
    return shaped(cutoffs.f1_cutoff(scored(spark, sf), "target", "label", "p"), "target", threshold="num", f1="num")


#: Languages as targets: the sources of the small tables have fewer than the 50 rows that the rule asks for.
BY_LANG = P.replace("scored AS (SELECT entity, target, lang, label", "scored AS (SELECT entity, lang AS target, label")


def scored_by_lang(spark, sf):
    return scored(spark, sf).drop("target").withColumnRenamed("lang", "target")


OPERATING = ROC + """,
op AS (
  SELECT target, count(*) AS n, count(*) FILTER (label = 1) AS n_active,
    avg(CASE WHEN label = 0 THEN CAST(p <= 0.3 AS INT) END) AS specificity_at,
    avg(CASE WHEN label = 0 THEN CAST(p > 0.3 AS INT) END) AS false_exclusion_at,
    avg(CASE WHEN p <= 0.3 THEN CAST(label = 0 AS INT) END) AS npv_at,
    avg(CASE WHEN label = 1 THEN CAST(p > 0.3 AS INT) END) AS sensitivity_at
  FROM scored GROUP BY target HAVING count(*) >= 50),
opj AS (
  SELECT op.*, CASE WHEN pos = 0 OR neg = 0 THEN 0.5 WHEN j <= 0 THEN top + 1 ELSE p END AS threshold,
         CAST(0.3 <= CASE WHEN pos = 0 OR neg = 0 THEN 0.5 WHEN j <= 0 THEN top + 1 ELSE p END AS BIGINT) AS is_conservative
  FROM op JOIN jmax USING (target))"""


@query("operating_point", BY_LANG + "," + OPERATING + """
SELECT target, n, n_active, round(specificity_at, 6) AS specificity_at, round(false_exclusion_at, 6) AS false_exclusion_at,
       round(npv_at, 6) AS npv_at, round(sensitivity_at, 6) AS sensitivity_at, round(threshold, 6) AS threshold, is_conservative FROM opj""")
def _(spark, sf):
    got = cutoffs.operating_point(scored_by_lang(spark, sf), "target", "label", "p", 0.3, 50)
    return shaped(got, "target", n="int", n_active="int", specificity_at="num", false_exclusion_at="num", npv_at="num",
                  sensitivity_at="num", threshold="num", is_conservative="int")


@query("cutoff_summary", BY_LANG + "," + OPERATING + """
SELECT count(*) AS n_targets, round(avg(threshold), 6) AS mean_threshold, round(stddev_samp(threshold), 6) AS std_threshold,
       round(min(threshold), 6) AS min_threshold, round(max(threshold), 6) AS max_threshold, count(*) FILTER (is_conservative = 1) AS n_conservative,
       round(avg(sensitivity_at), 6) AS mean_sensitivity, round(avg(specificity_at), 6) AS mean_specificity, round(avg(npv_at), 6) AS mean_npv FROM opj""")
def _(spark, sf):
    got = cutoffs.cutoff_summary(cutoffs.operating_point(scored_by_lang(spark, sf), "target", "label", "p", 0.3, 50))
    return shaped(got, n_targets="int", mean_threshold="num", std_threshold="num", min_threshold="num", max_threshold="num",
                  n_conservative="int", mean_sensitivity="num", mean_specificity="num", mean_npv="num")


CONF = """
SELECT {by}, count(*) FILTER (label = 1 AND pr = 1) AS tp, count(*) FILTER (label = 0 AND pr = 0) AS tn,
       count(*) FILTER (label = 0 AND pr = 1) AS fp, count(*) FILTER (label = 1 AND pr = 0) AS fn FROM {src} GROUP BY ALL"""
RATES = """
round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
  THEN (tp * tn - fp * fn) / sqrt(CAST((tp + fp) * (tp + fn) AS DOUBLE) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) + 0.0 AS mcc,
round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity"""
RATE_COLS = dict(tp="int", tn="int", fp="int", fn="int", accuracy="num", precision="num", recall="num", f1="num", mcc="num",
                 specificity="num")


@query("confusion_metrics", P + f""",
pred AS (SELECT *, CAST(p >= 0.5 AS INT) AS pr FROM scores), c AS ({CONF.format(by='target, model', src='pred')})
SELECT target, model, tp, tn, fp, fn, {RATES} FROM c""")
def _(spark, sf):
    pred = model_scores(spark, sf).withColumn("predicted", (F.col("p") >= 0.5).cast("int"))
    return shaped(M.confusion_metrics(pred, ["target", "model"]), "target", model="int", **RATE_COLS)


@query("train_test_gap", P + f""",
pred AS (SELECT *, CAST(p >= 0.5 AS INT) AS pr, CASE WHEN entity % 5 = 0 THEN 'Train_Test' ELSE 'Train_Train' END AS split FROM scores),
c AS ({CONF.format(by='lang, split', src='pred')})
SELECT lang, split, tp, tn, fp, fn, {RATES} FROM c""")
def _(spark, sf):
    pred = model_scores(spark, sf).withColumns({
        "predicted": (F.col("p") >= 0.5).cast("int"),
        "side": F.when(F.col("entity") % 5 == 0, "test").otherwise("train")})
    return shaped(M.by_side(pred, "lang", M.confusion_metrics), "lang", "split", **RATE_COLS)


@query("rank_auc", P + "," + ROC + "SELECT auc.target, tot.pos, tot.neg, round(auc, 6) AS auc FROM auc JOIN tot USING (target)")
def _(spark, sf):
    return shaped(M.rank_auc(scored(spark, sf), "target", "label", "p"), "target", pos="int", neg="int", auc="num")


@query("rank_auc_half", P + """,
ranked AS (SELECT target, model, label, rank() OVER (PARTITION BY target, model ORDER BY p) + (count(*) OVER (PARTITION BY target, model, p) - 1) / 2.0 AS rk FROM scores),
agg AS (SELECT target, model, sum(label) AS pos, count(*) - sum(label) AS neg, sum(rk) FILTER (label = 1) AS rs FROM ranked GROUP BY ALL)
SELECT target, model, round(CASE WHEN pos > 0 AND neg > 0 THEN (rs - pos * (pos + 1) / 2.0) / (CAST(pos AS DOUBLE) * neg) ELSE 0.5 END, 6) AS auc FROM agg""")
def _(spark, sf):
    return shaped(M.rank_auc(model_scores(spark, sf), ["target", "model"], "label", "p", 0.5), "target", model="int", auc="num")


@query("average_precision", P + "," + ROC + """
SELECT target, round(CASE WHEN any_value(pos) > 0 AND any_value(neg) > 0 THEN sum(hits * (tp / CAST(tp + fp AS DOUBLE))) / any_value(pos) END, 6) AS auprc
FROM roc GROUP BY target""")
def _(spark, sf):
    return shaped(M.average_precision(scored(spark, sf), "target", "label", "p"), "target", auprc="num")


@query("regression_metrics", """
WITH x AS (SELECT o_orderpriority AS grp, o_totalprice AS y, round(o_totalprice * (0.5 + (o_custkey % 100) / 100.0), 0) AS yp FROM orders),
m AS (SELECT grp, avg(y) AS my FROM x GROUP BY grp),
rk AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry,
              rank() OVER (PARTITION BY grp ORDER BY yp) + (count(*) OVER (PARTITION BY grp, yp) - 1) / 2.0 AS rp FROM x),
sp AS (SELECT grp, corr(ry, rp) AS spearman FROM rk GROUP BY grp)
SELECT grp, count(*) AS n, round(1 - sum((y - yp) * (y - yp)) / sum((y - my) * (y - my)), 6) AS r2,
       round(sqrt(avg((y - yp) * (y - yp))), 4) AS rmse, round(avg(abs(y - yp)), 4) AS mae, round(corr(y, yp), 6) AS pearson,
       round(any_value(spearman), 6) AS spearman
FROM x JOIN m USING (grp) JOIN sp USING (grp) GROUP BY grp""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("truth"),
        F.round(F.col("o_totalprice") * (0.5 + (F.col("o_custkey") % 100) / 100.0), 0).alias("predicted"))
    got = M.regression_metrics(rows, "grp")
    return got.select("grp", F.col("n").cast("bigint"), r("r2").alias("r2"), r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"),
                      r("pearson").alias("pearson"), r("spearman").alias("spearman"))


@query("cv_stats_population", T + """
SELECT model, count(m) AS n_folds, round(avg(m), 6) AS cv_mean, round(stddev_pop(m), 6) AS cv_std
FROM (SELECT model, fold, avg(metric) AS m FROM metrics GROUP BY ALL) GROUP BY model""")
def _(spark, sf):
    folds = metrics(spark, sf).groupBy("model", "fold").agg(F.avg("metric").alias("m"))
    return shaped(M.cv_stats(folds, "model", "m"), "model", n_folds="int", cv_mean="num", cv_std="num")


@query("cv_stats_sample", T + """
SELECT model, count(m) AS n_folds, round(avg(m), 6) AS cv_mean, round(stddev_samp(m), 6) AS cv_std
FROM (SELECT model, fold, avg(metric) AS m FROM metrics GROUP BY ALL) GROUP BY model""")
def _(spark, sf):
    folds = metrics(spark, sf).groupBy("model", "fold").agg(F.avg("metric").alias("m"))
    return shaped(M.cv_stats(folds, "model", "m", ddof=1), "model", n_folds="int", cv_mean="num", cv_std="num")


@query("link_probability", P + """
SELECT entity, model, round(least(greatest(1 / (1 + exp(-(p - 0.5) * 40)), 1e-6), 1 - 1e-6), 6) AS prob FROM scores""")
def _(spark, sf):
    return model_scores(spark, sf).select("entity", F.col("model").cast("bigint").alias("model"),
                                          r(C.link_probability((F.col("p") - 0.5) * 40)).alias("prob"))


@query("bin_stats", P + """,
b AS (SELECT p, label, CASE WHEN p < 0 THEN NULL WHEN p < .3 THEN 0 WHEN p < .5 THEN 1 WHEN p < .7 THEN 2 WHEN p < 1.01 THEN 3 END AS bin FROM scores)
SELECT bin, count(*) AS n, round(avg(label), 6) AS mean_value FROM b WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) > 10""")
def _(spark, sf):
    return shaped(M.bin_stats(model_scores(spark, sf), "p", "label"), bin="int", n="int", mean_value="num")


@query("leaderboard", T + """
SELECT model, features, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS std, count(metric) AS n,
       row_number() OVER (ORDER BY avg(metric) DESC, model, features) AS rank
FROM metrics WHERE split = 'Train_Test' GROUP BY model, features ORDER BY rank LIMIT 6""")
def _(spark, sf):
    return shaped(S.leaderboard(metrics(spark, sf), "metric", ["model", "features"], 6), "model", "features", mean="num",
                  std="num", n="int", rank="int")


@query("cv_summary", T + """,
f AS (SELECT model, target, fold, avg(metric) AS f FROM metrics GROUP BY ALL), t AS (SELECT model, target, avg(f) AS t FROM f GROUP BY ALL)
SELECT model, round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS std, count(t) AS n_targets FROM t GROUP BY model""")
def _(spark, sf):
    return shaped(S.cv_summary(metrics(spark, sf), "metric", "target", "model"), "model", mean="num", std="num", n_targets="int")


@query("split_summary", T + """
SELECT features, round(avg(metric), 6) AS mean_metric, count(*) AS n FROM metrics WHERE split = 'Train_Test' GROUP BY features""")
def _(spark, sf):
    return shaped(S.split_summary(metrics(spark, sf), ["metric"], "features"), "features", mean_metric="num", n="int")


@query("target_means", T + "SELECT target, round(avg(metric), 6) AS mean_metric FROM metrics GROUP BY target")
def _(spark, sf):
    return shaped(S.target_means(metrics(spark, sf), "metric"), "target", mean_metric="num")


@query("top_k_targets", T + """
SELECT target, round(avg(metric), 6) AS mean_metric FROM metrics GROUP BY target ORDER BY avg(metric) DESC, target LIMIT 10""")
def _(spark, sf):
    got = S.top_k(S.target_means(metrics(spark, sf), "metric"), [F.col("mean_metric").desc(), "target"], 10)
    return shaped(got, "target", mean_metric="num")


@query("best_row_overall", T + """
SELECT model, target, event_id, metric FROM metrics ORDER BY metric DESC, event_id LIMIT 1""")
def _(spark, sf):
    return S.best_row(metrics(spark, sf), "metric", ["event_id"]).select("model", "target", "event_id", "metric")


@query("best_row_by_features", T + """
SELECT features, model, target, event_id, metric FROM (
  SELECT *, row_number() OVER (PARTITION BY features ORDER BY metric DESC, event_id) AS rn FROM metrics) WHERE rn = 1""")
def _(spark, sf):
    return S.best_row(metrics(spark, sf), "metric", ["event_id"], "features").select("features", "model", "target", "event_id", "metric")


@query("distinct_by_order", T + """
SELECT target, event_id, model FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY event_id DESC) AS rn FROM metrics) WHERE rn = 1""")
def _(spark, sf):
    return S.distinct_by(metrics(spark, sf), "target", [F.col("event_id").desc()]).select("target", "event_id", "model")


@query("union_parts", T + """
SELECT model, target, metric, CASE WHEN part = 1 THEN fold ELSE -1 END AS fold FROM (
  SELECT *, 1 AS part FROM metrics WHERE event_id % 2 = 0 UNION ALL SELECT *, 2 FROM metrics WHERE event_id % 2 <> 0)""")
def _(spark, sf):
    m = metrics(spark, sf).select("event_id", "model", "target", "metric", "fold")
    parts = joins.union_all(m.where("event_id % 2 = 0").drop("event_id"), m.where("event_id % 2 <> 0").drop("event_id", "fold"))
    return shaped(parts.fillna(-1, ["fold"]), "model", "target", "metric", fold="int")


@query("common_ids", """
SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels""")
def _(spark, sf):
    return joins.common_ids(table(spark, sf, "documents").select("doc_id"),
                            table(spark, sf, "labels").select("doc_id"))


@query("minus_ids", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    return joins.minus_ids(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("join_metric_series", T + """
SELECT a.target, round(a.m, 6) AS test, round(b.m, 6) AS train FROM
  (SELECT target, avg(metric) AS m FROM metrics WHERE split = 'Train_Test' GROUP BY target) a JOIN
  (SELECT target, avg(metric) AS m FROM metrics WHERE split = 'Train_Train' GROUP BY target) b USING (target)""")
def _(spark, sf):
    m = metrics(spark, sf)
    got = joins.join_metrics(S.target_means(m.where("split = 'Train_Test'"), "metric", name="test"),
                             S.target_means(m.where("split = 'Train_Train'"), "metric", name="train"), "target")
    return shaped(got, "target", test="num", train="num")


@query("check_against_claims", T + """,
a AS (SELECT target, round(avg(metric), 4) AS got FROM metrics WHERE split = 'Train_Test' GROUP BY target),
b AS (SELECT target, round(avg(metric), 2) AS claim FROM metrics WHERE split = 'Train_Test' AND target % 7 <> 0 GROUP BY target)
SELECT target, got, claim, round(abs(got - claim), 6) AS gap, CASE WHEN got IS NULL OR claim IS NULL THEN 'MISSING' WHEN got = claim THEN 'EXACT'
  WHEN round(abs(got - claim), 9) <= 0.0015 THEN 'PASS' WHEN round(abs(got - claim), 9) <= 0.0035 THEN 'CLOSE' ELSE 'FAIL' END AS grade
FROM a FULL JOIN b USING (target)""")
def _(spark, sf):
    tests = metrics(spark, sf).where("split = 'Train_Test'")
    got = S.target_means(tests, "metric", name="got").withColumn("got", F.round("got", 4))
    claim = S.target_means(tests.where("target % 7 <> 0"), "metric", name="claim").withColumn("claim", F.round("claim", 2))
    return shaped(joins.check_against(got, claim, "target", "got", "claim", 0.0015 + 1e-9, 0.0035 + 1e-9), "target", "got", "claim", "grade", gap="num")


@query("expand_grid", P + """
SELECT target, c AS cutoff, count(*) FILTER (p >= c) AS n_above FROM scored CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS c) GROUP BY ALL""")
def _(spark, sf):
    wide = joins.expand_grid(scored(spark, sf), "cutoff", [0.25, 0.5, 0.75])
    return wide.groupBy("target", "cutoff").agg(F.count_if(F.col("p") >= F.col("cutoff")).alias("n_above"))


@query("missing_outputs", T + """
SELECT DISTINCT e.target, CAST(p.target IS NOT NULL AS INT) AS present FROM metrics e
LEFT JOIN (SELECT DISTINCT target FROM metrics WHERE metric > 80) p ON e.target = p.target""")
def _(spark, sf):
    m = metrics(spark, sf)
    return joins.missing_outputs(m, m.where("metric > 80"), "target")

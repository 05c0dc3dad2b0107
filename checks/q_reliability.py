"""Applicability-domain queries on the prediction binding."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import PREDICTIONS, RESPONSE, grid, model_scores, scored, with_cte
from checks.registry import query, r, shaped
from titerflow.functions import columns as C
from titerflow.functions.columns import hash_key, hash_number
from titerflow.operators import reliability as D

P = with_cte(PREDICTIONS)

LAGGED = "lagged AS (SELECT *, least(p, 1 - p) AS lag_score FROM scored)"


def curve_sql(src: str, by: str, score: str, p: str, levels: str) -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score}, entity) AS rk, count(*) OVER (PARTITION BY {by}) AS n_all FROM {src}),
kept AS (SELECT ranked.*, c AS coverage FROM ranked JOIN (SELECT unnest({levels}) AS c) ON rk <= greatest(2, (c * n_all + 99) // 100)),
kr AS (SELECT *, rank() OVER (PARTITION BY {by}, coverage ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, coverage, {p}) - 1) / 2.0 AS rr FROM kept),
curve0 AS (SELECT {by}, coverage, count(*) AS n_kept, sum(label) AS pos, count(*) - sum(label) AS neg, sum(rr) FILTER (label = 1) AS rs FROM kr GROUP BY ALL),
curve AS (SELECT {by}, coverage, n_kept, CASE WHEN pos > 0 AND neg > 0 THEN (rs - pos * (pos + 1) / 2.0) / (CAST(pos AS DOUBLE) * neg) END AS auc FROM curve0)"""


TENS = "[10,20,30,40,50,60,70,80,90,100]"
FINE = "[1,2,3,4,5,6,7,8,9,10,20,30,40,50,60,70,80,90,100]"

CONSENSUS = """
cons AS (
  SELECT lang, entity, any_value(label) AS label, count(p) AS n_models, round(avg(p), 8) AS p_mean, round(stddev_samp(p), 8) AS p_std
  FROM scores GROUP BY lang, entity HAVING count(p) >= 8),
zed AS (SELECT *, (0.5 - p_mean) / p_std AS z, 1 / (1 + 0.3275911 * abs((0.5 - p_mean) / p_std) / sqrt(2.0)) AS t FROM cons),
phi AS (SELECT *, 0.5 * (1 + (CASE WHEN z < 0 THEN -1 ELSE 1 END) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
        * exp(-(abs(z) / sqrt(2.0)) * (abs(z) / sqrt(2.0))))) AS phi FROM zed),
certain AS (SELECT lang, entity, label, p_mean, p_std, round(least(p_mean, 1 - p_mean), 7) AS class_lag, round(p_std, 7) AS cons_std,
            round(CASE WHEN p_std < 1e-9 THEN least(p_mean, 1 - p_mean) ELSE least(phi, 1 - phi) END, 7) AS cons_std_prob FROM phi)"""


def certain(spark, sf):
    rows = D.consensus(model_scores(spark, sf), ("lang", "entity"))
    rows = rows.withColumns({"p_mean": F.round("p_mean", 8), "p_std": F.round("p_std", 8)})
    return rows.withColumns({
        "class_lag": F.round(C.class_lag("p_mean"), 7), "cons_std": F.round("p_std", 7),
        "cons_std_prob": F.round(C.std_prob("p_mean", "p_std"), 7)})


@query("class_lag", P + "," + LAGGED + "SELECT entity, target, round(lag_score, 6) AS class_lag FROM lagged")
def _(spark, sf):
    return shaped(scored(spark, sf).withColumn("class_lag", C.class_lag("p")), "entity", "target", class_lag="num")


@query("keep_most_certain", P + "," + LAGGED + """
SELECT entity, target, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(lag_score, 6), entity) AS rk FROM lagged) WHERE rk <= 5""")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("s", F.round(C.class_lag("p"), 6))
    return shaped(D.keep_lowest(rows, "target", "s", 5), "entity", "target", rank="int")


@query("consensus", P + "," + CONSENSUS + "SELECT lang, entity, label, round(p_mean, 6) AS p_mean, round(p_std, 6) AS p_std FROM cons")
def _(spark, sf):
    return shaped(certain(spark, sf), "lang", "entity", "label", p_mean="num", p_std="num")


@query("std_prob", P + "," + CONSENSUS + "SELECT lang, entity, cons_std_prob FROM certain")
def _(spark, sf):
    return shaped(certain(spark, sf), "lang", "entity", "cons_std_prob")


@query("auc_at_coverage", P + ", lagged AS (SELECT *, round(least(p, 1 - p), 6) AS lag_score FROM scored)," + curve_sql("lagged", "lang", "lag_score", "p", TENS) +
       "SELECT lang, coverage, n_kept, round(auc, 6) AS auc FROM curve")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("s", F.round(C.class_lag("p"), 6))
    return shaped(D.auc_at_coverage(rows, "lang", "s"), "lang", coverage="int", n_kept="int", auc="num")


@query("auc_at_fine_coverage", P + ", lagged AS (SELECT *, round(least(p, 1 - p), 6) AS lag_score FROM scored)," + curve_sql("lagged", "target", "lag_score", "p", FINE) +
       "SELECT target, coverage, n_kept, round(auc, 6) AS auc FROM curve")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("s", F.round(C.class_lag("p"), 6))
    return shaped(D.auc_at_coverage(rows, "target", "s", grid=D.coverage_grid(True)), "target", coverage="int", n_kept="int", auc="num")


UNPIVOTED = """
threes AS (SELECT lang, entity, label, p_mean, unnest(['class_lag', 'cons_std', 'cons_std_prob']) AS score,
           unnest([class_lag, cons_std, cons_std_prob]) AS certainty FROM certain)"""


@query("certainty_curves", P + "," + CONSENSUS + "," + UNPIVOTED + "," + curve_sql("threes", "lang, score", "certainty", "p_mean", TENS) +
       "SELECT lang, score, coverage, n_kept, round(auc, 6) AS auc FROM curve")
def _(spark, sf):
    return shaped(D.certainty_curves(certain(spark, sf), "lang"), "lang", "score", coverage="int", n_kept="int", auc="num")


@query("coverage_comparison", P + "," + CONSENSUS + "," + UNPIVOTED + "," + curve_sql("threes", "lang, score", "certainty", "p_mean", FINE) + """
SELECT coverage, round(avg(auc) FILTER (score = 'class_lag'), 6) AS auc_class_lag, round(avg(auc) FILTER (score = 'cons_std'), 6) AS auc_cons_std,
  round(avg(auc) FILTER (score = 'cons_std_prob'), 6) AS auc_cons_std_prob, count(auc) FILTER (score = 'class_lag') AS valid_class_lag,
  count(auc) FILTER (score = 'cons_std') AS valid_cons_std, count(auc) FILTER (score = 'cons_std_prob') AS valid_cons_std_prob FROM curve GROUP BY coverage""")
def _(spark, sf):
    got = D.coverage_comparison(D.certainty_curves(certain(spark, sf), "lang", D.coverage_grid(True)))
    return shaped(got, coverage="int", **{f"auc_{s}": "num" for s in D.SCORES}, **{f"valid_{s}": "int" for s in D.SCORES})


BEST = """
tab AS (SELECT coverage, avg(auc) AS mean_auc, count(auc) AS n_valid FROM curve GROUP BY coverage)"""


@query("coverage_table", P + ", lagged AS (SELECT *, round(least(p, 1 - p), 6) AS lag_score FROM scored)," + curve_sql("lagged", "target", "lag_score", "p", TENS) + "," + BEST +
       "SELECT coverage, round(mean_auc, 6) AS mean_auc, n_valid FROM tab")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("s", F.round(C.class_lag("p"), 6))
    return shaped(D.coverage_table(D.auc_at_coverage(rows, "target", "s")), coverage="int", mean_auc="num", n_valid="int")


@query("coverage_gain", P + "," + CONSENSUS + "," + UNPIVOTED + "," + curve_sql("threes", "lang, score", "certainty", "p_mean", TENS) + """,
tab AS (SELECT coverage, avg(auc) AS mean_auc FROM curve WHERE score = 'cons_std' GROUP BY coverage)
SELECT (SELECT coverage FROM tab ORDER BY round(mean_auc, 12) DESC NULLS LAST, coverage LIMIT 1) AS best_coverage, round(max(mean_auc), 6) AS best_auc,
       round(max(mean_auc) FILTER (coverage = 100), 6) AS baseline_auc, round(max(mean_auc) - max(mean_auc) FILTER (coverage = 100), 6) AS max_gain FROM tab""")
def _(spark, sf):
    curves = D.certainty_curves(certain(spark, sf), "lang")
    return shaped(D.coverage_gain(curves, "cons_std"), best_coverage="int", best_auc="num", baseline_auc="num", max_gain="num")


@query("reliability_by_target", P + """,
ok AS (SELECT target FROM scored GROUP BY target HAVING count(*) >= 20 AND sum(label) BETWEEN 1 AND count(*) - 1),
lagged AS (SELECT *, round(least(p, 1 - p), 6) AS lag_score FROM scored WHERE target IN (SELECT target FROM ok)),""" + curve_sql("lagged", "target", "lag_score", "p", TENS) + """,
st AS (SELECT target, count(*) AS n_rows, 100.0 * avg(label) AS pct_positive, avg(lag_score) AS mean_score, quantile_cont(lag_score, 0.5) AS median_score,
       100.0 * avg(CAST(lag_score < 0.2 AS INT)) AS pct_below_20, 100.0 * avg(CAST(lag_score < 0.3 AS INT)) AS pct_below_30 FROM lagged GROUP BY target)
SELECT st.target, n_rows, round(pct_positive, 6) AS pct_positive, round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score,
  round(pct_below_20, 6) AS pct_below_20, round(pct_below_30, 6) AS pct_below_30, round(max(auc) FILTER (coverage = 100), 6) AS overall_auc,
  """ + ", ".join(f"round(max(auc) FILTER (coverage = {c}), 6) AS auc_cov{c:03d}" for c in range(10, 101, 10)) + """
FROM st JOIN curve USING (target) GROUP BY ALL""")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("class_lag", F.round(C.class_lag("p"), 6))
    got = D.reliability_by_target(rows)
    return shaped(got, "target", n_rows="int", pct_positive="num", mean_score="num", median_score="num", pct_below_20="num",
                  pct_below_30="num", overall_auc="num", **{f"auc_cov{c:03d}": "num" for c in D.coverage_grid()})


@query("share_below", P + """,
l AS (SELECT round(least(p, 1 - p), 6) AS s FROM scores)
SELECT count(*) AS n, round(avg(s), 6) AS mean, round(100.0 * avg(CAST(s < 0.2 AS INT)), 6) AS pct_below_20,
       round(100.0 * avg(CAST(s < 0.3 AS INT)), 6) AS pct_below_30, round(quantile_cont(s, 0.5), 6) AS median FROM l""")
def _(spark, sf):
    rows = model_scores(spark, sf).withColumn("s", F.round(C.class_lag("p"), 6))
    return shaped(D.share_below(rows, "s", (0.2, 0.3)), n="int", mean="num", pct_below_20="num", pct_below_30="num", median="num")


NOISE = "round(CAST('0x' || substr(md5(concat_ws('|', 'sweep', CAST(entity AS VARCHAR), target)), 1, 8) AS BIGINT) / 4294967296.0 * 0.5 + CASE WHEN value <= -0.4 THEN 0.3 ELSE 0.1 END, 3)"


@query("reliability_sweep", with_cte(RESPONSE) + f""",
preds AS (SELECT entity, target, {NOISE} AS p FROM grid),
sw AS (SELECT grid.entity, grid.target, c AS cutoff, CAST(value <= c AS INT) AS label, p, least(p, 1 - p) AS lag_score
       FROM grid JOIN preds USING (entity, target) CROSS JOIN (SELECT unnest([0.0, -0.5, -0.75, -1.0]) AS c)),
ok AS (SELECT cutoff, target FROM sw GROUP BY ALL HAVING count(*) >= 20 AND sum(label) BETWEEN 1 AND count(*) - 1),
src AS (SELECT sw.* FROM sw JOIN ok USING (cutoff, target)),""" + curve_sql("src", "cutoff, target", "lag_score", "p", TENS) + """
SELECT CAST(cutoff AS DOUBLE) AS cutoff, coverage, round(avg(auc), 6) AS mean_auc, count(auc) AS n_valid FROM curve GROUP BY ALL""")
def _(spark, sf):
    g = grid(spark, sf)
    noise = hash_number(hash_key("sweep", "entity", "target")) / F.lit(4294967296.0)
    preds = g.select("entity", "target", F.round(noise * 0.5 + F.when(F.col("value") <= -0.4, 0.3).otherwise(0.1), 3).alias("p"))
    return shaped(D.reliability_sweep(g, preds), "cutoff", coverage="int", mean_auc="num", n_valid="int")

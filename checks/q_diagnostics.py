"""Statistical test queries on the metrics and response bindings."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks import pvalue_sql as P
from checks.bindings import BITS, METRICS, PREDICTIONS, RESPONSE, bits, grid, metrics, table, with_cte
from checks.q_reliability import CONSENSUS, TENS, UNPIVOTED, certain, curve_sql
from checks.registry import query, r, shaped
from titerflow.operators import diagnostics as X
from titerflow.operators import similarity as S
from titerflow.operators.metrics import bin_stats
from titerflow.operators.reliability import certainty_curves
from titerflow.plans.diagnosis import diagnose_metrics
from titerflow.session import materialize

T = with_cte(METRICS)


def tests(spark, sf):
    return metrics(spark, sf).where("split = 'Train_Test'")


@query("kruskal", T + """,
t AS (SELECT * FROM metrics WHERE split = 'Train_Test'),
rk AS (SELECT model, metric, rank() OVER (ORDER BY metric) + (count(*) OVER (PARTITION BY metric) - 1) / 2.0 AS r FROM t),
g AS (SELECT model, sum(r) AS s, count(*) AS n, avg(metric) AS m FROM rk GROUP BY model),
ties AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY metric)),
a AS (SELECT count(*) AS n_groups, CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS ss, max(m) - min(m) AS mr FROM g),
hs AS (SELECT *, (12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h FROM a, ties)
SELECT n_groups, CAST(n AS BIGINT) AS n, round(h, 6) AS h, round(mr, 6) AS mean_range, round(""" + P.chi2("h", "n_groups - 1") + ", 6) AS p FROM hs")
def _(spark, sf):
    return shaped(X.kruskal(tests(spark, sf), "model", "metric"), n_groups="int", n="int", h="num", mean_range="num", p="num")


WILCOXON_Z = "(w - n * (n + 1) / 4.0) / sqrt((n * (n + 1.0) * (2 * n + 1) - tie / 2.0) / 24.0)"
MANN_WHITNEY_Z = "(greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1.0))))"


@query("wilcoxon_paired", T + """,
p AS (SELECT target, avg(metric) FILTER (features = 'bits') - avg(metric) FILTER (features = 'counts') AS d FROM metrics GROUP BY target),
q AS (SELECT round(d, 3) AS d FROM p WHERE d IS NOT NULL),
rk AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM q WHERE d <> 0),
ties AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM rk GROUP BY abs(d))),
ws AS (SELECT count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM rk)
SELECT n, w, round((SELECT avg(d) FROM q), 6) + 0.0 AS mean_gain, round(""" + P.normal(WILCOXON_Z) + ", 6) AS p FROM ws, ties")
def _(spark, sf):
    m = metrics(spark, sf).groupBy("target").agg(
        F.avg(F.when(F.col("features") == "bits", F.col("metric"))).alias("a"),
        F.avg(F.when(F.col("features") == "counts", F.col("metric"))).alias("b"))
    pairs = m.select(F.round(F.col("a") - F.col("b"), 3).alias("a"), F.lit(0.0).alias("b")).where("a IS NOT NULL")
    return shaped(X.wilcoxon_paired(pairs, "a", "b"), n="int", w="num", mean_gain="num", p="num")


SIZES = """
s AS (SELECT target, count(*) AS n_rows, avg(metric) AS m, 100.0 * avg(CAST(metric > 10 AS INT)) AS pct FROM metrics GROUP BY target)"""


def sizes(spark, sf):
    return metrics(spark, sf).groupBy("target").agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg("metric").alias("m"),
        (100.0 * F.avg((F.col("metric") > 10).cast("double"))).alias("pct"))


PEARSON_T = "r * sqrt((n - 2) / (1 - r * r))"


@query("pearson_size", T + "," + SIZES + ", c AS (SELECT count(*) AS n, corr(n_rows, m) AS r FROM s) SELECT n, round(r, 6) AS r, round(" + P.student(PEARSON_T, "n - 2") + ", 6) AS p FROM c")
def _(spark, sf):
    return shaped(X.pearson(sizes(spark, sf), "n_rows", "m"), n="int", r="num", p="num")


@query("mann_whitney", T + "," + SIZES + """,
rk AS (SELECT pct BETWEEN 88 AND 92 AS flag, round(m, 3) AS m, rank() OVER (ORDER BY round(m, 3)) + (count(*) OVER (PARTITION BY round(m, 3)) - 1) / 2.0 AS r FROM s),
ties AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM rk GROUP BY m)),
us AS (SELECT count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n2,
       sum(r) FILTER (flag) - count(*) FILTER (flag) * (count(*) FILTER (flag) + 1) / 2.0 AS u,
       round(avg(m) FILTER (flag), 6) AS mean1, round(avg(m) FILTER (NOT flag), 6) AS mean2 FROM rk)
SELECT n1, n2, u, mean1, mean2, round(""" + P.normal(MANN_WHITNEY_Z) + ", 6) AS p FROM us, ties")
def _(spark, sf):
    s = sizes(spark, sf).select(F.col("pct").between(88, 92).alias("flag"), F.round("m", 3).alias("m"))
    return shaped(X.mann_whitney(s, "flag", "m"), n1="int", n2="int", u="num", mean1="num", mean2="num", p="num")


@query("ttest_1samp", T + "," + SIZES + """,
e AS (SELECT count(*) AS n, avg(m) AS am, stddev_samp(m) / sqrt(count(*)) AS se FROM s)
SELECT (SELECT round(""" + P.student("(am - 50) / se", "n - 1") + ", 6) FROM e) AS p, (SELECT round(am - se * " + P.student_975("n - 1") + ", 5) FROM e) AS ci_low, (SELECT round(am + se * " + P.student_975("n - 1") + """, 5) FROM e) AS ci_high,
       count(*) AS n, round((avg(m) - 50) / (stddev_samp(m) / sqrt(count(*))), 6) AS t, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std,
       round(min(m), 6) AS min, round(max(m), 6) AS max, round(avg(CAST(m < 48 AS INT)), 6) AS share_below_4800, round(avg(CAST(m < 50 AS INT)), 6) AS share_below_5000 FROM s""")
def _(spark, sf):
    got = X.ttest_1samp(sizes(spark, sf), "m", 50, (48.0, 50.0))
    got = got.withColumns({c: F.round(c, 5) for c in ("ci_low", "ci_high")})  # the SQL quantile is an expansion
    return shaped(got, p="num", ci_low="num", ci_high="num", n="int", t="num", mean="num", std="num", min="num", max="num", share_below_4800="num", share_below_5000="num")


R = with_cte(RESPONSE)


@query("variance_parts", R + """,
e AS (SELECT entity, avg(value) AS rm FROM grid GROUP BY 1), t AS (SELECT target, avg(value) AS cm FROM grid GROUP BY 1),
g AS (SELECT avg(value) AS gm FROM grid),
v AS (SELECT (SELECT var_samp(rm) FROM e) AS ve, (SELECT var_samp(cm) FROM t) AS vt, (SELECT var_samp(value - rm - cm + gm) FROM grid JOIN e USING (entity) JOIN t USING (target), g) AS vr)
SELECT round(ve, 6) AS var_entity, round(vt, 6) AS var_target, round(vr, 6) AS var_residual, round(100 * ve / (ve + vt + vr), 6) AS pct_entity,
       round(100 * vt / (ve + vt + vr), 6) AS pct_target, round(100 * vr / (ve + vt + vr), 6) AS pct_residual FROM v""")
def _(spark, sf):
    return shaped(X.variance_parts(grid(spark, sf)), var_entity="num", var_target="num", var_residual="num", pct_entity="num",
                  pct_target="num", pct_residual="num")


@query("within_variance", R + """
SELECT round((SELECT avg(v) FROM (SELECT var_samp(value) AS v FROM grid GROUP BY entity)), 6) AS mean_entity_variance,
       round((SELECT avg(v) FROM (SELECT var_samp(value) AS v FROM grid GROUP BY target)), 6) AS mean_target_variance""")
def _(spark, sf):
    return shaped(X.within_variance(grid(spark, sf)), mean_entity_variance="num", mean_target_variance="num")


def draw_sql(ids: str, n: int) -> str:
    def pick(tag):
        return f"CAST('0x' || substr(md5(concat_ws('|', '42', '{tag}', CAST(d AS VARCHAR))), 1, 15) AS BIGINT) % n"

    return f"""
codes AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS code FROM (SELECT DISTINCT entity FROM {ids})),
total AS (SELECT count(*) AS n FROM codes),
draws AS (SELECT d AS draw, {pick('i')} AS i, {pick('j')} AS j, n FROM range(0, {3 * n}) AS t(d), total),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY draw) AS rn FROM draws WHERE i <> j) WHERE rn <= least({n}, n * (n - 1) // 2)),
pairs AS (SELECT draw, a.entity AS a, b.entity AS b FROM kept JOIN codes a ON a.code = i JOIN codes b ON b.code = j)"""


SIMILAR = """
psim AS (SELECT draw, a, b, len(list_intersect(x.bits, y.bits)) / CAST(len(x.bits) + len(y.bits) - len(list_intersect(x.bits, y.bits)) AS DOUBLE) AS similarity
         FROM pairs JOIN bits x ON x.entity = a JOIN bits y ON y.entity = b)"""

SHARED = """
shared AS (SELECT draw, va.value AS va, vb.value AS vb FROM pairs JOIN grid va ON va.entity = a JOIN grid vb ON vb.entity = b AND vb.target = va.target),
sr AS (SELECT draw, rank() OVER (PARTITION BY draw ORDER BY va) + (count(*) OVER (PARTITION BY draw, va) - 1) / 2.0 AS ra,
              rank() OVER (PARTITION BY draw ORDER BY vb) + (count(*) OVER (PARTITION BY draw, vb) - 1) / 2.0 AS rb FROM shared),
resp AS (SELECT draw, count(*) AS n_shared, corr(ra, rb) AS response FROM sr GROUP BY draw HAVING count(*) >= 10 AND corr(ra, rb) IS NOT NULL)"""


@query("sample_pairs", with_cte(BITS) + "," + draw_sql("bits", 5000) + "SELECT draw, a, b FROM pairs")
def _(spark, sf):
    return S.sample_pairs(bits(spark, sf), 5000)


@query("sampled_pair_similarity", with_cte(BITS) + "," + draw_sql("bits", 5000) + "," + SIMILAR + "SELECT draw, a, b, round(similarity, 6) AS similarity FROM psim")
def _(spark, sf):
    b = bits(spark, sf)
    return shaped(S.pair_similarity(S.sample_pairs(b, 5000), b), "draw", "a", "b", similarity="num")


@query("response_similarity", R + "," + draw_sql("grid", 5000) + "," + SHARED + "SELECT draw, n_shared, round(response, 6) + 0.0 AS response FROM resp")
def _(spark, sf):
    g = grid(spark, sf)
    return shaped(X.response_similarity(S.sample_pairs(g, 5000), g), "draw", n_shared="int", response="num")


BOTH = with_cte(RESPONSE, BITS) + ", few AS (SELECT grid.* FROM grid JOIN bits USING (entity))," + draw_sql("few", 5000) + "," + SHARED + "," + SIMILAR


def _both(spark, sf):
    g, b = grid(spark, sf), bits(spark, sf)
    pairs = materialize(S.sample_pairs(g.join(b.select("entity"), "entity", "left_semi"), 5000))
    return S.pair_similarity(pairs, b), X.response_similarity(pairs, g)


@query("similarity_vs_response", BOTH + """,
j AS (SELECT round(similarity, 9) AS s, round(response, 9) AS r FROM psim JOIN resp USING (draw)),
k AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS rr FROM j),
c AS (SELECT count(*) AS n, corr(rs, rr) AS r FROM k)
SELECT n, round(r, 6) AS spearman, round(100 * r * r, 6) AS r_squared_pct, round(""" + P.student(PEARSON_T, "n - 2") + ", 6) AS p FROM c")
def _(spark, sf):
    sim, resp = _both(spark, sf)
    got = X.similarity_vs_response(sim.withColumn("similarity", F.round("similarity", 9)), resp.withColumn("response", F.round("response", 9)))
    return shaped(got, n="int", spearman="num", r_squared_pct="num", p="num")


@query("similarity_bins", BOTH + """,
j AS (SELECT CASE WHEN similarity < .3 THEN 0 WHEN similarity < .5 THEN 1 WHEN similarity < .7 THEN 2 WHEN similarity < 1.01 THEN 3 END AS bin, response FROM psim JOIN resp USING (draw))
SELECT bin, count(*) AS n, round(avg(response), 6) + 0.0 AS mean_value FROM j GROUP BY bin HAVING count(*) > 10""")
def _(spark, sf):
    sim, resp = _both(spark, sf)
    return shaped(bin_stats(sim.join(resp, "draw"), "similarity", "response"), bin="int", n="int", mean_value="num")


ACTIVE_AT = -0.35
#: Bits of the pair similarities in the report: name, first bit, end.
HALVES = (("all bits", 0, 64), ("low bits", 0, 32), ("high bits", 32, 64))


def _half_sql(place: int, low: int, high: int) -> str:
    def own(t):
        return f"list_filter({t}.bits, lambda i: i >= {low} AND i < {high})"

    shared = f"len(list_intersect({own('x')}, {own('y')}))"
    return f"""
j{place} AS (SELECT round({shared} / nullif(CAST(len({own('x')}) + len({own('y')}) - {shared} AS DOUBLE), 0), 9) AS s, round(response, 9) AS r
       FROM pairs JOIN bits x ON x.entity = a JOIN bits y ON y.entity = b JOIN resp USING (draw)),
k{place} AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS rr FROM j{place} WHERE s IS NOT NULL),
c{place} AS (SELECT count(*) AS n, corr(rs, rr) AS r FROM k{place})"""


def _finding_sql(hypothesis: str, test: str, statistic: str, p: str, meaning: str, src: str) -> str:
    shown = "'n/a'" if not p else f"coalesce(printf('%.4e', {p}), 'n/a')"
    return f"SELECT 'default' AS configuration, '{hypothesis}' AS hypothesis, '{test}' AS test, coalesce({statistic}, 'n/a') AS statistic, {shown} AS p_value, coalesce({meaning}, 'n/a') AS interpretation FROM {src}"


REPORT = with_cte(METRICS, RESPONSE, BITS, PREDICTIONS) + ", few AS (SELECT grid.* FROM grid JOIN bits USING (entity))," + draw_sql("few", 5000).replace(
    "kept", "drawn") + "," + SHARED + "," + CONSENSUS + "," + UNPIVOTED + "," + curve_sql("threes", "lang, score", "certainty", "p_mean", TENS) + f""",
t AS (SELECT model, n_name AS target, metric FROM metrics JOIN nation ON n_nationkey = metrics.target % 25 WHERE split = 'Train_Test'),
kw AS (SELECT model, metric, rank() OVER (ORDER BY metric) + (count(*) OVER (PARTITION BY metric) - 1) / 2.0 AS r FROM t),
kg AS (SELECT model, sum(r) AS s, count(*) AS n, avg(metric) AS m FROM kw GROUP BY model),
kt AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY metric)),
ka AS (SELECT count(*) AS g, CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS ss, max(m) - min(m) AS mr FROM kg),
kh AS (SELECT g, mr, (12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h FROM ka, kt),
ends AS (SELECT max(auc) FILTER (coverage = 10) - max(auc) FILTER (coverage = 100) AS d FROM curve WHERE score = 'class_lag' GROUP BY lang),
wr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM ends WHERE d <> 0),
wt AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM wr GROUP BY abs(d))),
ww AS (SELECT count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, (SELECT avg(d) FROM ends) AS gain FROM wr),
tm AS (SELECT target, avg(metric) AS m FROM t GROUP BY target),
sz AS (SELECT target, m, CAST(count(*) AS DOUBLE) AS n_cells, 100.0 * avg(CAST(value <= {ACTIVE_AT} AS INT)) AS pct FROM tm JOIN grid USING (target) GROUP BY target, m),
ps AS (SELECT count(*) AS n, corr(n_cells, m) AS r FROM sz), pb AS (SELECT count(*) AS n, corr(pct, m) AS r FROM sz),
mr AS (SELECT pct BETWEEN 40 AND 60 AS flag, m, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r FROM sz),
mt AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM mr GROUP BY m)),
mu AS (SELECT count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n2, sum(r) FILTER (flag) - count(*) FILTER (flag) * (count(*) FILTER (flag) + 1) / 2.0 AS u,
       avg(m) FILTER (flag) AS mean1, avg(m) FILTER (NOT flag) AS mean2 FROM mr),
te AS (SELECT count(*) AS n, avg(m) AS am, stddev_samp(m) / sqrt(count(*)) AS se FROM tm),
tab AS (SELECT coverage, avg(auc) AS mean_auc FROM curve WHERE score = 'cons_std_prob' GROUP BY coverage),
gain AS (SELECT max(mean_auc) AS best, (SELECT coverage FROM tab ORDER BY round(mean_auc, 12) DESC NULLS LAST, coverage LIMIT 1) AS level, max(mean_auc) FILTER (coverage = 100) AS whole FROM tab),
ge AS (SELECT entity, avg(value) AS rm FROM grid GROUP BY 1), gt AS (SELECT target, avg(value) AS cm FROM grid GROUP BY 1), gg AS (SELECT avg(value) AS gm FROM grid),
gv AS (SELECT (SELECT var_samp(rm) FROM ge) AS ve, (SELECT var_samp(cm) FROM gt) AS vt, (SELECT var_samp(value - rm - cm + gm) FROM grid JOIN ge USING (entity) JOIN gt USING (target), gg) AS vr),
gw AS (SELECT (SELECT avg(v) FROM (SELECT var_samp(value) AS v FROM grid GROUP BY entity)) AS me, (SELECT avg(v) FROM (SELECT var_samp(value) AS v FROM grid GROUP BY target)) AS mt),""" + ",".join(
    _half_sql(place, low, high) for place, (_, low, high) in enumerate(HALVES)) + "\n" + "\nUNION ALL ".join([
    _finding_sql("H1 - algorithm", "Kruskal-Wallis of the metric across models", "printf('H=%.4f; range=%.4f', h, mr)", P.chi2("h", "g - 1"),
                 "printf('Mean metrics of the models lie within %.4f of each other.', mr)", "kh"),
    _finding_sql("H1 - reliability", "Paired Wilcoxon of AUC at 10 % and at full coverage", "printf('W=%.1f; gain=%.4f', w, gain)", P.normal(WILCOXON_Z),
                 "'A large gain means that the most certain predictions are the good ones.'", "ww, wt"),
    _finding_sql("H2 - data amount", "Pearson r of cells and mean metric", "printf('r=%.4f', r)", P.student(PEARSON_T, "n - 2"), "'Do targets with more data score higher?'", "ps"),
    _finding_sql("H2 - balance", "Pearson r of percentage active and mean metric", "printf('r=%.4f', r)", P.student(PEARSON_T, "n - 2"), "'Does the share of actives explain the metric?'", "pb"),
    _finding_sql("H2 - balance, two groups", "Mann-Whitney of balanced and other targets", "printf('U=%.1f; balanced=%.4f; other=%.4f', u, mean1, mean2)", P.normal(MANN_WHITNEY_Z),
                 "printf('%d balanced targets against %d others.', n1, n2)", "mu, mt"),
    _finding_sql("H3 - ranking", "One-sample t of the target means", "printf('t=%.4f; mean=%.4f; CI=[%.4f,%.4f]', (am - 50) / se, am, am - se * " + P.student_975("n - 1") + ", am + se * " + P.student_975("n - 1") + ")",
                 P.student("(am - 50) / se", "n - 1"), "'AUC needs no cutoff: a low one is weak ranking, not poor calibration alone.'", "te"),
    _finding_sql("Reliability - consensus", "Best coverage by consensus certainty against full coverage", "printf('best=%.4f at %d%%; full=%.4f; gain=%.4f', best, level, whole, best - whole)", "",
                 "'Does agreement of the models pick entities that are predicted better?'", "gain"),
    _finding_sql("H4 - features, variance", "Additive variance decomposition", "printf('entity=%.1f%%; target=%.1f%%; residual=%.1f%%', 100 * ve / (ve + vt + vr), 100 * vt / (ve + vt + vr), 100 * vr / (ve + vt + vr))", "",
                 "'Features of an entity alone reach its own share at most.'", "gv"),
    *[_finding_sql(f"H4 - features, similarity by {name}", "Rank correlation of pair similarity and response similarity", "printf('rs=%.4f; pairs=%d', r, n)", P.student(PEARSON_T, "n - 2"),
                   "printf('Similarity explains %.2f%% of the ranks of response similarity.', 100 * r * r)", f"c{place}") for place, (name, _, _) in enumerate(HALVES)],
    _finding_sql("H4 - features, within", "Mean variance inside entities and targets", "printf('entity=%.4f; target=%.4f', me, mt)", "",
                 "'High variance inside entities: the target decides what an entity does.'", "gw"),
])


@query("diagnostic_report", REPORT)
def _(spark, sf):
    g, b = grid(spark, sf), bits(spark, sf)
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("name"))
    results = metrics(spark, sf).join(nation, F.col("target") % 25 == F.col("_key")).drop("target", "_key").withColumnRenamed("name", "target")
    pairs = materialize(S.sample_pairs(g.join(b.select("entity"), "entity", "left_semi"), 5000))
    response = materialize(X.response_similarity(pairs, g).withColumn("response", F.round("response", 9)))
    similarities = {}
    for name, low, high in HALVES:
        part = b.withColumn("bits", F.filter("bits", lambda i: (i >= low) & (i < high)))
        similarities[name] = (S.pair_similarity(pairs, part).withColumn("similarity", F.round("similarity", 9)), response)
    return diagnose_metrics(
        results, g, mu=50.0, active_at=ACTIVE_AT, curves=certainty_curves(certain(spark, sf), "lang"), curve_target="lang", similarities=similarities)

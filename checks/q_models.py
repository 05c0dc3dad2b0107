"""Model queries: closed-form ones against SQL, Spark ML ones by rows."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.bindings import table
from checks.q_reliability import CONSENSUS, FINE, UNPIVOTED, curve_sql
from checks.registry import query, r, shaped
from titerflow.functions.columns import class_lag, std_prob
from titerflow.models import elastic
from titerflow.models import estimators as E
from titerflow.models import native as N
from titerflow.models.elastic import draw_settings
from titerflow.models.forest import forest_predictions
from titerflow.operators.reliability import certainty_curves, coverage_comparison, coverage_grid
from titerflow.operators.splits import random_split
from titerflow.operators.summaries import cv_summary
from titerflow.plans import applicability as A
from titerflow.session import temp_table_path

ROWS = """
rows0 AS (
  SELECT vec_id AS entity, 'even' AS target, 1 - label % 2 AS label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS side, embedding AS v FROM embeddings
  UNION ALL
  SELECT vec_id, 'low', CAST(label < 5 AS INT), CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END, embedding FROM embeddings)"""


def rows(spark, sf):
    emb = table(spark, sf, "embeddings")
    tasks = F.array(
        F.struct(F.lit("even").alias("target"), (1 - F.col("label") % 2).cast("int").alias("label")),
        F.struct(F.lit("low").alias("target"), (F.col("label") < 5).cast("int").alias("label")),
    )
    return emb.withColumn("t", F.explode(tasks)).select(
        F.col("vec_id").alias("entity"), "t.target", "t.label",
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("side"),
        F.col("embedding").cast("array<double>").alias("v"))


def vector_rows(spark, sf):
    return E.dense_vectors(rows(spark, sf))


@query("gaussian_nb", "WITH " + ROWS.strip() + """,
cellz AS (SELECT target, label, i AS f, CAST(v[i] AS DOUBLE) AS x FROM rows0 CROSS JOIN range(1, 65) AS t(i) WHERE side = 'train'),
st AS (SELECT target, label, f, avg(x) AS m, var_pop(x) AS s FROM cellz GROUP BY ALL),
eps AS (SELECT target, 0.01 * max(vp) AS eps FROM (SELECT target, f, var_pop(x) AS vp FROM cellz GROUP BY ALL) GROUP BY target),
pri AS (SELECT target, label, count(*) AS n FROM rows0 WHERE side = 'train' GROUP BY ALL),
ll AS (SELECT r.target, r.entity, st.label AS c, sum(-0.5 * ln(2 * pi() * (s + eps)) - (v[f] - m) * (v[f] - m) / (2 * (s + eps))) + ln(any_value(pri.n)) AS l
       FROM rows0 r JOIN st ON st.target = r.target JOIN eps ON eps.target = r.target JOIN pri ON pri.target = r.target AND pri.label = st.label
       WHERE r.side = 'test' GROUP BY ALL)
SELECT a.target, a.entity, round(1 / (1 + exp(a.l - b.l)), 6) AS p FROM ll a JOIN ll b ON a.target = b.target AND a.entity = b.entity AND a.c = 0 AND b.c = 1""")
def _(spark, sf):
    every = rows(spark, sf)
    got = N.gaussian_nb(every.where("side = 'train'"), every.where("side = 'test'"), smoothing=1e-2)
    return shaped(got, "target", "entity", p="num")


@query("knn_probability", "WITH " + ROWS.strip() + """,
d AS (SELECT a.target, a.entity, b.label, row_number() OVER (PARTITION BY a.target, a.entity ORDER BY round(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.v[i] AS DOUBLE) - b.v[i]) * (CAST(a.v[i] AS DOUBLE) - b.v[i]))), 9), b.entity) AS rk
      FROM rows0 a JOIN rows0 b ON a.target = b.target AND a.side = 'test' AND b.side = 'train')
SELECT target, entity, round(avg(label), 6) AS p FROM d WHERE rk <= 5 GROUP BY ALL""")
def _(spark, sf):
    every = rows(spark, sf)
    return shaped(N.knn_probability(every.where("side = 'train'"), every.where("side = 'test'")), "target", "entity", p="num")


@query("trainable_targets", """
SELECT source AS target, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg FROM documents JOIN labels USING (doc_id)
GROUP BY source HAVING count(*) >= 10 AND sum(quality) BETWEEN 1 AND count(*) - 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return N.trainable_targets(docs.select(F.col("source").alias("target"), F.col("quality").alias("label")))


def _descent(grad: str, bend: float, rounds: int) -> str:
    """Accelerated gradient descent as SQL: every row's probability at the optimum of a regularised linear model.

    ``grad`` is the slope of a row's loss at the margin f of a row with sign s; ``bend`` bounds its curvature.
    """
    return "WITH RECURSIVE " + ROWS.strip() + f""",
counts AS (SELECT target, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM rows0 WHERE side = 'train' GROUP BY target),
tr AS (SELECT r.target, r.entity, list_append(CAST(r.v AS DOUBLE[]), 1.0) AS z, 2.0 * label - 1 AS s,
         (pos + neg) / (2.0 * CASE WHEN label = 1 THEN pos ELSE neg END) AS w FROM rows0 r JOIN counts USING (target) WHERE side = 'train'),
col AS (SELECT target, j, list(z[j] ORDER BY entity) AS c FROM tr CROSS JOIN range(1, 66) AS t(j) GROUP BY target, j),
lip AS (SELECT target, 1 + {bend} * sum(w * list_dot_product(z, z)) AS l FROM tr GROUP BY target),
it AS (
  SELECT target, l, 0 AS i, list_transform(range(0, 65), lambda j: 0.0::DOUBLE) AS b, list_transform(range(0, 65), lambda j: 0.0::DOUBLE) AS a FROM lip
  UNION ALL
  SELECT target, l, i + 1, n, list_transform(range(1, 66), lambda j: n[j] + (sqrt(l) - 0.5) / (sqrt(l) + 0.5) * (n[j] - b[j])) FROM (
    SELECT q.target, any_value(l) AS l, any_value(i) AS i, any_value(b) AS b,
        list(a[j] - (CASE WHEN j = 65 THEN 0 ELSE a[j] END + list_dot_product(c, g)) / l ORDER BY j) AS n FROM (
      SELECT it.target, any_value(l) AS l, any_value(i) AS i, any_value(b) AS b, any_value(a) AS a, list(w * ({grad}) ORDER BY entity) AS g
      FROM (SELECT it.*, tr.entity, tr.w, tr.s, list_dot_product(tr.z, it.a) AS f FROM it JOIN tr ON tr.target = it.target WHERE i < {rounds}) AS it GROUP BY it.target) AS q
    JOIN col ON col.target = q.target GROUP BY q.target)),
fin AS (SELECT target, b FROM it WHERE i = {rounds}),
m AS (SELECT r.target, r.entity, r.side, list_dot_product(list_append(CAST(r.v AS DOUBLE[]), 1.0), b) AS f FROM rows0 r JOIN fin USING (target))
SELECT target, entity, side, round(greatest(least(1 / (1 + exp(-f)), 1 - 1e-6), 1e-6), 6) AS p FROM m"""


LOGIT = _descent("-s / (1 + exp(s * f))", 0.25, 600)
HINGE = _descent("-2 * s * greatest(0, 1 - s * f)", 2.0, 1500)


def _linear(model):
    def run(spark, sf):
        return shaped(E.score_rows(rows(spark, sf), model, strategy="class_weight"), "target", "entity", "side", p="num")

    return run


query("fit_logistic", LOGIT)(_linear("logit"))
query("fit_linear_svm", HINGE)(_linear("linear_svm"))


def _scored(model, **params):
    def run(spark, sf):
        scored = E.fit_targets(vector_rows(spark, sf), model, strategy="class_weight", **params)[1]
        return scored.select("target", "entity", "side", r("p").alias("p"))

    return run


@query("fit_random_forest")
def _(spark, sf):
    scored = forest_predictions(rows(spark, sf), "class_weight", num_trees=100)
    return scored.select("target", "entity", "side", r("p").alias("p"))


query("fit_boosted_trees")(_scored("gbt"))


def regression_rows(spark, sf):
    emb = table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    y = v[0] * 2.0 - v[1] + v[2] * v[3]
    fold = (F.col("vec_id") % 5 + 1).cast("int")
    return E.dense_vectors(emb.select(F.col("vec_id").alias("entity"), fold.alias("fold"), v.alias("v"), y.alias("label")))


def _net_sql(settings: list[tuple[int, float, float]], scaled: bool, parts: str, rounds: int = 400) -> str:
    """Accelerated proximal gradient descent on each part's own products: fits ``n`` with coefficients ``b`` and intercept ``i0``."""
    values = ", ".join(f"({i}, {a!r}::DOUBLE, {x!r}::DOUBLE)" for i, a, x in settings)
    spread = "greatest(stddev_pop(x), 1e-300)" if scaled else "1.0"
    return f"""WITH RECURSIVE reg AS (SELECT vec_id AS entity, vec_id % 5 + 1 AS fold, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
y AS (SELECT *, v[1] * 2 - v[2] + v[3] * v[4] AS y FROM reg),
part AS ({parts}),
tr AS (SELECT held, entity, v, y.y FROM y JOIN part ON y.fold <> part.held),
my AS (SELECT held, avg(y) AS my, count(*) AS n FROM tr GROUP BY held),
st AS (SELECT held, j, avg(x) AS m, {spread} AS sd FROM (SELECT held, j, v[j] AS x FROM tr CROSS JOIN range(1, 65) AS t(j)) GROUP BY held, j),
col AS (SELECT tr.held, st.j, any_value(m) AS m, any_value(sd) AS sd, list((v[st.j] - m) / sd ORDER BY entity) AS c, list(tr.y - my ORDER BY entity) AS yc
        FROM tr JOIN st ON st.held = tr.held JOIN my ON my.held = tr.held GROUP BY tr.held, st.j),
gram AS (SELECT a.held, a.j, list(list_dot_product(a.c, b.c) / len(a.c) ORDER BY b.j) AS g, any_value(list_dot_product(a.c, a.yc)) / any_value(len(a.c)) AS t
         FROM col a JOIN col b ON a.held = b.held GROUP BY a.held, a.j),
lip AS (SELECT held, sum(g[j]) AS tr FROM gram GROUP BY held),
s AS (SELECT * FROM (VALUES {values}) AS d(draw, alpha, l1)),
it AS (
  SELECT draw, held, alpha, l1, tr + alpha * (1 - l1) AS l, 0 AS i, list_transform(range(0, 64), lambda j: 0.0::DOUBLE) AS b, list_transform(range(0, 64), lambda j: 0.0::DOUBLE) AS a
  FROM s CROSS JOIN lip
  UNION ALL
  SELECT draw, held, alpha, l1, l, i + 1, n, list_transform(range(1, 65), lambda j: n[j] + 0.85 * (n[j] - b[j])) FROM (
    SELECT draw, held, any_value(alpha) AS alpha, any_value(l1) AS l1, any_value(l) AS l, any_value(i) AS i, any_value(b) AS b,
        list(sign(u) * greatest(abs(u) - alpha * l1 / l, 0) ORDER BY j) AS n FROM (
      SELECT draw, it.held, alpha, l1, l, i, b, j, a[j] - (list_dot_product(g, a) - t + alpha * (1 - l1) * a[j]) / l AS u FROM it JOIN gram ON gram.held = it.held WHERE i < {rounds})
    GROUP BY draw, held)),
fin AS (SELECT draw, it.held, any_value(alpha) AS alpha, any_value(l1) AS l1, list(b[j] / sd ORDER BY j) AS b, any_value(my) - sum(b[j] / sd * m) AS i0, any_value(n) AS n
        FROM it JOIN st ON st.held = it.held JOIN my ON my.held = it.held WHERE i = {rounds} GROUP BY draw, it.held)"""


FOLDS = "SELECT unnest(range(1, 6)) AS held"
SETTINGS = draw_settings(20, 42)


@query("fit_elastic_net", _net_sql([(0, 0.01, 0.5)], False, "SELECT 1 AS held", 3000) + """
SELECT entity, round(y, 6) + 0.0 AS truth, round(list_dot_product(v, b) + i0, 6) + 0.0 AS predicted FROM y CROSS JOIN fin WHERE fold = 1""")
def _(spark, sf):
    data = regression_rows(spark, sf)
    model = elastic.elastic_net(data.where("entity % 5 <> 0"), 0.01, 0.5)
    scored = elastic.predict(model, data.where("entity % 5 = 0"))
    return scored.select("entity", r("label").alias("truth"), r("predicted").alias("predicted"))


@query("random_search", _net_sql(SETTINGS, True, FOLDS) + """,
e AS (SELECT draw, held, alpha, l1, y.y, y.y - list_dot_product(v, b) - i0 AS e FROM fin JOIN y ON y.fold = fin.held),
f AS (SELECT draw, held, any_value(alpha) AS alpha, any_value(l1) AS l1, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY draw, held)
SELECT CAST(draw AS INT) AS draw, round(any_value(alpha), 6) AS alpha, round(any_value(l1), 6) AS l1_ratio, round(avg(r2), 6) + 0.0 AS cv_r2_mean, round(stddev_pop(r2), 6) + 0.0 AS cv_r2_std
FROM f GROUP BY draw""")
def _(spark, sf):
    result = E.random_search(regression_rows(spark, sf), "elastic_net", n_iter=20, folds=5)[1]
    return shaped(result, "draw", alpha="num", l1_ratio="num", cv_r2_mean="num", cv_r2_std="num")


@query("elastic_net_folds", _net_sql(SETTINGS, True, FOLDS) + """
SELECT CAST(draw AS INT) AS draw, CAST(held AS INT) AS fold, CAST(n AS BIGINT) AS n_train, j, round(b[j], 5) + 0.0 AS coefficient FROM fin CROSS JOIN range(1, 65) AS t(j)""")
def _(spark, sf):
    fits = elastic.search_elastic_net(regression_rows(spark, sf), 20, 5)[2]
    long = fits.select("draw", "fold", F.col("n_train").cast("bigint").alias("n_train"), F.posexplode("coefficients").alias("j", "b"))
    return long.select("draw", "fold", "n_train", (F.col("j") + 1).cast("bigint").alias("j"), r("b", 5).alias("coefficient"))


#: Naive Bayes for the split (held 0) and five folds, columns standardised on each training set.
FOLDED = "WITH " + ROWS.strip() + """,
fr AS (SELECT *, CAST(floor(entity / 3) AS BIGINT) % 5 + 1 AS fold FROM rows0),
h AS (SELECT unnest(range(0, 6)) AS held),
tr AS (SELECT h.held, fr.* FROM fr JOIN h ON CASE WHEN held = 0 THEN side = 'train' ELSE fold <> held END),
sc AS (SELECT held, j, stddev_pop(v[j]) AS sd FROM (SELECT DISTINCT held, entity, v FROM tr) CROSS JOIN range(1, 65) AS t(j) GROUP BY held, j),
ce AS (SELECT held, target, label, j, CAST(v[j] AS DOUBLE) AS x FROM tr CROSS JOIN range(1, 65) AS t(j)),
st AS (SELECT held, target, label, j, avg(x) AS m, var_pop(x) AS s FROM ce GROUP BY ALL),
ep AS (SELECT held, target, 0.01 * max(q / (sd * sd)) AS e FROM (SELECT held, target, j, var_pop(x) AS q FROM ce GROUP BY ALL) JOIN sc USING (held, j) GROUP BY held, target),
pr AS (SELECT held, target, label, count(*) AS n FROM tr GROUP BY ALL),
ll AS (SELECT st.held, fr.target, fr.entity, st.label AS c, sum(-0.5 * ln(s + e * sd * sd) - (v[j] - m) * (v[j] - m) / (2 * (s + e * sd * sd))) + ln(any_value(pr.n)) AS l
       FROM fr JOIN st ON st.target = fr.target AND (st.held = 0 OR st.held = fr.fold) JOIN sc USING (held, j) JOIN ep ON ep.held = st.held AND ep.target = st.target
       JOIN pr ON pr.held = st.held AND pr.target = st.target AND pr.label = st.label GROUP BY st.held, fr.target, fr.entity, st.label),
sp AS (SELECT a.held, a.target, a.entity, fr.label, 1 / (1 + exp(a.l - b.l)) AS p,
         CASE WHEN a.held > 0 THEN 'Fold_' || a.held WHEN side = 'train' THEN 'Train_Train' ELSE 'Train_Test' END AS split
       FROM ll a JOIN ll b ON a.held = b.held AND a.target = b.target AND a.entity = b.entity AND a.c = 0 AND b.c = 1 JOIN fr ON fr.target = a.target AND fr.entity = a.entity),
rk AS (SELECT *, rank() OVER (PARTITION BY target, split ORDER BY p) + (count(*) OVER (PARTITION BY target, split, p) - 1) / 2.0 AS r FROM sp),
me AS (SELECT target, split, count(*) FILTER (label = 1 AND p >= 0.5) AS tp, count(*) FILTER (label = 0 AND p < 0.5) AS tn,
         count(*) FILTER (label = 0 AND p >= 0.5) AS fp, count(*) FILTER (label = 1 AND p < 0.5) AS fn,
         (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM rk GROUP BY target, split)"""


def folded_rows(spark, sf):
    return rows(spark, sf).withColumn("fold", (F.floor(F.col("entity") / 3) % 5 + 1).cast("int"))


def _folded_grid(spark, sf):
    return E.run_grid({"raw": folded_rows(spark, sf)}, ["gaussian_nb"], {"fixed": lambda df: df}, folds=5, scaler="standard", smoothing=1e-2)


@query("grid_folds", FOLDED + " SELECT target, split, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(auc, 6) AS auc FROM me")
def _(spark, sf):
    return shaped(_folded_grid(spark, sf), "target", "split", tp="int", tn="int", fp="int", fn="int", accuracy="num", auc="num")


@query("grid_cv_summary", FOLDED + """, t AS (SELECT target, avg(auc) AS a FROM me WHERE split LIKE 'Fold%' GROUP BY target)
SELECT 'gaussian_nb' AS model, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS std, count(*) AS n_targets FROM t""")
def _(spark, sf):
    folds = _folded_grid(spark, sf).where("split like 'Fold%'")
    return shaped(cv_summary(folds, "auc", "target", "model", fold="split"), "model", mean="num", std="num", n_targets="int")


SMOOTHINGS = (1e-9, 1e-3, 1e-2, 0.05, 0.1, 0.2, 0.5, 1.0)
#: The same rows as FOLDED, one score per smoothing.
MANY = FOLDED.replace("0.01 * max(q / (sd * sd)) AS e FROM (", "k, k * max(q / (sd * sd)) AS e FROM (SELECT unnest([" + ", ".join(map(repr, SMOOTHINGS)) + "]) AS k) CROSS JOIN (").replace(
    "GROUP BY held, target),\npr", "GROUP BY held, target, k),\npr").replace("fr.entity, st.label AS c,", "fr.entity, k, st.label AS c,").replace(
    "GROUP BY st.held, fr.target, fr.entity, st.label)", "GROUP BY st.held, fr.target, fr.entity, st.label, k)").replace(
    "a.entity, fr.label, 1 /", "a.entity, a.k, fr.label, 1 /").replace("a.entity = b.entity AND a.c = 0", "a.entity = b.entity AND a.k = b.k AND a.c = 0").split(",\nrk AS")[0]


def _store(spark, sf):
    path = temp_table_path(spark, f"predictions-{uuid.uuid4().hex}")
    models = {f"nb_{k}": ("gaussian_nb", {"smoothing": k}) for k in SMOOTHINGS}
    return folded_rows(spark, sf), models, path


@query("out_of_fold_predictions", MANY + " SELECT target, entity, CAST(held AS INT) AS fold, round(k, 9) AS smoothing, round(p, 6) AS p FROM sp WHERE held > 0")
def _(spark, sf):
    data, models, path = _store(spark, sf)
    first = dict(list(models.items())[:3])
    A.update_predictions(data.where("target = 'low'"), first, path)  # the second call makes what is missing
    A.update_predictions(data, models, path)
    got = A.current_predictions(data, models, path)
    return shaped(got.withColumn("smoothing", F.round(F.substring("model", 4, 30).cast("double"), 9)), "target", "entity", "fold", "smoothing", p="num")


@query("models_to_coverage", MANY + ", scores AS (SELECT target AS lang, entity, label, p FROM sp WHERE held > 0)," + CONSENSUS + "," + UNPIVOTED + "," + curve_sql("threes", "lang, score", "certainty", "p_mean", FINE) + """
SELECT coverage, round(avg(auc) FILTER (score = 'class_lag'), 6) AS auc_class_lag, round(avg(auc) FILTER (score = 'cons_std'), 6) AS auc_cons_std,
  round(avg(auc) FILTER (score = 'cons_std_prob'), 6) AS auc_cons_std_prob, count(auc) FILTER (score = 'class_lag') AS valid_class_lag FROM curve GROUP BY coverage""")
def _(spark, sf):
    data, models, path = _store(spark, sf)
    A.update_predictions(data, models, path)
    rows = A.certain_predictions(A.current_predictions(data, models, path))
    # both engines compare rounded scores, so that ties are ties in both
    rows = rows.withColumns({"p_mean": F.round("p_mean", 8), "p_std": F.round("p_std", 8)})
    rows = rows.withColumns({"class_lag": F.round(class_lag("p_mean"), 7), "cons_std": F.round("p_std", 7), "cons_std_prob": F.round(std_prob("p_mean", "p_std"), 7)})
    got = coverage_comparison(certainty_curves(rows, "target", coverage_grid(True)))
    return shaped(got, coverage="int", auc_class_lag="num", auc_cons_std="num", auc_cons_std_prob="num", valid_class_lag="int")


@query("run_grid")
def _(spark, sf):
    every = folded_rows(spark, sf)
    sets = {"raw": E.dense_vectors(every), "abs": E.dense_vectors(every.withColumn("v", F.transform("v", F.abs)))}
    splits = {"random": lambda df: random_split(df.drop("side"), by="target"), "fixed": lambda df: df}
    return E.run_grid(sets, ["gaussian_nb", "knn", "logit", "linear_svm", "unknown"], splits, "class_weight", folds=5, scaler="standard")


@query("save_list_score_models")
def _(spark, sf):
    path = temp_table_path(spark, f"models-{uuid.uuid4().hex}")
    data = vector_rows(spark, sf)
    models, _ = E.fit_targets(data, "logit")
    E.save_models(spark, models, path, {name: {"threshold": 0.5, "model": "logit"} for name in models})
    out = None
    for row in E.list_models(spark, path).orderBy("target").collect():
        mine = data.where(F.col("target") == row["target"])
        part = E.score(mine, E.load_model(spark, path, row["model_id"]), row["threshold"])
        part = part.select("target", "entity", "predicted")
        out = part if out is None else out.unionByName(part)
    return out


@query("skipped_targets", """
SELECT source AS target, count(*) FILTER (doc_id % 5 <> 0) AS n_train FROM documents JOIN labels USING (doc_id) GROUP BY source
HAVING count(*) FILTER (doc_id % 5 <> 0 AND quality IS NOT NULL) < 10 OR count(DISTINCT CASE WHEN doc_id % 5 <> 0 THEN quality END) < 2""")
def _(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    data = docs.select(F.col("source").alias("target"), F.col("quality").alias("label"),
                       F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("side"))
    return E.skipped_targets(data).select("target", "n_train")

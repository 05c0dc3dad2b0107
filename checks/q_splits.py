"""Split, scaling and imbalance queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import BITS, PREDICTIONS, bits, scored, table, with_cte
from checks.registry import query, r, shaped
from titerflow.operators import scaling as X
from titerflow.operators import splits as S

P = with_cte(PREDICTIONS)


def H(seed, *cols):
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


@query("random_split", f"""
SELECT p_partkey AS entity, CASE WHEN row_number() OVER (ORDER BY {H(42, 'p_partkey')}) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS side FROM part""")
def _(spark, sf):
    return S.random_split(table(spark, sf, "part").select(F.col("p_partkey").alias("entity"))).select("entity", "side")


@query("random_split_threshold", f"""
SELECT p_partkey AS entity, CASE WHEN substr({H(42, 'p_partkey')}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS side FROM part""")
def _(spark, sf):
    return S.random_split(table(spark, sf, "part").select(F.col("p_partkey").alias("entity")), exact=False).select("entity", "side")


@query("random_split_by_target", P + f"""
SELECT entity, target, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY {H(7, 'target', 'entity')}) <= ceil(0.2 * count(*) OVER (PARTITION BY target))
  THEN 'test' ELSE 'train' END AS side FROM scored""")
def _(spark, sf):
    return S.random_split(scored(spark, sf), 0.2, 7, by="target").select("entity", "target", "side")


@query("random_split_stratified", P + f""",
c AS (SELECT target, label, count(*) AS c FROM scored GROUP BY ALL), s AS (SELECT target, min(c) AS smallest FROM c GROUP BY target),
st AS (SELECT entity, target, CASE WHEN smallest >= 2 THEN CAST(label AS VARCHAR) ELSE 'all' END AS stratum FROM scored JOIN s USING (target))
SELECT entity, target, CASE WHEN row_number() OVER (PARTITION BY target, stratum ORDER BY {H(7, 'target', 'entity')}) <= ceil(0.2 * count(*) OVER (PARTITION BY target, stratum))
  THEN 'test' ELSE 'train' END AS side FROM st""")
def _(spark, sf):
    return S.random_split(scored(spark, sf), 0.2, 7, by="target", stratify="label").select("entity", "target", "side")


@query("repeated_split", " UNION ALL ".join(f"""
SELECT p_partkey AS entity, {seed} AS seed, CASE WHEN row_number() OVER (ORDER BY {H(seed, 'p_partkey')}) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS side FROM part""" for seed in (1, 2, 3)))
def _(spark, sf):
    return S.repeated_split(table(spark, sf, "part").select(F.col("p_partkey").alias("entity")), [1, 2, 3])


GROUPED = """
sizes AS (SELECT p_brand AS g, count(*) AS size FROM part GROUP BY 1),
run AS (SELECT g, size, sum(size) OVER (ORDER BY size DESC, g) - size AS before, sum(size) OVER () AS total FROM sizes),
sides AS (SELECT g, size, before, CASE WHEN before < floor(0.2 * total) THEN 'test' ELSE 'train' END AS side FROM run)"""


@query("group_cumsum", "WITH " + GROUPED.strip() + "SELECT g, size, CAST(before AS BIGINT) AS before, CAST(total AS BIGINT) AS total FROM run")
def _(spark, sf):
    sizes = S.group_sizes(table(spark, sf, "part").select(F.col("p_brand").alias("g")), "g")
    return S.group_cumsum(sizes, "g")


@query("group_split", "WITH " + GROUPED.strip() + "SELECT p_partkey AS entity, p_brand AS g, side FROM part JOIN sides ON g = p_brand")
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("g"))
    return S.group_split(rows, "g").select("entity", "g", "side")


@query("group_sample_split", f"""
WITH g AS (SELECT DISTINCT p_brand AS g FROM part),
s AS (SELECT g, CASE WHEN row_number() OVER (ORDER BY {H(42, 'g')}) <= greatest(1, floor(0.2 * count(*) OVER ())) THEN 'test' ELSE 'train' END AS side FROM g)
SELECT p_partkey AS entity, g, side FROM part JOIN s ON g = p_brand""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("g"))
    return S.group_sample_split(rows, "g").select("entity", "g", "side")


@query("group_split_unmatched_half", f"""
WITH base AS (SELECT p_partkey AS entity, CASE WHEN p_size > 10 THEN p_brand END AS g FROM part),
sizes AS (SELECT g, count(*) AS size FROM base WHERE g IS NOT NULL GROUP BY 1),
run AS (SELECT g, sum(size) OVER (ORDER BY size DESC, g) - size AS before, sum(size) OVER () AS total FROM sizes),
sides AS (SELECT g, CASE WHEN before < floor(0.2 * total) THEN 'test' ELSE 'train' END AS side FROM run)
SELECT entity, g, side FROM base JOIN sides USING (g) UNION ALL
SELECT entity, g, CASE WHEN row_number() OVER (ORDER BY {H('loose', 'entity')}) > floor(count(*) OVER () / 2) THEN 'test' ELSE 'train' END FROM base WHERE g IS NULL""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("g"))
    return S.group_split(rows, "g", unmatched="half").select("entity", "g", "side")


@query("kfold", f"""
SELECT p_partkey AS entity, ntile(5) OVER (ORDER BY {H(42, 'p_partkey')}) AS fold FROM part""")
def _(spark, sf):
    return shaped(S.kfold(table(spark, sf, "part").select(F.col("p_partkey").alias("entity"))), "entity", fold="int")


@query("kfold_by_target", P + f"SELECT entity, target, ntile(10) OVER (PARTITION BY target ORDER BY {H(42, 'target', 'entity')}) AS fold FROM scored")
def _(spark, sf):
    return shaped(S.kfold(scored(spark, sf), 10, by="target"), "entity", "target", fold="int")


@query("split_audit", "WITH " + GROUPED.strip() + """
SELECT count(DISTINCT g) AS n_groups, CAST(0 AS BIGINT) AS n_leaking, count(*) FILTER (side = 'test') AS n_test, count(*) FILTER (side = 'train') AS n_train,
       round(count(*) FILTER (side = 'test') / count(*), 6) AS test_share,
       round(count(*) FILTER (side = 'test' AND p_size > 25) / count(*) FILTER (side = 'test'), 6) AS positive_test,
       round(count(*) FILTER (side = 'train' AND p_size > 25) / count(*) FILTER (side = 'train'), 6) AS positive_train
FROM part JOIN sides ON g = p_brand""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("g"),
                                           (F.col("p_size") > 25).cast("int").alias("label"))
    return shaped(S.split_audit(S.group_split(rows, "g"), "g", "label"), n_groups="int", n_leaking="int", n_test="int",
                  n_train="int", test_share="num", positive_test="num", positive_train="num")


LONG = """
long AS (SELECT vec_id AS entity, i - 1 AS feature, CAST(embedding[i] AS DOUBLE) AS x, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS side
         FROM embeddings CROSS JOIN range(1, 65) AS t(i))"""


def _long(spark, sf):
    emb = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("entity"), F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("side"),
        F.col("embedding").cast("array<double>").alias("v"))
    return X.melt_vector(emb, "v", "entity", "side")


@query("max_abs_scale", "WITH " + LONG.strip() + """,
fit AS (SELECT feature, max(abs(x)) AS m FROM long WHERE side = 'train' GROUP BY 1)
SELECT entity, feature, round(x / CASE WHEN m > 0 THEN m ELSE 1 END, 6) + 0.0 AS x FROM long JOIN fit USING (feature)""")
def _(spark, sf):
    return shaped(X.max_abs_scale(_long(spark, sf)), "entity", feature="int", x="num")


@query("standardize", "WITH " + LONG.strip() + """,
fit AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM long WHERE side = 'train' GROUP BY 1)
SELECT entity, feature, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS x FROM long JOIN fit USING (feature)""")
def _(spark, sf):
    return shaped(X.standardize(_long(spark, sf)), "entity", feature="int", x="num")


CLASSES = "c AS (SELECT target, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY target)"


@query("ratio_weights", P + "," + CLASSES + """
SELECT entity, target, round(CASE WHEN pos > 0 AND neg > 0 AND label = 1 THEN neg / pos ELSE 1 END, 6) AS weight FROM scored JOIN c USING (target)""")
def _(spark, sf):
    return shaped(X.ratio_weights(scored(spark, sf)), "entity", "target", weight="num")


@query("balanced_weights", P + "," + CLASSES + """
SELECT entity, target, round((pos + neg) / ((CAST(pos > 0 AS INT) + CAST(neg > 0 AS INT)) * CASE WHEN label = 1 THEN pos ELSE neg END), 6) AS weight FROM scored JOIN c USING (target)""")
def _(spark, sf):
    return shaped(X.balanced_weights(scored(spark, sf)), "entity", "target", weight="num")


FLIPPED = "flip AS (SELECT entity, target, 1 - label AS label FROM scored)"


@query("upsample", P + "," + FLIPPED + f""",
c AS (SELECT target, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM flip GROUP BY target HAVING pos > 0 AND pos < neg),
mi AS (SELECT f.*, pos, neg, row_number() OVER (PARTITION BY f.target ORDER BY {H(42, 'f.target', 'entity')}) - 1 AS i FROM flip f JOIN c ON f.target = c.target WHERE label = 1),
d AS (SELECT target, pos, unnest(range(0, neg - pos)) AS draw FROM c),
dd AS (SELECT target, draw, CAST('0x' || substr({H(42, 'target', 'draw')}, 1, 15) AS BIGINT) % pos AS i FROM d)
SELECT entity, target, label, CAST(-1 AS BIGINT) AS draw FROM flip UNION ALL
SELECT entity, mi.target, label, draw FROM dd JOIN mi ON dd.target = mi.target AND dd.i = mi.i""")
def _(spark, sf):
    flipped = scored(spark, sf).select("entity", "target", (1 - F.col("label")).alias("label"))
    return X.upsample(flipped).fillna(-1, ["draw"]).select("entity", "target", "label", "draw")


@query("imbalance_strategies", P + "," + FLIPPED + """,
c AS (SELECT target, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS neg FROM flip GROUP BY target),
s AS (SELECT unnest(['none', 'sample_weight', 'upsample', 'class_weight']) AS strategy), m AS (SELECT unnest(['rf', 'knn']) AS model),
e AS (SELECT *, CASE WHEN strategy = 'upsample' AND pos > 0 AND pos < neg THEN 2 * neg ELSE pos + neg END AS n_rows FROM c, s, m)
SELECT target, strategy, model, CAST(n_rows AS BIGINT) AS n,
       round(CASE WHEN strategy = 'sample_weight' AND model = 'rf' AND pos > 0 AND neg > 0 THEN 2 * neg ELSE n_rows END, 6) AS weight FROM e""")
def _(spark, sf):
    flipped = scored(spark, sf).select("entity", "target", (1 - F.col("label")).alias("label"))
    out = None
    for strategy in X.STRATEGIES:
        for model in ("rf", "knn"):
            part = X.imbalance(flipped, strategy, model).groupBy("target").agg(
                F.count(F.lit(1)).alias("n"), r(F.sum("weight")).alias("weight")).withColumns(
                {"strategy": F.lit(strategy), "model": F.lit(model)})
            out = part if out is None else out.unionByName(part)
    return out

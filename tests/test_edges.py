"""Hand-made frames: ties, one class, missing values, empty groups, hot groups."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerflow.functions import columns as C
from titerflow.functions import pvalues as V
from titerflow.models import native as N
from titerflow.operators import candidates as K
from titerflow.operators import cleaning, cutoffs, diagnostics, resolve, scaling, similarity, splits
from titerflow.operators import metrics as M
from titerflow.operators import reliability as D
from titerflow.operators.ordering import avg_rank, group_quantiles, roc_points, row_numbers, running_totals
from titerflow.sources import tables as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by_key(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_parse_censored(spark):
    texts = ["12.5", " >100", "< 5", ">", "<abc", "abc", "", None, "-3", "0", "1e3", "nan", "inf", ">abc", ".5", "5."]
    want = [(12.5, "="), (100.0, ">"), (5.0, "<"), (None, "invalid"), (None, "invalid"), (None, "invalid"), (None, "invalid"),
            (None, "invalid"), (-3.0, "="), (0.0, "="), (1000.0, "="), (None, "invalid"), (None, "invalid"), (None, "invalid"),
            (0.5, "="), (5.0, "=")]
    rows = frame(spark, list(enumerate(texts)), "i int, t string").select("i", C.parse_censored("t").alias("p")).orderBy("i")
    assert [(r.p.value, r.p.flag) for r in rows.collect()] == want


def test_neg_log10_uses_smallest_positive(spark):
    df = frame(spark, [(0, 100.0), (1, 0.0), (2, -5.0), (3, 1000.0), (4, None)], "i int, v double")
    got = by_key(cleaning.neg_log10_molar(df, "v"), "i", "p_value")
    assert got[0] == pytest.approx(7.0) and got[1] == got[2] == got[0] and got[3] == pytest.approx(6.0) and got[4] is None
    none = frame(spark, [(0, 0.0), (1, -1.0)], "i int, v double")
    assert by_key(cleaning.neg_log10_molar(none, "v"), "i", "p_value") == {0: pytest.approx(15.0), 1: pytest.approx(15.0)}


def test_labels_keep_missing_and_nan(spark):
    df = frame(spark, [(0, 1.0), (1, 3.0), (2, None), (3, float("nan"))], "i int, value double")
    assert by_key(cutoffs.binarize(df, 2.0), "i", "label") == {0: 0, 1: 1, 2: None, 3: None}
    assert by_key(cutoffs.binarize(df, 1.0, "<="), "i", "label") == {0: 1, 1: 0, 2: None, 3: None}


def test_equal_scores(spark):
    df = frame(spark, [("t", i % 2, 0.4) for i in range(10)], "target string, label int, p double")
    assert roc_points(df, "target", "label", "p").count() == 1
    assert M.rank_auc(df, "target", "label", "p").first()["auc"] == 0.5
    start = cutoffs.youden_probability(df, "target", "label", "p").first()
    assert start["threshold"] == pytest.approx(1.4) and start["j"] == 0
    assert cutoffs.youden_probability(df, "target", "label", "p", "clipped").first()["threshold"] == 0.4


def test_one_class(spark):
    df = frame(spark, [("t", 1, i / 10) for i in range(10)], "target string, label int, p double")
    assert M.rank_auc(df, "target", "label", "p").first()["auc"] is None
    assert M.rank_auc(df, "target", "label", "p", 0.5).first()["auc"] == 0.5
    assert M.average_precision(df, "target", "label", "p").first()["auprc"] is None
    assert cutoffs.youden_probability(df, "target", "label", "p").first()["threshold"] == 0.5


def test_youden_cutoff_small_and_flat_targets(spark):
    rows = [("nine", float(i)) for i in range(9)] + [("flat", 2.0)] * 12 + [("top", 1.0)] * 4 + [("top", 5.0)] * 8
    got = by_key(cutoffs.youden_cutoff(frame(spark, rows, "target string, value double")), "target", "threshold")
    assert got == {"flat": 2.0, "top": 5.0}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{k}", float(v)) for k in range(3) for v in np.round(rng.normal(size=101 + k), 1)]
    got = group_quantiles(frame(spark, rows, "t string, v double"), "t", "v", {"a": 0.1, "b": 0.5, "c": 0.77}).collect()
    for r in got:
        values = [v for t, v in rows if t == r["t"]]
        for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.77)):
            assert r[name] == pytest.approx(np.quantile(values, q))


def test_hot_group_and_partition_invariance(spark):
    rows = [("hot" if i % 3 else f"t{i % 7}", (i * 37) % 501, i) for i in range(3000)]
    df = frame(spark, rows, "t string, v int, i int")
    want, counters = {}, {}
    for t, v, i in sorted(rows):
        counters[t] = counters.get(t, 0) + 1
        want[i] = counters[t]
    for parts, chunks in ((1, 1), (5, 3), (13, 16)):
        got = row_numbers(df.repartition(parts), "t", ["v", "i"], "rank", "size", chunks=chunks)
        assert by_key(got, "i", "rank") == want
        assert all(r["size"] == counters[r["t"]] for r in got.collect())


def test_running_totals_sums(spark):
    df = frame(spark, [("a", 3, 1), ("a", 1, 2), ("a", 2, 4), ("b", 1, 8)], "t string, o int, x int")
    got = {(r["t"], r["o"]): (r["cum_x"], r["tot_x"]) for r in running_totals(df, "t", ["o"], ["x"]).collect()}
    assert got == {("a", 1): (2, 7), ("a", 2): (6, 7), ("a", 3): (7, 7), ("b", 1): (8, 8)}


def test_avg_rank_missing(spark):
    df = frame(spark, [(0, 1.0), (1, 2.0), (2, 2.0), (3, None), (4, 5.0)], "i int, v double")
    assert by_key(avg_rank(df, "v"), "i", "avg_rank") == {0: 1.0, 1: 2.5, 2: 2.5, 3: None, 4: 4.0}


def test_resolve_sources_tie_and_fill(spark):
    rows = [
        ("k1", "b", "x", "V2", 1), ("k1", "a", "y", "V2", 2), ("k1", "c", "x", "V1", 3), ("k1", "c", "z", "V1", 4),
        ("k1", "d", "z", "V1", 5), ("k2", "e", "x", "V1", 6), ("k2", "f", "x", "V1", 7), ("k2", "f", "y", "V1", 8),
        ("k3", "g", "x", "V1", 9), (None, "h", "x", "V2", 10),
    ]
    df = frame(spark, rows, "key string, entity string, target string, version string, i int")
    got = resolve.resolve_sources(df, "key", "entity", "version", "V2", "V1", ["i"])
    assert sorted((r["entity"], r["target"], r["filled"], r["i"]) for r in got.collect()) == [
        ("a", "x", 1, 3), ("a", "y", 0, 2), ("a", "z", 1, 4), ("f", "x", 0, 7), ("f", "y", 0, 8), ("g", "x", 0, 9),
    ]
    counts = resolve.merge_counts(resolve.choose_names(df, "key", "entity", "version", "V2")).first()
    assert (counts["n_cross_merges"], counts["n_same_merges"], counts["n_single"]) == (1, 1, 1)


def test_group_split_overshoots(spark):
    rows = [(i, "big" if i < 60 else f"g{i % 8}") for i in range(100)]
    out = splits.group_split(frame(spark, rows, "entity int, g string"), "g")
    audit = splits.split_audit(out, "g").first()
    assert (audit["n_leaking"], audit["n_test"]) == (0, 60)


@pytest.mark.parametrize("rule, n_test", [("train", 0), ("half", 3), ("group", None)])
def test_rows_without_group(spark, rule, n_test):
    rows = [(i, None if i < 6 else f"g{i % 10}") for i in range(46)]
    out = splits.group_split(frame(spark, rows, "entity int, g string"), "g", unmatched=rule)
    assert out.count() == 46
    if n_test is not None:
        assert out.where("g IS NULL AND side = 'test'").count() == n_test


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "entity").withColumn("target", F.col("entity") % 3)
    once = splits.random_split(df.repartition(3), by="target").orderBy("entity").collect()
    again = splits.random_split(df.repartition(11), by="target").orderBy("entity").collect()
    assert once == again
    sizes = splits.kfold(df, 7).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [71] * 4 + [72] * 3


def test_upsample_reaches_parity(spark):
    rows = [("t", i, int(i < 4)) for i in range(50)] + [("u", i, 1) for i in range(5)] + [("w", i, int(i > 2)) for i in range(9)]
    got = scaling.upsample(frame(spark, rows, "target string, entity int, label int"))
    counts = {(r["target"], r["label"]): r["count"] for r in got.groupBy("target", "label").count().collect()}
    assert counts == {("t", 0): 46, ("t", 1): 46, ("u", 1): 5, ("w", 0): 3, ("w", 1): 6}


def test_consensus_without_spread(spark):
    rows = [("t", 1, m, 0.3, 1) for m in range(8)] + [("t", 2, m, 0.1 * m, 0) for m in range(8)] + [("t", 3, m, 0.5, 0) for m in range(7)]
    got = {r["entity"]: r for r in D.consensus(frame(spark, rows, "target string, entity int, model int, p double, label int")).collect()}
    assert set(got) == {1, 2}
    assert got[1]["cons_std_prob"] == pytest.approx(0.3)
    z = (0.5 - got[2]["p_mean"]) / got[2]["p_std"]
    phi = 0.5 * math.erfc(-z / math.sqrt(2))
    assert got[2]["cons_std_prob"] == pytest.approx(min(phi, 1 - phi), abs=1e-6)


def test_coverage_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("t", i, round(rng.random(), 2), rng.randrange(2)) for i in range(57)]
    df = frame(spark, rows, "target string, entity int, p double, label int").withColumn("s", F.round(C.class_lag("p"), 6))
    grid = D.coverage_grid(True)
    got = by_key(D.auc_at_coverage(df, "target", "s", grid=grid), "coverage", "auc")
    order = sorted(rows, key=lambda r: (round(min(r[2], 1 - r[2]), 6), r[1]))
    assert set(got) == set(grid)
    for c in grid:
        kept = order[: max(2, -(-c * len(rows) // 100))]
        pos, neg = [r[2] for r in kept if r[3]], [r[2] for r in kept if not r[3]]
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert got[c] == (pytest.approx(want) if want is not None else None)


def bit_frame(spark, n=120, width=40, seed=1):
    rng = random.Random(seed)
    base = [sorted(rng.sample(range(width), rng.randrange(3, 12))) for _ in range(12)]
    rows = []
    for i in range(n):
        bits = set(base[i % 12]) ^ set(rng.sample(range(width), rng.randrange(0, 4)))
        rows.append((i, sorted(bits)))
    rows += [(n + i, rows[0][1]) for i in range(30)] + [(n + 30, []), (n + 31, [width + 1, width + 2])]
    return rows, frame(spark, rows, "entity int, bits array<int>")


@pytest.mark.parametrize("t, block", [(0.3, 2000), (0.6, 2000), (0.6, 5), (0.85, 3), (1.0, 2000)])
def test_tanimoto_pairs_are_complete(spark, t, block):
    rows, df = bit_frame(spark)
    sets = similarity.bit_sets(df)
    ids = {r["set_id"]: frozenset(r["bits"]) for r in sets.collect()}
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.tanimoto_pairs(sets, t, block).collect()}
    want = {}
    for a in ids:
        for b in ids:
            if a < b:
                s = len(ids[a] & ids[b]) / len(ids[a] | ids[b])
                if s >= t - 1e-9:
                    want[a, b] = s
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_leader_clusters_match_sequential_rule(spark):
    rows, df = bit_frame(spark)
    sim = {i: frozenset(b) for i, b in rows if b}

    def near(i, j):
        return len(sim[i] & sim[j]) / len(sim[i] | sim[j]) >= 0.4 - 1e-9

    neighbours = {i: [j for j in sim if j != i and near(i, j)] for i in sim}
    first = {}
    for i in sorted(sim):
        first.setdefault(sim[i], i)
    order = sorted(sim, key=lambda i: (-len(neighbours[i]), first[sim[i]], i))
    cluster = {}
    for i in order:
        if i not in cluster:
            for j in [i, *neighbours[i]]:
                cluster.setdefault(j, i)
    # the same leaders from one group, from groups of components, and in rounds
    sets = similarity.bit_sets(df)
    for bound, least in ((0.4, 0), (0.75, 40)):
        pairs = similarity.tanimoto_pairs(sets, bound)
        whole = by_key(similarity.leader_clusters(sets, pairs), "set_id", "leader")
        assert len(set(whole.values())) > least
        for solved in (0, 2, 12):
            assert by_key(similarity.leader_clusters(sets, pairs, solved), "set_id", "leader") == whole
    got = by_key(similarity.similarity_groups(df, 0.6), "entity", "cluster")
    assert got.pop(150) is None
    mine, theirs = {}, {}
    for i in sim:
        mine.setdefault(got[i], set()).add(i)
        theirs.setdefault(cluster[i], set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_knn_blocks_do_not_matter(spark):
    rng = np.random.default_rng(2)
    rows = [("t", i, [float(x) for x in rng.integers(0, 4, 5)], int(i % 2)) for i in range(90)]
    df = frame(spark, rows, "target string, entity int, v array<double>, label int")
    train, test = df.where("entity % 3 <> 0"), df.where("entity % 3 = 0")
    want = {}
    for _, i, v, _ in rows:
        if i % 3 == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j, y) for _, j, w, y in rows if j % 3)[:5]
            want[i] = sum(y for _, _, y in near) / 5
    for block in (7, 4096):
        assert by_key(N.knn_probability(train, test, 5, block=block), "entity", "p") == pytest.approx(want)


def test_knn_cells_leave_pairs_out_and_no_neighbour(spark):
    rng = np.random.default_rng(11)
    middles = rng.normal(0, 20, (12, 6))

    def rows(n):
        out = []
        for i in range(n):
            near = 0 if i % 3 == 0 else int(rng.integers(12))  # a third of the rows in one place
            out.append(("big", i, [float(x) for x in np.round(middles[near] + rng.normal(0, 1, 6), 1)], int(rng.integers(2))))
        copies = [("big", n + i, out[0][2], i % 2) for i in range(40)]
        return out + copies + [("small", i, [float(i % 5)] * 6, i % 2) for i in range(30)]

    shares = []
    for n, worth in ((600, 1.0), (2400, 0.5), (600, 0.0)):
        data = rows(n)
        df = frame(spark, data, "target string, entity int, v array<double>, label int")
        train, test = df.where("entity % 5 <> 0"), df.where("entity % 5 = 0")
        got = {(r["target"], r["entity"], r["rank"]): (r["_near"], r["label"]) for r in N.knn_neighbours(train, test, 4, block=100, pivots=40, worth=worth).collect()}
        want = {}
        for name in ("big", "small"):
            mine = [(i, np.array(v), y) for t, i, v, y in data if t == name]
            for i, v, _ in mine:
                if i % 5 == 0:
                    near = sorted((round(float(((v - w) ** 2).sum()), 9), j, y) for j, w, y in mine if j % 5)[:4]
                    want |= {(name, i, place + 1): (j, y) for place, (_, j, y) in enumerate(near)}
        assert got == want
        work = N.knn_compared(train, test, 4, block=100, pivots=40).collect()
        assert [r["target"] for r in work] == ["big"]
        shares.append(work[0]["compared"] / work[0]["pairs"])
    assert shares[0] < 0.6 and shares[1] < 0.4  # worth only chooses the plan
    flat = frame(spark, [("t", i, [1.0, 2.0], i % 2) for i in range(60)], "target string, entity int, v array<double>, label int")
    same = N.knn_neighbours(flat.where("entity >= 20"), flat.where("entity < 20"), 3, block=10)
    assert {(r["entity"], r["rank"]): r["_near"] for r in same.collect()} == {(i, j + 1): 20 + j for i in range(20) for j in range(3)}
    nothing = flat.where("entity < 0")
    assert N.knn_neighbours(nothing, flat, 3).count() == 0 and N.knn_neighbours(flat, nothing, 3, block=10).count() == 0


def test_gaussian_nb_skips_untrainable(spark):
    rows = [("one", i, [float(i)], 1) for i in range(20)] + [("few", i, [float(i)], i % 2) for i in range(6)]
    rows += [("ok", i, [float(i % 2) + i / 100], i % 2) for i in range(20)]
    df = frame(spark, rows, "target string, entity int, v array<double>, label int")
    got = N.gaussian_nb(df, df).collect()
    assert {r["target"] for r in got} == {"ok"}
    assert all((r["p"] > 0.5) == bool(r["label"]) for r in got)


def test_p_values():
    assert V.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert V.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert V.chi2_upper(18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    assert V.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert V.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)


def test_kruskal_single_group_is_null(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), (None, 3.0)], "g string, v double")
    row = diagnostics.kruskal(df, "g", "v").first()
    assert row["h"] is None and row["p"] is None and row["n"] == 2


def test_ttest_interval(spark):
    values = [0.5, 0.6, 0.55, 0.7, 0.65]
    row = diagnostics.ttest_1samp(frame(spark, [(v,) for v in values], "v double"), "v").first()
    mean, std = np.mean(values), np.std(values, ddof=1)
    half = 2.776445105 * std / math.sqrt(5)
    assert row["t"] == pytest.approx((mean - 0.5) / (std / math.sqrt(5)))
    assert (row["ci_low"], row["ci_high"]) == (pytest.approx(mean - half), pytest.approx(mean + half))


def test_diversity_cap_keeps_low_scores(spark):
    rows = [(i, "g" if i < 40 else "h", 0.9 if i % 2 else 0.1) for i in range(50)]
    got = K.diversity_cap(frame(spark, rows, "entity int, g string, score double"), "g", cap=5).collect()
    kept = [r["entity"] for r in got if r["g"] == "g" and r["score"] > 0.4 and r["capped_score"] > 0]
    assert sorted(kept) == [1, 3, 5, 7, 9]
    assert all(r["capped_score"] == 0.1 for r in got if r["score"] == 0.1)


def test_collect_ids_parts_hold_everything(spark):
    rows = [("k", i % 45) for i in range(300)] + [("j", 7), ("j", None)]
    got = cleaning.collect_ids(frame(spark, rows, "key string, id int"), "key", "id", part_size=10).collect()
    ids = sorted(int(x) for r in got if r["key"] == "k" for x in r["ids"].split(";"))
    assert ids == list(range(45)) and max(r["n_ids"] for r in got) == 10


def test_read_measurements_checks_columns(spark, tmp_path):
    from pyspark.sql import types as T

    path = str(tmp_path / "in")
    frame(spark, [("t", "x", "5")], "`Target Name` string, Ligand string, `IC50 (nM)` string").write.option("header", True).csv(path)
    good = T.StructType([T.StructField("targetname", T.StringType()), T.StructField("ic50(nm)", T.DoubleType())])
    assert S.read_measurements(spark, path, good).first()["ic50(nm)"] == 5.0
    with pytest.raises(ValueError, match="missing required columns"):
        S.read_measurements(spark, path, T.StructType([T.StructField("nope", T.StringType())]))


def test_cache_computes_only_missing(spark, tmp_path):
    seen = []

    def compute(rows):
        seen.append(sorted(r["entity"] for r in rows.collect()))
        return rows.withColumn("f", F.col("entity") * 2)

    ids = spark.range(6).withColumnRenamed("id", "entity")
    S.cached_features(ids.where("entity < 3"), str(tmp_path / "c"), compute)
    out = S.cached_features(ids.where("entity > 0"), str(tmp_path / "c"), compute)
    assert seen == [[0, 1, 2], [3, 4, 5]] and sorted(r["entity"] for r in out.collect()) == [1, 2, 3, 4, 5]


def test_melt_drops_text_and_nan(spark):
    wide = frame(spark, [("a", "1.5", float("nan"), 2.0), ("b", "x", 3.0, None)], "e string, t1 string, t2 double, t3 double")
    got = sorted((r["e"], r["target"], r["value"]) for r in S.melt_matrix(wide, ["e"]).collect())
    assert got == [("a", "t1", 1.5), ("a", "t3", 2.0), ("b", "t2", 3.0)]


def test_f1_cutoff_all_negative(spark):
    df = frame(spark, [("t", 0, 0.2)] * 3 + [("u", 1, 0.05)] * 2, "target string, label int, p double")
    assert by_key(cutoffs.f1_cutoff(df, "target", "label", "p"), "target", "threshold") == {"t": 0.1, "u": 0.1}


def test_best_coverage_ignores_levels_without_a_mean(spark):
    table = frame(spark, [(10, None, 0), (50, 0.7, 2), (60, 0.7, 3), (100, 0.6, 3)], "coverage int, mean_auc double, n_valid int")
    row = D.best_coverage(table).first()
    assert (row["best_coverage"], row["best_auc"], row["baseline_auc"]) == (50, 0.7, 0.6)


def test_similarity_split_by_kmeans(spark):
    rows, df = bit_frame(spark)
    out = similarity.similarity_split(df, method="kmeans", k=2, size=64)
    audit = splits.split_audit(out, "cluster").first()
    assert out.count() == len(rows) and audit["n_groups"] == 2 and audit["n_leaking"] == 0


def test_splits_keep_rows_of_null_groups_and_labels(spark):
    rows = [(f"e{i}", None if i % 3 == 0 else f"t{i % 2}", None if i % 4 == 0 else i % 2) for i in range(40)]
    df = frame(spark, rows, "entity string, target string, label int")
    for out in (
        splits.random_split(df, stratify="label"), splits.random_split(df, by="target"), splits.kfold(df, by="target"),
        splits.random_split(df, by="target", stratify="label"),
    ):
        assert sorted(r.entity for r in out.collect()) == sorted(r[0] for r in rows)
    sizes = splits.kfold(df, k=2, by="target").groupBy("target", "fold").count().collect()
    assert {r.target for r in sizes} == {None, "t0", "t1"} and len(sizes) == 6


def test_auc_of_large_counts(spark):
    from titerflow.operators.metrics import auc_of_points

    big = 4_000_000_000
    points = frame(spark, [("t", 0.1, big, 0), ("t", 0.9, big, big)], "target string, score double, n bigint, hits bigint")
    assert by_key(auc_of_points(points, "target", "score"), "target", "auc") == {"t": 1.0}


def test_missing_by_target_lists_targets_without_a_value(spark):
    from titerflow.operators.cleaning import missing_by_target

    df = frame(spark, [("a", "t", 1.0), ("b", "t", None), ("a", "u", None)], "entity string, target string, value double")
    got = {r.target: (r.n_filled, r.n_missing) for r in missing_by_target(df).collect()}
    assert got == {"t": (1, 1), "u": (0, 2)}


def test_numbers_with_large_exponents(spark):
    from titerflow.functions.columns import parse_censored

    df = frame(spark, [(t,) for t in ("1e100", ">1e-300", "1e999", "<5", "x")], "t string").select(parse_censored("t").alias("p"))
    assert [(r.p.value, r.p.flag) for r in df.collect()] == [(1e100, "="), (1e-300, ">"), (None, "invalid"), (5.0, "<"), (None, "invalid")]


def test_bits_that_repeat_count_once(spark):
    df = frame(spark, [("a", [1, 1, 2]), ("b", [1, 2, 2])], "entity string, bits array<int>")
    sets = similarity.bit_sets(df).collect()
    assert [(r["size"], r.n_members) for r in sets] == [(2, 2)]
    assert similarity.set_members(df).select("set_id").distinct().count() == 1


def test_models_and_skipped_targets_use_one_rule(spark):
    from titerflow.models.estimators import score_rows, skipped_targets

    rows = [("few", f"e{i}", None if i < 4 else i % 2, "train" if i < 12 else "test", [float(i), 1.0]) for i in range(14)]
    rows += [("one", f"e{i}", 1, "train" if i < 12 else "test", [float(i), 1.0]) for i in range(14)]
    rows += [("ok", f"e{i}", i % 2, "train" if i < 12 else "test", [float(i % 2), 1.0 + i]) for i in range(14)]
    df = frame(spark, rows, "target string, entity string, label int, side string, v array<double>")
    assert {r.target for r in skipped_targets(df).collect()} == {"few", "one"}
    for model in ("gaussian_nb", "knn"):
        assert {r.target for r in score_rows(df, model, strategy="sample_weight").select("target").distinct().collect()} == {"ok"}


def test_upsampling_makes_draws_in_pieces(spark):
    from titerflow.operators.scaling import balanced_weights, upsample

    data = [("one", 0, 1)] + [("one", i, 0) for i in range(1, 400)] + [(None, 0, 1), (None, 1, 1)] + [(None, i, 0) for i in range(2, 90)] + [("even", 0, 1), ("even", 1, 0), ("none", 1, 0)]
    rows = spark.createDataFrame(data, "target string, entity long, label int")
    whole = upsample(rows)
    n = {(r["target"], r["label"]): r["n"] for r in whole.groupBy("target", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {("one", 1): 399, ("one", 0): 399, (None, 1): 88, (None, 0): 88, ("even", 1): 1, ("even", 0): 1, ("none", 0): 1}
    as_rows = lambda df: sorted(map(repr, df.select("target", "entity", "label", "draw").collect()))
    assert as_rows(whole) == as_rows(upsample(rows, piece=7))
    assert {r["weight"] for r in balanced_weights(rows).where("target is null and label = 1").collect()} == {22.5}


def test_admission_of_a_batch(spark):
    from titerflow.streaming.diversity import admit_batch

    data = [("a", i, 0.9 if i % 3 else 0.1) for i in range(60)] + [(None, i, 0.5) for i in range(9)] + [("a", 5, None), ("b", 1, 0.4)]
    batch = spark.createDataFrame(data, "g string, at int, score double").repartition(5)
    used = spark.createDataFrame([("a", 3), ("z", 10)], "g string, used long")
    for share in (4, 1000):
        rows, now = admit_batch(batch, used, "g", ["at"], cap=10, share=share)
        got = {(r["g"], r["at"], r["score"]): r["capped_score"] for r in rows.collect()}
        good = [i for i in range(60) if i % 3]
        want = {("a", i, 0.9): 0.9 if n < 7 else 0.0 for n, i in enumerate(good)}
        want |= {("a", i, 0.1): 0.1 for i in range(0, 60, 3)} | {(None, i, 0.5): 0.5 for i in range(9)} | {("a", 5, None): None, ("b", 1, 0.4): 0.4}
        assert got == want
        assert {(r["g"], r["used"]) for r in now.collect()} == {("a", 10), (None, 9), ("b", 1)}
    rows, now = admit_batch(batch.limit(0), used, "g", ["at"])
    assert rows.collect() == [] and now.collect() == []


def test_banded_pairs_find_nearly_all(spark):
    rows, df = bit_frame(spark)
    sets = similarity.bit_sets(df)
    for bound in (0.4, 0.8, 1.0):
        exact = {(r["a"], r["b"], r["inter"]) for r in similarity.tanimoto_pairs(sets, bound).collect()}
        got = {(r["a"], r["b"], r["inter"]) for r in similarity.tanimoto_pairs_approx(sets, bound, block=16).collect()}
        assert got <= exact and len(got) >= 0.9 * len(exact)
    rows, bands = similarity.banding(0.5, 0.98)
    assert (1 - 0.5**rows) ** bands <= 0.02


def test_report_of_little_data_says_so(spark):
    from titerflow.plans.diagnosis import diagnose_metrics

    results = "model string, target string, metric double, split string"
    matrix = "entity int, target string, value double"
    many = [(m, f"t{i}", 0.5, "Train_Test") for m in "ab" for i in range(4)]
    for found, cells in (
        ([], []),
        ([("a", "t0", 0.5, "Train_Test")], [(1, "t0", 0.1)]),
        (many, [(e, f"t{i}", 1.0) for e in range(5) for i in range(4)]),  # nothing varies
        ([(None, None, None, "Train_Test")], [(None, None, None)]),
    ):
        rows = {r["hypothesis"]: r for r in diagnose_metrics(frame(spark, found, results), frame(spark, cells, matrix)).collect()}
        assert len(rows) == 7
        for name in ("H2 - data amount", "H2 - balance", "H3 - ranking", "H4 - features, variance"):
            assert rows[name]["statistic"] == "n/a" and rows[name]["p_value"] == "n/a"


def test_pearson_of_a_line(spark):
    df = frame(spark, [(float(i), 2.0 * i) for i in range(5)], "a double, b double")
    row = diagnostics.pearson(df, "a", "b").first()
    assert row["r"] == pytest.approx(1.0) and row["p"] < 1e-9


@pytest.mark.parametrize("t, block", [(0.4, 2000), (0.6, 16), (1.0, 7)])
def test_whole_comparison_gives_the_pairs_of_the_filter(spark, t, block, monkeypatch):
    rows, df = bit_frame(spark)
    sets = similarity.bit_sets(df)
    monkeypatch.setattr(similarity, "STRIP", 13)
    monkeypatch.setattr(similarity, "SLICE", 5)
    whole, filtered = ({(r["a"], r["b"], r["inter"], round(r["similarity"], 12)) for r in similarity.tanimoto_pairs(sets, t, block, share).collect()} for share in (0.0, float("inf")))
    assert whole == filtered and (whole or t == 1.0)
    assert {x[:3] for x in whole} == {(r["a"], r["b"], r["inter"]) for r in similarity.tanimoto_pairs_approx(sets, t, 0.9, block, share=0.0).collect()}
    counts = [by_key(similarity.count_neighbours(sets, t, block, share), "set_id", "n_neighbours") for share in (0.0, float("inf"))]
    assert counts[0] == counts[1]


def test_parts_hold_each_pair_once(spark, monkeypatch):
    rows, df = bit_frame(spark)
    sets = similarity.bit_sets(df)
    as_set = lambda f: {(r["a"], r["b"], r["inter"], round(r["similarity"], 12)) for r in f.collect()}
    want = as_set(similarity.tanimoto_pairs(sets, 0.4))
    for share in (0.0, float("inf")):
        exact, approx = (fn(sets, 0.4, block=16, share=share, parts=3) for fn in (similarity.tanimoto_pairs, similarity.tanimoto_pairs_approx))
        assert len(exact) == len(approx) == 3
        exact, approx = [as_set(f) for f in exact], [as_set(f) for f in approx]
        assert set().union(*exact) == want and sum(map(len, exact)) == len(want) and all(exact)
        assert all(a <= e for a, e in zip(approx, exact)) and (approx == exact if share == 0 else sum(map(len, approx)) >= 0.9 * len(want))
    assert similarity.pair_parts(sets, 0.4) == 1
    assert similarity.pair_parts(sets, 0.4, pairs=len(want) // 4, block=20) > 1


def test_banded_pairs_are_checked_part_by_part(spark, monkeypatch):
    import checks.q_features as Q
    from checks.registry import QUERIES

    rng, made = random.Random(3), []
    table = frame(spark, [(i, [rng.choice((-1.0, 1.0)) for _ in range(64)]) for i in range(120)], "vec_id int, embedding array<double>").withColumn("label", F.lit(0))
    monkeypatch.setattr("checks.bindings.table", lambda *a: table)
    whole = QUERIES["tanimoto_pairs_approx"](spark, "").collect()
    monkeypatch.setattr(Q, "settled", lambda *a, fn=Q.settled: made.append(1) or fn(*a))
    monkeypatch.setattr(similarity.pair_parts, "__defaults__", (20, 10**6, 40))
    assert QUERIES["tanimoto_pairs_approx"](spark, "").collect() == whole and len(made) > 1 and whole[0]["n_exact"] > 20


def test_leaders_by_heads_match_those_of_the_pairs(spark):
    rows, df = bit_frame(spark)
    sets = similarity.bit_sets(df)
    for bound in (0.4, 0.75):
        pairs = similarity.tanimoto_pairs(sets, bound)
        want = by_key(similarity.leader_clusters(sets, pairs), "set_id", "leader")
        for head in (3, 40, 2000):
            assert by_key(similarity.similar_leaders(sets, bound, head, 16, 0.0), "set_id", "leader") == want


def test_dense_sets_are_compared_in_blocks(spark):
    rng = random.Random(5)
    df = frame(spark, [(i, sorted(rng.sample(range(64), 32))) for i in range(300)], "entity int, bits array<int>")
    sets = similarity.bit_sets(df)
    assert similarity._prefixes(sets, 0.5, similarity.SHARE)[3]
    for pairs in (similarity.tanimoto_pairs(sets, 0.5), similarity.tanimoto_pairs_approx(sets, 0.5)):
        assert "CoGroup" in pairs._jdf.queryExecution().executedPlan().toString()


def test_gram_features_of_odd_texts(spark, monkeypatch):
    import hashlib
    from collections import Counter

    from titerflow.operators import features

    texts = [None, "", "ab", "abc", "a😀b😀b😀b", "é\n" * 9, "abcabc" * 50, "".join(map(chr, range(1, 900)))]
    df = frame(spark, list(enumerate(texts)) + [(3, "abcd")], "entity int, text string")
    want = {(i, t): Counter(int(hashlib.md5(t[j : j + 3].encode()).hexdigest()[:8], 16) % 2048 for j in range(len(t) - 2)) for i, t in df.collect() if t is not None}
    got = {(r["entity"], r["text"]): r["bits"] for r in features.hash_features(df, "text", portable=True).collect()}
    assert got == {k: sorted(c) for k, c in want.items()}
    both = Counter()
    for (i, _), c in want.items():
        both.update({(i, f): x for f, x in c.items()})
    assert {(r[0], r[1]): r[2] for r in features.count_features(df, "text", portable=True).collect()} == both
    monkeypatch.setattr(features, "CHARS", 7)  # parts of texts
    row, feature, x = features._counted([t or "" for t in texts], 3, 2048, {})
    assert dict(zip(zip(row.tolist(), feature.tolist()), x.tolist())) == {k: v for k, v in sum((Counter({(i, f): x for f, x in c.items()}) for (i, t), c in want.items() if t != "abcd"), Counter()).items()}


def test_sweep_ranks_rows_once_for_all_cutoffs(spark, monkeypatch):
    seen = []

    def noted(points, *args, **kw):
        seen.append(points.count())
        return ordering.running_totals(points, *args, **kw)

    from titerflow.operators import ordering

    monkeypatch.setattr(D, "running_totals", noted)
    rows = [(t, i, ((i * 7 + n) % 41) / 20.0 - 1.2, ((i * 13 + n) % 10) / 10.0) for n, t in enumerate(["a", "b", "few", None]) for i in range(9 if t == "few" else 60)]
    rows += [("a", 100, None, 0.1), ("a", 101, float("nan"), 0.1), ("a", 102, -0.8, None), *[("null", i, float(i % 2) - 1.0, None) for i in range(30)]]
    data = spark.createDataFrame(rows, "target string, entity long, value double, p double")
    values, preds = data.select("target", "entity", "value"), data.select("target", "entity", "p")
    cutoffs = (0.0, -0.5, -1.1, -3.0)
    got = {(r["cutoff"], r["coverage"]): (r["mean_auc"], r["n_valid"]) for r in D.reliability_sweep(values, preds, cutoffs).collect()}
    assert seen == [60 + 60 + 9 + 1 + 30]
    by_cutoff = preds.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    want = {(r["cutoff"], r["coverage"]): (r["mean_auc"], r["n_valid"]) for r in D.reliability_sweep(values, by_cutoff, cutoffs).collect()}
    assert len(seen) == 1 and got == {k: (pytest.approx(a), n) for k, (a, n) in want.items()} and {c for c, _ in got} == {0.0, -0.5, -1.1}

"""Linear models and elastic nets against plain numpy, on frames with odd rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from titerflow.models import elastic
from titerflow.models.crossval import fold_predictions, split_metrics, untrained, with_folds
from titerflow.models.linear import fit_linear, fold_scalers, score_linear
from titerflow.session import materialize

SCHEMA = "target string, entity long, label int, side string, fold int, v array<double>, extra double, held string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "z", "z") for r in rows], SCHEMA)


def made(n, seed, shift=0.0):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + shift
    return x, (x @ [1.0, -0.3, 4.0] - shift * 4.7 + g.normal(size=n) > 0.2).astype(int)


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for t, (name, n) in enumerate([("a", 60), (None, 45), ("b", 30), ("few", 6), ("one", 25)]):
        x, y = made(n, t, shift=100.0 * t)
        for i in range(n):
            label = 1 if name == "one" else int(y[i])
            out.append((name, i, label, "test" if i % 4 == 0 else "train", i % 3 + 1, x[i].tolist()))
    out += [("a", 900, None, "train", 1, [1.0, 1.0, 1.0]), ("a", 901, 1, "train", 2, None), ("a", 902, 7, "train", 3, [0.0, 0.0, 0.0]), ("a", 903, 0, None, 1, [9.0, 9.0, 9.0])]
    return out


def plain(kind, x, y, w, c):
    """Newton's method with halving, on one model."""
    z, sign, ridge = np.hstack([x, np.ones((len(x), 1))]), 2.0 * y - 1, np.array([1.0] * x.shape[1] + [0.0])

    def at(b):
        f = z @ b
        if kind == "logit":
            p = 1 / (1 + np.exp(-f))
            return c * w @ np.logaddexp(0, -sign * f) + b @ (ridge * b) / 2, c * z.T @ (w * (p - y)) + ridge * b, c * (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        gap = np.maximum(0, 1 - sign * f)
        return c * w @ gap**2 + b @ (ridge * b) / 2, -2 * c * z.T @ (w * sign * gap) + ridge * b, 2 * c * (z * (w * (gap > 0))[:, None]).T @ z + np.diag(ridge)

    b = np.zeros(z.shape[1])
    for _ in range(200):
        value, g, h = at(b)
        step, move = 1.0, np.linalg.solve(h + 1e-12 * np.eye(len(b)), g)
        while at(b - step * move)[0] > value and step > 1e-9:
            step /= 2
        b = b - step * move
    return b


@pytest.mark.parametrize("kind, scaler", [("logit", None), ("logit", "standard"), ("linear_svm", "max_abs")])
def test_linear_models_of_all_targets_and_folds(spark, rows, kind, scaler):
    data = frame(spark, rows)
    # one scaler per training set, whatever the target
    fitted = fit_linear(data, kind, c=0.7, folds=3, scaler=scaler, strategy="class_weight", features=data.select("entity", "v", "side", "fold"))
    got = {(r["target"], r["held"]): r for r in fitted.collect()}
    assert {t for t, _ in got} == {"a", None, "b"} and all(r["converged"] for r in got.values())
    for (name, held), r in got.items():
        def trains(row):
            return row[3] == "train" if held == 0 else row[4] != held
        own = [row for row in rows if row[0] == name and row[2] in (0, 1) and row[5] is not None and trains(row)]
        every = np.array([row[5] for row in rows if row[5] is not None and trains(row)])
        x, y = np.array([row[5] for row in own]), np.array([row[2] for row in own], float)
        centre, scale = np.zeros(3), np.ones(3)
        if scaler == "standard":
            centre, scale = every.mean(axis=0), every.std(axis=0)
        elif scaler == "max_abs":
            scale = np.abs(every).max(axis=0)
        w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        b = plain(kind, (x - centre) / scale, y, w, 0.7)
        raw = b[:-1] / scale
        margin = x @ raw + b[-1] - centre @ raw
        assert x @ np.array(r["coefficients"]) + r["intercept"] == pytest.approx(margin, abs=1e-5)
        assert (r["n_pos"], r["n_neg"]) == (y.sum(), len(y) - y.sum())


def test_linear_models_without_splits_and_weights(spark):
    x, y = made(40, 9)
    data = spark.createDataFrame([("t", i, int(y[i]), x[i].tolist(), 1.0 + i % 3) for i in range(40)], "target string, entity int, label int, v array<double>, w double")
    (r,) = fit_linear(data, "logit", weight="w").collect()
    assert np.append(r["coefficients"], r["intercept"]) == pytest.approx(plain("logit", x, y.astype(float), 1.0 + np.arange(40) % 3, 1.0), abs=1e-6)
    scored = score_linear(fit_linear(data, "logit"), data.unionByName(data.limit(1).withColumn("v", F.lit(None)))).collect()
    assert sum(s["p"] is None for s in scored) == 1 and all(0 < s["p"] < 1 for s in scored if s["v"]) and len(scored) == 41
    assert fit_linear(data.limit(0), "logit").collect() == []
    # separable and hardly regularised: steps are halved until it converges
    apart = spark.createDataFrame([("t", i, int(i > 10), [float(i), float(i % 2)]) for i in range(21)], "target string, entity int, label int, v array<double>")
    for kind in ("logit", "linear_svm"):
        fitted = materialize(fit_linear(apart, kind, c=1e4))
        assert fitted.first()["converged"] and all((s["p"] > 0.5) == (s["label"] == 1) for s in score_linear(fitted, apart).collect())
    with pytest.raises(ValueError):
        fit_linear(data, "forest")


def test_fold_predictions_judge_each_row_by_the_model_that_has_not_seen_it(spark, rows):
    data = with_folds(frame(spark, [r for r in rows if r[3]]), 3)
    for model, options in (("gaussian_nb", {"strategy": "sample_weight"}), ("logit", {"strategy": "upsample"}), ("knn", {"k": 3})):
        got = fold_predictions(data.drop("held"), model, folds=3, scaler="standard", **options).collect()
        places = [(r["target"], r["entity"], r["split"]) for r in got]
        assert len(places) == len(set(places))
        folds = {(t, e): s for t, e, s in places if s.startswith("Fold")}
        want = {(r[0], r[1]): f"Fold_{r[4]}" for r in rows if r[0] in ("a", None, "b") and r[5] is not None and r[3]}
        assert folds == want
    metrics = split_metrics(spark.createDataFrame([("t", "Fold_1", i % 2, 0.2 + 0.6 * (i % 2)) for i in range(8)], "target string, split string, label int, p double"), ("target",), "youden")
    assert [(r["accuracy"], r["auc"]) for r in metrics.collect()] == [(1.0, 1.0)]
    missing = {(r["target"], r["split"]) for r in untrained(data.drop("held"), 3).collect()}
    assert missing == {(t, s) for t in ("few", "one") for s in ("Train_Test", "Fold_1", "Fold_2", "Fold_3")}


def test_neighbours_judge_the_training_rows_of_the_split(spark):
    x, y = made(60, 4)
    x[7] = x[8]  # equal rows: the smaller entity is nearer
    data = [("t", i, int(y[i]) if i != 11 else None, i % 3 + 1, "test" if i % 5 == 0 else "train", x[i].tolist()) for i in range(60)]
    rows = spark.createDataFrame(data, "target string, entity int, label int, fold int, side string, v array<double>")
    got = {(r["split"], r["entity"]): r["p"] for r in fold_predictions(rows, "knn", folds=3, k=3).collect()}
    want = {}
    for i in range(60):
        for split, seen in (("Train_Test" if i % 5 == 0 else "Train_Train", lambda j: j % 5 != 0), (f"Fold_{i % 3 + 1}", lambda j: j % 3 != i % 3)):
            near = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), j) for j in range(60) if seen(j) and j != 11)[:3]
            want[split, i] = sum(int(y[j]) for _, j in near) / 3
    assert got == pytest.approx(want)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_large_targets_meet_in_blocks_and_rows_are_not_copied(spark, monkeypatch, kind):
    from titerflow.models import crossval, meeting

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (700, 5)) + 30.0, 2)
    x[100:160] = x[100]  # a group of equal rows
    data = []
    for t, n in (("big", 700), (None, 400), ("few", 30), ("tiny", 8)):
        for i in range(n):
            name = str(i) if kind == "string" else i
            data.append((t, name, None if i % 50 == 7 else int(x[i, 0] > 30), i % 3 + 1, None if i == 9 else "test" if i % 5 == 0 else "train", x[i].tolist()))
    twice = [r for r in data if r[0] == "big" and int(r[1]) in (20, 21)] + [("big", None, 1, 1, "train", x[3].tolist())]
    schema = f"target string, entity {kind}, label int, fold int, side string, v array<double>"

    def answers(rows):
        found = fold_predictions(spark.createDataFrame(rows, schema).repartition(3), "knn", folds=3, scaler="standard", k=4)
        return sorted(((r["target"] or "", str(r["entity"]), r["label"] is None, r["split"], r["held"], round(r["p"], 9)) for r in found.collect()))

    for rows in (data, data + twice):
        want = answers(rows)
        with monkeypatch.context() as m:
            m.setattr(crossval, "LARGE", 300)
            m.setattr(meeting, "STRIP", 16)
            m.setattr(meeting.fold_knn, "__defaults__", (64,))
            assert answers(rows) == want and len(want) > 2000
    monkeypatch.setattr(crossval, "LARGE", 300)
    plan = fold_predictions(spark.createDataFrame(data, schema), "knn", folds=3, k=4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan


def test_nearest_by_single_precision_misses_none(spark):
    from titerflow.models.meeting import Nearest

    rng = np.random.default_rng(8)
    for scale, shift in ((1.0, 0.0), (1e-6, 5.0), (1e3, 1e6), (1e20, 0.0)):
        x, y = rng.normal(shift, scale, (900, 7)), rng.normal(shift, scale, (150, 7))
        x[300:420] = x[5]
        y[:20] = x[5]
        found, label = Nearest(y, 6), rng.integers(0, 2, 900).astype("int32")
        for part in np.array_split(rng.permutation(900), 4):
            part = np.sort(part)
            found.meet(x[part], np.ones(len(part), bool), part, label[part])
        d = np.round(((y[:, None, :] - x[None, :, :]) ** 2).sum(-1), 9)
        want = np.argsort(d, axis=1, kind="stable")[:, :6]
        if scale < 1e10:
            assert (found.entity == want).all() and (found.label == label[want]).all()
        assert found.distance == pytest.approx(np.take_along_axis(d, want, 1), rel=1e-6, abs=1e-3 if shift > 9 else 2e-9)


def test_scalers_are_merged_from_parts(spark):
    data = [(i, [1e6 + i * 0.001, 5.0, -float(i)], "test" if i % 5 == 0 else "train", i % 4 + 1) for i in range(200)]
    features = spark.createDataFrame(data, "entity int, v array<double>, side string, fold int").repartition(7)
    for r in fold_scalers(features, 4, "standard").collect():
        x = np.array([d[1] for d in data if (d[2] == "train" if r["held"] == 0 else d[3] != r["held"])])
        assert r["centre"] == pytest.approx(x.mean(axis=0)) and r["scale"] == pytest.approx(np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0), rel=1e-6)
    with pytest.raises(ValueError):
        fold_scalers(features, 4, "rank")


def plain_net(x, y, alpha, l1):
    g, t, w = x.T @ x / len(y), x.T @ y / len(y), np.zeros(x.shape[1])
    size = np.linalg.eigvalsh(g).max() + alpha * (1 - l1)
    for _ in range(20000):
        u = w - (g @ w - t + alpha * (1 - l1) * w) / size
        w = np.sign(u) * np.maximum(np.abs(u) - alpha * l1 / size, 0)
    return w


def test_elastic_net_search(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(90, 4)) * [1, 10, 0.1, 1] + [0, 1e4, 3, -2]
    x[:, 3] = 7.0  # a constant column
    y = x[:, 0] + 0.2 * x[:, 1] - 8 * x[:, 2] + g.normal(size=90)
    data = [(i, i % 3 + 1, x[i].tolist(), float(y[i]), "z") for i in range(90)] + [(900, 1, None, 1.0, "z"), (901, 2, [1.0, 2.0, 3.0, 4.0], None, "z")]
    frame = spark.createDataFrame(data, "entity int, fold int, v array<double>, label double, sums string").repartition(5)
    settings = [(0, 0.05, 0.5), (1, 0.8, 0.15)]
    best, table, fits = elastic.search_elastic_net(frame, settings=settings)
    fold = np.arange(90) % 3 + 1
    scores = {0: [], 1: []}
    for r in fits.orderBy("draw", "fold").collect():
        a, b = x[fold != r["fold"]], y[fold != r["fold"]]
        scale = np.where(a.std(axis=0) > 1e-9, a.std(axis=0), 1.0)
        w = plain_net((a - a.mean(axis=0)) / scale, b - b.mean(), r["alpha"], r["l1_ratio"]) / scale
        left, right = x[fold == r["fold"]], y[fold == r["fold"]]
        error = right - left @ w - (b.mean() - a.mean(axis=0) @ w)
        scores[r["draw"]].append(1 - (error**2).sum() / ((right - right.mean()) ** 2).sum())
        assert r["coefficients"] == pytest.approx(w, abs=1e-6) and r["test_r2"] == pytest.approx(scores[r["draw"]][-1], abs=1e-6)
        assert (r["n_train"], r["n_test"]) == (60, 30)
    for r in table.collect():
        assert (r["cv_r2_mean"], r["cv_r2_std"]) == pytest.approx((np.mean(scores[r["draw"]]), np.std(scores[r["draw"]])), abs=1e-6)
    (r,) = best.collect()
    assert r["draw"] == max(scores, key=lambda d: np.mean(scores[d])) and r["n_train"] == 90
    scored = elastic.predict(best, frame.where("v is not null")).agg(F.avg("predicted")).first()[0]
    assert scored == pytest.approx(np.append(x, [[1, 2, 3, 4]], axis=0).mean(axis=0) @ np.array(r["coefficients"]) + r["intercept"])


def test_settings_are_drawn_from_ranges():
    from titerflow.models.estimators import SEARCH_SPACE, draw_params

    drawn = elastic.draw_settings(200, 1)
    assert len({a for _, a, _ in drawn}) == 200 and all(0.001 <= a <= 1 and 0.1 <= r <= 0.9 for _, a, r in drawn)
    trees = draw_params(SEARCH_SPACE["rf_regressor"], 50, 1)
    assert all(200 <= t["numTrees"] <= 400 and 10 <= t["maxDepth"] <= 20 for t in trees) and len({t["numTrees"] for t in trees}) > 20


def test_prediction_store_makes_only_what_is_missing(spark):
    import uuid

    from titerflow.plans.applicability import applicability, current_predictions, read_predictions, update_predictions
    from titerflow.session import temp_table_path

    path = temp_table_path(spark, f"store-{uuid.uuid4().hex}")
    x, y = made(60, 3)
    data = [(t, i, int(y[i]), "train", i % 3 + 1, x[i].tolist()) for t in ("a", "b") for i in range(60)] + [("few", 1, 1, "train", 1, [0.0, 0.0, 0.0])]
    schema = "target string, entity long, label int, side string, fold int, v array<double>"
    rows = spark.createDataFrame(data, schema)
    models = {f"m{k}": ("gaussian_nb", {"smoothing": 10.0**-k}) for k in range(8)}
    some = dict(list(models.items())[:2])
    assert update_predictions(rows.where("target = 'a'"), some, path, 3, None) == {"m0": 1, "m1": 1}
    assert update_predictions(rows.where("target <> 'few'"), models, path, 3, None) == {m: 1 if m in some else 2 for m in models}
    assert set(update_predictions(rows.where("target <> 'few'"), models, path, 3, None).values()) == {0}
    assert read_predictions(spark, path).count() == spark.read.parquet(path).count() == 2 * 60 * 8
    # a target that cannot be trained is tried again and leaves nothing
    assert set(update_predictions(rows, some, path, 3, None).values()) == {1} and current_predictions(rows, models, path, 3, None).count() == 960
    # a changed label makes new keys for its target alone; the old ones stay out of sight
    changed = rows.withColumn("label", F.when((F.col("target") == "b") & (F.col("entity") == 5), 1 - F.col("label")).otherwise(F.col("label")))
    assert current_predictions(changed, some, path, 3, None).count() == 120
    assert update_predictions(changed.where("target <> 'few'"), some, path, 3, None) == {"m0": 1, "m1": 1}
    assert current_predictions(changed, some, path, 3, None).count() == 240
    certain, curves, table = applicability(rows.where("target <> 'few'"), models, path, 3, None)
    assert certain.count() == 120 and table.count() == 19 and curves.where("auc is not null").count() > 0


def test_forests_do_not_depend_on_where_rows_lie_or_nodes_are_grown(spark):
    from titerflow.models.forest import forest_predictions

    g = np.random.default_rng(3)
    x = g.normal(size=(700, 2))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) ^ (g.random(700) < 0.1)).astype(int)
    rows = [(t, i, int(y[i]), "test" if i % 5 == 0 else "train", 1, x[i].tolist()) for t in ("a", None) for i in range(700 if t else 120)]
    rows += [("few", i, i % 2, "train", 1, [0.0, 1.0]) for i in range(6)] + [("one", i, 1, "train", 1, [0.0, 1.0]) for i in range(30)]
    rows += [("a", 900, None, "train", 1, [1.0, 1.0]), ("a", 901, 1, "train", 2, None), ("a", 902, 7, "train", 3, [0.0, 0.0])]
    data = frame(spark, rows)
    # both features are open to every node, so histograms over blocks and growth in one task must choose the same splits
    whole = forest_predictions(data, num_trees=8).collect()
    cut = forest_predictions(data.repartition(7), num_trees=8, limit=40).collect()
    want = {(r["target"], r["entity"]): r["p"] for r in whole}
    assert set(want) == {(r[0], r[1]) for r in rows if r[0] in ("a", None) and r[5]} and len(want) == len(whole) == len(cut)
    assert {(r["target"], r["entity"]): r["p"] for r in cut} == pytest.approx(want, abs=1e-9)
    judged = [r for r in whole if r["target"] == "a" and r["entity"] < 700 and r["side"] == "test"]
    assert np.mean([(r["p"] >= 0.5) == r["label"] for r in judged]) > 0.8
    assert forest_predictions(data.limit(0)).collect() == []


def test_trees_choose_the_best_split():
    from titerflow.models.forest import _best, _routed, grow

    g = np.random.default_rng(5)
    pos, neg = g.integers(0, 9, (2, 6, 3, 32)) * 1.0
    pos[:, 1:], neg[:, 1:] = g.permuted(pos[:, :1].repeat(2, 1), axis=2), g.permuted(neg[:, :1].repeat(2, 1), axis=2)

    def gini(a, b):
        return a * b / (a + b) if a + b else 0.0

    for node, (slot, at, gain) in enumerate(zip(*_best(pos, neg))):
        gains = [[gini(p.sum(), n.sum()) - gini(p[: b + 1].sum(), n[: b + 1].sum()) - gini(p[b + 1 :].sum(), n[b + 1 :].sum()) for b in range(32)] for p, n in zip(pos[node], neg[node])]
        assert gain == pytest.approx(np.max(gains)) and gains[slot][at] == pytest.approx(gain)
    x, y = g.integers(0, 32, (300, 4)).astype(np.uint8), g.integers(0, 2, 300) * 1.0
    feature, cut, left, p = grow(x, y, np.ones(300), 0, 30, 4, lambda node, n: np.tile(np.arange(4), (n, 1)))
    alike = {tuple(r): y[(x == r).all(axis=1)].mean() for r in x}
    assert p[_routed(x, feature, cut, left)] == pytest.approx([alike[tuple(r)] for r in x])  # grown until rows are alike


def test_lowest_values_of_a_row_with_ties():
    from titerflow.models.native import _lowest

    g = np.random.default_rng(1)
    for n, take in ((3, 3), (200, 5), (1000, 5), (1000, 1), (1003, 40)):
        d = np.concatenate([g.random((20, n)), g.integers(0, 3, (20, n)) * 1.0, np.zeros((1, n)), g.integers(0, 9, (5, n)) * 3e-10 + 2.0])
        place, value = _lowest(d.copy(), take)
        want = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :take]
        assert (place == want).all() and (value == np.round(np.take_along_axis(d, want, 1), 9)).all()


def test_splits_of_the_same_rows_share_models_of_folds(spark, monkeypatch):
    from titerflow.models import estimators as E

    asked = []

    def noted(rows, model, folds=0, *args, **kw):
        asked.append((model, folds))
        return fold_predictions(rows, model, folds, *args, **kw)

    monkeypatch.setattr(E, "fold_predictions", noted)
    x, y = made(90, 4)
    data = spark.createDataFrame([("t", i, int(y[i]), i % 3 + 1, x[i].tolist()) for i in range(90)], "target string, entity long, label int, fold int, v array<double>")

    def side(by):
        return F.when(F.col("entity") % by == 0, "test").otherwise("train")

    splits = {"fives": lambda df: df.withColumn("side", side(5)), "fours": lambda df: df.withColumn("side", side(4)), "fewer": lambda df: df.where("entity < 70").withColumn("side", side(4))}
    models = ["gaussian_nb", "knn"]

    def grid(some):
        rows = E.run_grid({"v": data}, models, {n: splits[n] for n in some}, folds=3, scaler="standard", threshold_on="test").collect()
        return {(r["split_method"], r["model"], r["split"]): (r["tp"], r["tn"], r["fp"], r["fn"], round(r["auc"], 9)) for r in rows}

    together = grid(splits)
    assert asked == [*[(m, 3) for m in models], *[(m, 0) for m in models], *[(m, 3) for m in models]]
    assert {k: v for k, v in together.items() if k[0] == "fours"} == grid(["fours"]) and len(together) == 3 * (2 * 5 - 1)


def test_settled_keeps_only_the_last_table(spark):
    import os

    from titerflow import session

    first = materialize(spark.range(5))
    paths = []

    def make():
        middle = materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
        paths.append(middle.inputFiles()[0].removeprefix("file://"))
        return middle.where("k > 2")

    out = session.settled(spark, make)
    assert out.count() == 4 and first.count() == 5 and not os.path.exists(paths[0])
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    session.release()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in out.inputFiles())

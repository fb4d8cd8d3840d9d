"""Model layer: penalty mapping by a gradient check, determinism, a metric
floor on a separable table, and the staged history against the final model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parityframe.operators import learners as ml


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, float(a), float(b), float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int"), x, y


def test_logistic_penalty_mapping(spark):
    df, x, y = table(spark)
    C = 0.5
    m = ml.logistic(len(y), C=C).fit(ml.assemble(df, ["a", "b", "c"]))
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    grad_w = C * (x.T @ (p - y)) + w          # d/dw of C*sum(loss) + |w|^2/2
    grad_b = C * np.sum(p - y)
    assert np.max(np.abs(grad_w)) < 1e-3 and abs(grad_b) < 1e-3


def test_boosted_deterministic_and_accurate(spark):
    df, _, _ = table(spark, seed=1)
    d = ml.assemble(df, ["a", "b", "c"])
    p1 = ml.predictions(ml.boosted(maxIter=5, maxDepth=3).fit(d), d, "id", "label").orderBy("id").collect()
    p2 = ml.predictions(ml.boosted(maxIter=5, maxDepth=3).fit(d), d, "id", "label").orderBy("id").collect()
    assert p1 == p2
    acc = np.mean([r.y_true == r.y_pred for r in p1])
    assert acc > 0.85


def test_history_last_round_matches_model(spark):
    df, _, _ = table(spark, seed=2)
    d = ml.assemble(df, ["a", "b", "c"])
    m = ml.boosted(maxIter=4, maxDepth=2).fit(d)
    h = ml.eval_history(m, {"train": d})
    last = {r.metric: r.value for r in h.where(F.col("round") == 4).collect()}
    preds = ml.predictions(m, d, "id", "label").collect()
    err = np.mean([r.y_true != r.y_pred for r in preds])
    assert last["error"] == pytest.approx(err)
    assert h.select("round").distinct().count() == 4


def test_history_equals_staged_predictions(spark, monkeypatch):
    df, _, y = table(spark, seed=3)
    d = ml.assemble(df, ["a", "b", "c"])
    m = ml.boosted(maxIter=6, maxDepth=3).fit(d)
    monkeypatch.setattr(ml, "AUC_ROUNDS", 4)
    got = {(r.round, r.metric): r.value for r in ml.eval_history(m, {"train": d}).collect()}
    staged = np.zeros(len(y))
    for i, (tree, weight) in enumerate(zip(m.trees, m.treeWeights)):
        staged += weight * np.array([r.prediction for r in tree.transform(d).orderBy("id").collect()])
        p = 1 / (1 + np.exp(-2 * staged))
        pairs = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
        assert got[i + 1, "auc"] == pytest.approx(pairs)
        assert got[i + 1, "error"] == pytest.approx(np.mean((p > 0.5) != (y == 1)))
        assert got[i + 1, "logloss"] == pytest.approx(-np.mean(np.log(np.where(y == 1, p, 1 - p))))


def test_penalty_follows_each_fit(spark):
    df, _, _ = table(spark, seed=4)
    from parityframe.operators.split import stratified_folds
    d = ml.assemble(stratified_folds(df, "label", ["id"], k=4), ["a", "b", "c"])
    seen = []

    def make(n, **kw):
        seen.append((n, ml.logistic(n, **kw).getRegParam()))
        return ml.logistic(n, max_iter=5, **kw)
    ml.learning_curve(make, d, ["id"], [0.25, 1.0])
    ml.grid_search(make, {"C": [0.01]}, d)
    assert len(seen) == 2 * 4 + 4 + 1 and seen[-1][0] == 400 and all(299 <= n <= 301 for n, _ in seen[-5:-1])
    assert all(reg == pytest.approx(1 / (0.01 * n)) for n, reg in seen)


def test_empty_curve_point_stays(spark):
    df, _, _ = table(spark, n=20)
    d = ml.assemble(df.withColumn("fold", F.col("id") % 2), ["a", "b", "c"])
    rows = ml.learning_curve(ml.logistic, d, ["id"], [0.0]).collect()
    assert len(rows) == 4 and all(r.n_train == 0 and r.accuracy is None for r in rows)


def test_fits_of_a_size_are_scored_in_one_pass(spark, monkeypatch):
    df, _, _ = table(spark, n=200, seed=6)
    d = ml.assemble(df.withColumn("fold", (F.col("id") % 3).cast("int")), ["a", "b", "c"])
    passes, seen = [], ml._accuracies
    monkeypatch.setattr(ml, "_accuracies", lambda df, label, asked: passes.append(len(asked)) or seen(df, label, asked))
    got = {(r.frac, r.fold, r.split): r.accuracy for r in ml.learning_curve(ml.logistic, d, ["id"], [0.5, 1.0]).collect()}
    assert sorted(passes) == [3, 3]
    t = ml.by_curve_draw(d, ["id"])
    for frac in (0.5, 1.0):
        for fold in range(3):
            rows, held = t.where((F.col("fold") != fold) & (F.col("__u") <= frac)), t.where(F.col("fold") == fold)
            m = ml.logistic(rows.count()).fit(rows)
            for split, part in (("train", rows), ("validation", held)):
                y = np.array([(r.prediction, r.label) for r in m.transform(part).collect()])
                assert got[frac, fold, split] == np.mean(y[:, 0] == y[:, 1])
    assert np.isnan(ml._accuracy(m, d.where("id < 0"), "label"))

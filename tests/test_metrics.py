"""Hand-checkable metric and fairness cases (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from parityframe.operators import fairness as fx
from parityframe.operators import metrics as mx


def pred(spark, rows, groups=("g",)):
    cols = ", ".join(f"{g} string" for g in groups)
    return spark.createDataFrame(rows, f"{cols}, y_true int, y_pred int, score double")


def test_auc_ties(spark):
    p = pred(spark, [("a", 0, 0, .5), ("a", 1, 0, .5), ("a", 0, 0, .1), ("a", 1, 1, .9)])
    assert mx.roc_auc(p).first()["auc"] == pytest.approx(0.875)


def test_auc_invariant_under_monotone_map(spark):
    rows = [("a", i % 3 == 0, 0, (i * 37 % 101) / 101.0) for i in range(200)]
    rows = [(g, int(y), p, s) for g, y, p, s in rows]
    p = pred(spark, rows)
    a1 = mx.roc_auc(p).first()["auc"]
    a2 = mx.roc_auc(p.withColumn("score", F.col("score") * 3 - 7), n_buckets=7).first()["auc"]
    assert a1 == pytest.approx(a2)


def test_confusion_one_class(spark):
    p = pred(spark, [("a", 1, 1, .9), ("a", 1, 0, .1)])
    c = mx.confusion(p).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (0, 0, 1, 1)
    r = fx.equalized_odds(p, ["g"]).first()
    assert r["tpr"] == pytest.approx(.5) and r["fpr"] is None and r["fnr"] == pytest.approx(.5)


def test_tpr_plus_fnr_is_one(spark):
    rows = [(g, (i * 7) % 2, (i * 3) % 2, 0.5) for i, g in enumerate("abcabcabcab" * 5)]
    for r in fx.equalized_odds(pred(spark, rows), ["g"]).collect():
        if r["tpr"] is not None:
            assert r["tpr"] + r["fnr"] == pytest.approx(1.0)


def test_parity_gap(spark):
    # selection rates .2, .5, .4
    rows = ([("a", 0, 1, 0.)] * 1 + [("a", 0, 0, 0.)] * 4 + [("b", 0, 1, 0.)] * 1 + [("b", 0, 0, 0.)] * 1
            + [("c", 0, 1, 0.)] * 2 + [("c", 0, 0, 0.)] * 3)
    assert fx.parity_difference(pred(spark, rows), ["g"]).first()[0] == pytest.approx(0.3)


def test_odds_gap(spark):
    # TPR .8 / .6, FPR .1 / .4
    a = [("a", 1, 1, 0.)] * 8 + [("a", 1, 0, 0.)] * 2 + [("a", 0, 1, 0.)] * 1 + [("a", 0, 0, 0.)] * 9
    b = [("b", 1, 1, 0.)] * 6 + [("b", 1, 0, 0.)] * 4 + [("b", 0, 1, 0.)] * 4 + [("b", 0, 0, 0.)] * 6
    v = fx.odds_difference(pred(spark, a + b), ["g"]).first()[0]
    assert v == pytest.approx(0.3)
    assert 0 <= v <= 1


def test_below_mean(spark):
    fr = spark.createDataFrame([("a", .9), ("b", .6), ("c", .6)], "g string, f1 double")
    out = {r["g"] for r in fx.disadvantaged_groups(fr, ["g"], "f1").collect()}
    assert out == {"b", "c"}


def test_before_after_unequal_groups(spark):
    pre = spark.createDataFrame([("A", .5), ("B", .6)], "g string, accuracy double")
    post = spark.createDataFrame([("B", .7), ("C", .8)], "g string, accuracy double")
    rows = {r["g"]: (r["before"], r["after"]) for r in fx.before_after(pre, post, ["g"], "accuracy").collect()}
    assert rows == {"A": (.5, None), "B": (.6, .7), "C": (None, .8)}


def test_early_stop(spark):
    h = spark.createDataFrame([("test", i, "error", v) for i, v in enumerate([.5, .4, .4, .4, .3])],
                              "split string, round int, metric string, value double")
    r = mx.early_stop(h, patience=2).first()
    assert (r["best_round"], r["stop_round"], r["stopped"]) == (1, 3, True)


def test_overfit_flag(spark):
    # train: perfect separation; test: one ranking error -> AUC gap
    rows = [("train", 1, 1, .9), ("train", 0, 0, .1)] * 5 + [("test", 1, 1, .9), ("test", 0, 0, .1), ("test", 0, 0, .95)]
    p = spark.createDataFrame(rows, "split string, y_true int, y_pred int, score double")
    r = mx.overfit_check(p).first()
    assert r["overfit"] is True and r["auc_gap"] > .05


def test_class_report_totals(spark):
    p = pred(spark, [("a", 1, 1, 0.), ("a", 0, 1, 0.), ("a", 0, 0, 0.), ("a", 1, 0, 0.)])
    rep = {r["label"]: r for r in mx.classification_report(p).collect()}
    assert rep["accuracy"]["f1"] == pytest.approx(.5) and rep["accuracy"]["support"] == 4
    assert rep["1"]["precision"] == pytest.approx(.5) and rep["macro avg"]["recall"] == pytest.approx(.5)


def test_python_metric_fallback(spark):
    import numpy as np

    def acc(y, p, sample_weight):
        return float(np.sum(sample_weight * (y == p)) / np.sum(sample_weight))
    acc.python = True
    rows = [("a", 1, 1, 0.), ("a", 0, 1, 0.), ("b", 0, 0, 0.)]
    fr = {r["g"]: r["acc"] for r in mx.metric_frame(pred(spark, rows), ["g"], {"acc": acc}).collect()}
    assert fr == {"a": .5, "b": 1.0}


def test_complete_cells(spark):
    rows = [("x", "p", 1, 1, 0.), ("y", "q", 0, 0, 0.)]
    p = spark.createDataFrame(rows, "a string, b string, y_true int, y_pred int, score double")
    fr = mx.metric_frame(p, ["a", "b"], ["n", "accuracy"], complete=True).collect()
    assert len(fr) == 4 and sum(r["n"] for r in fr) == 2


def test_python_metric_no_groups(spark):
    import numpy as np

    def acc(y, p, sample_weight):
        return float(np.sum(sample_weight * (y == p)) / np.sum(sample_weight))
    acc.python = True
    p = pred(spark, [("a", 1, 1, 0.), ("a", 0, 1, 0.), ("b", 0, 0, 0.), ("b", 1, 1, 0.)])
    r = mx.metric_frame(p, [], {"n": None, "acc": acc}).collect()
    assert len(r) == 1 and r[0]["acc"] == pytest.approx(0.75) and r[0]["n"] == 4

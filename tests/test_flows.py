"""End-to-end flows on the smallest driver tables."""

import os

import pytest
from pyspark.sql import functions as F

from parityframe.operators import learners as ml
from parityframe.operators.rebalance import group_bootstrap
from parityframe.plans import flows
from parityframe.plans.tables import MODEL_FEATURES, model_table, orders_pred

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


def test_audit_flow_and_sink(spark, tmp_path):
    out = flows.fairness_audit(orders_pred(spark, SF), ["c_mktsegment", "o_orderpriority"])
    assert out["group_report"].count() == 10
    assert out["flagged_f1"].where("below_mean").count() >= 1
    paths = flows.write_plot_tables({"metric_frame": out["metric_frame"]}, str(tmp_path))
    assert spark.read.parquet(paths[0]).count() == out["metric_frame"].count()


def test_mitigation_flow(spark):
    t = model_table(spark, SF).withColumn("split", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train"))
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    out = flows.mitigation(train, test, "o_orderkey", "label", MODEL_FEATURES, ["c_mktsegment"],
                           lambda: ml.logistic(1000, max_iter=50))
    assert out["before_after_accuracy"].count() == 5
    assert {r.scenario for r in out["bundle"].collect()} == {"before", "after"}


def test_bootstrap_empty_raises(spark):
    df = spark.createDataFrame([], "id int, g string, y int")
    with pytest.raises(ValueError):
        group_bootstrap(df, ["g"], "y", ["id"])


@pytest.mark.parametrize("order", ["train_only", "before_split"])
def test_split_and_rebalance(spark, order):
    t = model_table(spark, SF)
    train, test = flows.split_and_rebalance(t, "o_orderkey", "label", MODEL_FEATURES, ["c_mktsegment"], rebalance=order)
    n_test, n_train = test.count(), train.count()
    assert n_test > 0 and n_train > 0
    for r in train.groupBy("c_mktsegment").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect():
        if order == "train_only":
            assert r.p * 2 == r.n            # balanced inside each group


def test_the_raw_tables_joins_run_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 11), "ab"[i % 2], i % 2) for i in range(60)], "id long, x double, y double, g string, label int")
    raw = rows.select("id", "x", "g", "label").join(rows.select("id", "y"), "id")
    seen, fences = [], flows.clean.iqr_sequential
    monkeypatch.setattr(flows.clean, "iqr_sequential", lambda df, *a: seen.append(df) or fences(df, *a))
    p = flows.prepare(raw, flows.TableSpec("id", "label", ["g"]))
    assert p.table.count() == 60 and "Join" in raw._jdf.queryExecution().toString()
    assert "Join" not in seen[0]._jdf.queryExecution().toString()

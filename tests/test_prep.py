"""Cleaning, features, encoding, selection (FIXTURES.md section 3)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parityframe.functions import features as fe
from parityframe.operators import clean, encode, profile
from parityframe.operators import select as sx


def col(spark, vals, name="x", t="double"):
    return spark.createDataFrame([(v,) for v in vals], f"{name} {t}")


def test_iqr_fence(spark):
    out, f = clean.iqr_filter(col(spark, [1., 2., 3., 4., 100.]), "x")
    assert (f.q1, f.q3, f.lower, f.upper) == (2., 4., -1., 7.)
    assert sorted(r.x for r in out.collect()) == [1., 2., 3., 4.]


def test_rare_flag_removed_literal(spark):
    out, _ = clean.iqr_filter(col(spark, [0] * 9 + [1], t="int"), "x")
    assert [r.x for r in out.collect()] == [0] * 9


def test_auto_columns_skip_flags(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "id int, flag int, v double")
    assert clean.default_iqr_columns(df, id_cols=["id"]) == ["v"]


def test_null_and_nan(spark):
    out, f = clean.iqr_filter(col(spark, [0., float("nan"), 2., 3., 4., 5., None]), "x")
    assert (f.q1, f.q3) == (2., 4.)
    assert sorted(r.x for r in out.collect()) == [0., 2., 3., 4., 5.]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_at_any_size(spark, seed):
    rng = np.random.default_rng(seed)
    vals = [float(v) for v in np.round(rng.lognormal(size=3000), 2)]
    df = col(spark, vals)
    a = clean.column_quantiles(df, "x", [.25, .5, .75])
    b = clean.column_quantiles(df, "x", [.25, .5, .75], gather=1)
    assert a == pytest.approx(b, abs=1e-12)
    assert a == pytest.approx(list(np.quantile(vals, [.25, .5, .75])))


def test_sequential_plan_single_scan(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(1000).select(F.col("id"), (F.col("id") % 97).cast("double").alias("v")).write.parquet(p)
    df = spark.read.parquet(p)
    out, _ = clean.iqr_sequential(df, ["v", "id", "v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PushedFilters" in plan


def test_safe_features(spark):
    df = spark.createDataFrame([(-1.0, 0.0), (3.0, 2.0), (-4.0, 1.0)], "a double, b double")
    r = df.select(fe.safe_log1p("a").alias("l"), fe.safe_sqrt("a").alias("s"), fe.safe_ratio("a", "b").alias("q")).collect()
    assert r[0].l is None and r[0].q is None and r[2].s is None
    assert r[1].l == pytest.approx(math.log(4.0)) and r[1].q == pytest.approx(1.5)


def test_group_delta(spark):
    df = spark.createDataFrame([("a", 1.), ("a", 3.), ("b", 5.)], "k string, x double")
    out = {(r.k, r.x): r.Delta_x for r in fe.group_mean_delta(df, ["x"], "k").collect()}
    assert out == {("a", 1.): -1., ("a", 3.): 1., ("b", 5.): 0.}


def test_encode_roundtrip_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("Z",), ("é",), (None,)], "c string")
    enc = encode.fit_label_encoder(df, ["c"])
    m = {r.value: r.code for r in enc.mapping.collect()}
    assert m == {"Z": 0, "a": 1, "b": 2, "é": 3}
    back = encode.decode_columns(encode.apply_label_encoder(df, enc), enc.mapping, ["c"])
    assert sorted(r.c for r in back.collect() if r.c) == sorted(["b", "a", "Z", "é"])
    new = spark.createDataFrame([("q",)], "c string")
    assert encode.apply_label_encoder(new, enc, unseen="null").first().c is None
    with pytest.raises(Exception):
        encode.apply_label_encoder(new, enc, unseen="error").collect()


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1.0)], "a int, b double")
    assert {r.column: r.nulls for r in profile.null_counts(df).collect()} == {"a": 0, "b": 2}
    assert profile.duplicate_count(df).first().duplicates == 1
    assert tuple(profile.shape(df).first()) == (3, 2)


def test_constant_corr(spark):
    df = spark.createDataFrame([(1., 1.), (1., 2.), (1., 3.)], "x double, y double")
    r = sx.corr_matrix(df, ["x", "y"]).first()
    assert r.r is None
    assert sx.corr_prune(sx.corr_matrix(df, ["x", "y"]), 0.7).count() == 0


def test_prune_order(spark):
    df = spark.createDataFrame([(float(a), 2. * a, -float(a)) for a in range(10)], "a double, b double, c double")
    dropped = [r.column for r in sx.corr_prune(sx.corr_matrix(df, ["a", "b", "c"]), 0.7, protected=["b"]).collect()]
    assert dropped == ["c"]


def test_chi2_and_k_best(spark):
    df = spark.createDataFrame([(1., 0), (1., 0), (3., 1), (3., 1)], "x double, y int")
    s = sx.chi2_scores(df, ["x"], "y")
    assert s.first().score == pytest.approx(2.0)
    assert sx.select_k_best(s, 5).count() == 1


def test_narrowing_equals_gathering(spark):
    rng = np.random.default_rng(3)
    df = col(spark, [float(v) for v in np.round(rng.normal(size=2000) * 10, 3)])
    want, fw = clean.iqr_sequential(df, ["x", "x"])
    got, fg = clean.iqr_sequential(df, ["x", "x"], gather=20)
    assert [v for f in fg for v in (f.q1, f.q3)] == pytest.approx([v for f in fw for v in (f.q1, f.q3)])
    assert got.count() == want.count()


def test_clinical_feature_set(spark):
    from parityframe.functions import clinical
    cols = sorted({c for _, _, ins in clinical.SOLUTION_FEATURES for c in ins} - {"Country"})
    rows = [tuple([float(i + j + 1) for j in range(len(cols))] + [c]) for i, c in enumerate(["x", "x", "y"])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", Country string")
    out = clinical.apply_feature_set(df, clinical.SOLUTION_FEATURES)
    names = [n for n, _, _ in clinical.SOLUTION_FEATURES]
    assert all(n in out.columns for n in names) and len(names) == 17
    r = {x.Country + str(x.WBC_Count): x for x in out.collect()}
    wbc = [x.WBC_Count for x in out.collect() if x.Country == "x"]
    some = next(iter(r.values()))
    assert some.Hemoglobin_WBC == pytest.approx(some.Hemoglobin_Level / some.WBC_Count)
    assert sorted(x.Delta_WBC for x in out.collect() if x.Country == "x") == pytest.approx(
        sorted(w - sum(wbc) / len(wbc) for w in wbc))


def test_corr_pairwise_complete(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 3.0), (3.0, 6.5, float("nan")), (4.0, 8.0, 1.0), (5.0, 9.0, 0.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.r for r in sx.corr_matrix(df, ["a", "b", "c"]).collect()}
    arr = np.array([[np.nan if v is None else v for v in r] for r in rows])

    def pair(i, j):
        m = ~np.isnan(arr[:, i]) & ~np.isnan(arr[:, j])
        return np.corrcoef(arr[m, i], arr[m, j])[0, 1]
    assert got[("a", "b")] == pytest.approx(pair(0, 1))
    assert got[("a", "c")] == pytest.approx(pair(0, 2))
    assert got[("b", "c")] == pytest.approx(pair(1, 2))

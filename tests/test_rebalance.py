"""Splits, folds, scaling, bootstrap, neighbours, SMOTE: hand cases and
properties (exactness vs brute force, partition independence)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parityframe.operators import rebalance as rb
from parityframe.operators import split as sp
from parityframe.operators.neighbors import knn_same_class


def boot_input(spark):
    rows = [(1, "A", 1), (2, "A", 1), (3, "A", 0), (4, "A", 0),
            (5, "B", 1), (6, "B", 1), (7, "B", 1),
            (8, "C", 1), (9, "C", 0), (10, "C", 0), (11, "C", 0)]
    return spark.createDataFrame(rows, "id int, g string, y int")


def test_bootstrap_cases(spark):
    out = rb.group_bootstrap(boot_input(spark), ["g"], "y", ["id"]).collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append(r)
    assert "B" not in by                                  # one class: dropped
    a = by["A"]
    assert len(a) == 4 and sorted(r.id for r in a if r.y == 1) == [1, 2]   # tie: negatives redrawn
    assert all(r.id in (3, 4) for r in a if r.y == 0)
    c = by["C"]
    assert sorted(r.id for r in c if r.y == 0) == [9, 10, 11] and [r.id for r in c if r.y == 1] == [8, 8, 8]


def test_bootstrap_tie_keep_and_balance(spark):
    out = rb.group_bootstrap(boot_input(spark), ["g"], "y", ["id"], tie="keep")
    assert sorted(r.id for r in out.where("g = 'A'").collect()) == [1, 2, 3, 4]
    rep = {(r.g, r.y): r.status for r in rb.balance_report(boot_input(spark), out, ["g"], "y").collect()}
    assert rep[("B", 1)] == "dropped" and rep[("C", 1)] == "kept"


def test_bootstrap_partition_independent(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"),
                                 (F.col("id") % 7 == 0).cast("int").alias("y"))
    a = sorted(tuple(r) for r in rb.group_bootstrap(df, ["g"], "y", ["id"]).collect())
    b = sorted(tuple(r) for r in rb.group_bootstrap(df.repartition(7), ["g"], "y", ["id"]).collect())
    assert a == b
    for g in "012":
        sub = [r for r in a if r[1] == g]
        assert sum(1 for r in sub if r[2] == 1) == sum(1 for r in sub if r[2] == 0)


def test_split_exact(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    s = sp.train_test_split(df, ["k"], 0.2)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"test": math.ceil(0.2 * 1003), "train": 1003 - math.ceil(0.2 * 1003)}
    s2 = sp.train_test_split(df.repartition(5), ["k"], 0.2)
    assert sorted(r.k for r in s.where("split='test'").collect()) == sorted(r.k for r in s2.where("split='test'").collect())


def test_folds_balanced(spark):
    df = spark.range(203).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    f = sp.stratified_folds(df, "y", ["id"], k=5)
    for y in (0, 1):
        sizes = [r["count"] for r in f.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5


def test_minmax(spark):
    train = spark.createDataFrame([(0., 5.), (10., 5.)], "x double, c double")
    mm = sp.fit_minmax(train, ["x", "c"])
    r = mm.apply(spark.createDataFrame([(12., 5.)], "x double, c double")).first()
    assert r.x == pytest.approx(1.2) and r.c == 0.0


def test_sample_with_replacement(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    out = rb.sample_with_replacement(df, 120, ["k"])
    assert out.count() == 120 and out.select("k").distinct().count() <= 50


def brute_knn(pts, k):
    res = {}
    for key, lab, v in pts:
        cands = [(float(np.sum((np.array(v) - np.array(w)) ** 2)), o) for o, l2, w in pts if l2 == lab and o != key]
        res[key] = [o for _, o in sorted(cands)[:k]]
    return res


@pytest.mark.parametrize("dim,block", [(2, 8), (5, 16)])
def test_knn_exact(spark, dim, block):
    rng = np.random.default_rng(dim)
    pts = [(i, int(i % 3), [float(x) for x in np.round(rng.normal(size=dim), 3)]) for i in range(150)]
    df = spark.createDataFrame(pts, "k long, lab int, v array<double>")
    got = {}
    for r in knn_same_class(df, "k", "lab", "v", k=4, cell_rows=block).collect():
        got.setdefault(r.k, []).append((r.nb_rank, r.nb_key))
    want = brute_knn(pts, 4)
    assert {k: [b for _, b in sorted(v)] for k, v in got.items()} == want


def test_knn_with_equal_vectors_and_few_rows(spark):
    pts = [(i, int(i < 40), [float(i % 3 == 0), float(i % 2)]) for i in range(60)] + [(99, 7, [0.0, 0.0])]
    df = spark.createDataFrame(pts, "k long, lab int, v array<double>")
    got = {}
    for r in knn_same_class(df, "k", "lab", "v", k=4, cell_rows=2).collect():
        got.setdefault(r.k, []).append((r.nb_rank, r.nb_key))
    assert {k: [b for _, b in sorted(v)] for k, v in got.items()} == {k: v for k, v in brute_knn(pts, 4).items() if v}
    with pytest.raises(ValueError):
        knn_same_class(df.unionByName(df.limit(1)), "k", "lab", "v")


def test_knn_sends_a_query_once_to_a_group_of_cells(spark, monkeypatch):
    """Many cells to search, some larger than a group, values shared by more rows than k."""
    from parityframe.operators import neighbors as nn
    for name, value in (("PART_ROWS", 16), ("GROUP_ROWS", 24), ("PAIRS", 64)):
        monkeypatch.setattr(nn, name, value)
    plans, seen = [], nn._searched
    monkeypatch.setattr(nn, "_searched", lambda plan, *a: plans.append(plan) or seen(plan, *a))
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(90, 8)), 2)
    pts = [(i, i % 2, vectors[i % 90].tolist()) for i in range(120)] + [(200 + i, 1, vectors[1].tolist()) for i in range(9)]
    df = spark.createDataFrame(pts, "k long, lab int, v array<double>")
    got = {}
    for r in knn_same_class(df, "k", "lab", "v", k=4, cell_rows=3).collect():
        got.setdefault(r.k, []).append((r.nb_rank, r.nb_key, r.dist))
    assert {k: [b for _, b, _ in sorted(v)] for k, v in got.items()} == brute_knn(pts, 4)
    where = {k: np.array(v) for k, _, v in pts}
    assert all(d == pytest.approx(np.linalg.norm(where[k] - where[b])) for k, v in got.items() for _, b, d in v)
    assert len(plans) == 2
    rows = plans[1].collect()
    assert len({(r.c, r.id, r.g) for r in rows}) == len(rows) and sum(len(r.cells) for r in rows) > 3 * len(rows)


def test_knn_pairs_do_not_follow_the_class(spark):
    """Eleven features, two one-hot groups (5 and 4 flags) and two measures:
    four times the points must not mean twice the compared pairs for each."""
    from parityframe.operators.neighbors import recall
    rng = np.random.default_rng(0)

    def per_point(n):
        v = np.c_[np.eye(5)[rng.integers(0, 5, n)], np.eye(4)[rng.integers(0, 4, n)], rng.normal(size=(n, 2)).round(2)]
        df = spark.createDataFrame([(i, 0, row) for i, row in enumerate(v.tolist())], "k long, lab int, v array<double>")
        pairs = []
        rows = knn_same_class(df, "k", "lab", "v", k=5, cell_rows=32, pair_counts=pairs).count()
        assert rows == 5 * n
        return pairs[0] / n, df
    small, _ = per_point(1000)
    large, df = per_point(4000)
    assert large < 2 * small
    assert recall(df, "k", "lab", "v", probe=8, sample=200) > 0.5


def test_duplicate_keys_raise(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0)], "id long, y int, a double")
    for call in (lambda: rb.smote(df, "id", "y", ["a"]), lambda: sp.train_test_split(df, ["id"]),
                 lambda: sp.stratified_folds(df, "y", ["id"]), lambda: rb.sample_with_replacement(df, 3, ["id"]),
                 lambda: rb.group_bootstrap(df.withColumn("g", F.lit("x")), ["g"], "y", ["id"])):
        with pytest.raises(ValueError):
            call()


def test_split_and_folds_move_no_rows(spark):
    """No exchange over raw rows: only counts are shuffled."""
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"), F.lit("text").alias("wide"))
    for out in (sp.train_test_split(df, ["k"]), sp.stratified_folds(df, "y", ["k"])):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    sizes = sp.stratified_folds(df, "y", ["k"]).groupBy("y", "fold").count().collect()
    assert len(sizes) == 10 and all(r["count"] == 50 for r in sizes)


def test_bootstrap_of_few_rows_joins_copies(spark, monkeypatch):
    df = spark.createDataFrame([(i, "g", int(i < 2)) for i in range(200)], "id long, g string, y int")
    want = sorted(map(tuple, rb.group_bootstrap(df, ["g"], "y", ["id"]).collect()))
    monkeypatch.setattr(rb, "SLOT_CHUNK", 10)
    assert sorted(map(tuple, rb.group_bootstrap(df, ["g"], "y", ["id"]).collect())) == want


def test_smote_balances(spark):
    rows = [(i, int(i < 12), float(i % 7), int(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b int")
    out = rb.smote(df, "id", "y", ["a", "b"], k=3)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 48
    orig = {r.id: (r.a, r.b) for r in df.collect()}
    for r in out.where("synthetic").collect():
        (a0, b0), (a1, b1) = orig[r.base_key], orig[r.nb_key]
        assert min(a0, a1) - 1e-9 <= r.a <= max(a0, a1) + 1e-9
        assert isinstance(r.b, int)


def test_smote_by_the_nearest_cells(spark):
    """A dozen independent features: what the search of a few cells finds is measured,
    and the class is balanced all the same."""
    from parityframe.operators.neighbors import recall
    rng = np.random.default_rng(2)
    names = [f"f{i}" for i in range(12)]
    rows = [(i, int(i < 400), *map(float, v)) for i, v in enumerate(rng.random((1000, 12)))]
    df = spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{n} double" for n in names))
    assert recall(df, "id", "y", names, probe=12, sample=150, cell_rows=32) >= 0.9
    out = rb.smote(df, "id", "y", names, k=5, probe=2)
    assert {r["count"] for r in out.groupBy("y").count().collect()} == {600}
    assert out.where("synthetic AND nb_key IS NULL").isEmpty()


def test_xxhash_mode_exact_split(spark):
    from parityframe.functions import hashing
    df = spark.range(1000).withColumnRenamed("id", "k")
    s = sp.train_test_split(df, ["k"], 0.2, hash_method="xxhash64")
    assert s.where("split = 'test'").count() == 200
    hs = [r.h for r in df.select(hashing.hash32(1, "k", method="xxhash64").alias("h")).collect()]
    assert min(hs) >= 0 and max(hs) < 2 ** 32

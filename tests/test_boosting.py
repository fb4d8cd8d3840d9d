"""Boosted fits against a plain version; independence of the rows' layout; sets,
prefixes and early stops against separate fits."""

import json
import pickle
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from parityframe.operators import boosting as bo
from parityframe.operators import learners as ml
from parityframe.operators.split import stratified_folds
from parityframe.plans import flows, q_flows
from parityframe.plans.flows import Stages

FEATS = ["a", "b", "c"]


def table(spark, n=300, seed=0, missing=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.4 * rng.normal(size=n) > 0).astype(int)
    if missing:
        x[rng.random((n, 3)) < 0.05] = np.nan
    rows = [(i, *map(float, v), int(t), i % 5) for i, (v, t) in enumerate(zip(x, y))]
    return ml.assemble(spark.createDataFrame(rows, "id long, a double, b double, c double, label int, fold int"), FEATS), x, y


def same(a, b):
    return len(a.list_of_trees) == len(b.list_of_trees) and all(
        (getattr(s, k) == getattr(t, k)).all() for s, t in zip(a.list_of_trees, b.list_of_trees) for k in ("feature", "cut", "value", "left"))


def plain_fit(codes, y, rounds, depth, rate, bins):
    """Margins of a booster that tries every split of every node in a loop."""
    def leaf(g, h):
        return -g.sum() / (h.sum() + 1)

    def grow(rows, g, h, level):
        best, out = (1e-6, None), np.full(len(rows), leaf(g[rows], h[rows]))
        if level < depth:
            for f in range(len(codes)):
                for cut in range(bins):
                    left = codes[f, rows] <= cut
                    gl, hl, gr, hr = g[rows[left]].sum(), h[rows[left]].sum(), g[rows[~left]].sum(), h[rows[~left]].sum()
                    if hl >= 1 and hr >= 1:
                        gain = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                        if gain > best[0] + 1e-12:
                            best = gain, left
        if best[1] is not None:
            for side in (best[1], ~best[1]):
                out[side] = grow(rows[side], g, h, level + 1)
        return out
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + rate * grow(np.arange(len(y)), p - y, p * (1 - p), 0)
    return margin


def test_as_a_plain_booster(spark):
    d, x, y = table(spark)
    est = ml.boosted(maxIter=6, maxDepth=3, stepSize=0.3, maxBins=8)
    binning = est.binning(d)
    want = plain_fit(binning.codes(x), y, 6, 3, 0.3, 9)
    got = {r.id: r.score for r in ml.predictions(est.fit(d), d, "id", "label").collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-5)


def test_bins_are_exact_ranks(spark):
    d, x, _ = table(spark, n=997, seed=5)
    for f, cuts in enumerate(ml.boosted(maxBins=16).binning(d.repartition(5)).cuts):
        v = np.sort(x[:, f][~np.isnan(x[:, f])])
        want = sorted({*v[[len(v) * i // 16 for i in range(1, 16)]]} - {v[-1]})
        assert cuts == pytest.approx(want, abs=1e-5) and (cuts >= np.array(want) - 1e-12).all()


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_layout_does_not_matter(spark, small):
    d, _, _ = table(spark, seed=1)
    est = ml.boosted(maxIter=5, maxDepth=4, subsamplingRate=0.7)
    models = [bo.fit_set(est.rows(d.repartition(n)), est.binning(d.repartition(n)), [est.spec()], small_bytes=small)[0] for n in (1, 4, 32)]
    scores = [[r.score for r in ml.predictions(m, d.repartition(3), "id", "label").orderBy("id").collect()] for m in models]
    assert same(models[0], models[1]) and same(models[0], models[2]) and scores[0] == scores[1] == scores[2]
    # Rows are really drawn, and both ways of summing agree.
    assert not same(models[0], ml.boosted(maxIter=5, maxDepth=4).fit(d))
    assert same(models[0], est.fit(d)) and models[0].history == est.fit(d).history


def test_tasks_in_step_with_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(bo, "CHECKPOINT_ROUNDS", 2)
    monkeypatch.setattr(bo, "TASK_ROWS", 10)       # over 16 tasks: summed by treeReduce
    d, _, _ = table(spark, n=90, seed=2)
    est = ml.boosted(maxIter=4, maxDepth=2)
    fits = [est.spec(fold=f, features=x, rounds=r) for f, x, r in ((0, None, 4), (3, (0, 2), 2), (None, (1,), 3))]
    rows, binning = est.rows(d, fold_col="fold"), est.binning(d)
    a, b = (bo.fit_set(rows, binning, fits, small_bytes=n) for n in (0, 1 << 30))
    assert all(same(x, y) and x.history == y.history for x, y in zip(a, b))
    alone = [bo.fit_set(rows, binning, [f])[0] for f in fits]
    assert all(same(x, y) for x, y in zip(a, alone))
    assert {int(f) for t in a[1].list_of_trees for f in t.feature if f >= 0} <= {0, 2}


def test_a_short_fit_is_a_prefix(spark):
    d, _, _ = table(spark, seed=3)
    long, short = ml.boosted(maxIter=6, maxDepth=3).fit(d), ml.boosted(maxIter=3, maxDepth=3).fit(d)
    assert same(long.first(3), short) and long.first(3).history == short.history and long.first(9) is long


def test_grid_gives_the_scores_of_separate_fits(spark):
    d, _, _ = table(spark, seed=4)
    d = d.withColumn("fold", F.col("fold") % 2)
    grid = {"maxIter": [2, 4, 6], "maxDepth": [2], "stepSize": [0.1, 0.4]}
    calls = []
    seen = bo.fit_set
    bo.fit_set = lambda rows, binning, fits, *a, **k: calls.append(fits) or seen(rows, binning, fits, *a, **k)
    try:
        best, scores = ml.grid_search(lambda n, **p: ml.boosted(subsamplingRate=0.8, **p), grid, d)
    finally:
        bo.fit_set = seen
    # 2 rates x 2 folds of the most rounds, then the refit.
    assert [len(c) for c in calls] == [4, 1] and {f.rounds for f in calls[0]} == {6}
    binning = ml.boosted().binning(d)
    got = {r.params: r.mean_accuracy for r in scores.collect()}
    want = {}
    for p in ml.grid_points(grid):
        est = ml.boosted(subsamplingRate=0.8, **p)
        fits = [est.fit(d.where(F.col("fold") != f), binning=binning) for f in range(2)]
        want[", ".join(f"{k}={v}" for k, v in sorted(p.items()))] = np.mean([
            ml._accuracy(m, d.where(F.col("fold") == f), "label") for f, m in enumerate(fits)])
    assert got == pytest.approx(want) and best.rounds == int(max(want, key=want.get).split("maxIter=")[1].split(",")[0])


def test_early_stop_grows_no_more_trees(spark):
    from parityframe.operators import metrics as mx
    d, _, _ = table(spark, seed=6)
    train, test = d.where("id % 3 > 0"), d.where("id % 3 = 0")
    est = ml.boosted(maxIter=60, maxDepth=4, stepSize=0.5)
    whole, short = est.fit(train, test), est.fit(train, test, patience=5)
    assert short.stopped and len(short.list_of_trees) == short.rounds < 60 and same(whole.first(short.rounds), short)
    want = mx.early_stop(ml.history_table(whole, spark), 5, metric="error", split="test").first()
    assert mx.early_stop(ml.history_table(short, spark), 5, metric="error", split="test").first() == want
    assert (want.best_round, want.stop_round) == (short.best_round, short.rounds)
    assert not est.fit(train, test, patience=100).stopped


def test_history_on_the_way_and_after(spark):
    d, _, _ = table(spark, seed=7)
    train, test = d.where("id % 3 > 0"), d.where("id % 3 = 0")
    m = ml.boosted(maxIter=5, maxDepth=3).fit(train, test)
    key = ("split", "round", "metric")
    on_the_way = {tuple(r[k] for k in key): r.value for r in ml.history_table(m, spark).collect()}
    after = {tuple(r[k] for k in key): r.value for r in ml.eval_history(m, {"train": train, "test": test}).collect()}
    assert {k: v for k, v in after.items() if k[2] != "auc"} == pytest.approx(on_the_way, abs=1e-6)
    assert len([k for k in after if k[2] == "auc"]) == 10


def test_history_is_one_pass_and_one_shuffle(spark):
    d, _, _ = table(spark, seed=8)
    m = ml.boosted(maxIter=50, maxDepth=2).fit(d)
    sums = bo.staged_sums(bo.staged_scores(m, [d, d], "label", range(1, 51), ml.AUC_ROUNDS), 1e-15, True)
    plan = sums._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("rangepartitioning(split") == 1 and plan.count("Exchange") == 1


def test_auc_with_ties_over_tasks(spark):
    from parityframe.operators.metrics import roc_auc
    d, _, _ = table(spark, n=400, seed=9)
    m = ml.boosted(maxIter=3, maxDepth=1).fit(d)      # a few scores only
    got = {r["round"]: r.value for r in ml.eval_history(m, {"all": d.repartition(9)}, metrics=("auc",)).collect()}
    for n in (1, 2, 3):
        want = roc_auc(ml.predictions(m.first(n), d, "id", "label"), "y_true", "score").first().auc
        assert got[n] == pytest.approx(want)
    one = ml.eval_history(m, {"ones": d.where("label = 1")}, metrics=("auc", "error"), rounds=[2]).collect()
    assert {r.metric: r.value is None for r in one} == {"auc": True, "error": False}


def test_curves_of_boosters_are_separate_fits(spark):
    d, _, _ = table(spark, seed=10)
    d = d.withColumn("fold", F.col("fold") % 2)
    make = lambda n: ml.boosted(maxIter=3, maxDepth=3)      # noqa: E731
    got = {(r.frac, r.fold, r.split): (r.n_train, r.accuracy) for r in ml.learning_curve(make, d, ["id"], [0.0, 0.4, 1.0]).collect()}
    t, binning = ml.by_curve_draw(d, ["id"]), make(0).binning(d)
    for frac in (0.4, 1.0):
        for fold in range(2):
            rows = t.where((F.col("fold") != fold) & (F.col("__u") <= frac))
            m = make(0).fit(rows, binning=binning)
            for split, part in (("train", rows), ("validation", t.where(F.col("fold") == fold))):
                assert got[frac, fold, split] == (rows.count(), pytest.approx(ml._accuracy(m, part, "label")))
    assert all(got[0.0, f, s] == (0, None) for f in range(2) for s in ("train", "validation"))


def test_curve_prefix_is_a_pruned_scan(spark):
    d, _, _ = table(spark, n=2000, seed=11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # tiny ranges stay files of their own
    try:
        t = ml.by_curve_draw(d.repartition(8), ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {r[0]: (r[1], r[2]) for r in t.groupBy(F.input_file_name()).agg(F.min("__u"), F.max("__u")).collect()}
    bounds = sorted(files.values())
    assert len(bounds) > 2 and all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    prefix = t.where("__u <= 0.1")
    assert "LessThanOrEqual(__u,0.1)" in prefix._jdf.queryExecution().executedPlan().toString()
    assert prefix.select(F.input_file_name()).distinct().count() < len(bounds)


def test_elimination_fits_no_subset_twice(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(240, 26))
    y = (x[:, 3] + x[:, 20] > 0).astype(int)
    names = [f"f{i}" for i in range(26)]
    df = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                               "id long, " + ", ".join(f"{n} double" for n in names) + ", label int")
    df = stratified_folds(df, "label", ["id"], k=3)
    seen = []
    fit_set = bo.fit_set
    monkeypatch.setattr(bo, "fit_set", lambda r, b, fits, *a, **k: seen.append([(f.fold, f.features) for f in fits]) or fit_set(r, b, fits, *a, **k))
    res = ml.rfecv(lambda n: ml.boosted(maxIter=3, maxDepth=2), df, names, min_features=10)
    flat = [x for level in seen for x in level]
    assert len(flat) == len(set(flat)) == 4 * 17 and [len(level) for level in seen] == [4] * 17
    assert {n for n in res.means} == set(range(10, 27)) and len(res.selected) >= 10
    assert {"f3", "f20"} <= set(res.selected)
    for floor in (10, 20, 21):
        kept = res.at_floor(floor)
        assert len(kept) >= floor and len(set(kept)) == len(kept)
        assert res.means[len(kept)] == max(v for n, v in res.means.items() if n >= floor)
    assert set(res.at_floor(10)) == set(res.selected)
    by_rank = {r.feature: r["rank"] for r in res.ranking.collect()}
    assert {f for f, r in by_rank.items() if r == 1} == set(res.selected)


def test_elimination_by_slices_equals_columns(spark):
    d, _, _ = table(spark, missing=False)
    res = ml.rfecv(lambda n: ml.logistic(n, max_iter=20), d, FEATS, min_features=1)
    got = {(r.n_features, r.fold): r.accuracy for r in res.scores.collect()}
    for fold in range(2):
        m = ml.logistic(240, max_iter=20).fit(ml.assemble(d.drop("features").where(F.col("fold") != fold), FEATS))
        assert got[3, fold] == pytest.approx(ml._accuracy(m, ml.assemble(d.drop("features").where(F.col("fold") == fold), FEATS), "label"))
    assert sorted(n for n, _ in got) == sorted([1, 2, 3] * 5)


def _quick(preset=None, **kw):
    return ml.boosted(maxDepth=kw.pop("maxDepth", 2), maxIter=kw.pop("maxIter", 3), **kw)


def test_leaderboard_flow_makes_each_stage_once(spark):
    raw, st = q_flows.raw_orders(spark, "/root/testdata/sf0.001"), Stages()
    calls = []
    get = st.get
    st.get = lambda name, build: get(name, lambda: calls.append(name) or build())
    out = flows.full_leaderboard(raw, q_flows.SPEC, {"logistic": lambda n: ml.logistic(n, max_iter=20), "a": lambda n: _quick(), "b": lambda n: _quick(stepSize=0.3)},
                                 k=3, selectors=("k_best", "rfecv"), selector=lambda n: _quick(), min_features=2, rebalance="smote", stages=st)
    rows = {r.model: r for r in out["leaderboard"].collect()}
    assert len(rows) == 6 and len({r.n for r in rows.values()}) == 1
    assert {r.model for r in out["importance"].select("model").distinct().collect()} == set(rows)
    assert len(calls) == len(set(calls)) and {"prepared", "parts", "k_best", "rfecv"} <= set(calls)
    # SMOTE before the split: both classes are the same size over both parts.
    parts = st.made["parts"]
    both = parts.train.select("label").unionByName(parts.test.select("label"))
    assert len({r["count"] for r in both.groupBy("label").count().collect()}) == 1


def test_mitigation_flow_as_the_reference(spark, monkeypatch):
    raw, st = q_flows.raw_orders(spark, "/root/testdata/sf0.001"), Stages()
    elbow = {}
    monkeypatch.setattr(ml, "depth_elbow", lambda make, depths, train, label, **k: elbow.update(n=train.count()) or train.select("label"))
    out = flows.full_mitigation(raw, q_flows.SPEC, lambda n: ml.logistic(n, max_iter=20), lambda n=0, **p: _quick(**p), sizes=[0.5, 1.0], depths=[2],
                                grid={"maxIter": [2, 4], "maxDepth": [1, 2]}, selector=lambda n: _quick(), min_features=2, patience=2, stages=st)
    before, after = st.made["parts before"], st.made["parts after"]
    # I5 then I3 on the training part: classes equal over all, the test part as before.
    assert len({r["count"] for r in after.train.groupBy("label").count().collect()}) == 1
    assert after.test.count() == before.test.count() and elbow["n"] == before.train.count() < after.train.count()
    assert after.keys == ["__row", "label", "slot"]
    assert after.train.where("slot IS NULL AND instr(__row, '#') < length(__row)").count() > 0
    stop = out["early_stop"].first()
    assert (stop.metric, stop.split) == ("error", "test")
    assert {r.model for r in out["curve"].collect()} == {"logistic", "boosted"}
    assert set(st.made["grid"]) == {"maxIter", "maxDepth"}
    assert json.dumps(sorted(out)) == json.dumps(sorted([
        "before_after_accuracy", "before_after_recall", "before_after_f1", "bundle", "bundle_groups", "history", "early_stop", "overfit",
        "curve", "elbow"]))


def test_the_larger_sibling_is_what_its_parent_has_beyond_the_other(spark, monkeypatch):
    d, _, _ = table(spark, n=400, seed=13)
    est = ml.boosted(maxIter=3, maxDepth=5, subsamplingRate=0.7)
    asked = []
    seen = bo.RoundRows.histogram

    def histogram(view, tree, nodes):
        asked.append((len(nodes), len(tree.feature)))
        return seen(view, tree, nodes)
    monkeypatch.setattr(bo.RoundRows, "histogram", histogram)
    block = pickle.loads(bo._blocks(est.rows(d, fold_col="fold"), est.binning(d), [est.spec()], 1).map(pickle.dumps).collect()[0])
    assert block.y.dtype == np.uint8 and block.fold.dtype == np.int16 and not len(block.share)
    bo._grown_alone([block], est.spec(), bo.BINS + 1)
    # Of the pairs that the first split and later ones make, one node each is summed.
    assert [n for n, nodes in asked if nodes in (1, 3)] == [1, 1] * 3


def test_scores_only_where_asked(spark):
    d, _, _ = table(spark, seed=14)
    fits = bo.fit_folds([ml.boosted(maxIter=n, maxDepth=2) for n in (2, 5)], d, [0, None])
    assert {h[0] for h in fits[1, 0, None].history} == {2, 5} and {h[0] for h in fits[0, 0, None].history} == {2}
    whole = bo.fit_set(ml.boosted().rows(d, fold_col="fold"), ml.boosted().binning(d), [ml.boosted(maxIter=5, maxDepth=2).spec(fold=0)])[0]
    assert bo.scored_at(fits[1, 0, None], "test") == bo.scored_at(whole, "test")


def test_a_batch_of_one_score_before_the_tail(spark):
    # A constant model: all rows of the batch merge into one.
    d, _, _ = table(spark, n=60, seed=15)
    m = ml.boosted(maxIter=2, maxDepth=1, minHessian=1e9).fit(d)
    sums = bo.staged_sums(bo.staged_scores(m, [d], "label", [2], ml.AUC_ROUNDS), 1e-15, True).collect()
    assert sum(r.pos + r.neg for r in sums) == 60
    got = {(r["round"], r.metric): r.value for r in ml.eval_history(m, {"all": d}, rounds=[2]).collect()}
    assert got[2, "auc"] == 0.5 and len(got) == 3


def test_history_by_rounds_and_by_ranges(spark, monkeypatch):
    d, _, _ = table(spark, n=300, seed=16)
    m = ml.boosted(maxIter=9, maxDepth=2).fit(d)
    parts = {"a": d.where("id % 3 > 0").repartition(4), "b": d.where("id % 3 = 0"), "none": d.limit(0)}
    rounds = [1, 4, 9, 12]

    def history():
        return {(r.split, r["round"], r.metric): r.value for r in ml.eval_history(m, parts, rounds=rounds).collect()}
    by_round = history()
    monkeypatch.setattr(bo, "HISTORY_ROWS", 0)
    assert len(by_round) == 18 and by_round == pytest.approx(history())


def coded_block(n=5000, features=5, seed=3, top=33):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, top, (features, n)).astype(np.uint8)
    y = (codes[0] / top + (codes[1] > top // 3) * codes[2] / top + 0.3 * rng.normal(size=n) > 0.7).astype(np.uint8)
    return bo.Block(codes, y, (np.arange(n) % 5).astype(np.int16), rng.integers(0, 1 << 63, n).astype(np.uint64), rng.random(n), np.zeros((1, n)))


@pytest.mark.parametrize("top,depth", [(33, 7), (33, 10), (200, 7), (2, 3)])
def test_leaves_read_from_tables_are_those_of_the_descent(monkeypatch, top, depth):
    monkeypatch.setattr(bo, "LOOKUP_ROWS", 700)
    block = coded_block(top=top)
    g = bo._grown_alone([block], bo.Fit(3, depth, 0.3, min_hessian=0.1), top)
    rows = bo.Lookup(block.codes, top)
    trees = [*g.trees, bo.Tree.stump()]
    assert max(len(t.feature) for t in trees) > 8 or top == 2
    for tree in trees:
        assert (rows.leaf_of(tree) == tree.leaf_of(block.codes)).all()
    margins = sum(0.3 * t.value[t.leaf_of(block.codes)] for t in g.trees)
    assert np.allclose(block.margins[0], margins)


@pytest.mark.parametrize("pair_rows", [0, 1 << 40])
@pytest.mark.parametrize("features", [None, (0, 3, 4), (2,)])
def test_sums_of_pairs_and_of_single_features(monkeypatch, pair_rows, features):
    monkeypatch.setattr(bo, "PAIR_ROWS", pair_rows)
    block, fit = coded_block(n=900), bo.Fit(1, 2, 0.1, subsample=0.7, fold=1, features=features)
    tree = bo.Tree.stump()
    children = tree.split(np.array([0]), 3, 16, 1.0, 0.0, 0.0)
    used = range(5) if features is None else features
    rows = block.drawn(fit, 4, block.trains(fit))
    whole = bo.RoundRows(block, 0, fit, 4, 33).histogram(tree, children)
    shared = bo.RoundRows(block, 0, fit, 4, 33, alone=False)
    assert shared.codes is None and (shared.of(block.codes).histogram(tree, children) == whole).all()
    assert whole.shape == (2, len(used), 33, 2)
    for at, side in enumerate((block.codes[3, rows] <= 16, block.codes[3, rows] > 16)):
        for j, f in enumerate(used):
            for code in range(33):
                here = rows[side & (block.codes[f, rows] == code)]
                assert whole[at, j, code].tolist() == [((0.5 - block.y[here]) * bo.SCALE).sum(), len(here) * bo.SCALE / 4]


def test_a_fit_holds_the_rows_that_it_asks_for_near_each_other():
    blocks = [coded_block(n=400, seed=s) for s in (1, 2)]
    fit = bo.Fit(6, 4, 0.3, subsample=0.8, fold=2, share=0.3)
    one = bo._joined(blocks, fit)
    asked = sum(int((b.trains(fit) | b.held(fit)).sum()) for b in blocks)
    assert len(one.y) == asked < 800 and one.codes.flags.c_contiguous and one.margins.shape == (1, asked)
    assert (np.diff((one.codes[0] >> 5).astype(int)) >= 0).all()
    alone, apart = bo._grown_alone([one], fit, 33), bo._grown_alone(blocks, fit, 33)
    assert alone.history == apart.history
    assert all((getattr(a, k) == getattr(b, k)).all() for a, b in zip(alone.trees, apart.trees) for k in ("feature", "cut", "value", "gain"))


def test_labels_beyond_one_keep_their_weights():
    block = coded_block(n=300)
    block.y = block.y * 1000.0
    view = bo.RoundRows(block, 0, bo.Fit(1, 1, 0.1), 0, 33)
    sums = view.histogram(bo.Tree.stump(), np.array([0]))
    assert sums[0, 0, :, 0].sum() == ((0.5 - block.y) * bo.SCALE).sum()


def test_features_of_few_codes_are_summed_together():
    codes = np.random.default_rng(3).integers(0, [[33], [33], [33], [26], [6]], (5, 4000)).astype(np.uint8)
    columns = bo.Columns(codes, (0, 1, 2, 3, 4))
    assert [g for g, _ in columns.groups(bo.GROUP_BINS)] == [[0, 1, 4], [2, 3]]
    assert [g for g, _ in columns.groups(33 * 33)] == [[0, 1], [2, 3], [4]]
    for group, numbers in columns.groups(bo.GROUP_BINS):
        rows = np.ravel_multi_index(codes[group], [columns.sizes[f] for f in group])
        assert (numbers == rows).all()


@pytest.mark.parametrize("step,depth", [(64, 3), (1000, 5), (1 << 15, 5)])
def test_rows_parted_where_they_are(monkeypatch, step, depth):
    monkeypatch.setattr(bo, "STEP_ROWS", step)
    block, fit = coded_block(n=1500), bo.Fit(2, depth, 0.3, subsample=0.6, fold=1, min_hessian=0.1)
    tree = bo._grown_alone([coded_block(n=1500)], fit, 33).trees[0]
    view = bo.RoundRows(block, 0, fit, 0, 33, columns=bo.Columns(block.codes, None))
    drawn = block.drawn(fit, 0, block.trains(fit))
    view.advance(tree, block.margins[0], 0.3, bo.Lookup(block.codes, 33))
    leaf = tree.leaf_of(block.codes)
    assert sorted(view.order.tolist()) == drawn.tolist() and len(view.held) > 2
    assert all((np.sort(view.order[a:b]) == drawn[leaf[drawn] == node]).all() for node, (a, b) in view.held.items())
    assert (block.margins[0] == 0.3 * tree.value[leaf]).all()


def test_a_fit_scores_the_rounds_that_its_booster_names(spark):
    d, _, _ = table(spark, seed=15)
    est = ml.boosted(maxIter=4, maxDepth=2)
    unread = replace(est, scored=()).fit(d)
    assert same(unread, est.fit(d)) and not unread.history
    # An early stop needs all of them; a search those that it ranks by.
    assert {h[0] for h in replace(est, scored=()).fit(d, d, patience=9).history} == {1, 2, 3, 4}
    assert bo.fit_folds([replace(est, scored=())], d, [0])[0, 0, None].history[-1][0] == 4


def test_dear_fits_are_dealt_out_first():
    fits = [bo.Fit(10, 4, 0.1, share=s) for s in (0.1, 1.0, 0.5)] + [bo.Fit(10, 4, 0.1), bo.Fit(10, 3, 0.1)]
    assert sorted(range(5), key=lambda i: -fits[i].cost()) == [1, 3, 4, 2, 0]


def test_a_grid_finds_its_bins_once(spark, monkeypatch):
    d, _, _ = table(spark, seed=4)
    d = d.withColumn("fold", F.col("fold") % 2)
    make = lambda n, **p: ml.boosted(maxDepth=2, **p)      # noqa: E731
    alone = make(0, maxIter=3).fit(d)
    binned, seen = [], bo.fit_binning
    monkeypatch.setattr(bo, "fit_binning", lambda *a: binned.append(1) or seen(*a))
    best, _ = ml.grid_search(make, {"maxIter": [3]}, d)
    assert len(binned) == 1 and same(best, alone)


def test_a_history_by_rounds_holds_little_beside_the_scores(monkeypatch):
    rng = np.random.default_rng(4)
    margins, y = np.round(rng.normal(size=5000), 1), rng.integers(0, 2, 5000).astype(np.uint8)
    whole = bo._round_sums(margins, y, 1e-15)
    # Stretches are cut where scores differ, however many are equal.
    monkeypatch.setattr(bo, "HISTORY_STEP", 7)
    parts = bo._round_sums(margins, y, 1e-15)
    assert parts[:3] == whole[:3] and parts == pytest.approx(whole)
    less = sum(float((margins[y == 0] < m).sum() + 0.5 * (margins[y == 0] == m).sum()) for m in margins[y == 1])
    assert parts[2] == less and parts[:2] == [int(y.sum()), int((1 - y).sum())]


def test_a_history_of_some_million_rows_shuffles_no_scores(spark, monkeypatch):
    d, _, _ = table(spark, n=60, seed=17)
    m = ml.boosted(maxIter=2, maxDepth=1).fit(d)
    assert bo.history_by_rounds(9_000_000, 5) and not bo.history_by_rounds(9_000_000, 26) and not bo.history_by_rounds(1 << 25, 1)
    monkeypatch.setattr(bo, "staged_scores", None)
    ml.eval_history(m, {"all": SimpleNamespace(count=lambda: 9_000_000, select=d.select, sparkSession=spark)}).collect()


def test_parts_lost_on_the_way_are_made_again(spark, monkeypatch):
    d, _, _ = table(spark, n=200, seed=18)
    est = ml.boosted(maxIter=5, maxDepth=3, subsamplingRate=0.7)
    fits = [est.spec(fold=f, features=x, rounds=r) for f, x, r in ((0, None, 5), (2, (0, 1), 3))]
    rows, binning = est.rows(d, fold_col="fold"), est.binning(d)
    seen, made = bo.Parts.sums, bo.Parts._make
    jobs, again = [], []

    def sums(parts, todos, so_far):
        jobs.append(parts.job)
        if parts.places is not None and len(jobs) % 2:
            name = parts.name

            def lose(part):
                with bo.Kept(name, part, fits, 33) as kept:
                    # A task that was cut off, or an executor that went away.
                    kept.dump(None, "done") if part % 2 else kept.drop()
            parts.places.foreach(lose)
        return seen(parts, todos, so_far)
    monkeypatch.setattr(bo, "TASK_ROWS", 50)
    monkeypatch.setattr(bo, "CHECKPOINT_ROUNDS", 2)
    monkeypatch.setattr(bo.Parts, "sums", sums)
    monkeypatch.setattr(bo.Parts, "_make", lambda parts, *so_far: again.append(parts.job) or made(parts, *so_far))
    lost, whole = (bo.fit_set(rows, binning, fits, small_bytes=n) for n in (0, 1 << 30))
    assert len(again) > 5 and len({*again}) < len(jobs)
    assert all(same(a, b) and a.history == b.history for a, b in zip(lost, whole))


def test_a_part_keeps_a_round_between_its_jobs(monkeypatch, tmp_path):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    block, fit = coded_block(n=900), bo.Fit(2, 3, 0.3, subsample=0.7, fold=1, features=(0, 2, 3))
    want = bo._grown_alone([bo._joined([coded_block(n=900)], fit)], fit, 33)
    g, job, fresh = bo._Growing(fit), 0, None
    with bo.Kept("a", 0, [fit], 33) as kept:
        kept.make([block.part(0, 300), block.part(300, 900)], {0: []}, {}, 1)
    while g.open():
        g.start()
        level, todo = 0, bo.Todo(fresh, fresh is not None, g.rounds, g.tree, g.asked)
        while todo:
            job += 1
            outs = []
            for _ in range(2):      # another attempt gets the same sums and changes nothing
                with bo.Kept("a", 0, [fit], 33) as kept:
                    outs.append(kept.run(job, {0: todo}))
            assert (outs[0]["hist", 0] == outs[1]["hist", 0]).all()
            if todo.scores:
                g.scored(outs[0]["scores", 0])
            g.grow(outs[0]["hist", 0], level)
            level, todo = level + 1, bo.Todo(tree=g.tree, nodes=g.asked) if len(g.asked) else None
        fresh = g.tree
        g.add_tree()
    with bo.Kept("a", 0, [fit], 33) as kept:
        g.scored(kept.run(job + 1, {0: bo.Todo(fresh, True)})["scores", 0])
        assert kept.run(job + 3, {}) is None
    assert all((getattr(a, k) == getattr(b, k)).all() for a, b in zip(g.trees, want.trees) for k in ("feature", "cut", "value", "gain"))
    assert g.history == want.history and len(g.trees) == 2

"""Catalogue: trained-classifier operators (N1-N14, F5). Results depend on a
fit, so these have no SQL oracle (rows-only check); the metric layer they feed
is oracle-checked separately, and what SQL can say about a fit is
(``learning_curve_sizes``, ``grid_fold_sizes``, ``logistic_gradient``).

Folds, sizes, depths, rounds, grid, penalty and patience are the reference's:
boosted fits are of the first preset, 400 rounds of depth 7, unless a query says so."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityframe.functions.hashing import sql_hash32
from parityframe.functions.metric_exprs import round_doubles
from parityframe.operators import fairness as fx
from parityframe.operators import learners as ml
from parityframe.operators import metrics as mx
from parityframe.operators.rebalance import group_bootstrap
from parityframe.operators.split import fit_minmax, stratified_folds, train_test_split
from parityframe.plans.catalog import register
from parityframe.plans.tables import MODEL_FEATURES, WIDE_FEATURES, model_table, wide_table
from parityframe.session import checkpoint as _ckpt

FEATS = [f + "_s" for f in MODEL_FEATURES]
GROUPS = ["c_mktsegment", "o_orderpriority"]
FOLDS = 5
#: Boosting rounds of the first preset.
TREES = ml.PRESETS["boost_a"]["maxIter"]
PATIENCE = 25
#: Least numbers of features in the reference's eliminations.
RFECV_FLOORS = [10, 20, 21]


def prepared(spark, sf):
    """Split (exact, by key hash), min-max scale fitted on train, stratified
    folds on train; both parts checkpointed to cut lineage."""
    return _prepared(model_table(spark, sf), MODEL_FEATURES)


def _prepared(t, features):
    s = train_test_split(t, ["o_orderkey"], 0.2).transform(_ckpt)
    train0 = s.where(F.col("split") == "train")
    mm = fit_minmax(train0, features)
    scaled = mm.apply(s, suffix="_s")
    train = stratified_folds(scaled.where(F.col("split") == "train"), "label", ["o_orderkey"], k=FOLDS)
    feats = [f + "_s" for f in features]
    train = ml.assemble(train, feats).transform(_ckpt)
    test = ml.assemble(scaled.where(F.col("split") == "test"), feats).transform(_ckpt)
    return train, test


def _gbt(n=None, **kw):
    """The first boosted preset (a penalty doesn't depend on n). No query reads the fit's
    own scores of its rounds but those that ask for them: a search or an early stop."""
    return ml.boosted("boost_a", **kw).unscored()


@register("logreg_scores")
def q_logreg_scores(spark, sf):
    train, test = prepared(spark, sf)
    m = ml.logistic(train.count()).fit(train)
    return round_doubles(ml.predictions(m, test, "o_orderkey", "label", GROUPS))


@register("gbt_scores")
def q_gbt_scores(spark, sf):
    train, test = prepared(spark, sf)
    m = _gbt().fit(train)
    return round_doubles(ml.predictions(m, test, "o_orderkey", "label", GROUPS))


@register("gbt_scores_b")
def q_gbt_scores_b(spark, sf):
    """The second boosted preset, 1000 rounds."""
    train, test = prepared(spark, sf)
    return round_doubles(ml.predictions(ml.boosted("boost_b").unscored().fit(train), test, "o_orderkey", "label", GROUPS))


@register("gbt_deep_leaderboard")
def q_gbt_deep_leaderboard(spark, sf):
    """Both presets at depth 10."""
    train, test = prepared(spark, sf)
    names = ["boost_a_deep", "boost_b_deep"]
    models = ml.parallel(lambda name: ml.boosted(name).unscored().fit(train), names, 2)
    a, b = (ml.predictions(m, test, "o_orderkey", "label").withColumn("model", F.lit(name)) for name, m in zip(names, models))
    return round_doubles(mx.leaderboard(a.unionByName(b)))


@register("grid_search")
def q_grid_search(spark, sf):
    """The 18 points."""
    train, _ = prepared(spark, sf)
    _, table = ml.grid_search(_gbt, ml.GRID_18, train)
    return round_doubles(table)


@register("grid_search_logistic")
def q_grid_search_logistic(spark, sf):
    """C over a small grid; each fold's penalty follows its own size."""
    train, _ = prepared(spark, sf)
    _, table = ml.grid_search(ml.logistic, {"C": [0.01, 0.1, 1.0]}, train)
    return round_doubles(table)


@register("depth_elbow")
def q_depth_elbow(spark, sf):
    train, _ = prepared(spark, sf)
    return round_doubles(ml.depth_elbow(lambda d: _gbt(maxDepth=d), ml.ELBOW_DEPTHS, train))


@register("learning_curve")
def q_learning_curve(spark, sf):
    train, _ = prepared(spark, sf)
    return round_doubles(ml.curve_summary(ml.learning_curve(ml.logistic, train, ["o_orderkey"], ml.CURVE_SIZES)))


@register("learning_curve_boosted")
def q_learning_curve_boosted(spark, sf):
    """The curve of the first boosted preset: 25 fits as one set."""
    train, _ = prepared(spark, sf)
    return round_doubles(ml.curve_summary(ml.learning_curve(_gbt, train, ["o_orderkey"], ml.CURVE_SIZES)))


_TRAIN_SQL = f"""
base AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label
  FROM orders JOIN customer ON o_custkey = c_custkey),
split AS (SELECT *, row_number() OVER (ORDER BY {sql_hash32(42, 'o_orderkey')}, o_orderkey) AS r,
  count(*) OVER () AS n FROM base),
train AS (SELECT o_orderkey, label FROM split WHERE r > ceil(0.2 * n)),
folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {sql_hash32('42|fold', 'o_orderkey')}, o_orderkey)
  * {FOLDS} + count(*) OVER (PARTITION BY label) - 1) // count(*) OVER (PARTITION BY label) - 1 AS INTEGER) AS fold FROM train)
"""


@register("learning_curve_sizes", f"""WITH {_TRAIN_SQL},
fracs AS (SELECT unnest([{', '.join(f"{x}::DOUBLE" for x in ml.CURVE_SIZES)}]) AS frac)
SELECT frac, f.fold, CAST(count_if(t.fold <> f.fold AND {sql_hash32('42|curve', 't.o_orderkey')} / 4294967296.0 <= frac) AS BIGINT) AS n_train
FROM fracs, (SELECT DISTINCT fold FROM folded) f, folded t GROUP BY frac, f.fold""")
def q_learning_curve_sizes(spark, sf):
    train, _ = prepared(spark, sf)
    return ml.curve_sizes(train, ["o_orderkey"], ml.CURVE_SIZES)


@register("grid_fold_sizes", f"WITH {_TRAIN_SQL} SELECT fold, label, count(*) AS n FROM folded GROUP BY fold, label")
def q_grid_fold_sizes(spark, sf):
    train, _ = prepared(spark, sf)
    return train.groupBy("fold", "label").agg(F.count("*").alias("n"))


@register("logistic_gradient", "SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATS) + "]) AS feature, 0.0::DOUBLE AS gradient")
def q_logistic_gradient(spark, sf):
    """The gradient of ``C * sum(loss) + |w|^2 / 2`` at the fitted weights, per
    coefficient and row: zero at the optimum, if the penalty is right."""
    train, _ = prepared(spark, sf)
    C = 0.01
    n = train.count()
    fitted = ml.logistic(n, C=C).fit(train)
    miss = ml.vector_to_array(F.col("probability"))[1] - F.col("label")
    sums = fitted.transform(train).agg(*[F.sum(miss * F.col(f)).alias(f) for f in FEATS])
    long = sums.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), (C * F.col(f) + F.lit(float(w))).alias("g"))
        for f, w in zip(FEATS, fitted.coefficients.toArray())])).alias("s"))
    # Rounded to 1e-4 of a row's weight; + 0.0 turns -0.0 into 0.0.
    return long.select("s.feature", (F.round(F.col("s.g") / (C * n), 4) + F.lit(0.0)).alias("gradient"))


@register("rfecv")
def q_rfecv(spark, sf):
    """Every size's score in every fold, and the ranking (fold -1). The table has
    five features, fewer than the reference's floor of 10, so the floor is 2."""
    train, _ = prepared(spark, sf)
    return _rfecv_table(ml.rfecv(ml.logistic, train.drop("features"), FEATS, min_features=2))


@register("rfecv_trees")
def q_rfecv_trees(spark, sf):
    """The same by the trees' gains, as most of the reference's runs."""
    train, _ = prepared(spark, sf)
    return _rfecv_table(ml.rfecv(_gbt, train.drop("features"), FEATS, min_features=2))


@register("rfecv_wide")
def q_rfecv_wide(spark, sf):
    """26 features down to the reference's floors 10, 20 and 21, by the flows' booster:
    (floor, n_features, feature, accuracy); one elimination serves the three."""
    train, _ = _prepared(wide_table(spark, sf), WIDE_FEATURES)
    feats = [f + "_s" for f in WIDE_FEATURES]
    res = ml.rfecv(lambda n: ml.boosted("boost_selector"), train.drop("features"), feats, min_features=min(RFECV_FLOORS))
    rows = []
    for floor in RFECV_FLOORS:
        kept = res.at_floor(floor)
        rows += [(floor, len(kept), f, res.means[len(kept)]) for f in kept]
    return round_doubles(spark.createDataFrame(rows, "floor int, n_features int, feature string, accuracy double"))


def _rfecv_table(res):
    scores = res.scores.select("n_features", "fold", "accuracy", F.lit(None).cast("string").alias("feature"),
                               F.lit(None).cast("int").alias("rank"))
    kept = res.ranking.select(F.lit(len(res.selected)).alias("n_features"), F.lit(-1).alias("fold"),
                              F.lit(None).cast("double").alias("accuracy"), "feature", "rank")
    return round_doubles(scores.unionByName(kept))


@register("importance_coef")
def q_importance_coef(spark, sf):
    train, _ = prepared(spark, sf)
    return round_doubles(ml.coef_importance(ml.logistic(train.count()).fit(train), FEATS))


@register("importance_gain")
def q_importance_gain(spark, sf):
    train, _ = prepared(spark, sf)
    return round_doubles(ml.gain_importance(_gbt().fit(train), FEATS))


@register("importance_weight")
def q_importance_weight(spark, sf):
    train, _ = prepared(spark, sf)
    return ml.split_count_importance(_gbt().fit(train), FEATS)


@register("eval_history_leaves")
@register("eval_history")
def q_eval_history(spark, sf):
    train, test = prepared(spark, sf)
    m = _gbt().fit(train)
    return round_doubles(ml.eval_history(m, {"train": train, "test": test}))


@register("eval_history_chosen")
def q_eval_history_chosen(spark, sf):
    """Some metrics at some rounds only."""
    train, test = prepared(spark, sf)
    return round_doubles(ml.eval_history(_gbt().fit(train), {"train": train, "test": test}, metrics=("auc",),
                                         rounds=[1, TREES // 2, TREES]))


@register("early_stop_model")
def q_early_stop_model(spark, sf):
    """The fit itself stops; its history is what it summed by then."""
    train, test = prepared(spark, sf)
    fitted = _gbt().fit(train, test, PATIENCE, "error")
    return round_doubles(mx.early_stop(ml.history_table(fitted, spark), patience=PATIENCE, metric="error", split="test"))


@register("model_overfit")
def q_model_overfit(spark, sf):
    train, test = prepared(spark, sf)
    m = _gbt().fit(train)
    p = (ml.predictions(m, train, "o_orderkey", "label").withColumn("split", F.lit("train"))
         .unionByName(ml.predictions(m, test, "o_orderkey", "label").withColumn("split", F.lit("test"))))
    return round_doubles(mx.overfit_check(p))


@register("model_leaderboard")
def q_model_leaderboard(spark, sf):
    train, test = prepared(spark, sf)
    lr = ml.logistic(train.count()).fit(train)
    gb = _gbt().fit(train)
    p = (ml.predictions(lr, test, "o_orderkey", "label").withColumn("model", F.lit("logistic"))
         .unionByName(ml.predictions(gb, test, "o_orderkey", "label").withColumn("model", F.lit("boosted"))))
    return round_doubles(mx.leaderboard(p))


@register("model_fairness_audit")
def q_model_fairness_audit(spark, sf):
    train, test = prepared(spark, sf)
    p = ml.predictions(_gbt().fit(train), test, "o_orderkey", "label", GROUPS).transform(_ckpt)
    return round_doubles(mx.group_report(p, GROUPS, metrics=["n", "accuracy", "precision", "recall", "f1",
                                                             "tpr", "fpr", "fnr"]))


@register("mitigation_before_after")
def q_mitigation(spark, sf):
    """K5/K6 on real classifiers: logistic regression trained on the training
    part as is vs. after group bootstrap (I5) of the training part only,
    audited on the same test part."""
    train, test = prepared(spark, sf)
    n = train.count()
    base = ml.predictions(ml.logistic(n).fit(train), test, "o_orderkey", "label", GROUPS).transform(_ckpt)
    boot = group_bootstrap(train.drop("features"), GROUPS, "label", ["o_orderkey"])
    boot = ml.assemble(boot, FEATS).transform(_ckpt)
    post = ml.predictions(ml.logistic(boot.count()).fit(boot), test, "o_orderkey", "label", GROUPS).transform(_ckpt)
    pre_f = mx.metric_frame(base, GROUPS, ["accuracy"])
    post_f = mx.metric_frame(post, GROUPS, ["accuracy"])
    return round_doubles(fx.before_after(pre_f, post_f, GROUPS, "accuracy"))


@register("mitigation_bundle")
def q_mitigation_bundle(spark, sf):
    train, test = prepared(spark, sf)
    n = train.count()
    base = ml.predictions(ml.logistic(n).fit(train), test, "o_orderkey", "label", GROUPS)
    boot = ml.assemble(group_bootstrap(train.drop("features"), GROUPS, "label", ["o_orderkey"]), FEATS).transform(_ckpt)
    post = ml.predictions(ml.logistic(boot.count()).fit(boot), test, "o_orderkey", "label", GROUPS)
    return round_doubles(fx.fairness_bundle(base, GROUPS, "before").unionByName(
        fx.fairness_bundle(post, GROUPS, "after")))

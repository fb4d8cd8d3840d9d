"""Learners, search and curves on Spark ML.

Logistic fits are Spark ML estimators (distributed over the rows); the driver only
loops over folds, grid points and feature subsets, as CrossValidator does. Boosted
fits are those of :mod:`parityframe.operators.boosting`, where a whole search is one set
of fits. Every result is a table: prediction tables ``(id, groups..., y_true,
y_pred, score)``, scores per (param, fold, split), importances per feature,
evaluation history per (split, round, metric).
"""

from __future__ import annotations

import itertools
import math
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parityframe.functions.hashing import uniform
from parityframe.operators import boosting
from parityframe.operators.boosting import Booster, history_table, scored_at  # noqa: F401
from parityframe.session import checkpoint, ensure_checkpoint_dir

# Hyper-parameter presets of the reference's boosted learners.
PRESETS = {
    "boost_a": {"maxIter": 400, "maxDepth": 7, "stepSize": 0.1, "subsamplingRate": 0.8},
    "boost_b": {"maxIter": 1000, "maxDepth": 7, "stepSize": 0.05, "subsamplingRate": 1.0},
    "boost_a_deep": {"maxIter": 400, "maxDepth": 10, "stepSize": 0.1, "subsamplingRate": 0.8},
    "boost_b_deep": {"maxIter": 1000, "maxDepth": 10, "stepSize": 0.05, "subsamplingRate": 1.0},
    # Of the recursive elimination in the flows.
    "boost_selector": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "subsamplingRate": 1.0},
}
# The 18-point search of the rebalanced booster, the depths of the
# elbow, the sizes of the learning curve.
GRID_18 = {"maxIter": [100, 200, 300], "maxDepth": [4, 6, 8], "stepSize": [0.1, 0.05]}
ELBOW_DEPTHS = [4, 5, 6, 7, 8, 9, 10]
CURVE_SIZES = [0.1, 0.325, 0.55, 0.775, 1.0]


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def logistic(n_rows: int, C: float = 0.01, max_iter: int = 1000, label: str = "label") -> LogisticRegression:
    """L2 logistic regression with the penalty of ``C * sum(loss) +
    |w|^2 / 2``: dividing by ``C * n`` gives Spark's objective with
    ``regParam = 1 / (C * n)`` (no standardization, intercept unpenalized)."""
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (C * max(1, n_rows)),
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8)


def boosted(preset: str | None = None, seed: int = 42, label: str = "label", **params) -> Booster:
    """Gradient-boosted trees; ``preset`` names one of PRESETS,
    keyword arguments override (``maxIter``, ``maxDepth``, ...). Second-order
    leaves with an L2 term; symmetric trees are not reproduced. The fit does not
    depend on how the rows are dealt."""
    return Booster(**{**(PRESETS[preset] if preset else {}), "seed": seed, "labelCol": label, **params})


def predictions(model: Model, df: DataFrame, id_col: str, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prediction table ``(id, keep..., y_true, y_pred, score)``; score
    is the positive-class probability, y_pred = score > 0.5."""
    scored = model.transform(df)
    score = vector_to_array("probability")[1]
    return scored.select(F.col(id_col).alias("id"), *keep, F.col(label).cast("int").alias("y_true"),
                         (score > 0.5).cast("int").alias("y_pred"), score.alias("score"))


def coef_importance(model, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)`` = |coefficient|."""
    spark = SparkSession.getActiveSession()
    coefs = model.coefficients.toArray().tolist()
    return spark.createDataFrame([(f, abs(float(c))) for f, c in zip(features, coefs)],
                                 "feature string, importance double")


def gain_importance(model, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)`` from the trees' normalised gains."""
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def split_count_importance(model, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)`` = number of internal nodes splitting on
    the feature (0 when unused)."""
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(n)) for f, n in zip(features, model.split_counts())], "feature string, importance double")


# ------------------------------------------------------------------ N4
def grid_points(grid: dict) -> list[dict]:
    """Every combination of the grid's values, in the order of its lists."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def parallel(work, items: list, parallelism: int) -> list:
    """Run independent fits ``parallelism`` at a time, results in order."""
    wrapped = inheritable_thread_target(SparkSession.getActiveSession())(work)
    with ThreadPool(max(1, min(parallelism, len(items) or 1))) as pool:
        return pool.map(wrapped, items, chunksize=1)


def _fold_parts(train: DataFrame, fold_col: str) -> dict:
    """{fold: (n, training rows, held-out rows)}. Sizes come from one count."""
    sizes = {r[fold_col]: r["count"] for r in train.groupBy(fold_col).count().collect()}
    total = sum(sizes.values())
    return {f: (total - n, train.where(F.col(fold_col) != f), train.where(F.col(fold_col) == f))
            for f, n in sorted(sizes.items())}


def grid_scores(make_estimator, grid: dict, train: DataFrame, label: str = "label", fold_col: str = "fold",
                parallelism: int = 4) -> list[tuple[dict, float]]:
    """(point, mean held-out accuracy) of every point of a grid, see :func:`grid_search`."""
    return _scored_grid(make_estimator, grid, train, label, fold_col, parallelism)[0]


def _scored_grid(make_estimator, grid: dict, train: DataFrame, label: str, fold_col: str, parallelism: int) -> tuple:
    """:func:`grid_scores`, and of boosted fits the first one's estimator and the bins of all."""
    points, parts = grid_points(grid), _fold_parts(train, fold_col)
    jobs = [(make_estimator(part[0], **p), f) for p in points for f, part in parts.items()]
    first = binning = None
    if jobs and isinstance(jobs[0][0], Booster):
        made = [e for e, _ in jobs[::len(parts)]]
        first, binning = made[0], made[0].binning(train)
        fits = boosting.fit_folds(made, train, list(parts), fold_col, binning=binning)
        scores = [scored_at(fits[i, f, None], "test") for i in range(len(made)) for f in parts]
    else:
        def score(job):
            _, rows, held = parts[job[1]]
            return _accuracy(job[0].fit(rows), held, label)
        scores = parallel(score, jobs, parallelism)
    return [(p, sum(scores[i * len(parts):(i + 1) * len(parts)]) / len(parts)) for i, p in enumerate(points)], first, binning


def _first_best(scores: list) -> dict:
    return max(enumerate(scores), key=lambda s: (s[1][1], -s[0]))[1][0]


def best_point(make_estimator, grid: dict, train: DataFrame, label: str = "label", fold_col: str = "fold") -> dict:
    """The grid's best point; of equals the first."""
    return _first_best(grid_scores(make_estimator, grid, train, label, fold_col))


def grid_search(make_estimator, grid: dict, train: DataFrame, label: str = "label", fold_col: str = "fold",
                parallelism: int = 4):
    """K-fold grid search on a fold column (H2), accuracy, refit on all
    training rows. ``make_estimator(n, **point)`` builds the estimator for a fit
    on n rows, so that a penalty stated per row follows each fold's size. Boosted
    points that differ in rounds alone are read off one fit of the most rounds, and
    all folds and points advance as one set; the refit has their bins where its own are the same.
    Returns (best fit, table ``(params, mean_accuracy)``)."""
    scores, first, binning = _scored_grid(make_estimator, grid, train, label, fold_col, parallelism)
    best = make_estimator(train.count(), **_first_best(scores))
    same = isinstance(best, Booster) and (best.maxBins, best.featuresCol) == (first.maxBins, first.featuresCol)
    best = best.fit(train, binning=binning) if same else best.fit(train)
    rows = [(", ".join(f"{k}={v}" for k, v in sorted(p.items())), float(a)) for p, a in scores]
    return best, train.sparkSession.createDataFrame(rows, "params string, mean_accuracy double")


def _accuracies(df: DataFrame, label: str, asked: Sequence[tuple]) -> list[list[float]]:
    """For each (model, conditions): its accuracy on the rows of each condition (NaN without
    any), all counted in one pass over ``df``."""
    scored, counts = df, []
    for i, (model, wheres) in enumerate(asked):
        if isinstance(model, LogisticRegressionModel):
            # The class alone, without a vector of scores for each row.
            model = model.copy().setRawPredictionCol("").setProbabilityCol("")
        scored = model.transform(scored).withColumnRenamed("prediction", f"__p{i}").drop("rawPrediction", "probability")
        right = F.col(f"__p{i}") == F.col(label).cast("double")
        counts += [c for where in wheres for c in (F.count_if(where & right), F.count_if(where))]
    found = scored.agg(*[c.alias(f"__n{i}") for i, c in enumerate(counts)]).first()
    shares = iter([right / n if n else math.nan for right, n in zip(found[::2], found[1::2])])
    return [[next(shares) for _ in wheres] for _, wheres in asked]


def _accuracy(model, df: DataFrame, label: str) -> float:
    return _accuracies(df, label, [(model, [F.lit(True)])])[0][0]


# ------------------------------------------------------------------ N5
def depth_elbow(make_estimator, depths: Sequence[int], train: DataFrame, label: str = "label",
                fold_col: str = "fold", parallelism: int = 4) -> DataFrame:
    """Grid over tree depth with train and validation accuracy per fold:
    ``(depth, fold, split, accuracy)`` (CrossValidator keeps no train score)."""
    parts = _fold_parts(train, fold_col)
    made = [make_estimator(d) for d in depths]
    if made and isinstance(made[0], Booster):
        fits = boosting.fit_folds(made, train, list(parts), fold_col)
        rows = [(int(d), int(f), name, scored_at(fits[i, f, None], split)) for i, d in enumerate(depths) for f in parts
                for name, split in (("train", "train"), ("validation", "test"))]
    else:
        def scores(job):
            (depth, estimator), (fold, (_, rows, held)) = job
            fitted = estimator.fit(rows)
            return [(int(depth), int(fold), "train", _accuracy(fitted, rows, label)),
                    (int(depth), int(fold), "validation", _accuracy(fitted, held, label))]
        rows = sum(parallel(scores, [(m, p) for m in zip(depths, made) for p in parts.items()], parallelism), [])
    return train.sparkSession.createDataFrame(rows, "depth int, fold int, split string, accuracy double")


# ------------------------------------------------------------------ N12
def curve_sizes(train: DataFrame, key_cols: Sequence[str], sizes: Sequence[float], fold_col: str = "fold",
                seed: int = 42) -> DataFrame:
    """``(frac, fold, n_train)`` of every point of the learning curve, one job."""
    u = uniform(f"{seed}|curve", *key_cols)
    counted = train.groupBy(F.col(fold_col).alias("fold")).agg(
        *[F.count_if(u <= frac).alias(f"__n{i}") for i, frac in enumerate(sizes)])
    long = counted.select("fold", F.explode(F.array(*[
        F.struct(F.lit(float(frac)).alias("frac"), F.col(f"__n{i}").alias("n")) for i, frac in enumerate(sizes)])).alias("s"))
    everything = Window.partitionBy("frac")
    return long.select("s.frac", "fold", "s.n").select(
        "frac", F.col("fold").cast("int").alias("fold"), (F.sum("n").over(everything) - F.col("n")).cast("long").alias("n_train"))


def by_curve_draw(train: DataFrame, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """``train`` with the curve's draw ``__u``, stored in its order: a prefix
    ``__u <= frac`` is a scan that skips by the files' minima and maxima."""
    t = train.withColumn("__u", uniform(f"{seed}|curve", *key_cols))
    path = os.path.join(ensure_checkpoint_dir(train.sparkSession), f"curve-{uuid.uuid4().hex}")
    t.repartitionByRange("__u").sortWithinPartitions("__u").write.parquet(path)
    return train.sparkSession.read.parquet(path)


def learning_curve(make_estimator, train: DataFrame, key_cols: Sequence[str], sizes: Sequence[float],
                   label: str = "label", fold_col: str = "fold", seed: int = 42, parallelism: int = 4) -> DataFrame:
    """For each size fraction and fold, fit on the nested hash prefix
    ``u <= frac`` of the training folds; score on it and on the held-out
    fold. ``make_estimator(n)`` builds the estimator for n rows; boosted fits
    of all points advance as one set. Returns
    ``(frac, n_train, fold, split, accuracy)``; a point without rows has NULL
    accuracies."""
    points = curve_sizes(train, key_cols, sizes, fold_col, seed).orderBy("frac", "fold").collect()
    schema = "frac double, n_train bigint, fold int, split string, accuracy double"
    made = {i: make_estimator(r["n_train"]) for i, r in enumerate(points) if r["n_train"]}
    first = next(iter(made.values()), None)
    if isinstance(first, Booster):
        folds = sorted({r["fold"] for r in points})
        fits = boosting.fit_folds([first], train, folds, fold_col, [float(s) for s in sizes], uniform(f"{seed}|curve", *key_cols))
        rows = [(float(r["frac"]), int(r["n_train"]), int(r["fold"]), name,
                 scored_at(fits[0, r["fold"], float(r["frac"])], split) if r["n_train"] else None)
                for r in points for name, split in (("train", "train"), ("validation", "test"))]
        return train.sparkSession.createDataFrame(rows, schema)
    t = by_curve_draw(train, key_cols, seed)

    def learned(r):
        return (F.col(fold_col) != r["fold"]) & (F.col("__u") <= r["frac"])
    fitted = dict(zip(made, parallel(lambda i: made[i].fit(t.where(learned(points[i]))), list(made), parallelism)))

    def scores(frac):
        # The fits of a size are scored in one pass over the table.
        at = [i for i in fitted if points[i]["frac"] == frac]
        return dict(zip(at, _accuracies(t, label, [(fitted[i], [learned(points[i]), F.col(fold_col) == points[i]["fold"]]) for i in at])))
    found: dict = {}
    for some in parallel(scores, sorted({points[i]["frac"] for i in fitted}), parallelism):
        found |= some
    rows = [(float(r["frac"]), int(r["n_train"]), int(r["fold"]), name, found[i][j] if i in found else None)
            for i, r in enumerate(points) for j, name in enumerate(("train", "validation"))]
    return train.sparkSession.createDataFrame(rows, schema)


def curve_summary(curve: DataFrame) -> DataFrame:
    """Mean accuracy per (frac, split) - the plotted curve."""
    return curve.groupBy("frac", "split").agg(F.avg("accuracy").alias("mean_accuracy"),
                                              F.avg("n_train").alias("mean_n_train"))


# ------------------------------------------------------------------ F5
@dataclass
class RFECVResult:
    scores: DataFrame     # (n_features, fold, accuracy)
    ranking: DataFrame    # (feature, rank, support)
    selected: list
    #: Features, first eliminated to last, on all rows; mean accuracy by size.
    order: list
    means: dict

    def at_floor(self, min_features: int) -> list:
        """Features kept if no fewer than ``min_features`` may remain: the elimination
        is the same, only fewer sizes compete."""
        sizes = [n for n in self.means if n >= min(min_features, max(self.means))]
        n = max(sorted(sizes), key=lambda n: (self.means[n], -n))
        return self.order[::-1][:n]


def _importances(model, n: int) -> list[float]:
    if hasattr(model, "coefficients"):
        return [abs(float(c)) for c in model.coefficients.toArray()]
    return [float(v) for v in model.featureImportances.toArray()][:n]


def _subset_fits(made: dict, data: DataFrame, parts: dict, subsets: dict, binning, label: str, fold_col: str, parallelism: int) -> dict:
    """{fold: (held-out accuracy or None, importance by place)} of one level: each
    fold (None: all rows) fitted on its own subset of the assembled vector."""
    if binning is not None:
        fits = boosting.fit_folds([made[None]], data, list(subsets), fold_col, subsets=subsets, binning=binning)
        return {f: (scored_at(m, "test") if f is not None else None, dict(enumerate(m.featureImportances))) for (_, f, _), m in fits.items()}

    def one(fold):
        _, rows, held = parts[fold]
        slicer = VectorSlicer(inputCol="__all", outputCol="features", indices=list(subsets[fold]))
        m = made[fold].fit(slicer.transform(rows))
        score = None if held is None else _accuracy(m, slicer.transform(held), label)
        return score, dict(zip(subsets[fold], _importances(m, len(subsets[fold]))))
    return dict(zip(subsets, parallel(one, list(subsets), parallelism)))


def rfecv(make_estimator, train: DataFrame, features: Sequence[str], label: str = "label",
          fold_col: str = "fold", min_features: int = 10, step: int = 1, parallelism: int = 4) -> RFECVResult:
    """recursive feature elimination with cross-validation.

    On each fold's training part, features are eliminated ``step`` at a time
    by lowest importance; every subset is scored on the held-out fold. The
    size with the best mean accuracy is chosen (ties: fewer features), then
    elimination on all training rows fixes which features remain.
    ``make_estimator(n)`` builds the estimator for a fit on n rows; importances
    are |coefficients| or the trees' gains.

    The features are assembled once; subsets are slices of that vector. All folds and
    the elimination on all rows take a level together, each (fold, subset) is
    fitted once, and boosted levels are one set of fits.
    """
    feats = list(features)
    min_features = min(min_features, len(feats))
    parts = _fold_parts(train, fold_col)
    made = {f: make_estimator(n) for f, (n, _, _) in parts.items()} | {None: make_estimator(train.count())}
    booster = isinstance(made[None], Booster)
    data = assemble(train.drop("features"), feats, "features" if booster else "__all")
    binning = made[None].binning(data) if booster else None
    folds = list(parts)
    parts = {f: (n, data.where(F.col(fold_col) != f), data.where(F.col(fold_col) == f)) for f, (n, _, _) in parts.items()}
    parts[None] = (None, data, None)
    current = {f: tuple(range(len(feats))) for f in parts}
    order: dict = {f: [] for f in parts}
    rows = []
    while True:
        level = _subset_fits(made, data, parts, current, binning, label, fold_col, parallelism)
        rows += [(len(current[f]), int(f), level[f][0]) for f in folds]
        size = len(current[None])
        k = min(step, size - min_features)
        if not k:
            break
        for f, (_, importance) in level.items():
            drop = sorted(current[f], key=lambda i: (importance[i], -i))[:k]
            order[f] += drop
            current[f] = tuple(i for i in current[f] if i not in drop)
    spark = train.sparkSession
    scores = spark.createDataFrame(rows, "n_features int, fold int, accuracy double")
    found: dict[int, list] = {}
    for n, _, a in rows:
        found.setdefault(n, []).append(a)
    means = {n: sum(a) / len(a) for n, a in found.items()}
    names = [feats[i] for i in [*order[None], *current[None][::-1]]]     # elimination order on all rows
    best_n = max(sorted(means), key=lambda n: (means[n], -n))
    kept = names[::-1][:best_n]
    rank = {ftr: 1 if ftr in kept else i - best_n + 2 for i, ftr in enumerate(names[::-1])}
    ranking = spark.createDataFrame([(ftr, int(rank[ftr]), ftr in kept) for ftr in feats],
                                    "feature string, rank int, support boolean")
    return RFECVResult(scores, ranking, [c for c in feats if c in kept], names, means)


# ------------------------------------------------------------------ N10
#: Rounds whose scores a task hands on together.
AUC_ROUNDS = 20


def eval_history(model, parts: dict[str, DataFrame], label: str = "label", eps: float = 1e-15,
                 metrics: Sequence[str] = ("logloss", "auc", "error"),
                 rounds: Sequence[int] | None = None) -> DataFrame:
    """``(split, round, metric, value)``: log loss, error and AUC of the
    staged booster (first r trees) per split.

    A small table is broadcast as bin codes and the rounds are dealt to tasks, which
    sort a round's scores themselves. On a larger one rows are scored once: a task carries each row's running margin from tree to tree.
    The staged scores are sorted by (split, round, score) in one shuffle of composite
    ranges for all AUCs together; each task sums its stretch, and the AUC joins the
    stretches by the negatives before them. Log loss and error come from the same
    sums; without the AUC nothing but these is shuffled."""
    names = list(parts)
    wanted = sorted(set(rounds)) if rounds is not None else list(range(1, model.rounds + 1))
    tables = [parts[n] for n in names]
    if boosting.history_by_rounds(sum(t.count() for t in tables), model.n_features):
        sums = checkpoint(boosting.staged_sums_small(model, tables, label, wanted, eps))
    else:
        staged = boosting.staged_scores(model, tables, label, wanted, AUC_ROUNDS)
        sums = checkpoint(boosting.staged_sums(staged, eps, "auc" in metrics))
    before = Window.partitionBy("split", "round").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = sums.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    n = F.sum("pos") + F.sum("neg")
    out = stretches.groupBy("split", "round").agg(
        (F.sum("ll") / n).alias("logloss"), (F.sum("err") / n).alias("error"),
        F.try_divide(F.sum(F.col("num") + F.col("pos") * F.col("below")),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))
    split = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("split") + 1)
    return out.select(split.alias("split"), "round", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("s")
    ).select("split", "round", "s.metric", "s.value")

"""The reference's three script families as Spark flows.

Each flow returns a dict of result tables (the data behind the reference's
figures, J1-J7); :func:`write_plot_tables` writes them as Parquet (A4).
Prediction tables are scored once and checkpointed, then every report is an
aggregate over them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parityframe.functions import clinical
from parityframe.functions.features import features_of
from parityframe.operators import clean, encode
from parityframe.operators import fairness as fx
from parityframe.operators import metrics as mx
from parityframe.operators import learners as ml
from parityframe.operators import select as sx
from parityframe.operators.rebalance import group_bootstrap, smote
from parityframe.operators.split import fit_minmax, stratified_folds, train_test_split
from parityframe.sources.io import write_artifact
from parityframe.session import checkpoint as _ckpt

AUDIT = ["n", "accuracy", "precision", "recall", "f1", "tpr", "fpr", "fnr"]


@dataclass(frozen=True)
class TableSpec:
    """What the flows need to know of a raw table."""
    id_col: str
    label: str
    sensitive: list
    features: list = field(default_factory=list)      # (name, kind, inputs), see functions.clinical
    second_pass: list = field(default_factory=list)   # measures fenced again
    protected: list = field(default_factory=list)     # never pruned


#: The clinical table of the reference, with the features of its selection scripts.
CLINICAL = TableSpec(clinical.ID_COL, clinical.LABEL_COL, clinical.SENSITIVE_COLS, clinical.SELECTION_FEATURES,
                     clinical.SECOND_PASS_COLS, clinical.BASE_FEATURES)


@dataclass(frozen=True)
class Prepared:
    table: DataFrame
    features: list          # pruned, in column order
    mapping: DataFrame      # (column, value, code)
    fences: list
    dropped: list


def prepare(raw: DataFrame, spec: TableSpec, threshold: float = 0.7) -> Prepared:
    """The scripts' common block: two passes of IQR fences (C2, C3), encoding
    with a kept map (E2), derived features (D12), correlation pruning (F2) that
    leaves ids, label and sensitive columns alone. Each step's table is stored
    before the next one is fitted on it; the raw one too, whose joins (and what they
    send to the driver to be broadcast) every fence's jobs would repeat."""
    raw = raw.transform(_ckpt)
    first = clean.default_iqr_columns(raw, [spec.id_col], spec.label)
    kept, fences = clean.iqr_sequential(raw, first + list(spec.second_pass))
    kept = kept.transform(_ckpt)
    coder = encode.fit_label_encoder(kept, [c for c in encode.string_columns(kept) if c != spec.id_col])
    coded = encode.apply_label_encoder(kept, coder)
    wide = clinical.apply_feature_set(coded, spec.features).transform(_ckpt)
    numbers = features_of(wide, [spec.id_col, spec.label])
    dropped = [r["column"] for r in sx.corr_prune(
        sx.corr_matrix(wide, numbers), threshold, protected=spec.protected, sensitive=spec.sensitive).orderBy("pos").collect()]
    table = wide.drop(*dropped)
    return Prepared(table, features_of(table, [spec.id_col, spec.label]), coder.mapping, fences, dropped)


class Stages:
    """The stored tables and fits of one flow by name. Branches ask for the stages
    that they share; each is made once."""

    def __init__(self):
        self.made: dict = {}

    def get(self, name, build: Callable):
        if name not in self.made:
            out = build()
            self.made[name] = out.transform(_ckpt) if isinstance(out, DataFrame) else out
        return self.made[name]


@dataclass(frozen=True)
class Parts:
    train: DataFrame        # with a fold column
    test: DataFrame
    features: list          # scaled copies
    keys: list              # what identifies a training row


def split_and_scale(p: Prepared, spec: TableSpec, rebalance: str | None = None, test_frac: float = 0.2,
                    folds: int = 5, order: str = "train_only") -> Parts:
    """Exact split (H1), optional rebalancing (I3, I5, or I5 then I3) of the training
    part or, with ``order='before_split'`` as the reference has it, of the whole table,
    scaling fitted on the training part (H3), stratified folds (H2)."""
    if order not in ("train_only", "before_split"):
        raise ValueError("order must be 'train_only' or 'before_split'")
    table, keys = p.table, [spec.id_col]

    def balanced(df):
        out, own = _rebalanced(df, spec.id_col, spec.label, p.features, list(spec.sensitive), rebalance, with_keys=True)
        return out.transform(_ckpt), own
    if rebalance and order == "before_split":
        table, keys = balanced(table)
    s = train_test_split(table, keys, test_frac).transform(_ckpt)
    train, test = (s.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    if rebalance and order == "train_only":
        train, keys = balanced(train)
    scale = fit_minmax(train, p.features)
    train = stratified_folds(scale.apply(train, "_s"), spec.label, keys, folds).transform(_ckpt)
    return Parts(train, scale.apply(test, "_s").transform(_ckpt), [f + "_s" for f in p.features], keys)


def selected_features(parts: Parts, spec: TableSpec, how: str, k: int | None = None, selector: Callable | None = None,
                      min_features: int = 10) -> list:
    """``k_best``: the k best by chi2 (F3, F4; all if None); ``rfecv``: what recursive
    elimination by ``selector(n)`` keeps (F5)."""
    features = parts.features
    if how == "k_best":
        if not k or k >= len(features):
            return features
        best = sx.select_k_best(sx.chi2_scores(parts.train, features, spec.label), k).orderBy("pos").collect()
        return [r["feature"] for r in best]
    if how != "rfecv":
        raise ValueError("how must be 'k_best' or 'rfecv'")
    return ml.rfecv(selector, parts.train, features, spec.label, min_features=min_features).selected


def full_leaderboard(raw: DataFrame, spec: TableSpec, learners: dict[str, Callable], k: int | None = None,
                     selectors: Sequence[str] = ("k_best",), selector: Callable | None = None, min_features: int = 10,
                     rebalance: str | None = None, order: str = "before_split", stages: Stages | None = None) -> dict[str, DataFrame]:
    """Flow 3.1 from the raw table: prepare, rebalance (``rebalance='smote'`` before the
    split as the reference does, or only the training part), split, scale, then
    for every selector x learner a fit, its test scores and importances: the
    leaderboard. Branches share their stages. ``learners``: name -> make_estimator(n);
    with several selectors the models are called learner+selector."""
    st = stages or Stages()
    p = st.get("prepared", lambda: prepare(raw, spec))
    parts = st.get("parts", lambda: split_and_scale(p, spec, rebalance, order=order))
    n = st.get("rows", parts.train.count)
    chosen = {how: st.get(how, lambda: selected_features(parts, spec, how, k, selector, min_features)) for how in selectors}
    jobs = [(how, name) for how in selectors for name in learners]

    def fitted(job):
        how, name = job
        return st.get(f"{name}+{how}", lambda: learners[name](n).fit(ml.assemble(parts.train, chosen[how])))
    models = {f"{name}+{how}" if len(selectors) > 1 else name: (m, chosen[how])
              for (how, name), m in zip(jobs, ml.parallel(fitted, jobs, 4))}
    return st.get("reports", lambda: _reports(models, parts.test, spec.id_col, spec.label, spec.sensitive))


def _reports(models: dict, test: DataFrame, id_col: str, label: str, keep: Sequence[str]) -> dict[str, DataFrame]:
    """Predictions, leaderboard (N13) and importances (J1) of {name: (model, features)}."""
    preds, imps = None, None
    for name, (m, feats) in models.items():
        p = ml.predictions(m, ml.assemble(test, feats), id_col, label, keep).withColumn("model", F.lit(name))
        preds = p if preds is None else preds.unionByName(p)
        imp = (ml.coef_importance(m, feats) if hasattr(m, "coefficients") else ml.gain_importance(m, feats))
        imp = imp.withColumn("model", F.lit(name))
        imps = imp if imps is None else imps.unionByName(imp)
    preds = preds.transform(_ckpt)
    return {"predictions": preds, "leaderboard": mx.leaderboard(preds), "importance": imps}


def _tuned(parts: Parts, features: list, spec: TableSpec, make_estimator: Callable, grid: dict | None):
    """The fit on all training rows, of the grid's best point if there is one."""
    tr = ml.assemble(parts.train, features)
    if grid:
        return ml.grid_search(make_estimator, grid, tr, spec.label)[0]
    return make_estimator(tr.count()).fit(tr)


def full_audit(raw: DataFrame, spec: TableSpec, make_estimator: Callable, grid: dict | None = None,
               selector: Callable | None = None, min_features: int = 10) -> dict[str, DataFrame]:
    """Flow 3.2 from the raw table: recursive elimination by ``selector(n)`` if given, one
    classifier (the best of ``grid`` if given), audited by the sensitive
    attributes; codes are replaced by their values before the audit."""
    p = prepare(raw, spec)
    parts = split_and_scale(p, spec)
    features = selected_features(parts, spec, "rfecv", None, selector, min_features) if selector else parts.features
    model = _tuned(parts, features, spec, make_estimator, grid)
    pred = ml.predictions(model, ml.assemble(parts.test, features), spec.id_col, spec.label, spec.sensitive)
    return fairness_audit(encode.decode_columns(pred, p.mapping, spec.sensitive).transform(_ckpt), spec.sensitive)


def full_mitigation(raw: DataFrame, spec: TableSpec, make_estimator: Callable, make_booster: Callable,
                    method: str = "bootstrap+smote", patience: int = 25, sizes: Sequence[float] = tuple(ml.CURVE_SIZES),
                    depths: Sequence[int] = tuple(ml.ELBOW_DEPTHS), grid: dict | None = None,
                    selector: Callable | None = None, min_features: int = 20, stages: Stages | None = None) -> dict[str, DataFrame]:
    """Flow 3.3 from the raw table: audit before and after rebalancing the
    training part (I5, then I3), each on the features that ``selector(n)`` keeps. On the
    rebalanced part the booster (the best of ``grid``) is fitted until its test
    ``error`` has not improved for ``patience`` rounds: history, early stop, overfit check;
    learning curves of both learners. The depth elbow is drawn on the training part
    before rebalancing, as the reference has it. ``make_booster(n, **params)``."""
    st = stages or Stages()
    p = st.get("prepared", lambda: prepare(raw, spec))
    out, preds, parts, features = {}, {}, {}, {}
    for name, how in (("before", None), ("after", method)):
        parts[name] = st.get(f"parts {name}", lambda: split_and_scale(p, spec, how))
        features[name] = st.get(f"features {name}", lambda: selected_features(
            parts[name], spec, "rfecv", None, selector, min_features) if selector else parts[name].features)
        tr, te = (ml.assemble(d, features[name]) for d in (parts[name].train, parts[name].test))
        model = st.get(f"model {name}", lambda: make_estimator(tr.count()).fit(tr))
        preds[name] = st.get(f"predictions {name}", lambda: ml.predictions(model, te, spec.id_col, spec.label, spec.sensitive))
    for metric in ("accuracy", "recall", "f1"):
        frames = [mx.metric_frame(preds[n], spec.sensitive, [metric]) for n in ("before", "after")]
        out[f"before_after_{metric}"] = fx.before_after(*frames, spec.sensitive, metric)
    out["bundle"] = fx.fairness_bundle(preds["before"], spec.sensitive, "before").unionByName(
        fx.fairness_bundle(preds["after"], spec.sensitive, "after"))
    out["bundle_groups"] = fx.scenario_groups(preds["before"], spec.sensitive, "before").unionByName(
        fx.scenario_groups(preds["after"], spec.sensitive, "after"))
    tr = st.get("rows after", lambda: ml.assemble(parts["after"].train, features["after"]))
    te = ml.assemble(parts["after"].test, features["after"])
    tuned = st.get("grid", lambda: ml.best_point(make_booster, grid, tr, spec.label)) if grid else {}
    booster = st.get("booster", lambda: make_booster(tr.count(), **tuned).fit(tr, te, patience, "error"))
    out["history"] = st.get("history", lambda: ml.eval_history(booster, {"train": tr, "test": te}, spec.label))
    out["early_stop"] = mx.early_stop(out["history"], patience, metric="error", split="test")
    scores = [ml.predictions(booster, d, spec.id_col, spec.label).withColumn("split", F.lit(s))
              for s, d in (("train", tr), ("test", te))]
    out["overfit"] = mx.overfit_check(scores[0].unionByName(scores[1]))
    curves = [ml.curve_summary(ml.learning_curve(make, tr, parts["after"].keys, sizes, spec.label)).withColumn("model", F.lit(name))
              for name, make in (("logistic", make_estimator), ("boosted", lambda n: make_booster(n, **tuned)))]
    out["curve"] = curves[0].unionByName(curves[1])
    plain = ml.assemble(parts["before"].train, features["before"])
    out["elbow"] = ml.depth_elbow(lambda d: make_booster(0, maxDepth=d), depths, plain, spec.label)
    return out


def flagged_frame(frame: DataFrame, metric: str) -> DataFrame:
    """The metric frame with the unweighted mean over groups and a
    ``below_mean`` flag. The small group table is materialized first so the
    mean (a scalar subquery) does not re-read the prediction rows."""
    frame = frame.transform(_ckpt)
    mean = frame.select(F.avg(metric)).scalar()
    return frame.select("*", mean.alias(f"mean_{metric}"), (F.col(metric) < mean).alias("below_mean"))


def fairness_audit(pred: DataFrame, attributes: Sequence[str]) -> dict[str, DataFrame]:
    """Flow 3.2 on a prediction table: per-attribute report and rates (J2),
    intersectional frame (J3), below-mean groups (J4), group shares."""
    attrs = list(attributes)
    # Two passes over the predictions; everything else comes from these tables.
    frame = mx.metric_frame(pred, attrs, ["n", "accuracy", "f1"]).transform(_ckpt)
    report = mx.group_report(pred, attrs, metrics=AUDIT).transform(_ckpt)
    out = {
        "group_report": report,
        "metric_frame": frame,
        "flagged_f1": flagged_frame(frame, "f1"),
        "flagged_accuracy": flagged_frame(frame, "accuracy"),
        "bundle": fx.fairness_bundle(pred, attrs, "audit"),
    }
    whole = Window.partitionBy("attribute")
    shares = report.select("attribute", F.col("group_value").alias("value"), "n",
                           (F.col("n") * 100.0 / F.sum("n").over(whole)).alias("pct"))
    for a in attrs:
        out[f"share_{a}"] = shares.filter(F.col("attribute") == a).drop("attribute").orderBy(F.desc("pct"), "value")
    return out


def leaderboard(train: DataFrame, test: DataFrame, id_col: str, label: str, features: Sequence[str],
                learners: dict, keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Flow 3.1: fit each named estimator on the assembled training part,
    score the test part once, and report the leaderboard (N13) and
    importances (J1)."""
    feats = list(features)
    tr = ml.assemble(train, feats)
    return _reports({name: (est.fit(tr), feats) for name, est in learners.items()}, test, id_col, label, keep)


def _rebalanced(df: DataFrame, id_col: str, label: str, features: list, groups: list, method: str,
                with_keys: bool = False):
    """Rebalanced rows; with ``with_keys`` also the columns that identify
    every output row (drawn copies and synthetic rows included)."""
    if method == "bootstrap":
        out = group_bootstrap(df, groups, label, [id_col], draw_key="__draw" if with_keys else None)
        return (out, [id_col, "__draw"]) if with_keys else out
    if method == "smote":
        out = smote(df, id_col, label, features)
        if with_keys:
            return out.drop("synthetic", "base_key", "nb_key"), [id_col, label, "slot"]
        return out.drop("synthetic", "slot", "base_key", "nb_key")
    if method == "bootstrap+smote":
        drawn = group_bootstrap(df, groups, label, [id_col], draw_key="__draw")
        # A drawn copy is a point of its own, named after its id and its draw.
        one = drawn.withColumn("__row", F.concat_ws("#", F.col(id_col).cast("string"), F.coalesce("__draw", F.lit("")))).drop("__draw")
        out = smote(one.transform(_ckpt), "__row", label, features).drop("synthetic", "base_key", "nb_key")
        return (out, ["__row", label, "slot"]) if with_keys else out.drop("__row", "slot")
    raise ValueError("method must be 'bootstrap', 'smote' or 'bootstrap+smote'")


def split_and_rebalance(df: DataFrame, id_col: str, label: str, features: Sequence[str], groups: Sequence[str],
                        rebalance: str = "train_only", method: str = "bootstrap",
                        test_frac: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Exact split (H1) and rebalancing (I5 or I3) in either order:
    ``train_only`` (default) rebalances the training part only;
    ``before_split`` rebalances the whole table first, as the reference's
    scripts do, so copies of test rows can reach training. Drawn and
    synthetic rows are split by their own identifying columns."""
    from parityframe.operators.split import train_test_split
    feats, groups = list(features), list(groups)
    if rebalance == "train_only":
        s = train_test_split(df, [id_col], test_frac).transform(_ckpt)
        train = s.where(F.col("split") == "train").drop("split")
        test = s.where(F.col("split") == "test").drop("split")
        return _rebalanced(train, id_col, label, feats, groups, method).transform(_ckpt), test
    if rebalance == "before_split":
        b, keys = _rebalanced(df, id_col, label, feats, groups, method, with_keys=True)
        s = train_test_split(b, keys, test_frac).transform(_ckpt)
        extra = [k for k in keys if k not in df.columns] + ["split"]
        return s.where(F.col("split") == "train").drop(*extra), s.where(F.col("split") == "test").drop(*extra)
    raise ValueError("rebalance must be 'train_only' or 'before_split'")


def mitigation(train: DataFrame, test: DataFrame, id_col: str, label: str, features: Sequence[str],
               groups: Sequence[str], make_estimator, method: str = "bootstrap") -> dict[str, DataFrame]:
    """Flow 3.3: audit a model before and after rebalancing the training
    part (group bootstrap or SMOTE), on the same test part; pairs groups by
    key (J5). Use :func:`split_and_rebalance` to reproduce the reference's
    rebalance-before-split order."""
    feats, groups = list(features), list(groups)
    balanced = _rebalanced(train, id_col, label, feats, groups, method).transform(_ckpt)
    te = ml.assemble(test, feats)
    pre = ml.predictions(make_estimator().fit(ml.assemble(train, feats)), te, id_col, label, groups).transform(_ckpt)
    post = ml.predictions(make_estimator().fit(ml.assemble(balanced, feats)), te, id_col, label, groups).transform(_ckpt)
    fa = mx.metric_frame(pre, groups, ["accuracy", "f1"])
    fb = mx.metric_frame(post, groups, ["accuracy", "f1"])
    return {
        "before_after_accuracy": fx.before_after(fa, fb, groups, "accuracy"),
        "before_after_f1": fx.before_after(fa, fb, groups, "f1"),
        "bundle": fx.fairness_bundle(pre, groups, "before").unionByName(fx.fairness_bundle(post, groups, "after")),
    }


def write_plot_tables(tables: dict[str, DataFrame], out_dir: str) -> list[str]:
    """A4: write each result table to ``out_dir/<name>`` as Parquet."""
    paths = []
    for name, df in tables.items():
        p = os.path.join(out_dir, name)
        write_artifact(df, p)
        paths.append(p)
    return paths

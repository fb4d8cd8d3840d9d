"""Classification metrics over a prediction table.

Prediction table: ``(id, group cols..., y_true int, y_pred int, score double)``.
Every function is one aggregate (or grouping-sets aggregate) over it, so the
raw rows are read once with map-side partial aggregation; only aggregated,
per-group rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityframe.operators.joins import keyed_join
from parityframe.functions.metric_exprs import (
    PRF_ZERO_DIVISION, RATE_ZERO_DIVISION, confusion_aggs, metric_aggs, metrics_from_counts, ratio,
)

REPORT_METRICS = ["n", "accuracy", "precision", "recall", "f1"]
ODDS_METRICS = ["n", "tpr", "fpr", "fnr"]


# ---------------------------------------------------------------- G1-G3, G6
def confusion(pred: DataFrame, y: str = "y_true", p: str = "y_pred", positive: int = 1) -> DataFrame:
    """G1: one row ``(tn, fp, fn, tp)``."""
    return pred.agg(*[v.alias(k) for k, v in confusion_aggs(y, p, positive).items()])


def summary_metrics(pred: DataFrame, names: Sequence[str] = ("n", "accuracy", "precision", "recall", "f1"),
                    y: str = "y_true", p: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (and any other count metric),
    overall or per ``by`` group."""
    aggs = metric_aggs(list(names), y, p)
    return pred.groupBy(*by).agg(*aggs) if by else pred.agg(*aggs)


def log_loss(pred: DataFrame, y: str = "y_true", score: str = "score", eps: float = 1e-15,
             by: Sequence[str] = ()) -> DataFrame:
    """Mean binary log loss with probabilities clipped to [eps, 1-eps],
    plus the error rate of ``score > 0.5``."""
    pc = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    yv = F.col(y).cast("double")
    ll = -F.avg(yv * F.log(pc) + (F.lit(1.0) - yv) * F.log(F.lit(1.0) - pc))
    err = F.avg(((F.col(score) > 0.5).cast("int") != F.col(y)).cast("double"))
    aggs = [ll.alias("log_loss"), err.alias("error_rate")]
    return pred.groupBy(*by).agg(*aggs) if by else pred.agg(*aggs)


# ---------------------------------------------------------------------- G4
def classification_report(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and
    weighted averages, as rows ``(label, precision, recall, f1, support)``.

    Only the (y, p) count table (at most classes^2 rows) leaves the scan.
    The accuracy row carries accuracy in ``f1`` and the total in ``support``.
    """
    cm = pred.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    parts = cm.select(F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("c").alias("true_n"), F.lit(0).cast("long").alias("pred_n"),
                 F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("true_n"), F.col("c").alias("pred_n"),
                 F.lit(0).cast("long").alias("tp")),
    )).alias("s")).select("s.*")
    per = parts.groupBy("cls").agg(F.sum("true_n").alias("support"), F.sum("pred_n").alias("pred_n"),
                                   F.sum("tp").alias("tp"))
    per = per.select(
        F.col("cls").cast("string").alias("label"),
        ratio(F.col("tp"), F.col("pred_n"), 0.0).alias("precision"),
        ratio(F.col("tp"), F.col("support"), 0.0).alias("recall"),
        ratio(F.lit(2) * F.col("tp"), F.col("pred_n") + F.col("support"), 0.0).alias("f1"),
        F.col("support").cast("long").alias("support"),
        F.col("tp"))
    acc = per.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                  F.lit(None).cast("double").alias("recall"),
                  ratio(F.sum("tp"), F.sum("support"), None).alias("f1"),
                  F.sum("support").cast("long").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    F.sum("support").cast("long").alias("support"))
    tot = F.sum("support")
    weighted = per.agg(F.lit("weighted avg").alias("label"),
                       ratio(F.sum(F.col("precision") * F.col("support")), tot, None).alias("precision"),
                       ratio(F.sum(F.col("recall") * F.col("support")), tot, None).alias("recall"),
                       ratio(F.sum(F.col("f1") * F.col("support")), tot, None).alias("f1"),
                       tot.cast("long").alias("support"))
    return per.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)


# ---------------------------------------------------------------------- G5
def roc_auc(pred: DataFrame, y: str = "y_true", score: str = "score", by: Sequence[str] = (),
            n_buckets: int | None = None, weight: str | None = None, missing: bool = False) -> DataFrame:
    """Exact ROC AUC with ties counted half (Mann-Whitney), per ``by``.

    Scores are first reduced to distinct (by, score) rows with positive and
    negative counts. The running count of negatives below each score is
    needed; a single ordered window over millions of distinct scores would
    run in one task, so scores are cut into ranges by approximate quantiles
    (about a million rows per range, 256 to 65,536 ranges), counted per
    range, and the window runs inside each (by, range) only. Exact.

    Rows without a label or with a NULL or NaN score have no place in the
    order and are left out; ``missing`` adds their number as ``n_missing``.
    """
    by = list(by)
    yv = F.col(y)
    if weight is None:
        pos_agg, neg_agg = F.count_if(yv == 1), F.count_if(yv != 1)
    else:   # rows that already carry counts
        pos_agg = F.sum(F.when(yv == 1, F.col(weight)).otherwise(F.lit(0)))
        neg_agg = F.sum(F.when(yv != 1, F.col(weight)).otherwise(F.lit(0)))
    from parityframe.operators.ranking import add_bucket, count_and_splits, quantile_splits
    from parityframe.session import checkpoint
    known = yv.isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    # Stored: the ranges and the counts below come from it, the input is run once.
    dist = checkpoint(pred.filter(known).groupBy(*by, F.col(score).cast("double").alias("s"))
                      .agg(pos_agg.cast("long").alias("pos"), neg_agg.cast("long").alias("neg")))
    splits = quantile_splits(dist, "s", n_buckets) if n_buckets else count_and_splits(dist, "s")[1]
    dist = add_bucket(dist, "s", splits, "bk")
    bucket_tot = dist.groupBy(*by, "bk").agg(F.sum("neg").alias("bneg"))
    w_b = (Window.partitionBy(*by).orderBy("bk") if by else Window.orderBy("bk"))
    offs = bucket_tot.select(*by, "bk", F.coalesce(
        F.sum("bneg").over(w_b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    w_in = Window.partitionBy(*by, "bk").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    dist = dist.withColumn("below_in", F.coalesce(F.sum("neg").over(w_in), F.lit(0)))
    j = keyed_join(dist, offs, by + ["bk"]).select(
        *by, "pos", "neg", (F.col("off") + F.col("below_in")).alias("below"))
    num = F.sum(F.col("pos") * (F.col("below") + F.col("neg") * F.lit(0.5)))
    den = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    aggs = [F.try_divide(num, den).alias("auc"),
            F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg")]
    out = j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)
    if not missing:
        return out
    lost = F.count_if(~known).cast("long").alias("n_missing")
    if by:
        return keyed_join(pred.groupBy(*by).agg(lost), out, by, "left")
    one = F.lit(1).alias("__one")
    return pred.agg(lost).select("*", one).join(out.select("*", one), "__one").drop("__one")


# ------------------------------------------------------------------ G7, K1
def _attribute_sets(pred: DataFrame, attributes: Sequence[str], aggs: list[Column], dropna: bool = True) -> DataFrame:
    """One Expand + two-phase aggregate for all attributes at once. With
    ``dropna`` rows without a value of an attribute are no group of it."""
    attrs = list(attributes)
    g = pred.groupingSets([[a] for a in attrs], *attrs).agg(
        *[F.grouping(a).alias(f"__g_{i}") for i, a in enumerate(attrs)], *aggs)
    attr_name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, a in reversed(list(enumerate(attrs))):
        active = F.col(f"__g_{i}") == 0
        attr_name = F.when(active, F.lit(a)).otherwise(attr_name)
        value = F.when(active, F.col(a).cast("string")).otherwise(value)
    agg_names = [c for c in g.columns if c not in attrs and not c.startswith("__g_")]
    out = g.select(attr_name.alias("attribute"), value.alias("group_value"), *agg_names)
    return out.filter(F.col("group_value").isNotNull()) if dropna else out


def group_report(pred: DataFrame, attributes: Sequence[str], y: str = "y_true", p: str = "y_pred",
                 metrics: Sequence[str] = REPORT_METRICS, dropna: bool = True) -> DataFrame:
    """Per attribute and group value: n, accuracy, precision, recall, F1
    of the positive class. All attributes in one grouping-sets job."""
    return _attribute_sets(pred, attributes, metric_aggs(list(metrics), y, p), dropna)


# ---------------------------------------------------------------- G8, G16
def _python_metric_frame(pred: DataFrame, groups: list[str], name: str, fn: Callable,
                         y: str, p: str) -> DataFrame:
    """G16 fallback for a Python metric ``fn(y_true, y_pred, sample_weight)``.

    Binary-classification metrics depend only on the (y, p) counts, so the
    raw rows are first reduced to weighted counts per group (at most four
    rows per group); pandas then sees only those small tables, never a
    group's raw rows.
    """
    counts = pred.groupBy(*groups, F.col(y).alias("__y"), F.col(p).alias("__p")).agg(
        F.count(F.lit(1)).cast("double").alias("__w"))
    schema_fields = [f for f in counts.schema.fields if f.name in groups]
    out_schema = T.StructType(schema_fields + [T.StructField(name, T.DoubleType())])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        val = float(fn(pdf["__y"].to_numpy(), pdf["__p"].to_numpy(), sample_weight=pdf["__w"].to_numpy()))
        row = {g: [pdf[g].iloc[0]] for g in groups}
        row[name] = [val]
        return pd.DataFrame(row)

    if groups:
        return counts.groupBy(*groups).applyInPandas(apply, out_schema)
    # Global: one group of at most four rows.
    return counts.groupBy(F.lit(0).alias("__all")).applyInPandas(
        lambda pdf: apply(pdf), T.StructType([T.StructField(name, T.DoubleType())]))


def metric_frame(pred: DataFrame, groups: Sequence[str],
                 metrics: Sequence[str] | dict = ("n", "accuracy", "precision", "recall", "f1"),
                 y: str = "y_true", p: str = "y_pred", complete: bool = False,
                 levels: str = "groups",
                 prf_zero_division: float | None = PRF_ZERO_DIVISION,
                 rate_zero_division: float | None = RATE_ZERO_DIVISION) -> DataFrame:
    """Intersectional metric frame ``(groups..., metrics...)``.

    ``metrics``: names of count metrics, or a dict name -> callable. A
    callable taking two Columns returns an aggregate Column (stays in
    Catalyst); a callable marked ``python=True`` (attribute) is run as
    ``fn(y, p, sample_weight)`` on per-group weighted counts (G16).
    ``levels``: 'groups' (plain groupBy), 'rollup' or 'cube' (partial levels,
    totals have NULL keys). ``complete``: include empty combinations of the
    observed values with NULL metrics.
    """
    groups = list(groups)
    named: list[str] = []
    col_metrics: dict[str, Column] = {}
    py_metrics: dict[str, Callable] = {}
    items = metrics.items() if isinstance(metrics, dict) else [(m, None) for m in metrics]
    for name, fn in items:
        if fn is None:
            named.append(name)
        elif getattr(fn, "python", False):
            py_metrics[name] = fn
        else:
            col_metrics[name] = fn(F.col(y), F.col(p)).alias(name)
    c = confusion_aggs(y, p)
    aggs = [v.alias(k) for k, v in metrics_from_counts(
        c["tn"], c["fp"], c["fn"], c["tp"], named, prf_zero_division, rate_zero_division).items()]
    aggs += list(col_metrics.values())
    if levels == "groups":
        gd = pred.groupBy(*groups)
    elif levels == "rollup":
        gd = pred.rollup(*groups)
    elif levels == "cube":
        gd = pred.cube(*groups)
    else:
        raise ValueError("levels must be 'groups', 'rollup' or 'cube'")
    out = gd.agg(*aggs) if aggs else pred.select(*groups).distinct()
    for name, fn in py_metrics.items():
        extra = _python_metric_frame(pred, groups, name, fn, y, p)
        if groups:
            out = keyed_join(out, extra, groups, "left")
        else:   # one row each: attach on a constant key, not a keyless join
            out = keyed_join(out.withColumn("__all", F.lit(0)), extra.withColumn("__all", F.lit(0)),
                             ["__all"], "left").drop("__all")
    if complete and groups:
        out = _complete_cells(pred, out, groups)
    return out


def _complete_cells(pred: DataFrame, frame: DataFrame, groups: list[str]) -> DataFrame:
    """All combinations of the observed non-NULL values of each group column,
    plus every observed cell. The values of each column are numbered; cell
    number i of a distributed range then names one value of each column by
    its digits, which are looked up by equi-joins. Any number of cells works,
    no value list is gathered and no Cartesian product is planned."""
    from parityframe.operators.encode import encoder_map
    from parityframe.session import checkpoint
    spark = pred.sparkSession
    codes = checkpoint(encoder_map(pred, groups))
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
    cells = 1
    for g in groups:
        cells *= sizes.get(g, 0)
    grid = spark.range(cells)
    step = 1
    for g in groups:
        digit = F.pmod(F.floor(F.col("id") / F.lit(step)).cast("long") if step > 1 else F.col("id"), F.lit(max(1, sizes.get(g, 0))))
        values = codes.filter(F.col("column") == g).select(
            F.col("code").cast("long").alias("__digit"), F.col("value").cast(pred.schema[g].dataType).alias(g))
        grid = grid.withColumn("__digit", digit).join(values, "__digit").drop("__digit")
        step *= max(1, sizes.get(g, 0))
    grid = grid.drop("id")
    rest = [c for c in frame.columns if c not in groups]
    joined = keyed_join(frame, grid, groups, "full")
    if "n" in rest:
        joined = joined.withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("long")))
    return joined


# ---------------------------------------------------------- G10-G12, G14, G15
def group_share(df: DataFrame, col: str, dropna: bool = True, ordered: bool = False) -> DataFrame:
    """Share of each value in percent, ``(value, n, pct)``. With
    ``dropna`` rows without a value don't count; ``ordered`` sorts by ``pct``
    descending, then by value."""
    from parityframe.session import checkpoint
    # One scan: the small counts table is materialized and gives the total too.
    rows = df.filter(F.col(col).isNotNull()) if dropna else df
    counts = checkpoint(rows.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.select(F.sum("n"))
    out = counts.select("value", "n", (F.col("n") * 100.0 / total.scalar()).alias("pct"))
    return out.orderBy(F.desc("pct"), "value") if ordered else out


def group_combinations(df: DataFrame, cols: Sequence[str], dropna: bool = True) -> DataFrame:
    """Distinct group combinations with their size."""
    base = df.dropna(subset=list(cols)) if dropna else df
    return base.groupBy(*cols).agg(F.count(F.lit(1)).alias("size"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct values, ascending."""
    return df.select(col).distinct().orderBy(col)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
              approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Quantiles per column, long form ``(column, q, value)``.
    Exact by default (linear interpolation, NaN treated as NULL): all columns
    together in a fixed number of counting jobs, at any number of distinct values."""
    if not approx:
        from parityframe.operators.quantile import all_quantiles
        rows = [(c, float(q), v) for c, line in zip(cols, all_quantiles(df, cols, probs)) for q, v in zip(probs, line)]
        return df.sparkSession.createDataFrame(rows, "column string, q double, value double")
    aggs = []
    for c in cols:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs.append(F.percentile_approx(v, list(probs), accuracy).alias(c))
    wide = df.agg(*aggs)
    stacks = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("vals")) for c in cols]
    long = wide.select(F.explode(F.array(*stacks)).alias("s")).select("s.column", F.posexplode("s.vals"))
    qarr = F.array(*[F.lit(float(q)) for q in probs])
    return long.select("column", F.element_at(qarr, F.col("pos") + 1).alias("q"), F.col("col").alias("value"))


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, min, max)``; NaN is missing."""
    aggs = []
    for c in cols:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
        for c in cols])).alias("s")).select("s.*")


# ------------------------------------------------------------- N11, N13, N14
def leaderboard(pred: DataFrame, model_col: str = "model", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Accuracy (and F1) per model over a union of prediction tables."""
    return pred.groupBy(model_col).agg(*metric_aggs(["n", "accuracy", "f1"], y, p))


def overfit_check(pred: DataFrame, split_col: str = "split", y: str = "y_true", p: str = "y_pred",
                  score: str = "score", gap: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Train minus test of accuracy, precision, recall, F1 and AUC;
    ``overfit`` when the accuracy, F1 or AUC gap exceeds ``gap``.

    Input has a ``split`` column with values 'train' and 'test'. Output: one
    row per ``by`` group with ``<metric>_train``, ``<metric>_test``,
    ``<metric>_gap`` and ``overfit``.
    """
    keys = list(by) + [split_col]
    m = summary_metrics(pred, ["accuracy", "precision", "recall", "f1"], y, p, by=keys)
    a = roc_auc(pred, y, score, by=keys).select(*keys, "auc")
    both = keyed_join(m, a, keys)
    names = ["accuracy", "precision", "recall", "f1", "auc"]
    piv = both.groupBy(*by).agg(*[
        F.max(F.when(F.col(split_col) == s, F.col(n))).alias(f"{n}_{s}") for n in names for s in ("train", "test")])
    out = piv.select(*by, *[F.col(f"{n}_{s}") for n in names for s in ("train", "test")],
                     *[(F.col(f"{n}_train") - F.col(f"{n}_test")).alias(f"{n}_gap") for n in names])
    flag = ((F.col("accuracy_gap") > gap) | (F.col("f1_gap") > gap) | (F.col("auc_gap") > gap))
    return out.withColumn("overfit", F.coalesce(flag, F.lit(False)))


def early_stop(history: DataFrame, patience: int, metric: str | None = None, split: str | None = None,
               minimize: bool = True, round_col: str = "round", value_col: str = "value",
               keys: Sequence[str] = ("split", "metric")) -> DataFrame:
    """Early stopping on an evaluation-history table.

    For each (split, metric) series: ``best_round`` = first round with the
    best value so far at the stopping point; ``stop_round`` = first round
    that is ``patience`` rounds past the best, else the last round;
    ``stopped`` tells which. The history table holds one row per round.
    """
    h = history
    if metric is not None:
        h = h.filter(F.col("metric") == metric)
    if split is not None:
        h = h.filter(F.col("split") == split)
    keys = list(keys)
    v = F.col(value_col) if minimize else -F.col(value_col)
    w_run = Window.partitionBy(*keys).orderBy(round_col).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("__v", v).withColumn("__best", F.min("__v").over(w_run))
    # round at which the running best was first reached
    w_first = Window.partitionBy(*keys, "__best").orderBy(round_col)
    h = h.withColumn("__best_round", F.first(round_col).over(w_first.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("__trigger", (F.col(round_col) - F.col("__best_round")) >= patience)
    agg = h.groupBy(*keys).agg(
        F.min(F.when(F.col("__trigger"), F.col(round_col))).alias("trig_round"),
        F.max(round_col).alias("last_round"))
    agg = agg.withColumn(round_col, F.coalesce(F.col("trig_round"), F.col("last_round")))
    j = keyed_join(agg, h.select(*keys, round_col, "__best_round", "__best"), keys + [round_col])
    return j.select(*keys, F.col("__best_round").alias("best_round"), F.col(round_col).alias("stop_round"),
                    F.col("trig_round").isNotNull().alias("stopped"),
                    (F.col("__best") * (1 if minimize else -1)).alias("best_value"))

"""Group-fairness measures over a prediction table.

Per-group rates come from one grouping-sets or groupBy aggregate of the raw
rows; the gaps (max minus min over groups) and comparisons then run on the
small per-group tables only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parityframe.functions.metric_exprs import confusion_aggs, metric_aggs, metrics_from_counts
from parityframe.operators.metrics import _attribute_sets


def equalized_odds(pred: DataFrame, attributes: Sequence[str], y: str = "y_true", p: str = "y_pred",
                   zero_division: float | None = None, dropna: bool = True) -> DataFrame:
    """K1: ``(attribute, group_value, n, tpr, fpr, fnr)`` for every value of
    every attribute, one job. A group without positives (or negatives) gets
    NULL rates by default instead of failing."""
    return _attribute_sets(pred, attributes, metric_aggs(["n", "tpr", "fpr", "fnr"], y, p,
                                                         rate_zero_division=zero_division), dropna)


def selection_rates(pred: DataFrame, groups: Sequence[str], y: str = "y_true",
                    p: str = "y_pred") -> DataFrame:
    """K2: selection rate (share predicted positive) per group combination,
    with the TPR/FPR needed by K4 in the same pass."""
    c = confusion_aggs(y, p)
    m = metrics_from_counts(c["tn"], c["fp"], c["fn"], c["tp"], ["n", "selection_rate", "tpr", "fpr"])
    return pred.groupBy(*groups).agg(*[v.alias(k) for k, v in m.items()])


def _gap(col: str, empty_rate: float | None) -> Column:
    v = F.col(col) if empty_rate is None else F.coalesce(F.col(col), F.lit(float(empty_rate)))
    return F.max(v) - F.min(v)


def parity_difference(pred: DataFrame, groups: Sequence[str], y: str = "y_true",
                      p: str = "y_pred") -> DataFrame:
    """K3: demographic parity difference = max - min selection rate over
    the group combinations (intersection of all ``groups``)."""
    return selection_rates(pred, groups, y, p).agg(_gap("selection_rate", None).alias("parity_difference"))


def odds_difference(pred: DataFrame, groups: Sequence[str], y: str = "y_true", p: str = "y_pred",
                    empty_rate: float | None = 0.0) -> DataFrame:
    """K4: equalized odds difference = greatest(TPR gap, FPR gap) over the
    group combinations. A group with no positives (negatives) counts as
    rate ``empty_rate`` (0 by default; NULL skips it)."""
    r = selection_rates(pred, groups, y, p)
    return r.agg(F.greatest(_gap("tpr", empty_rate), _gap("fpr", empty_rate)).alias("odds_difference"))


def fairness_bundle(pred: DataFrame, groups: Sequence[str], scenario: str, y: str = "y_true",
                    p: str = "y_pred", empty_rate: float | None = 0.0) -> DataFrame:
    """K5: long summary ``(scenario, metric, value)``: overall accuracy,
    precision, recall and F1, demographic parity difference and equalized odds difference, all
    from one per-group aggregate (the overall numbers are sums of the
    per-group counts, so the raw rows are read once)."""
    c = confusion_aggs(y, p)
    per = pred.groupBy(*groups).agg(*[v.alias(k) for k, v in c.items()])
    m = metrics_from_counts(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"), ["selection_rate", "tpr", "fpr"],
                            rate_zero_division=None)
    per = per.select("*", *[v.alias(k) for k, v in m.items()])
    tot = metrics_from_counts(F.sum("tn"), F.sum("fp"), F.sum("fn"), F.sum("tp"), ["accuracy", "precision", "recall", "f1"])
    summary = per.agg(
        *[tot[m].alias(m) for m in ("accuracy", "precision", "recall", "f1")],
        _gap("selection_rate", None).alias("parity_difference"),
        F.greatest(_gap("tpr", empty_rate), _gap("fpr", empty_rate)).alias("odds_difference"))
    names = ["accuracy", "precision", "recall", "f1", "parity_difference", "odds_difference"]
    return summary.select(F.lit(scenario).alias("scenario"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("s")
    ).select("scenario", "s.metric", "s.value")


def scenario_groups(pred: DataFrame, groups: Sequence[str], scenario: str, y: str = "y_true",
                    p: str = "y_pred") -> DataFrame:
    """K5, per group: ``(scenario, groups..., n, accuracy, recall, precision,
    f1, selection_rate, tpr, fpr)`` in one aggregate."""
    m = metric_aggs(["n", "accuracy", "recall", "precision", "f1", "selection_rate", "tpr", "fpr"], y, p)
    return pred.groupBy(*groups).agg(*m).select(F.lit(scenario).alias("scenario"), "*")


def before_after(pre: DataFrame, post: DataFrame, groups: Sequence[str], metric: str) -> DataFrame:
    """K6: pair two per-group metric tables by group key (full outer join,
    NULL-safe), not by position: ``(groups..., before, after, delta)``."""
    from parityframe.operators.joins import keyed_join
    a = pre.select(*groups, F.col(metric).alias("before"))
    b = post.select(*groups, F.col(metric).alias("after"))
    j = keyed_join(a, b, groups, "full")
    return j.select(*groups, "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def group_label(groups: Sequence[str]) -> Column:
    """Text label ``"col=value, col=value"`` for a group row."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{g}="), F.coalesce(F.col(g).cast("string"), F.lit("NULL")))
                               for g in groups])


def disadvantaged_groups(frame: DataFrame, groups: Sequence[str], metric: str,
                         decode: DataFrame | None = None) -> DataFrame:
    """Groups whose ``metric`` is below the unweighted mean of the metric
    over groups (NULL metrics are skipped in the mean, as pandas does).

    The group table is materialized first (it is small), so the mean (a
    scalar subquery) and the filter do not re-read the prediction rows. ``decode``: an encoder map ``(column, value,
    code)``; group codes are replaced by their values before labelling.
    """
    from parityframe.session import checkpoint
    frame = checkpoint(frame)   # small per-group table: the raw rows are read once
    mean = frame.select(F.avg(metric)).scalar()
    out = frame.filter(F.col(metric) < mean).select(*groups, F.col(metric), mean.alias("mean_over_groups"))
    if decode is not None:
        from parityframe.operators.encode import decode_columns
        out = decode_columns(out, decode, [g for g in groups])
    return out.select(group_label(groups).alias("group"), *groups, metric, "mean_over_groups")


def gaps_by_attribute(pred: DataFrame, attributes: Sequence[str], y: str = "y_true", p: str = "y_pred",
                      empty_rate: float | None = 0.0) -> DataFrame:
    """K3/K4 per attribute: ``(attribute, parity_difference,
    odds_difference)`` over the values of each attribute separately (the
    intersectional form is :func:`parity_difference` / :func:`odds_difference`
    on all attributes). All attributes in one grouping-sets job."""
    rates = _attribute_sets(pred, attributes, metric_aggs(["selection_rate", "tpr", "fpr"], y, p))
    return rates.groupBy("attribute").agg(
        _gap("selection_rate", None).alias("parity_difference"),
        F.greatest(_gap("tpr", empty_rate), _gap("fpr", empty_rate)).alias("odds_difference"))

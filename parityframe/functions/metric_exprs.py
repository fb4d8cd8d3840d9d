"""Aggregate Column builders for binary-classification metrics.

Every metric is an aggregate ``Column`` built from four confusion counts, so
any ``groupBy`` / ``groupingSets`` / ``rollup`` computes all of them in one
pass with map-side partial aggregation.

Zero-denominator policy (the reference's libraries warn and return 0 for
precision/recall/F1; the hand-written rates divide by zero): each ratio takes
``zero_division``; ``None`` gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default zero-division values.
PRF_ZERO_DIVISION = 0.0      # precision, recall, f1
RATE_ZERO_DIVISION = None    # tpr, fpr, fnr


def ratio(num: Column, den: Column, zero_division: float | None) -> Column:
    r = F.try_divide(num.cast("double"), den.cast("double"))
    if zero_division is None:
        return r
    return F.coalesce(r, F.lit(float(zero_division)))


def confusion_aggs(y: str = "y_true", p: str = "y_pred", positive: int = 1) -> dict[str, Column]:
    """tn, fp, fn, tp as BIGINT aggregate columns."""
    yt = F.col(y) == F.lit(positive)
    yp = F.col(p) == F.lit(positive)
    return {
        "tn": F.count_if(~yt & ~yp).cast("long"),
        "fp": F.count_if(~yt & yp).cast("long"),
        "fn": F.count_if(yt & ~yp).cast("long"),
        "tp": F.count_if(yt & yp).cast("long"),
    }


def metrics_from_counts(tn: Column, fp: Column, fn: Column, tp: Column,
                        names: list[str],
                        prf_zero_division: float | None = PRF_ZERO_DIVISION,
                        rate_zero_division: float | None = RATE_ZERO_DIVISION) -> dict[str, Column]:
    """Metric Columns computed from (possibly aggregate) count Columns."""
    n = tn + fp + fn + tp
    table = {
        "n": lambda: n.cast("long"),
        "accuracy": lambda: ratio(tp + tn, n, None),
        "error_rate": lambda: F.lit(1.0) - ratio(tp + tn, n, None),
        "precision": lambda: ratio(tp, tp + fp, prf_zero_division),
        "recall": lambda: ratio(tp, tp + fn, prf_zero_division),
        "f1": lambda: ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn, prf_zero_division),
        "tpr": lambda: ratio(tp, tp + fn, rate_zero_division),
        "fpr": lambda: ratio(fp, fp + tn, rate_zero_division),
        "fnr": lambda: ratio(fn, fn + tp, rate_zero_division),
        "tnr": lambda: ratio(tn, tn + fp, rate_zero_division),
        "selection_rate": lambda: ratio(tp + fp, n, None),
        "base_rate": lambda: ratio(tp + fn, n, None),
        "tn": lambda: tn, "fp": lambda: fp, "fn": lambda: fn, "tp": lambda: tp,
    }
    unknown = [m for m in names if m not in table]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {sorted(table)}")
    return {m: table[m]() for m in names}


def metric_aggs(names: list[str], y: str = "y_true", p: str = "y_pred", positive: int = 1,
                prf_zero_division: float | None = PRF_ZERO_DIVISION,
                rate_zero_division: float | None = RATE_ZERO_DIVISION) -> list[Column]:
    """Aggregate Columns (aliased) for the named metrics."""
    c = confusion_aggs(y, p, positive)
    cols = metrics_from_counts(c["tn"], c["fp"], c["fn"], c["tp"], names,
                               prf_zero_division, rate_zero_division)
    return [v.alias(k) for k, v in cols.items()]


# A user metric: (y_true Column, y_pred Column) -> aggregate Column.
ColumnMetric = Callable[[Column, Column], Column]


def balanced_accuracy(y: Column, p: Column) -> Column:
    """Example user metric as an aggregate Column: mean of TPR and TNR."""
    tp = F.count_if((y == 1) & (p == 1))
    pos = F.count_if(y == 1)
    tn = F.count_if((y == 0) & (p == 0))
    neg = F.count_if(y == 0)
    return (F.coalesce(F.try_divide(tp.cast("double"), pos.cast("double")), F.lit(0.0))
            + F.coalesce(F.try_divide(tn.cast("double"), neg.cast("double")), F.lit(0.0))) / F.lit(2.0)


def round_half_away(c: Column, digits: int = 6) -> Column:
    """Round in binary floating point, half away from zero:
    ``round(x * 10^d) / 10^d``. Spark's ``round`` rounds the decimal text of
    the double instead, which differs from other engines on exact ties."""
    m = float(10 ** digits)
    y = c.cast("double") * F.lit(m)
    r = F.when(y >= 0, F.floor(y + F.lit(0.5))).otherwise(F.ceil(y - F.lit(0.5))).cast("double") / F.lit(m)
    # NaN/inf pass through unchanged.
    return F.when(F.isnan(y) | (F.abs(y) == F.lit(float("inf"))), c.cast("double")).otherwise(r)


def round_doubles(df, digits: int = 6):
    """Round every double column (sum order differs across engines)."""
    from pyspark.sql.types import DoubleType, FloatType
    return df.select(*[
        round_half_away(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])

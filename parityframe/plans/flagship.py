"""Flagship query: the per-attribute fairness audit (G7 + K1).

For every value of every sensitive attribute: group size, accuracy,
precision, recall, F1 of the positive class, TPR, FPR and FNR, all from one
Expand + two-phase aggregate over the prediction table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parityframe.functions.metric_exprs import round_doubles
from parityframe.operators.metrics import group_report
from parityframe.plans.tables import orders_pred

AUDIT_METRICS = ["n", "accuracy", "precision", "recall", "f1", "tpr", "fpr", "fnr"]


def fairness_audit(spark: SparkSession, sf: str) -> DataFrame:
    pred = orders_pred(spark, sf)
    return round_doubles(group_report(pred, ["c_mktsegment", "o_orderpriority"], metrics=AUDIT_METRICS))

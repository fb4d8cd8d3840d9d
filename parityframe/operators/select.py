"""Correlation and closed-form feature selection.

All of these reduce the rows with one aggregate (map-side partial
aggregation) into a table of size (features x features) or (classes x
features); ranking and pruning then run on that small table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parityframe.session import checkpoint


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair i<j, pairwise-complete (rows
    where both are non-NULL; NaN counts as missing), long form ``(col_a,
    col_b, pos_a, pos_b, r, abs_r)``. A constant column gives NULL rather
    than the ANSI divide-by-zero error of ``corr``.

    One pass of products of whole column blocks: each task multiplies its Arrow
    batches (values shifted by the column's mean from a first small aggregate,
    which keeps the moment formulas stable, and presence masks) and adds up
    p x p matrices, so a hundred columns are no wider a plan than two. A task
    leaves p^2 / 2 rows, which are summed by pair.
    """
    cols = list(cols)
    if len(cols) < 2:
        raise ValueError("need at least two columns")
    p = len(cols)
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    facts = values.agg(*[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(p) for f in (F.avg, F.min, F.max)]).first()
    # A constant is shifted by itself, so that its deviations are exactly 0.
    shift = np.array([float((facts[f"min{i}"] if facts[f"min{i}"] == facts[f"max{i}"] else facts[f"avg{i}"]) or 0.0)
                      for i in range(p)])
    first, second = np.triu_indices(p, 1)
    names = ["i", "j", "n", "si", "sj", "qi", "qj", "x"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = s = q = x = 0
        for batch in batches:
            raw = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            there = ~np.isnan(raw)
            here, dev = there.astype(float), np.where(there, raw - shift, 0.0)
            n, s, q, x = n + here.T @ here, s + dev.T @ here, q + (dev * dev).T @ here, x + dev.T @ dev
        if not isinstance(n, int):
            # s[i, j] sums column i where j is present.
            cells = [first.astype(np.int32), second.astype(np.int32), *(m[first, second] for m in (n, s, s.T, q, q.T, x))]
            yield pa.record_batch([pa.array(c) for c in cells], names=names)
    sums = values.mapInArrow(products, "i int, j int, " + ", ".join(f"{c} double" for c in names[2:])).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in names[2:]])
    cov = F.col("x") - F.try_divide(F.col("si") * F.col("sj"), F.col("n"))
    spread = [F.greatest(F.col(q) - F.try_divide(F.col(t) * F.col(t), F.col("n")), F.lit(0.0)) for t, q in (("si", "qi"), ("sj", "qj"))]
    quotient = F.try_divide(cov, F.sqrt(spread[0] * spread[1]))
    r = F.when(quotient.isNotNull(), F.least(F.greatest(quotient, F.lit(-1.0)), F.lit(1.0)))
    pairs = df.sparkSession.createDataFrame([(cols[i], cols[j], int(i), int(j)) for i, j in zip(first, second)],
                                            "col_a string, col_b string, pos_a int, pos_b int")
    out = pairs.join(sums, (F.col("pos_a") == F.col("i")) & (F.col("pos_b") == F.col("j")), "left").select(
        "col_a", "col_b", "pos_a", "pos_b", r.alias("r"))
    return checkpoint(out.withColumn("abs_r", F.abs("r")))


def corr_prune(corr: DataFrame, threshold: float = 0.7, protected: Sequence[str] = (), id_cols: Sequence[str] = (),
               label: str | None = None, sensitive: Sequence[str] = (), literal: bool = False) -> DataFrame:
    """columns to drop, ``(column, pos)``: a column is dropped when any
    earlier column (dropped or not) has abs r >= threshold with it and it
    is not protected. A pure filter, no iteration.

    Ids and the label are left out of the comparison, and sensitive columns
    are protected, so that the audit keeps them. ``literal=True`` compares
    every column and protects only ``protected``, as the reference's loop does
    (it can drop a sensitive column, the label or an id)."""
    keep = set(protected) | (set() if literal else set(sensitive))
    out = set() if literal else {*id_cols, *([label] if label else [])}
    hit = corr.where((F.col("abs_r") >= threshold) & ~F.col("col_b").isin(list(keep) or [""])
                     & ~F.col("col_a").isin(list(out) or [""]) & ~F.col("col_b").isin(list(out) or [""]))
    return hit.groupBy(F.col("col_b").alias("column"), F.col("pos_b").alias("pos")).agg(
        F.max("abs_r").alias("max_abs_r"))


def chi2_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """chi-square score of each non-negative feature against the class:
    O_c = sum of x in class c, E_c = (n_c / n) * sum of x,
    score = sum_c (O_c - E_c)^2 / E_c. Output ``(feature, pos, score)``. A
    negative value makes the query fail."""
    feats = list(features)
    df = df.withColumns({f: _not_negative(f) for f in feats})
    per = df.groupBy(F.col(label).alias("__cls")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(f).cast("double")).alias(f"__s{i}") for i, f in enumerate(feats)])
    return _chi2_from_class_sums(per, feats, [])


def _not_negative(col: str):
    x = F.col(col).cast("double")
    return F.when(x < 0, F.raise_error(F.lit(f"chi2 needs non-negative values; {col} has others"))).otherwise(x)


def _chi2_from_class_sums(per: DataFrame, feats: list[str], keys: list[str]) -> DataFrame:
    """Scores from a table (keys..., __cls, __n, __s<i>) of per-class sums."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    share = F.try_divide(F.col("__n").cast("double"), F.sum("__n").over(w).cast("double"))
    terms = []
    for i in range(len(feats)):
        expected = share * F.sum(f"__s{i}").over(w)
        terms.append(F.try_divide((F.col(f"__s{i}") - expected) ** 2, expected).alias(f"__t{i}"))
    terms = per.select(*keys, *terms)
    scores = terms.groupBy(*keys).agg(*[F.sum(f"__t{i}").alias(f"__c{i}") for i in range(len(feats))])
    return scores.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(i).alias("pos"), F.col(f"__c{i}").alias("score"))
        for i, f in enumerate(feats)])).alias("s")).select(*keys, "s.feature", "s.pos", "s.score")


def select_k_best(scores: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """top ``k`` features by score (NaN/NULL lowest; ties favour the later
    column), returned with their original position for ordering."""
    keys = list(keys)
    s = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(
        s.desc_nulls_last(), F.col("pos").desc())
    return scores.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= k).drop("__rk")


def closed_form_rfe(df: DataFrame, features: Sequence[str], label: str, fold_col: str = "fold") -> DataFrame:
    """per cross-validation fold, chi2 scores on the training part
    (rows outside the fold) and the elimination order they imply
    (``rank`` 1 = kept longest). Training sums are total minus fold sums,
    so one aggregate by (fold, class) serves every fold."""
    feats = list(features)
    per = df.groupBy(F.col(fold_col).alias("fold"), F.col(label).alias("__cls")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(f).cast("double")).alias(f"__s{i}") for i, f in enumerate(feats)])
    wt = Window.partitionBy("__cls")
    train = per.select("fold", "__cls", (F.sum("__n").over(wt) - F.col("__n")).alias("__n"), *[
        (F.sum(f"__s{i}").over(wt) - F.col(f"__s{i}")).alias(f"__s{i}") for i in range(len(feats))])
    sc = _chi2_from_class_sums(train, feats, ["fold"])
    s = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    w = Window.partitionBy("fold").orderBy(s.desc_nulls_last(), F.col("pos").desc())
    return sc.withColumn("rank", F.row_number().over(w))

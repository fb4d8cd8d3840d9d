"""IQR outlier filters (C1-C4) and exact quantiles.

A fence is ``[Q1 - 1.5 IQR, Q3 + 1.5 IQR]`` with linearly interpolated
quantiles, inclusive. NaN is treated as missing (pandas skips it; Spark's
``percentile`` would count it), and a row with a missing value in a filtered
column is dropped, as the reference's comparison does.

Sequential filtering (C2) computes each column's fence on the rows that
survived the previous columns. Writing that lazily would reference the frame
twice per step (2^N scans); instead each fence is one small aggregate job
whose two numbers are inlined as literals, so the final plan is a single
scan with one conjunctive filter that Parquet can push down.

Quantiles are exact by distributed narrowing, the same way at every size:
each round cuts the range that holds the wanted ranks (by approximate
quantiles and by equal widths), counts rows per cut in one job, and goes on
with the cut that holds the rank. A range of at most ``gather`` rows is read
and sorted instead; that bounds what reaches the driver and changes no value.
``method='approx'`` takes ``percentile_approx`` (not equal to the oracle).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parityframe.operators.profile import numeric_columns
from parityframe.operators.quantile import all_quantiles
from parityframe.operators.ranking import add_bucket, quantile_splits

#: Values that the last step of the narrowing reads at most (8 bytes each).
GATHER = 200_000


@dataclass(frozen=True)
class Fence:
    column: str
    q1: float | None
    q3: float | None
    integral: bool = False     # integer column: compare in its own type

    @property
    def lower(self) -> float | None:
        return None if self.q1 is None else self.q1 - 1.5 * (self.q3 - self.q1)

    @property
    def upper(self) -> float | None:
        return None if self.q3 is None else self.q3 + 1.5 * (self.q3 - self.q1)

    def predicate(self) -> Column:
        if self.q1 is None or self.q3 is None or math.isnan(self.q1) or math.isnan(self.q3):
            return F.lit(False)  # no finite value: the reference keeps nothing
        if self.integral:
            # x >= L  <=>  x >= ceil(L) for integers: same rows, and a
            # predicate on the column's own type reaches the Parquet reader.
            lo = max(math.ceil(self.lower), -(2 ** 63))
            hi = min(math.floor(self.upper), 2 ** 63 - 1)
            c = F.col(f"`{self.column}`")
            return c.isNotNull() & (c >= F.lit(lo)) & (c <= F.lit(hi))
        c = F.col(f"`{self.column}`").cast("double")
        return c.isNotNull() & ~F.isnan(c) & (c >= F.lit(self.lower)) & (c <= F.lit(self.upper))


def _clean_value(col: str) -> Column:
    c = F.col(f"`{col}`").cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def _cuts(sub: DataFrame, lo: float, hi: float, buckets: int) -> list[float]:
    """Ascending cuts of [lo, hi]: approximate quantiles, equal widths, and the
    next number after lo, so that every round leaves a smaller range."""
    step = (hi - lo) / 256
    even = [lo + step * i for i in range(1, 256)] if math.isfinite(step) else [0.0]
    cuts = {*quantile_splits(sub, "v", buckets), *even, math.nextafter(lo, math.inf), hi}
    return sorted(c for c in cuts if lo < c <= hi)


def _order_statistics(df: DataFrame, col: str, ranks: Sequence[int], n: int, gather: int,
                      buckets: int = 1024) -> dict[int, float]:
    """0-based order statistics of ``col`` (NULL/NaN removed, n values left).
    Wanted ranks in the same range share its jobs."""
    base = df.select(_clean_value(col).alias("v")).where(F.col("v").isNotNull())
    out: dict[int, float] = {}
    # (lowest, highest value of the range, its rows) -> [(rank, rank in the range)]
    ranges: dict[tuple, list] = {(None, None, n): [(k, k) for k in sorted(set(ranks))]}
    while ranges:
        found: dict[tuple, list] = {}
        for (lo, hi, rows), items in ranges.items():
            sub = base if lo is None else base.where((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi)))
            if rows <= gather:
                values = np.sort(sub.toArrow().column("v").to_numpy())
                out.update({k: float(values[at]) for k, at in items})
                continue
            if lo is None:
                ends = sub.agg(F.min("v"), F.max("v")).first()
                lo, hi = float(ends[0]), float(ends[1])
            hist = add_bucket(sub, "v", _cuts(sub, lo, hi, buckets), "b").groupBy("b").agg(
                F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).orderBy("b").collect()
            below = 0
            for r in hist:
                for k, at in items:
                    if below <= at < below + r["n"]:
                        if r["mn"] == r["mx"]:
                            out[k] = float(r["mn"])
                        else:
                            found.setdefault((r["mn"], r["mx"], r["n"]), []).append((k, at - below))
                below += r["n"]
        ranges = found
    return out


def column_quantiles(df: DataFrame, col: str, probs: Sequence[float], method: str = "exact",
                     accuracy: int = 10000, gather: int = GATHER) -> list[float | None]:
    """Linear-interpolated quantiles of one column (NaN treated as NULL)."""
    if method == "approx":
        arr = df.agg(F.percentile_approx(_clean_value(col), list(probs), accuracy).alias("q")).first()["q"]
        return [None if arr is None else arr[i] for i in range(len(probs))]
    if method != "exact":
        raise ValueError("method must be 'exact' or 'approx'")
    n = df.where(_clean_value(col).isNotNull()).count()
    if n == 0:
        return [None] * len(probs)
    plan = []
    for q in probs:
        pos = (n - 1) * float(q)
        lo = int(math.floor(pos))
        plan.append((lo, min(lo + 1, n - 1), pos - lo))
    stats = _order_statistics(df, col, [r for p in plan for r in p[:2]], n, gather)
    return [stats[a] + f * (stats[b] - stats[a]) for a, b, f in plan]


def fit_fence(df: DataFrame, col: str, method: str = "exact", **kw) -> Fence:
    q1, q3 = column_quantiles(df, col, [0.25, 0.75], method, **kw)
    return Fence(col, q1, q3, _is_integral(df, col))


def _is_integral(df: DataFrame, col: str) -> bool:
    from pyspark.sql import types as T
    return isinstance(df.schema[col].dataType, T.IntegralType)


def iqr_filter(df: DataFrame, col: str, method: str = "exact") -> tuple[DataFrame, Fence]:
    """Keep rows inside one column's IQR fence."""
    fence = fit_fence(df, col, method)
    return df.where(fence.predicate()), fence


def default_iqr_columns(df: DataFrame, id_cols: Sequence[str] = (), label_col: str | None = None,
                        columns="auto") -> list[str]:
    """Columns for C2. ``'all'``: every numeric column (the reference's
    literal loop, which deletes the rare value of a 0/1 flag); ``'auto'``:
    numeric minus ids, the label and columns with at most 2 distinct values."""
    nums = numeric_columns(df)
    if columns == "all":
        return nums
    cand = [c for c in nums if c not in set(id_cols) and c != label_col]
    if not cand:
        return []
    d = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cand]).first()
    return [c for c in cand if d[c] > 2]


def iqr_sequential(df: DataFrame, columns: Sequence[str], method: str = "exact",
                   **kw) -> tuple[DataFrame, list[Fence]]:
    """Fences in order, each fitted on the survivors of the previous
    ones. A repeated column (the reference's second pass) gets a new fence.
    Returns the lazily filtered frame and the fences (one small job each)."""
    fences: list[Fence] = []
    cur = df
    for c in columns:
        f = fit_fence(cur, c, method, **kw)
        fences.append(f)
        cur = cur.where(f.predicate())
    return cur, fences


def iqr_one_shot(df: DataFrame, columns: Sequence[str], method: str = "exact") -> tuple[DataFrame, list[Fence]]:
    """C4: all fences from the same input, one filter. Differs from C2 by
    design (fences do not see earlier filters). Exact fences of all columns
    are fitted together, in a fixed number of jobs."""
    if method == "exact":
        fences = [Fence(c, q1, q3, _is_integral(df, c)) for c, (q1, q3) in zip(columns, all_quantiles(df, columns, [0.25, 0.75]))]
    else:
        fences = [fit_fence(df, c, method) for c in columns]
    pred = F.lit(True)
    for f in fences:
        pred = pred & f.predicate()
    return df.where(pred), fences

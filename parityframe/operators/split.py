"""Reproducible splits, folds and scaling (H1-H3).

Randomness is a portable hash of (seed, key), so the same rows land in the
same part on any cluster layout, on retries and in DuckDB. Exact sizes come
from cut points: the (hash, key) of the wanted ranks are found by histograms
of the hash, narrowed level by level, and every row is then compared with
them. Only counts are shuffled; no row moves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parityframe.functions.hashing import hash32, require_unique_key, uniform


def train_test_split(df: DataFrame, key_cols: Sequence[str], test_frac: float = 0.2, seed: int = 42,
                     mode: str = "exact", split_col: str = "split", hash_method: str = "md5") -> DataFrame:
    """H1: add ``split`` in {'train','test'}.

    ``exact``: the test part is the ``ceil(test_frac * n)`` rows with the
    smallest (hash, key), as a shuffled split with a fixed size would give.
    ``bernoulli``: each row independently, ``u < test_frac`` (no count job).
    """
    keys = list(key_cols)
    if mode == "bernoulli":
        return df.withColumn(split_col, F.when(uniform(seed, *keys, method=hash_method) < test_frac, F.lit("test")).otherwise(F.lit("train")))
    if mode != "exact":
        raise ValueError("mode must be 'exact' or 'bernoulli'")
    require_unique_key(df, keys)
    n_test = int(math.ceil(test_frac * df.count()))
    hashed = df.withColumn("__h", hash32(seed, *keys, method=hash_method))
    cut = rank_cuts(hashed, None, keys, lambda _, n: [n_test]).get(None, [None])[0]
    is_test = F.lit(False) if cut is None else _up_to(keys, cut)
    return hashed.select(*df.columns, F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias(split_col))


def stratified_folds(df: DataFrame, label: str, key_cols: Sequence[str], k: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """H2: rank r (from 1) of n by (hash, key) within its class goes to fold
    ``ceil(r * k / n) - 1``, so fold sizes differ by at most one per class. The
    classes must be few (k - 1 cut points of each are in the plan)."""
    keys = list(key_cols)
    require_unique_key(df, keys)
    hashed = df.withColumn("__h", hash32(f"{seed}|fold", *keys))
    cuts = rank_cuts(hashed, label, keys, lambda _, n: [n * j // k for j in range(1, k)])
    fold = F.lit(None).cast("int")
    for cls, points in cuts.items():
        # As many cuts below a row as its fold's number.
        passed = sum((F.when(_up_to(keys, p), F.lit(0)).otherwise(F.lit(1)) if p else F.lit(1) for p in points), F.lit(0))
        fold = F.when(F.col(label).eqNullSafe(F.lit(cls).cast(df.schema[label].dataType)), passed).otherwise(fold)
    return hashed.select(*df.columns, fold.cast("int").alias(fold_col))


def _up_to(keys: Sequence[str], cut: tuple) -> Column:
    """(hash, key) is at most the cut."""
    h, key = cut
    same = F.struct(*keys) <= F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, key)])
    return (F.col("__h") < F.lit(h)) | ((F.col("__h") == F.lit(h)) & same)


#: Bits of the hash that each round of histograms adds.
_LEVELS = (12, 10, 10)


def rank_cuts(hashed: DataFrame, group: str | None, keys: Sequence[str], ranks: Callable) -> dict:
    """{group value: [(hash, key) at each of ``ranks(value, n)``]}, None for rank 0.
    ``hashed`` has the 32-bit hash as ``__h``. Three counting jobs narrow the
    hash to one value, a last one sorts the few rows that share it."""
    g = F.col(group) if group else F.lit(None).cast("int")
    slim = hashed.select(g.alias("__g"), "__h", *keys)
    sizes = {r["__g"]: r["count"] for r in slim.groupBy("__g").count().collect()}
    # (group, place) -> (prefix so far, rank within it)
    wanted = {(v, i): (0, r) for v, n in sizes.items() for i, r in enumerate(ranks(v, n)) if r > 0}
    left = 32
    for bits in _LEVELS:
        prefixes = sorted({p for p, _ in wanted.values()})
        part = slim if left == 32 else slim.filter(F.shiftright("__h", left).isin(prefixes))
        left -= bits
        counts: dict = {}
        for r in part.groupBy("__g", F.shiftright("__h", left).alias("__p")).count().orderBy("__p").collect():
            counts.setdefault((r["__g"], r["__p"] >> bits), []).append((r["__p"], r["count"]))
        for at, (prefix, rank) in wanted.items():
            for p, n in counts[at[0], prefix]:
                if rank <= n:
                    break
                rank -= n
            wanted[at] = (p, rank)
    tied: dict = {}
    same = slim.filter(F.col("__h").isin(sorted({h for h, _ in wanted.values()})))
    for r in same.orderBy(*keys).collect():
        tied.setdefault((r["__g"], r["__h"]), []).append(tuple(r[k] for k in keys))
    return {v: [(wanted[v, i][0], tied[v, wanted[v, i][0]][wanted[v, i][1] - 1]) if (v, i) in wanted else None
                for i in range(len(ranks(v, n)))] for v, n in sizes.items()}


@dataclass(frozen=True)
class MinMax:
    bounds: dict  # column -> (min, max)

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """H3 transform: ``(x - min) / (max - min)``, and ``x - min`` for a
        column that was constant in the fit; values outside the fitted range
        leave [0, 1] (as fit on train); NaN is missing."""
        cols = {}
        for c, (lo, hi) in self.bounds.items():
            x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
            if lo is None or hi is None:
                cols[c + suffix] = F.lit(None).cast("double")
            elif hi == lo:
                cols[c + suffix] = x - F.lit(float(lo))
            else:
                cols[c + suffix] = (x - F.lit(float(lo))) / F.lit(float(hi - lo))
        return df.withColumns(cols)


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> MinMax:
    """H3 fit: min and max of each column in one aggregate."""
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    row = df.agg(*[F.min(value[c]).alias(f"{c}__lo") for c in cols],
                 *[F.max(value[c]).alias(f"{c}__hi") for c in cols]).first()
    return MinMax({c: (row[f"{c}__lo"], row[f"{c}__hi"]) for c in cols})


def split_where(df: DataFrame, part: str, split_col: str = "split") -> DataFrame:
    return df.where(F.col(split_col) == part)

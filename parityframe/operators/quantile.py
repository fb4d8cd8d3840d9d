"""Order statistics of many columns at once, in a fixed number of jobs.

A double's bits, with the sign turned, order as the number does. Sixteen bits at
a time, a job counts the values of every column under the prefixes that hold a
wanted rank, a window inside each prefix finds the next sixteen bits, and only
these places reach the driver: one job for the columns' sizes and one for each
level, whatever the number of columns and ranks. Counts are whole numbers, so the
result does not depend on how rows are dealt. All four levels give the value
itself; fewer give an upper bound that agrees in its leading bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parityframe.session import ship

BITS = 16
SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """uint64 that order as the doubles do; -0.0 counts as 0.0."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def from_bits(bits: int) -> float:
    bits = bits & ~(1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def clean_array(cols: Sequence[str]) -> Column:
    """The columns as an array of doubles."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def _level_counts(rows: DataFrame, level: int, wanted: dict) -> DataFrame:
    """(c, parent, sub, n): values of column c under the wanted prefixes."""
    shift = np.uint64(64 - BITS * (level + 1))

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
            out = []
            for c, parents in wanted.items():
                v = x[:, c]
                prefix = ordered_bits(v[~np.isnan(v)]) >> shift
                if level:
                    prefix = prefix[np.isin(prefix >> np.uint64(BITS), parents)]
                found, n = np.unique(prefix, return_counts=True)
                out.append((np.full(len(found), c), found >> np.uint64(BITS), found & np.uint64((1 << BITS) - 1), n))
            if out:
                whole = [np.concatenate(p) for p in zip(*out)]
                yield pa.record_batch([pa.array(p.astype(np.int64)) for p in whole], names=["c", "parent", "sub", "n"])
    counted = rows.mapInArrow(run, "c long, parent long, sub long, n long")
    return counted.groupBy("c", "parent", "sub").agg(F.sum("n").alias("n"))


def array_order_statistics(df: DataFrame, array: Column, n_cols: int, ranks: Callable[[int], Sequence[int]],
                           levels: int = 4) -> list[tuple[int, dict[int, float]]]:
    """For each place of ``array`` (doubles; null or NaN is missing): the number of
    values, and {rank: value} for the 0-based ``ranks(n)``."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(array.alias("x")).where("x IS NOT NULL")
    # A missing value is NaN from here on.
    rows = rows.select(F.transform("x", lambda v: F.coalesce(v, F.lit(math.nan))).alias("x"))
    sizes = rows.agg(*[F.count_if(~F.isnan(F.col("x")[c])).alias(f"n{c}") for c in range(n_cols)]).first()
    sizes = [int(n or 0) for n in sizes]
    # (column, rank) -> (prefix, rank under it)
    at = {(c, r): (0, r) for c, n in enumerate(sizes) if n for r in sorted(set(ranks(n)))}
    for level in range(levels if at else 0):
        wanted: dict = {}
        for (c, _), (prefix, _) in at.items():
            wanted.setdefault(c, set()).add(prefix)
        wanted = {c: np.array(sorted(p), np.uint64) for c, p in wanted.items()}
        below = Window.partitionBy("c", "parent").orderBy("sub")
        counts = _level_counts(rows, level, wanted).withColumn("upto", F.sum("n").over(below))
        keys = list(at)
        # As many rows as ranks are wanted.
        asked = spark.createDataFrame([(i, c, at[c, r][0], at[c, r][1]) for i, (c, r) in enumerate(keys)],
                                      "i int, c long, parent long, place long")
        hit = counts.join(F.broadcast(asked), ["c", "parent"]).where("place < upto AND place >= upto - n")
        for r in hit.select("i", "sub", (F.col("place") - F.col("upto") + F.col("n")).alias("place")).collect():
            at[keys[r["i"]]] = (at[keys[r["i"]]][0] << BITS | r["sub"], r["place"])
    rest = 64 - BITS * levels
    out: list = [(n, {}) for n in sizes]
    for (c, r), (prefix, _) in at.items():
        out[c][1][r] = from_bits(prefix << rest | (1 << rest) - 1)
    return out


def all_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> list[list[float | None]]:
    """Linearly interpolated quantiles of every column; missing values are left
    out, a column without any value has None."""
    cols = list(cols)

    def around(n):
        return [r for q in probs for p in [(n - 1) * float(q)] for r in (math.floor(p), min(math.floor(p) + 1, n - 1))]
    out = []
    for n, found in array_order_statistics(df, clean_array(cols), len(cols), around) if cols else ():
        line: list = []
        for q in probs:
            if not n:
                line.append(None)
                continue
            p = (n - 1) * float(q)
            low, high, part = found[math.floor(p)], found[min(math.floor(p) + 1, n - 1)], p - math.floor(p)
            line.append(low if not part or low == high else low + part * (high - low))
        out.append(line)
    return out

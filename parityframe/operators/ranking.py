"""Exact ranks without a window over a whole partition.

``row_number() OVER (PARTITION BY g ORDER BY h, key)`` puts every row of a
group into one task; with a hot group (a third of the table) that task
never finishes. Here ``h`` is a 32-bit portable hash, so its top bits split
each group into up to ``2**bucket_bits`` buckets of nearly equal size:

1. ``local`` = row_number inside (g, bucket), ordered by (h, key): the
   window is partitioned by the bucket too, so the work spreads evenly.
2. ``offset`` = rows of g in lower buckets: a running sum over the small
   (g, bucket, count) table.
3. rank = offset + local.

The count table has at most ``groups x 2**bucket_bits`` rows; its join to the
rows is left to AQE, which broadcasts it when its runtime size is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_rank(df: DataFrame, partition_cols: Sequence[str], hash_col: str,
               key_cols: Sequence[str], rank_col: str = "rn",
               bucket_bits: int = 16) -> DataFrame:
    """Append ``rank_col`` = 1-based row number within ``partition_cols``
    ordered by (``hash_col``, ``key_cols``). ``hash_col`` must hold values in
    [0, 2^32)."""
    part = list(partition_cols)
    bcol = "__pf_bucket"
    shift = 32 - bucket_bits
    with_b = df.withColumn(bcol, F.shiftright(F.col(hash_col), shift))

    counts = with_b.groupBy(*part, bcol).agg(F.count(F.lit(1)).alias("__pf_cnt"))
    w_off = (Window.partitionBy(*part).orderBy(bcol) if part else Window.orderBy(bcol))
    offsets = counts.select(
        *part, bcol,
        F.coalesce(F.sum("__pf_cnt").over(w_off.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__pf_off"))

    w_local = Window.partitionBy(*part, bcol).orderBy(F.col(hash_col), *[F.col(k) for k in key_cols])
    local = with_b.withColumn("__pf_local", F.row_number().over(w_local))

    # Null group keys must still match their own offsets.
    from parityframe.operators.joins import keyed_join
    joined = keyed_join(local, offsets, part + [bcol])
    return joined.select(*df.columns, (F.col("__pf_off") + F.col("__pf_local")).alias(rank_col))


def ordered_rank(df: DataFrame, partition_cols: Sequence[str], bucket_col: str,
                 order_cols: Sequence[str], rank_col: str = "rn") -> DataFrame:
    """Like :func:`exact_rank` for any order: ``bucket_col`` must hold a
    number that is non-decreasing in ``order_cols`` (e.g. from
    :func:`add_quantile_bucket` on the first order column). The window then
    runs inside (partition, bucket) only."""
    part = list(partition_cols)
    bcol = "__pf_bucket"
    with_b = df.withColumn(bcol, F.col(bucket_col).cast("long"))
    counts = with_b.groupBy(*part, bcol).agg(F.count(F.lit(1)).alias("__pf_cnt"))
    w_off = (Window.partitionBy(*part).orderBy(bcol) if part else Window.orderBy(bcol))
    offsets = counts.select(*part, bcol, F.coalesce(
        F.sum("__pf_cnt").over(w_off.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__pf_off"))
    w_local = Window.partitionBy(*part, bcol).orderBy(*[F.col(c) for c in order_cols])
    local = with_b.withColumn("__pf_local", F.row_number().over(w_local))
    from parityframe.operators.joins import keyed_join
    joined = keyed_join(local, offsets, part + [bcol])
    return joined.select(*df.columns, (F.col("__pf_off") + F.col("__pf_local")).alias(rank_col))


def buckets_for(n_rows: int, rows_per_bucket: int = 1_000_000, lo: int = 256, hi: int = 65536) -> int:
    """Number of quantile ranges so that each holds about
    ``rows_per_bucket`` rows (bounded, so the split list stays small)."""
    return int(min(hi, max(lo, -(-n_rows // rows_per_bucket))))


def quantile_splits(df: DataFrame, col: str, n_buckets: int = 1024, accuracy: int | None = None) -> list[float]:
    """Sorted distinct approximate-quantile boundaries of ``col`` (one small
    job; at most ``n_buckets - 1`` numbers reach the driver). The sketch
    accuracy defaults to 8x the bucket count so ranges come out even."""
    accuracy = accuracy or max(10000, 8 * n_buckets)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    b = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, accuracy).alias("b")).first()["b"] or []
    return sorted(set(float(x) for x in b if x is not None and x == x))


def add_bucket(df: DataFrame, col: str, splits: Sequence[float], out_col: str) -> DataFrame:
    """``out_col`` = index of the range of ``splits`` holding ``col``
    (binary search in the JVM via ``Bucketizer``; NULL/NaN go to an extra
    last bucket). Non-decreasing in ``col``."""
    from pyspark.ml.feature import Bucketizer
    edges = [float("-inf")] + [s for s in splits if s not in (float("-inf"), float("inf"))] + [float("inf")]
    tmp = "__pf_bin_in"
    b = Bucketizer(splits=edges, inputCol=tmp, outputCol=out_col, handleInvalid="keep")
    out = b.transform(df.withColumn(tmp, F.col(col).cast("double")))
    return out.drop(tmp).withColumn(out_col, F.col(out_col).cast("long"))


def count_and_splits(df: DataFrame, col: str, base_buckets: int = 256) -> tuple[int, list[float]]:
    """Row count and quantile splits in one job; a second, finer job runs
    only when the data needs more than ``base_buckets`` ranges (about a
    million rows each)."""
    probs = [i / base_buckets for i in range(1, base_buckets)]
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.percentile_approx(F.col(col).cast("double"), probs, max(10000, 8 * base_buckets)).alias("b")).first()
    n = int(row["n"])
    want = buckets_for(n)
    if want > base_buckets:
        return n, quantile_splits(df, col, want)
    return n, sorted(set(float(x) for x in (row["b"] or []) if x is not None and x == x))


def add_quantile_bucket(df: DataFrame, col: str, out_col: str, n_buckets: int | None = None) -> DataFrame:
    """Bucket by approximate quantiles; the bucket count grows with the row
    count unless given."""
    splits = quantile_splits(df, col, n_buckets) if n_buckets else count_and_splits(df, col)[1]
    return add_bucket(df, col, splits, out_col)

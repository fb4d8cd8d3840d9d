"""Portable, partition-independent random numbers.

A row's random draw is a pure function of (seed, tag, key columns), so a
retried task, a rerun on another cluster layout and an independent DuckDB
query all see the same value. ``rand(seed)`` is not used anywhere: its
stream depends on partition layout.

Spark:  conv(substr(md5(concat_ws('|', seed, key...)), 1, 8), 16, 10)
DuckDB: ('0x' || substr(md5(concat_ws('|', seed, key...)), 1, 8))::BIGINT
Both give an integer in [0, 2^32). A NULL key part is hashed as the single
character U+0000, so that it keeps its place among the parts.

``method='xxhash64'`` takes Spark's native hash of the typed values instead
(no string building; the same on every cluster layout, not outside Spark).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_32 = 4294967296.0

def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(seed: int | str, *parts, method: str = "md5") -> Column:
    """32-bit unsigned hash of ``seed|part1|part2...`` as BIGINT in [0, 2^32)."""
    if method == "xxhash64":
        # The hash skips NULL values, hence the flags.
        h = F.xxhash64(F.lit(str(seed)), *[x for p in parts for x in (_as_col(p), _as_col(p).isNull())])
        return F.pmod(h, F.lit(4294967296)).cast("long")
    if method != "md5":
        raise ValueError("hash method must be 'md5' or 'xxhash64'")
    cols = [F.lit(str(seed))] + [F.coalesce(_as_col(p).cast("string"), F.lit("\0")) for p in parts]
    digest = F.md5(F.concat_ws("|", *cols))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, *parts, method: str = "md5") -> Column:
    """Portable uniform draw in [0, 1)."""
    return hash32(seed, *parts, method=method) / F.lit(TWO_32)


def sql_hash32(seed: int | str, *parts: str) -> str:
    """DuckDB text of :func:`hash32` (for oracle SQL)."""
    inner = ", ".join([f"'{seed}'"] + [f"coalesce(CAST({p} AS VARCHAR), chr(0))" for p in parts])
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT"


def check_unique_key(df: DataFrame, key_cols: Sequence[str]) -> bool:
    """True when ``key_cols`` identify each row (one job on the keys; NULL is
    a key value)."""
    return df.groupBy(*key_cols).count().filter("count > 1").isEmpty()


def require_unique_key(df: DataFrame, key_cols: Sequence[str]) -> None:
    if not check_unique_key(df, key_cols):
        raise ValueError(f"key columns {list(key_cols)} do not identify rows uniquely")

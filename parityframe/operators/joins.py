"""Key joins used across operators (L2-L4).

Both sides are aliased, so frames derived from the same source can be
joined without ambiguous column references. NULL keys match each other
(``<=>``), which Spark still plans as an equi-join. The join strategy is
left to the planner: AQE broadcasts a side whose runtime size is small and
splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(alias: str, c: str):
    return F.col(f"{alias}.`{c}`")


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
               null_safe: bool = True, broadcast_right: bool = False) -> DataFrame:
    """Join on same-named ``keys``; output = keys, then left's other
    columns, then right's other columns (right wins no name clashes: a
    duplicate non-key name from the right is dropped)."""
    keys = list(keys)
    l_ = left.alias("__l")
    r_ = (F.broadcast(right) if broadcast_right else right).alias("__r")
    cond = None
    for k in keys:
        e = _q("__l", k).eqNullSafe(_q("__r", k)) if null_safe else (_q("__l", k) == _q("__r", k))
        cond = e if cond is None else cond & e
    j = l_.join(r_, cond, how)
    if how in ("full", "full_outer", "outer"):
        kcols = [F.coalesce(_q("__l", k), _q("__r", k)).alias(k) for k in keys]
    elif how in ("right", "right_outer"):
        kcols = [_q("__r", k).alias(k) for k in keys]
    else:
        kcols = [_q("__l", k).alias(k) for k in keys]
    if how in ("left_semi", "semi", "left_anti", "anti"):
        return j.select(*kcols, *[_q("__l", c).alias(c) for c in left.columns if c not in keys])
    lcols = [c for c in left.columns if c not in keys]
    rcols = [c for c in right.columns if c not in keys and c not in set(lcols)]
    return j.select(*kcols, *[_q("__l", c).alias(c) for c in lcols], *[_q("__r", c).alias(c) for c in rcols])

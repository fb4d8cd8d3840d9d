"""Query catalogue: each operator bound to the driver's tables, with the
matching DuckDB SQL (the correctness oracle).

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLE[name] = sql``.
Every query reads the given tables whole. Doubles are rounded to 6 places on
both sides (summation order differs between engines); counts are BIGINT.
Queries whose result depends on a trained model have no SQL entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from parityframe.plans import (  # noqa: F401
        q_flows, q_metrics, q_prep, q_select, q_rebalance, q_learners,
    )

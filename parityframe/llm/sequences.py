"""Conversations as ordered rows: numbering that no long conversation can
gather in one task, shared by the operators on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parityframe.llm.common import stored

#: A segment has 2**SEGMENT_BITS rows at most: what one grouped row holds.
SEGMENT_BITS = 10


def segment() -> F.Column:
    return F.shiftright("mid", SEGMENT_BITS).alias("segment")


def in_order(rows: DataFrame, by: list, name: str) -> DataFrame:
    """``rows``, stored sorted by the columns ``by`` (nulls first), with ``mid``,
    which ascends in that order. Tasks hold ranges of all of ``by``, so that the
    rows of one conversation may lie in many tasks. :func:`segment` cuts
    the order into segments."""
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(spread.withColumn("mid", F.monotonically_increasing_id()), name)


def segment_starts(ordered: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, segment, start, n_rows): the place of each segment's first row in its
    conversation, and the rows of the whole conversation. The windows see one row
    for each segment."""
    counted = ordered.groupBy(id_col, segment()).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(id_col)
    return counted.select(id_col, "segment", (F.sum("n").over(whole.orderBy("segment")) - F.col("n")).alias("start"),
                          F.sum("n").over(whole).alias("n_rows"))

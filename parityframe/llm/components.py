"""Connected components of a link table, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parityframe.llm.common import stored


def _largest_smaller(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step. Edges are (u, v) with v < u. Each node's neighbours (all
    of them, or the smaller ones) are tied to the smallest of them or itself.
    The join back is on a unique key, so Spark can split a hot node."""
    near = edges
    if both_ways:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("least", "u").alias("least"))
    tied = near.join(least, "u")
    if both_ways:
        tied = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        tied = tied.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v")) \
            .unionByName(least.select("u", F.col("least").alias("v")))
    return tied.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (two long columns a, b); the
    component is its smallest node. Alternates the large-star and small-star
    steps until nothing changes; each round is stored in the shared folder."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                   "links")
    state = None
    while True:
        check = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(check) == state:
            break
        state = tuple(check)
        edges = stored(_largest_smaller(_largest_smaller(edges, True), False), "links")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))

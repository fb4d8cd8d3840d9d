"""Bindings of the operators' roles to the driver's tables.

The reference audits one clinical CSV; the driver's TPC-H-like tables stand
in for it (see FIXTURES.md):

* large prediction table: ``orders JOIN customer``; y_true = order status
  'F', y_pred = total price above 250,000, score = price / (price + 250,000)
  (so ``score > 0.5`` is the same rule), groups = market segment and order
  priority;
* imbalanced labelled table: ``documents JOIN labels``; y_true = quality,
  groups = lang and source.

Each binding has a Spark builder and the matching DuckDB SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parityframe.sources.io import read_table

PRICE_CUT = 250000.0
CHARS_CUT = 1500


def orders_pred(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    price = F.col("o_totalprice")
    return j.select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment"), F.col("o_orderpriority"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        (price > F.lit(PRICE_CUT)).cast("int").alias("y_pred"),
        (price / (price + F.lit(PRICE_CUT))).alias("score"))


ORDERS_PRED_SQL = f"""
SELECT o.o_orderkey AS id, c.c_mktsegment, o.o_orderpriority,
       CAST(o.o_orderstatus = 'F' AS INTEGER) AS y_true,
       CAST(o.o_totalprice > {PRICE_CUT} AS INTEGER) AS y_pred,
       o.o_totalprice / (o.o_totalprice + {PRICE_CUT}) AS score
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""


def docs_labeled(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = read_table(spark, sf, "labels")
    return d.join(lab, "doc_id")


DOCS_LABELED_SQL = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def docs_pred(spark: SparkSession, sf: str) -> DataFrame:
    d = docs_labeled(spark, sf)
    n = F.col("n_chars").cast("double")
    return d.select(F.col("doc_id").alias("id"), "lang", "source",
                    F.col("quality").alias("y_true"),
                    (F.col("n_chars") > CHARS_CUT).cast("int").alias("y_pred"),
                    (n / (n + F.lit(float(CHARS_CUT)))).alias("score"))


DOCS_PRED_SQL = f"""
SELECT d.doc_id AS id, d.lang, d.source, l.quality AS y_true,
       CAST(d.n_chars > {CHARS_CUT} AS INTEGER) AS y_pred,
       CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + {float(CHARS_CUT)}) AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


MODEL_FEATURES = ["o_days", "o_totalprice", "c_acctbal", "c_nationkey", "prio_num"]


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Modelling table: label = order status 'F'; numeric features; the
    sensitive groups (segment, priority) are carried but not used as
    features."""
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(
        "o_orderkey", "c_mktsegment", "o_orderpriority",
        F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).cast("double").alias("o_days"),
        F.col("o_totalprice").cast("double"), F.col("c_acctbal").cast("double"),
        F.col("c_nationkey").cast("double"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("prio_num"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"))


#: Measures of an order's lines and what is taken of each.
LINE_MEASURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
LINE_STATS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "dev": F.stddev_pop}
WIDE_FEATURES = MODEL_FEATURES + ["n_lines"] + [f"{m}_{s}" for m in LINE_MEASURES for s in LINE_STATS]


def wide_table(spark: SparkSession, sf: str) -> DataFrame:
    """The modelling table with 21 measures of each order's lines: 26 features."""
    lines = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        *[stat(F.col(c).cast("double")).alias(f"{m}_{s}") for m, c in LINE_MEASURES.items() for s, stat in LINE_STATS.items()])
    return model_table(spark, sf).join(lines, "o_orderkey")

"""Catalogue: profile (A2, A3, B1, B2), IQR cleaning (C1-C4), features
(D2-D12) and encoding (E1-E3) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityframe.functions import features as fe
from parityframe.functions.metric_exprs import round_doubles
from parityframe.operators import clean, encode, profile
from parityframe.plans.catalog import register
from parityframe.sources.io import read_table

# ---------------------------------------------------------------- profile
_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def _docs_left_labels(spark, sf):
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(*_DOC_COLS)


@register("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls "
    f"FROM (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
    for c in _DOC_COLS))
def q_null_profile(spark, sf):
    return profile.null_counts(_docs_left_labels(spark, sf))


_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("duplicate_rows", f"""SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(_LI_COLS)})""")
def q_duplicate_rows(spark, sf):
    return profile.duplicate_count(read_table(spark, sf, "lineitem"))


@register("duplicate_rows_projected", """SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity)""")
def q_duplicate_rows_projected(spark, sf):
    return profile.duplicate_count(read_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@register("shape", "SELECT CAST(count(*) AS BIGINT) AS n_rows, 6 AS n_columns FROM orders")
def q_shape(spark, sf):
    return profile.shape(read_table(spark, sf, "orders"))


@register("preview", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
       o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5""")
def q_preview(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return profile.preview(o, ["o_orderkey"], 5)


# ------------------------------------------------------------------ IQR
def _fence_sql(src: str, col: str) -> str:
    q1 = f"(SELECT quantile_cont({col}, 0.25) FROM {src} WHERE NOT isnan({col}))"
    q3 = f"(SELECT quantile_cont({col}, 0.75) FROM {src} WHERE NOT isnan({col}))"
    return (f"SELECT * FROM {src} WHERE {col} >= {q1} - 1.5 * ({q3} - {q1}) "
            f"AND {col} <= {q3} + 1.5 * ({q3} - {q1})")


def _chain_sql(table: str, cols: list[str], out_cols: str) -> str:
    ctes, src = [], table
    for i, c in enumerate(cols):
        ctes.append(f"t{i} AS MATERIALIZED ({_fence_sql(src, f'CAST({c} AS DOUBLE)')})")
        src = f"t{i}"
    return f"WITH {', '.join(ctes)} SELECT {out_cols} FROM {src}"


@register("iqr_single", _chain_sql("events", ["value"], "event_id, user_id, value"))
def q_iqr_single(spark, sf):
    out, _ = clean.iqr_filter(read_table(spark, sf, "events"), "value")
    return out.select("event_id", "user_id", "value")


_SEQ = ["value", "user_id", "value"]


@register("iqr_sequential", _chain_sql("events", _SEQ, "event_id, user_id, value"))
def q_iqr_sequential(spark, sf):
    out, _ = clean.iqr_sequential(read_table(spark, sf, "events"), _SEQ)
    return out.select("event_id", "user_id", "value")


@register("iqr_sequential_refine", _chain_sql("events", _SEQ, "event_id, user_id, value"))
def q_iqr_sequential_refine(spark, sf):
    """C2 with a low ``gather``, so that the histogram narrowing runs at test scale too."""
    out, _ = clean.iqr_sequential(read_table(spark, sf, "events"), _SEQ, gather=500)
    return out.select("event_id", "user_id", "value")


# The reference's literal first pass over every numeric column, then a
# second pass over named measures with recomputed fences.
# Events have outliers (value), and a length per event gives a second column.
_EV_SQL = "(SELECT event_id, user_id, value, value * value AS power FROM events)"
_EV_NUM = ["event_id", "user_id", "value", "power"]


def _events_power(spark, sf):
    return read_table(spark, sf, "events").select("event_id", "user_id", "value", (F.col("value") * F.col("value")).alias("power"))


@register("iqr_two_pass", _chain_sql(_EV_SQL, _EV_NUM + ["value", "power"], "event_id, user_id, value"))
def q_iqr_two_pass(spark, sf):
    ev = _events_power(spark, sf)
    first = clean.default_iqr_columns(ev, columns="all")
    out, _ = clean.iqr_sequential(ev, first + ["value", "power"])
    return out.select("event_id", "user_id", "value")


_ONE = ["user_id", "value", "power"]


def _one_shot_sql():
    conds = []
    for c in _ONE:
        q1 = f"(SELECT quantile_cont({c}, 0.25) FROM {_EV_SQL})"
        q3 = f"(SELECT quantile_cont({c}, 0.75) FROM {_EV_SQL})"
        conds.append(f"{c} BETWEEN {q1} - 1.5 * ({q3} - {q1}) AND {q3} + 1.5 * ({q3} - {q1})")
    return f"SELECT event_id, user_id, value FROM {_EV_SQL} WHERE {' AND '.join(conds)}"


@register("iqr_one_shot", _one_shot_sql())
def q_iqr_one_shot(spark, sf):
    out, _ = clean.iqr_one_shot(_events_power(spark, sf), _ONE)
    return out.select("event_id", "user_id", "value")


@register("iqr_fences", """WITH t0 AS MATERIALIZED (SELECT * FROM events),
f0 AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM t0),
t1 AS MATERIALIZED (SELECT t0.* FROM t0, f0 WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
f1 AS (SELECT quantile_cont(CAST(user_id AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(user_id AS DOUBLE), 0.75) AS q3 FROM t1)
SELECT 0 AS step, 'value' AS column, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3,
       ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower, ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper FROM f0
UNION ALL SELECT 1, 'user_id', ROUND(q1, 6), ROUND(q3, 6), ROUND(q1 - 1.5 * (q3 - q1), 6), ROUND(q3 + 1.5 * (q3 - q1), 6) FROM f1""")
def q_iqr_fences(spark, sf):
    """The fitted fences of C2 as a table (what the reference prints)."""
    _, fences = clean.iqr_sequential(read_table(spark, sf, "events"), ["value", "user_id"])
    rows = [(i, f.column, f.q1, f.q3, f.lower, f.upper) for i, f in enumerate(fences)]
    return round_doubles(spark.createDataFrame(
        rows, "step int, column string, q1 double, q3 double, lower double, upper double"))


# ---------------------------------------------------------------- features
@register("feat_log_sqrt", """SELECT c_custkey,
  ROUND(CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END, 6) AS log_acctbal,
  ROUND(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS sqrt_acctbal FROM customer""")
def q_feat_log_sqrt(spark, sf):
    c = read_table(spark, sf, "customer")
    return round_doubles(fe.apply_features(c, {"log_acctbal": fe.safe_log1p("c_acctbal"),
                                               "sqrt_acctbal": fe.safe_sqrt("c_acctbal")})
                         .select("c_custkey", "log_acctbal", "sqrt_acctbal"))


@register("feat_ratio", """SELECT l_orderkey, l_linenumber, l_partkey,
  ROUND(l_extendedprice / NULLIF(l_tax, 0), 6) AS price_per_tax,
  ROUND(l_discount / NULLIF(l_tax, 0), 6) AS discount_tax,
  ROUND(l_quantity / NULLIF(l_discount, 0), 6) AS qty_per_discount FROM lineitem""")
def q_feat_ratio(spark, sf):
    li = read_table(spark, sf, "lineitem")
    spec = {"price_per_tax": fe.safe_ratio("l_extendedprice", "l_tax"),
            "discount_tax": fe.safe_ratio("l_discount", "l_tax"),
            "qty_per_discount": fe.safe_ratio("l_quantity", "l_discount")}
    return round_doubles(fe.apply_features(li, spec).select("l_orderkey", "l_linenumber", "l_partkey", *spec))


_FLAGS = {"f_return": "l_returnflag = 'R'", "f_open": "l_linestatus = 'O'", "f_nodisc": "l_discount = 0",
          "f_notax": "l_tax = 0", "f_bulk": "l_quantity > 40", "f_pricey": "l_extendedprice > 50000"}


@register("feat_scores", f"""SELECT l_orderkey, l_linenumber, l_partkey,
  CAST({_FLAGS['f_return']} AS INTEGER) + CAST({_FLAGS['f_open']} AS INTEGER) AS pair_score,
  {' + '.join(f'CAST({v} AS INTEGER)' for v in _FLAGS.values())} AS risk_score FROM lineitem""")
def q_feat_scores(spark, sf):
    li = read_table(spark, sf, "lineitem")
    flags = {k: F.expr(v).cast("int") for k, v in _FLAGS.items()}
    li = li.withColumns(flags)
    out = fe.apply_features(li, {"pair_score": fe.additive_score(["f_return", "f_open"]),
                                 "risk_score": fe.additive_score(list(_FLAGS))})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "pair_score", "risk_score")


@register("feat_interaction", """WITH s AS (SELECT DISTINCT o_orderstatus AS v FROM orders),
p AS (SELECT DISTINCT o_orderpriority AS v FROM orders),
sc AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM s),
pc AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM p)
SELECT o.o_orderkey, sc.code AS o_orderstatus, pc.code AS o_orderpriority, sc.code * pc.code AS status_x_priority
FROM orders o JOIN sc ON o.o_orderstatus = sc.v JOIN pc ON o.o_orderpriority = pc.v""")
def q_feat_interaction(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    enc = encode.fit_label_encoder(o, ["o_orderstatus", "o_orderpriority"])
    coded = encode.apply_label_encoder(o, enc)
    return fe.apply_features(coded, {"status_x_priority": fe.interaction("o_orderstatus", "o_orderpriority")})


@register("feat_group_delta", """SELECT c_custkey, c_nationkey,
  ROUND(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS Delta_c_acctbal FROM customer""")
def q_feat_group_delta(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return round_doubles(fe.group_mean_delta(c, ["c_acctbal"], "c_nationkey").drop("c_acctbal"))


@register("delta_missing", """WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)
SELECT c_custkey, c_nationkey, ROUND(v - avg(v) OVER (PARTITION BY c_nationkey), 6) AS Delta_v FROM c""")
def q_delta_missing(spark, sf):
    """A NaN is missing: it gets no delta and leaves its group's mean alone."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(
        F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("v"))
    return round_doubles(fe.group_mean_delta(c, ["v"], "c_nationkey").drop("v"))


@register("feat_spec", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  CAST(l.l_returnflag = 'R' AS INTEGER) + CAST(l.l_linestatus = 'O' AS INTEGER) AS flag_score,
  ROUND(CASE WHEN l.l_extendedprice > -1 THEN ln(1 + l.l_extendedprice) END, 6) AS log_price,
  ROUND(CASE WHEN l.l_quantity >= 0 THEN sqrt(l.l_quantity) END, 6) AS sqrt_qty,
  ROUND(l.l_extendedprice / NULLIF(o.o_totalprice, 0), 6) AS share_of_order,
  ROUND(o.o_totalprice / NULLIF(l.l_quantity, 0), 6) AS order_per_qty,
  CAST(l.l_discount > 0.05 AS INTEGER) AS cls
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def q_feat_spec(spark, sf):
    """One declarative spec of D2-D10 features, one projection."""
    li = read_table(spark, sf, "lineitem")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    spec = {
        "flag_score": fe.additive_score([(F.col("l_returnflag") == "R").cast("int"),
                                         (F.col("l_linestatus") == "O").cast("int")]),
        "log_price": fe.safe_log1p("l_extendedprice"),
        "sqrt_qty": fe.safe_sqrt("l_quantity"),
        "share_of_order": fe.safe_ratio("l_extendedprice", "o_totalprice"),
        "order_per_qty": fe.safe_ratio("o_totalprice", "l_quantity"),
        "cls": fe.threshold_class("l_discount", 0.05),
    }
    return round_doubles(fe.apply_features(j, spec).select("l_orderkey", "l_linenumber", "l_partkey", *spec))


# ---------------------------------------------------------------- encoding
_ENC_SQL = """SELECT "column", value, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT 'p_type' AS column, p_type AS value FROM part WHERE p_type IS NOT NULL
      UNION SELECT DISTINCT 'p_brand', p_brand FROM part WHERE p_brand IS NOT NULL)"""


@register("encode_fit", _ENC_SQL)
def q_encode_fit(spark, sf):
    return encode.fit_label_encoder(read_table(spark, sf, "part"), ["p_type", "p_brand"]).mapping


@register("encode_apply", f"""WITH m AS ({_ENC_SQL})
SELECT p.p_partkey, t.code AS p_type, b.code AS p_brand, p.p_size FROM part p
JOIN m t ON t."column" = 'p_type' AND t.value = p.p_type
JOIN m b ON b."column" = 'p_brand' AND b.value = p.p_brand""")
def q_encode_apply(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    enc = encode.fit_label_encoder(part, ["p_type", "p_brand"])
    return encode.apply_label_encoder(part, enc)


@register("encode_roundtrip", "SELECT p_partkey, p_type, p_brand FROM part")
def q_encode_roundtrip(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    enc = encode.fit_label_encoder(part, ["p_type", "p_brand"])
    return encode.decode_columns(encode.apply_label_encoder(part, enc), enc.mapping, ["p_type", "p_brand"])


@register("encode_all_strings", """SELECT "column", value, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT 'c_mktsegment' AS column, c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL
      UNION SELECT DISTINCT 'c_name', c_name FROM customer WHERE c_name IS NOT NULL)""")
def q_encode_all_strings(spark, sf):
    """E2 over every string column chosen by type."""
    c = read_table(spark, sf, "customer")
    return encode.fit_label_encoder(c, profile.columns_of_type(c, ["string"])).mapping


# ------------------------------------------------------------ sources/sinks
def _scratch(spark, name):
    import os
    import uuid
    from parityframe.session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_csv_scan(spark, sf):
    """A1: a header CSV read back with a declared schema (the table is first
    written as CSV into the shared scratch folder)."""
    from parityframe.sources.io import read_csv
    c = read_table(spark, sf, "customer")
    path = _scratch(spark, "csv")
    c.write.mode("overwrite").option("header", True).csv(path)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return read_csv(spark, path, schema=schema)


@register("artifact_roundtrip", """WITH s AS (SELECT lang, count(*) AS n, avg(n_chars) AS mean_chars FROM documents GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, ROUND(mean_chars, 6) AS mean_chars FROM s""")
def q_artifact_roundtrip(spark, sf):
    """A4: a result table written as Parquet and read back."""
    from parityframe.sources.io import write_artifact
    d = read_table(spark, sf, "documents")
    t = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))
    path = _scratch(spark, "artifact")
    write_artifact(t, path)
    return round_doubles(spark.read.parquet(path))


@register("iqr_approx")
def q_iqr_approx(spark, sf):
    """C1 with approximate quantiles (``percentile_approx``): cheaper, but
    fences can differ slightly from the exact ones, so no oracle."""
    out, _ = clean.iqr_sequential(read_table(spark, sf, "events"), _SEQ, method="approx")
    return out.select("event_id", "user_id", "value")

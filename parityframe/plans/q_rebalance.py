"""Catalogue: splits, folds, scaling (H1-H3) and rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityframe.functions.metric_exprs import round_doubles
from parityframe.operators import rebalance as rb
from parityframe.operators import split as sp
from parityframe.operators.neighbors import knn_same_class
from parityframe.plans.catalog import register
from parityframe.plans.sqlkit import hash32_sql
from parityframe.plans.tables import DOCS_LABELED_SQL, docs_labeled
from parityframe.sources.io import read_table
from parityframe.session import checkpoint as _ckpt

H = hash32_sql


# ------------------------------------------------------------------ H1-H3
_SPLIT_SQL = f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {H(42, 'o_orderkey')}, o_orderkey)
  <= CEIL(0.2 * (SELECT count(*) FROM orders)) THEN 'test' ELSE 'train' END AS split FROM orders"""


@register("split_exact", _SPLIT_SQL)
def q_split_exact(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return sp.train_test_split(o, ["o_orderkey"], 0.2)


@register("split_bernoulli", f"""SELECT o_orderkey, CASE WHEN {H(42, 'o_orderkey')} / 4294967296.0 < 0.2
  THEN 'test' ELSE 'train' END AS split FROM orders""")
def q_split_bernoulli(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return sp.train_test_split(o, ["o_orderkey"], 0.2, mode="bernoulli")


@register("folds_stratified", f"""SELECT doc_id, quality,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY {H('42|fold', 'doc_id')}, doc_id) * 5 + count(*) OVER (PARTITION BY quality) - 1)
    // count(*) OVER (PARTITION BY quality) - 1 AS INTEGER) AS fold
FROM ({DOCS_LABELED_SQL})""")
def q_folds(spark, sf):
    d = docs_labeled(spark, sf).select("doc_id", "quality")
    return sp.stratified_folds(d, "quality", ["doc_id"], k=5)


@register("minmax_scale", f"""WITH s AS ({_SPLIT_SQL}),
j AS (SELECT o.o_orderkey, s.split, o.o_totalprice, o.o_custkey FROM orders o JOIN s ON o.o_orderkey = s.o_orderkey),
b AS (SELECT min(o_totalprice) AS p0, max(o_totalprice) AS p1, min(o_custkey) AS c0, max(o_custkey) AS c1 FROM j WHERE split = 'train')
SELECT o_orderkey, split, ROUND((o_totalprice - p0) / (p1 - p0), 6) AS o_totalprice_s,
       ROUND((o_custkey - c0) / CAST(c1 - c0 AS DOUBLE), 6) AS o_custkey_s, 0.0::DOUBLE AS const_s FROM j, b""")
def q_minmax(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey").withColumn("const", F.lit(7))
    s = sp.train_test_split(o, ["o_orderkey"], 0.2)
    s = s.transform(_ckpt)
    mm = sp.fit_minmax(sp.split_where(s, "train"), ["o_totalprice", "o_custkey", "const"])
    out = mm.apply(s, suffix="_s")
    return round_doubles(out.select("o_orderkey", "split", "o_totalprice_s", "o_custkey_s", "const_s"))


@register("minmax_missing", """WITH v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
b AS (SELECT min(value) AS lo, max(value) AS hi FROM v)
SELECT event_id, ROUND((value - lo) / (hi - lo), 6) AS value_s FROM v, b""")
def q_minmax_missing(spark, sf):
    """Every seventh value NULL or NaN: neither may become a bound."""
    gap = F.when(F.col("event_id") % 14 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit(float("nan")))
    e = read_table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, gap)
                                               .otherwise(F.col("value")).alias("value"))
    return round_doubles(sp.fit_minmax(e, ["value"]).apply(e, suffix="_s").select("event_id", "value_s"))


# ------------------------------------------------------------------ I1-I4
@register("smote_need", """SELECT label, CAST(count(*) AS BIGINT) AS n,
  CAST(max(count(*)) OVER () - count(*) AS BIGINT) AS need FROM embeddings GROUP BY label""")
def q_smote_need(spark, sf):
    return rb.smote_need(read_table(spark, sf, "embeddings"), "label")


def _knn_sql(src: str, key: str, label: str, dist2: str, k: int = 5, where: str = "") -> str:
    return f"""p AS ({src}),
pairs AS (SELECT a.{key} AS qk, a.{label} AS lbl, b.{key} AS pk, {dist2} AS d2
          FROM p a JOIN p b ON a.{label} = b.{label} AND a.{key} <> b.{key} {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY d2, pk) AS nb_rank FROM pairs)"""


_EMB_D2 = ("list_reduce(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), "
           "lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)")


@register("smote_neighbors", f"""WITH {_knn_sql('SELECT vec_id, label, embedding FROM embeddings', 'vec_id', 'label', _EMB_D2)}
SELECT qk AS vec_id, lbl AS label, CAST(nb_rank AS INTEGER) AS nb_rank, pk AS nb_key, ROUND(sqrt(d2), 6) AS dist
FROM r WHERE nb_rank <= 5""")
def q_smote_neighbors(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return round_doubles(knn_same_class(e, "vec_id", "label", "embedding", k=5))


_DOC_D2 = ("(CAST(a.n_chars AS DOUBLE) - CAST(b.n_chars AS DOUBLE)) * (CAST(a.n_chars AS DOUBLE) - CAST(b.n_chars AS DOUBLE)) "
           "+ (CAST(a.toxic AS DOUBLE) - CAST(b.toxic AS DOUBLE)) * (CAST(a.toxic AS DOUBLE) - CAST(b.toxic AS DOUBLE))")


@register("smote_neighbors_docs", f"""WITH {_knn_sql(f'SELECT doc_id, quality, n_chars, toxic FROM ({DOCS_LABELED_SQL})', 'doc_id', 'quality', _DOC_D2)}
SELECT qk AS doc_id, lbl AS quality, CAST(nb_rank AS INTEGER) AS nb_rank, pk AS nb_key, ROUND(sqrt(d2), 6) AS dist
FROM r WHERE nb_rank <= 5""")
def q_smote_neighbors_docs(spark, sf):
    """Low-dimensional case with small cells, so that both rounds matter."""
    d = docs_labeled(spark, sf)
    return round_doubles(knn_same_class(d, "doc_id", "quality", ["n_chars", "toxic"], k=5, cell_rows=16))


_FLAGS = {"f_a": "c_custkey % 2", "f_b": "c_custkey % 3", "f_c": "c_custkey % 5", "f_d": "c_custkey % 7",
          "f_e": "c_nationkey % 2", "f_f": "c_nationkey % 3", "f_g": "CAST(c_mktsegment = 'BUILDING' AS INTEGER)",
          "f_h": "CAST(c_mktsegment = 'MACHINERY' AS INTEGER)", "f_i": "CAST(c_acctbal < 0 AS INTEGER)",
          "f_j": "CAST(floor(c_acctbal / 1000) AS INTEGER)", "f_k": "CAST(floor(c_acctbal / 5000) AS INTEGER)"}
_FLAGS_SQL = ("SELECT c_custkey, c_nationkey % 4 AS cls, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _FLAGS.items())
              + " FROM customer")
_FLAGS_D2 = " + ".join(f"(a.{n} - b.{n}) * (a.{n} - b.{n})" for n in _FLAGS)


@register("smote_neighbors_flags", f"""WITH {_knn_sql(_FLAGS_SQL, 'c_custkey', 'cls', _FLAGS_D2)}
SELECT qk AS c_custkey, lbl AS cls, CAST(nb_rank AS INTEGER) AS nb_rank, pk AS nb_key, ROUND(sqrt(d2), 6) AS dist
FROM r WHERE nb_rank <= 5""")
def q_smote_neighbors_flags(spark, sf):
    """Eleven flags and codes: equal vectors, many ties."""
    c = read_table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_nationkey % 4 AS cls", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in _FLAGS.items()])
    return round_doubles(knn_same_class(c, "c_custkey", "cls", list(_FLAGS), k=5, cell_rows=32))


_SMOTE_SQL = f"""WITH pts AS (SELECT doc_id, quality, n_chars, toxic FROM ({DOCS_LABELED_SQL})),
cnt AS (SELECT quality, count(*) AS n FROM pts GROUP BY quality),
need AS (SELECT quality, n, max(n) OVER () - n AS need, LEAST(5, n - 1) AS keff FROM cnt),
slots AS (SELECT quality, n, keff, unnest(range(1, need + 1)) AS slot FROM need WHERE need > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {H('42|rank', 'doc_id')}, doc_id) AS rn FROM pts),
dr AS (SELECT quality, slot, ({H('42|base', 'quality', 'slot')} % n) + 1 AS rn,
              ({H('42|nb', 'quality', 'slot')} % keff) + 1 AS nb,
              {H('42|u', 'quality', 'slot')} / 4294967296.0 AS u FROM slots),
base AS (SELECT dr.*, r.doc_id AS base_key, r.n_chars AS b_n, r.toxic AS b_t
         FROM dr JOIN ranked r ON r.quality = dr.quality AND r.rn = dr.rn),
pairs AS (SELECT a.doc_id AS qk, b.doc_id AS pk,
                 row_number() OVER (PARTITION BY a.doc_id ORDER BY {_DOC_D2}, b.doc_id) AS nb_rank
          FROM pts a JOIN pts b ON a.quality = b.quality AND a.doc_id <> b.doc_id),
j AS (SELECT base.*, pairs.pk AS nb_key FROM base JOIN pairs ON pairs.qk = base.base_key AND pairs.nb_rank = base.nb),
f AS (SELECT j.*, p.n_chars AS nb_n, p.toxic AS nb_t FROM j JOIN pts p ON p.doc_id = j.nb_key)
SELECT quality, slot, base_key, nb_key,
  CAST(trunc(CAST(b_n AS DOUBLE) + u * (CAST(nb_n AS DOUBLE) - CAST(b_n AS DOUBLE))) AS BIGINT) AS n_chars,
  CAST(trunc(CAST(b_t AS DOUBLE) + u * (CAST(nb_t AS DOUBLE) - CAST(b_t AS DOUBLE))) AS INTEGER) AS toxic
FROM f"""


@register("smote", _SMOTE_SQL)
def q_smote(spark, sf):
    d = docs_labeled(spark, sf).select("doc_id", "quality", "n_chars", "toxic")
    out = rb.smote(d, "doc_id", "quality", ["n_chars", "toxic"], k=5)
    return out.where("synthetic").select("quality", "slot", "base_key", "nb_key", "n_chars", "toxic")


@register("smote_counts", f"""WITH pts AS (SELECT quality FROM ({DOCS_LABELED_SQL}))
SELECT quality, CAST(max(count(*)) OVER () AS BIGINT) AS n FROM pts GROUP BY quality""")
def q_smote_counts(spark, sf):
    """After SMOTE every class has the majority count."""
    d = docs_labeled(spark, sf).select("doc_id", "quality", "n_chars", "toxic")
    return rb.smote(d, "doc_id", "quality", ["n_chars", "toxic"], k=5).groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ I5-I7
def _boot_sql(groups: list[str], src: str | None = None) -> str:
    src = src or f"SELECT doc_id, lang, source, n_chars, quality, toxic FROM ({DOCS_LABELED_SQL})"
    g = ", ".join(groups)
    on = " AND ".join(f"x.{c} = c.{c}" for c in groups)
    on2 = " AND ".join(f"d.{c} = s.{c}" for c in groups) + " AND d.rn = s.rn"
    nn = " AND ".join(f"{c} IS NOT NULL" for c in groups)
    return f"""WITH x0 AS (SELECT * FROM ({src}) WHERE {nn}),
c AS (SELECT {g}, count_if(quality = 1) AS npos, count_if(quality = 0) AS nneg FROM x0 GROUP BY ALL
      HAVING count_if(quality = 1) > 0 AND count_if(quality = 0) > 0),
x AS (SELECT x0.*, CASE WHEN c.npos < c.nneg THEN 1 ELSE 0 END AS small,
             CASE WHEN c.npos < c.nneg THEN c.npos ELSE c.nneg END AS nsmall
      FROM x0 JOIN c ON {on.replace('x.', 'x0.')}),
s AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {H(42, 'doc_id')}, doc_id) AS rn FROM x WHERE quality = small),
d AS (SELECT {g}, ({H('42|pick', *groups, 'doc_id')} % nsmall) + 1 AS rn FROM x WHERE quality <> small)
SELECT doc_id, lang, source, n_chars, quality, toxic FROM x WHERE quality <> small
UNION ALL SELECT s.doc_id, s.lang, s.source, s.n_chars, s.quality, s.toxic FROM d JOIN s ON {on2}"""


def _docs6(spark, sf):
    return docs_labeled(spark, sf).select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


@register("group_bootstrap", _boot_sql(["lang"]))
def q_group_bootstrap(spark, sf):
    return rb.group_bootstrap(_docs6(spark, sf), ["lang"], "quality", ["doc_id"])


_THIRD = f"""SELECT doc_id, lang, source, n_chars, quality, toxic FROM (SELECT * EXCLUDE (quality),
  CASE WHEN doc_id % 9 = 0 THEN 2 ELSE quality END AS quality FROM ({DOCS_LABELED_SQL}))"""


@register("bootstrap_extra_label", _boot_sql(["lang"], _THIRD + " WHERE quality < 2"))
def q_bootstrap_extra_label(spark, sf):
    """Rows of a third label belong to neither class and go."""
    d = _docs6(spark, sf).withColumn("quality", F.when(F.col("doc_id") % 9 == 0, F.lit(2)).otherwise(F.col("quality")))
    return rb.group_bootstrap(d, ["lang"], "quality", ["doc_id"])


@register("group_bootstrap_2attr", _boot_sql(["lang", "source"]))
def q_group_bootstrap2(spark, sf):
    return rb.group_bootstrap(_docs6(spark, sf), ["lang", "source"], "quality", ["doc_id"])


@register("group_balance", f"""WITH b AS ({_boot_sql(['lang', 'source'])}),
x AS (SELECT * FROM ({DOCS_LABELED_SQL}) WHERE lang IS NOT NULL AND source IS NOT NULL),
nb AS (SELECT lang, source, quality, count(*) AS n FROM x GROUP BY ALL),
na AS (SELECT lang, source, quality, count(*) AS n FROM b GROUP BY ALL)
SELECT nb.lang, nb.source, nb.quality, CAST(nb.n AS BIGINT) AS n_before, CAST(COALESCE(na.n, 0) AS BIGINT) AS n_after,
       CASE WHEN na.n IS NULL THEN 'dropped' ELSE 'kept' END AS status
FROM nb LEFT JOIN na ON nb.lang = na.lang AND nb.source = na.source AND nb.quality = na.quality""")
def q_group_balance(spark, sf):
    d = _docs6(spark, sf)
    after = rb.group_bootstrap(d, ["lang", "source"], "quality", ["doc_id"])
    return rb.balance_report(d, after, ["lang", "source"], "quality")


@register("sample_with_replacement", f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {H(42, 'doc_id')}, doc_id) AS rn FROM labels),
n AS (SELECT count(*) AS n FROM labels),
s AS (SELECT unnest(range(1, n + 1)) AS slot FROM n)
SELECT s.slot AS __slot, r.doc_id, r.quality, r.toxic FROM s JOIN n ON true JOIN r ON r.rn = ({H('42|pick', 's.slot')} % n.n) + 1""")
def q_sample_with_replacement(spark, sf):
    lab = read_table(spark, sf, "labels")
    return rb.sample_with_replacement(lab, lab.count(), ["doc_id"])


_TRAIN_SQL = f"""SELECT doc_id, lang, source, n_chars, quality, toxic FROM (
  SELECT *, row_number() OVER (ORDER BY {H(42, 'doc_id')}, doc_id) AS rn, count(*) OVER () AS n
  FROM ({DOCS_LABELED_SQL})) WHERE rn > CEIL(0.2 * n)"""


@register("rebalance_train_only", _boot_sql(["lang"], _TRAIN_SQL))
def q_rebalance_train_only(spark, sf):
    """Flow order of 3.3 without the reference's leak: exact split first
    (H1), then group bootstrap (I5) of the training part only."""
    from parityframe.plans.flows import split_and_rebalance
    train, _ = split_and_rebalance(_docs6(spark, sf), "doc_id", "quality", [], ["lang"])
    return train

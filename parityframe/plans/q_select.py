"""Catalogue: correlation and closed-form selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityframe.functions.metric_exprs import round_doubles
from parityframe.operators import select as sx
from parityframe.operators.split import stratified_folds
from parityframe.plans.catalog import register
from parityframe.plans.sqlkit import hash32_sql
from parityframe.plans.tables import DOCS_LABELED_SQL, docs_labeled
from parityframe.sources.io import read_table

_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "price_copy", "const_one"]


def _li_orders(spark, sf):
    li = read_table(spark, sf, "lineitem")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.withColumns({"price_copy": F.col("l_extendedprice") * 2 + 1, "const_one": F.lit(1.0),
                          "y": (F.col("o_orderstatus") == "F").cast("int")})


_LO_SQL = """SELECT l.*, o.o_totalprice, l.l_extendedprice * 2 + 1 AS price_copy, 1.0::DOUBLE AS const_one,
       CAST(o.o_orderstatus = 'F' AS INTEGER) AS y FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""


def _corr_sql():
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for j in range(i + 1, len(_CORR_COLS)):
            b = _CORR_COLS[j]
            r = (f"covar_pop({a}, {b}) / NULLIF(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
                 f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS pos_a, {j} AS pos_b, ROUND({r}, 6) AS r, "
                         f"ROUND(abs({r}), 6) AS abs_r FROM lo")
    return f"WITH lo AS ({_LO_SQL}) " + " UNION ALL ".join(parts)


@register("corr_matrix", _corr_sql())
def q_corr_matrix(spark, sf):
    return round_doubles(sx.corr_matrix(_li_orders(spark, sf), _CORR_COLS))


@register("corr_prune", f"""WITH c AS ({_corr_sql()})
SELECT col_b AS "column", pos_b AS pos, max(abs_r) AS max_abs_r FROM c
WHERE abs_r >= 0.7 AND col_b NOT IN ('l_quantity', 'l_extendedprice') GROUP BY ALL""")
def q_corr_prune(spark, sf):
    c = sx.corr_matrix(_li_orders(spark, sf), _CORR_COLS)
    return round_doubles(sx.corr_prune(c, 0.7, protected=["l_quantity", "l_extendedprice"]))


def _prune_sql(extra):
    return f"""WITH c AS ({_corr_sql()}) SELECT col_b AS "column", pos_b AS pos, max(abs_r) AS max_abs_r FROM c
WHERE abs_r >= 0.7 {extra} GROUP BY ALL"""


@register("corr_prune_literal", _prune_sql(""))
def q_corr_prune_literal(spark, sf):
    """The reference's loop to the letter: every column can go."""
    c = sx.corr_matrix(_li_orders(spark, sf), _CORR_COLS)
    return round_doubles(sx.corr_prune(c, 0.7, id_cols=["l_quantity"], sensitive=["price_copy"], literal=True))


@register("corr_prune_guarded", _prune_sql("AND col_b <> 'l_extendedprice' AND 'l_quantity' NOT IN (col_a, col_b)"))
def q_corr_prune_guarded(spark, sf):
    """Ids and label out of the comparison, sensitive columns protected."""
    c = sx.corr_matrix(_li_orders(spark, sf), _CORR_COLS)
    return round_doubles(sx.corr_prune(c, 0.7, id_cols=["l_quantity"], label="y", sensitive=["l_extendedprice"]))


_CHI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _chi2_sql(src: str, feats: list[str], label: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    sums = ", ".join(f"sum(CAST({f} AS DOUBLE)) AS s{i}" for i, f in enumerate(feats))
    terms = ", ".join(
        f"power(s{i} - (CAST(n AS DOUBLE) / sum(n) OVER ({part})) * sum(s{i}) OVER ({part}), 2) / "
        f"NULLIF((CAST(n AS DOUBLE) / sum(n) OVER ({part})) * sum(s{i}) OVER ({part}), 0) AS t{i}"
        for i in range(len(feats)))
    per = f"SELECT {k}{label} AS cls, count(*) AS n, {sums} FROM {src} GROUP BY ALL"
    unions = " UNION ALL ".join(f"SELECT {k}'{f}' AS feature, {i} AS pos, sum(t{i}) AS score FROM tt GROUP BY ALL"
                                if keys else f"SELECT '{f}' AS feature, {i} AS pos, sum(t{i}) AS score FROM tt"
                                for i, f in enumerate(feats))
    return f"per AS ({per}), tt AS (SELECT {k}{terms} FROM per), sc AS ({unions})"


@register("chi2_scores", f"WITH lo AS ({_LO_SQL}), {_chi2_sql('lo', _CHI, 'y')} "
                         "SELECT feature, pos, ROUND(score, 6) AS score FROM sc")
def q_chi2(spark, sf):
    return round_doubles(sx.chi2_scores(_li_orders(spark, sf), _CHI, "y"))


@register("select_k_best", f"""WITH lo AS ({_LO_SQL}), {_chi2_sql('lo', _CHI, 'y')},
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, pos DESC) AS rk FROM sc)
SELECT feature, pos, ROUND(score, 6) AS score FROM r WHERE rk <= 2""")
def q_select_k_best(spark, sf):
    return round_doubles(sx.select_k_best(sx.chi2_scores(_li_orders(spark, sf), _CHI, "y"), 2))


_RFE = ["n_chars", "toxic", "is_en"]


def _docs_folds(spark, sf):
    d = docs_labeled(spark, sf).withColumn("is_en", (F.col("lang") == "en").cast("int"))
    return stratified_folds(d, "quality", ["doc_id"], k=5)


_FOLDS_SQL = f"""SELECT *, CAST(lang = 'en' AS INTEGER) AS is_en,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY {hash32_sql('42|fold', 'doc_id')}, doc_id) * 5 + count(*) OVER (PARTITION BY quality) - 1)
    // count(*) OVER (PARTITION BY quality) - 1 AS INTEGER) AS fold
FROM ({DOCS_LABELED_SQL})"""


def _rfe_sql():
    sums = ", ".join(f"sum(CAST({f} AS DOUBLE)) AS s{i}" for i, f in enumerate(_RFE))
    train = ", ".join(f"sum(s{i}) OVER (PARTITION BY cls) - s{i} AS s{i}" for i in range(len(_RFE)))
    terms = ", ".join(
        f"power(s{i} - (CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY fold)) * sum(s{i}) OVER (PARTITION BY fold), 2) / "
        f"NULLIF((CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY fold)) * sum(s{i}) OVER (PARTITION BY fold), 0) AS t{i}"
        for i in range(len(_RFE)))
    unions = " UNION ALL ".join(f"SELECT fold, '{f}' AS feature, {i} AS pos, sum(t{i}) AS score FROM tt GROUP BY fold"
                                for i, f in enumerate(_RFE))
    return f"""WITH f AS ({_FOLDS_SQL}),
per AS (SELECT fold, quality AS cls, count(*) AS n, {sums} FROM f GROUP BY ALL),
tr AS (SELECT fold, cls, sum(n) OVER (PARTITION BY cls) - n AS n, {train} FROM per),
tt AS (SELECT fold, {terms} FROM tr),
sc AS ({unions})
SELECT fold, feature, pos, ROUND(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY fold ORDER BY score DESC NULLS LAST, pos DESC) AS INTEGER) AS rank FROM sc"""


@register("closed_form_rfe", _rfe_sql())
def q_closed_form_rfe(spark, sf):
    out = sx.closed_form_rfe(_docs_folds(spark, sf), _RFE, "quality")
    return round_doubles(out.withColumn("rank", F.col("rank").cast("int")))

"""Catalogue: metrics (G*), fairness (K*), history-table operators (N11,
N13, N14) on the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from parityframe.functions.metric_exprs import balanced_accuracy, round_doubles
from parityframe.operators import fairness as fx
from parityframe.operators import metrics as mx
from parityframe.plans.catalog import register
from parityframe.plans.sqlkit import counts_sql, div, metrics_sql
from parityframe.plans.tables import DOCS_PRED_SQL, ORDERS_PRED_SQL, docs_pred, orders_pred
from parityframe.sources.io import read_table

OP = f"WITH p AS ({ORDERS_PRED_SQL})"
DP = f"WITH p AS ({DOCS_PRED_SQL})"
GROUPS = ["c_mktsegment", "o_orderpriority"]
RPT = ["n", "accuracy", "precision", "recall", "f1"]


# ------------------------------------------------------------------ G1-G6
@register("confusion", f"{OP} SELECT {counts_sql()} FROM p")
def q_confusion(spark, sf):
    return mx.confusion(orders_pred(spark, sf))


@register("summary_metrics",
          f"{OP}, c AS (SELECT {counts_sql()} FROM p) SELECT {metrics_sql(RPT)} FROM c")
def q_summary(spark, sf):
    return round_doubles(mx.summary_metrics(orders_pred(spark, sf), RPT))


@register("class_report", f"""{DP},
cm AS (SELECT y_true AS y, y_pred AS p, count(*) AS c FROM p GROUP BY 1, 2),
cls AS (SELECT y AS k FROM cm UNION SELECT p FROM cm),
per AS (
  SELECT k,
    CAST(COALESCE((SELECT sum(c) FROM cm WHERE y = k), 0) AS BIGINT) AS support,
    CAST(COALESCE((SELECT sum(c) FROM cm WHERE p = k), 0) AS BIGINT) AS pred_n,
    CAST(COALESCE((SELECT sum(c) FROM cm WHERE y = k AND p = k), 0) AS BIGINT) AS tp
  FROM cls),
m AS (
  SELECT CAST(k AS VARCHAR) AS label, {div('tp', 'pred_n', 0.0)} AS precision,
         {div('tp', 'support', 0.0)} AS recall, {div('2 * tp', 'pred_n + support', 0.0)} AS f1,
         support, tp FROM per)
SELECT label, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND({div('sum(tp)', 'sum(support)', None)}, 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', ROUND(avg(precision), 6), ROUND(avg(recall), 6), ROUND(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', ROUND(sum(precision * support) / sum(support), 6),
       ROUND(sum(recall * support) / sum(support), 6), ROUND(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM m
""")
def q_class_report(spark, sf):
    return round_doubles(mx.classification_report(docs_pred(spark, sf)))


_AUC_SQL = """
s AS (SELECT {by}score, CAST(count_if(y_true = 1) AS BIGINT) AS pos, CAST(count_if(y_true <> 1) AS BIGINT) AS neg
      FROM p GROUP BY {by}score),
c AS (SELECT *, COALESCE(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT {by}ROUND(sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM c {grp}"""


@register("roc_auc", f"{OP}, " + _AUC_SQL.format(by="", part="", grp=""))
def q_roc_auc(spark, sf):
    return round_doubles(mx.roc_auc(orders_pred(spark, sf)))


@register("roc_auc_by_group", f"{DP}, " + _AUC_SQL.format(by="lang, ", part="PARTITION BY lang ", grp="GROUP BY lang"))
def q_roc_auc_by_group(spark, sf):
    return round_doubles(mx.roc_auc(docs_pred(spark, sf), by=["lang"]))


@register("log_loss", f"""{OP}, q AS (SELECT y_true, LEAST(GREATEST(score, 1e-15), 1 - 1e-15) AS pc, score FROM p)
SELECT ROUND(-avg(y_true * ln(pc) + (1 - y_true) * ln(1 - pc)), 6) AS log_loss,
       ROUND(avg(CAST(CAST(score > 0.5 AS INTEGER) <> y_true AS DOUBLE)), 6) AS error_rate FROM q""")
def q_log_loss(spark, sf):
    return round_doubles(mx.log_loss(orders_pred(spark, sf)))


# ------------------------------------------------------------------ G7, G8
def _per_attribute_sql(attrs, metrics, base=OP):
    parts = [f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS group_value, {counts_sql()} FROM p GROUP BY {a}"
             for a in attrs]
    return f"{base}, c AS ({' UNION ALL '.join(parts)}) SELECT attribute, group_value, {metrics_sql(metrics)} FROM c"


@register("group_report", _per_attribute_sql(GROUPS, RPT))
def q_group_report(spark, sf):
    return round_doubles(mx.group_report(orders_pred(spark, sf), GROUPS))


@register("metric_frame", f"""{OP}, c AS (SELECT {', '.join(GROUPS)}, {counts_sql()} FROM p GROUP BY ALL)
SELECT {', '.join(GROUPS)}, {metrics_sql(RPT)} FROM c""")
def q_metric_frame(spark, sf):
    return round_doubles(mx.metric_frame(orders_pred(spark, sf), GROUPS, RPT))


@register("metric_frame_complete", f"""{DP},
c AS (SELECT lang, source, {counts_sql()} FROM p GROUP BY ALL),
g AS (SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM p WHERE lang IS NOT NULL) l,
                                   (SELECT DISTINCT source FROM p WHERE source IS NOT NULL) s)
SELECT g.lang, g.source, COALESCE(CAST(c.tn + c.fp + c.fn + c.tp AS BIGINT), 0) AS n,
       ROUND({div('c.tp + c.tn', 'c.tn + c.fp + c.fn + c.tp', None)}, 6) AS accuracy,
       CASE WHEN c.lang IS NOT NULL THEN ROUND({div('2 * c.tp', '2 * c.tp + c.fp + c.fn', 0.0)}, 6) END AS f1
FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source""")
def q_metric_frame_complete(spark, sf):
    fr = mx.metric_frame(docs_pred(spark, sf), ["lang", "source"], ["n", "accuracy", "f1"], complete=True)
    # Empty cells have no confusion counts: f1 is NULL there, not 0.
    fr = fr.withColumn("f1", F.when(F.col("accuracy").isNotNull(), F.col("f1")))
    return round_doubles(fr)


@register("metric_rollup", f"""{OP}, c AS (SELECT {', '.join(GROUPS)}, {counts_sql()} FROM p GROUP BY ROLLUP ({', '.join(GROUPS)}))
SELECT {', '.join(GROUPS)}, {metrics_sql(['n', 'accuracy', 'f1'])} FROM c""")
def q_metric_rollup(spark, sf):
    return round_doubles(mx.metric_frame(orders_pred(spark, sf), GROUPS, ["n", "accuracy", "f1"], levels="rollup"))


@register("custom_metric", f"""{OP}
SELECT {', '.join(GROUPS)}, CAST(count(*) AS BIGINT) AS n,
  ROUND((COALESCE(count_if(y_true = 1 AND y_pred = 1) / NULLIF(CAST(count_if(y_true = 1) AS DOUBLE), 0), 0)
       + COALESCE(count_if(y_true = 0 AND y_pred = 0) / NULLIF(CAST(count_if(y_true = 0) AS DOUBLE), 0), 0)) / 2, 6)
  AS balanced_accuracy
FROM p GROUP BY ALL""")
def q_custom_metric(spark, sf):
    return round_doubles(mx.metric_frame(orders_pred(spark, sf), GROUPS,
                                         {"n": None, "balanced_accuracy": balanced_accuracy}))


def weighted_mcc(y, p, sample_weight):
    """A user metric written for NumPy with sample weights (Matthews
    correlation), run by the G16 fallback on per-group weighted counts."""
    w = np.asarray(sample_weight, dtype=float)
    tp = w[(y == 1) & (p == 1)].sum()
    tn = w[(y != 1) & (p != 1)].sum()
    fp = w[(y != 1) & (p == 1)].sum()
    fn = w[(y == 1) & (p != 1)].sum()
    den = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return 0.0 if den == 0 else (tp * tn - fp * fn) / den


weighted_mcc.python = True


@register("custom_metric_py", f"""{OP}, c AS (SELECT {', '.join(GROUPS)}, {counts_sql()} FROM p GROUP BY ALL)
SELECT {', '.join(GROUPS)}, CAST(tn + fp + fn + tp AS BIGINT) AS n,
  ROUND(COALESCE((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
    / NULLIF(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc
FROM c""")
def q_custom_metric_py(spark, sf):
    return round_doubles(mx.metric_frame(orders_pred(spark, sf), GROUPS, {"n": None, "mcc": weighted_mcc}))


# ------------------------------------------------------------ G9-G12
@register("disadvantaged_groups", f"""{OP}, c AS (SELECT {', '.join(GROUPS)}, {counts_sql()} FROM p GROUP BY ALL),
f AS (SELECT {', '.join(GROUPS)}, {div('2 * tp', '2 * tp + fp + fn', 0.0)} AS f1 FROM c)
SELECT 'c_mktsegment=' || c_mktsegment || ', o_orderpriority=' || o_orderpriority AS "group",
       c_mktsegment, o_orderpriority, ROUND(f1, 6) AS f1, ROUND((SELECT avg(f1) FROM f), 6) AS mean_over_groups
FROM f WHERE f1 < (SELECT avg(f1) FROM f)""")
def q_disadvantaged(spark, sf):
    fr = mx.metric_frame(orders_pred(spark, sf), GROUPS, ["f1"])
    return round_doubles(fx.disadvantaged_groups(fr, GROUPS, "f1"))


@register("disadvantaged_decoded", f"""{DP},
codes AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT lang FROM p WHERE lang IS NOT NULL)),
c AS (SELECT lang, {counts_sql()} FROM p GROUP BY lang),
f AS (SELECT lang, {div('tp + tn', 'tn + fp + fn + tp', None)} AS accuracy FROM c)
SELECT 'lang=' || lang AS "group", lang, ROUND(accuracy, 6) AS accuracy,
       ROUND((SELECT avg(accuracy) FROM f), 6) AS mean_over_groups
FROM f WHERE accuracy < (SELECT avg(accuracy) FROM f)""")
def q_disadvantaged_decoded(spark, sf):
    """G9 with E2/E3: groups are integer codes during the audit and decoded
    for the report, as the reference does."""
    from parityframe.operators.encode import apply_label_encoder, fit_label_encoder
    pred = docs_pred(spark, sf)
    enc = fit_label_encoder(pred, ["lang"])
    coded = apply_label_encoder(pred, enc)
    fr = mx.metric_frame(coded, ["lang"], ["accuracy"])
    return round_doubles(fx.disadvantaged_groups(fr, ["lang"], "accuracy", decode=enc.mapping))


@register("group_share", f"""{OP}
SELECT c_mktsegment AS value, CAST(count(*) AS BIGINT) AS n,
       ROUND(count(*) * 100.0 / (SELECT count(*) FROM p), 6) AS pct FROM p GROUP BY 1""")
def q_group_share(spark, sf):
    return round_doubles(mx.group_share(orders_pred(spark, sf), "c_mktsegment"))


@register("group_combinations", """SELECT lang, source, CAST(count(*) AS BIGINT) AS size FROM documents
WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL""")
def q_group_combinations(spark, sf):
    return mx.group_combinations(read_table(spark, sf, "documents"), ["lang", "source"])


@register("distinct_sorted", "SELECT DISTINCT o_orderpriority FROM orders")
def q_distinct_sorted(spark, sf):
    return mx.distinct_sorted(read_table(spark, sf, "orders"), "o_orderpriority")


@register("quantiles", """SELECT 'l_extendedprice' AS column, CAST(0.25 AS DOUBLE) AS q, ROUND(quantile_cont(l_extendedprice, 0.25), 6) AS value FROM lineitem
UNION ALL SELECT 'l_extendedprice', 0.5, ROUND(quantile_cont(l_extendedprice, 0.5), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 0.75, ROUND(quantile_cont(l_extendedprice, 0.75), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 0.25, ROUND(quantile_cont(l_quantity, 0.25), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 0.5, ROUND(quantile_cont(l_quantity, 0.5), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 0.75, ROUND(quantile_cont(l_quantity, 0.75), 6) FROM lineitem""")
def q_quantiles(spark, sf):
    return round_doubles(mx.quantiles(read_table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]))


@register("min_max", """SELECT 'l_discount' AS column, min(l_discount) AS min, max(l_discount) AS max FROM lineitem
UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem""")
def q_min_max(spark, sf):
    return mx.min_max(read_table(spark, sf, "lineitem"), ["l_discount", "l_tax"])


# ------------------------------------------------------------------ K1-K6
@register("equalized_odds", _per_attribute_sql(GROUPS, ["n", "tpr", "fpr", "fnr"]))
def q_equalized_odds(spark, sf):
    return round_doubles(fx.equalized_odds(orders_pred(spark, sf), GROUPS))


@register("equalized_odds_docs", _per_attribute_sql(["lang", "source"], ["n", "tpr", "fpr", "fnr"], base=DP))
def q_equalized_odds_docs(spark, sf):
    return round_doubles(fx.equalized_odds(docs_pred(spark, sf), ["lang", "source"]))


@register("selection_rate", f"""{OP}, c AS (SELECT {', '.join(GROUPS)}, {counts_sql()} FROM p GROUP BY ALL)
SELECT {', '.join(GROUPS)}, {metrics_sql(['n', 'selection_rate', 'tpr', 'fpr'])} FROM c""")
def q_selection_rate(spark, sf):
    return round_doubles(fx.selection_rates(orders_pred(spark, sf), GROUPS))


_RATES = f"""c AS (SELECT {{g}}, {counts_sql()} FROM p GROUP BY ALL),
r AS (SELECT {div('tp + fp', 'tn + fp + fn + tp', None)} AS sr,
             COALESCE({div('tp', 'tp + fn', None)}, 0) AS tpr, COALESCE({div('fp', 'fp + tn', None)}, 0) AS fpr FROM c)"""


@register("parity_difference", f"{OP}, {_RATES.format(g=', '.join(GROUPS))} SELECT ROUND(max(sr) - min(sr), 6) AS parity_difference FROM r")
def q_parity(spark, sf):
    return round_doubles(fx.parity_difference(orders_pred(spark, sf), GROUPS))


@register("odds_difference", f"""{DP}, {_RATES.format(g='lang, source')}
SELECT ROUND(GREATEST(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS odds_difference FROM r""")
def q_odds(spark, sf):
    return round_doubles(fx.odds_difference(docs_pred(spark, sf), ["lang", "source"]))


@register("fairness_bundle", f"""{DP}, {_RATES.format(g='lang, source')},
t AS (SELECT {counts_sql()} FROM p)
SELECT 'baseline' AS scenario, 'accuracy' AS metric, ROUND({div('tp + tn', 'tn + fp + fn + tp', None)}, 6) AS value FROM t
UNION ALL SELECT 'baseline', 'f1', ROUND({div('2 * tp', '2 * tp + fp + fn', 0.0)}, 6) FROM t
UNION ALL SELECT 'baseline', 'precision', ROUND({div('tp', 'tp + fp', 0.0)}, 6) FROM t
UNION ALL SELECT 'baseline', 'recall', ROUND({div('tp', 'tp + fn', 0.0)}, 6) FROM t
UNION ALL SELECT 'baseline', 'parity_difference', ROUND(max(sr) - min(sr), 6) FROM r
UNION ALL SELECT 'baseline', 'odds_difference', ROUND(GREATEST(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) FROM r""")
def q_bundle(spark, sf):
    return round_doubles(fx.fairness_bundle(docs_pred(spark, sf), ["lang", "source"], "baseline"))


@register("before_after", f"""{DP},
pre AS (SELECT lang, source, {counts_sql()} FROM p WHERE score < 0.7 GROUP BY ALL),
post AS (SELECT lang, source, {counts_sql('y_true', 'CAST(score > 0.55 AS INTEGER)')} FROM p WHERE score > 0.3 GROUP BY ALL),
a AS (SELECT lang, source, {div('tp + tn', 'tn + fp + fn + tp', None)} AS accuracy FROM pre),
b AS (SELECT lang, source, {div('tp + tn', 'tn + fp + fn + tp', None)} AS accuracy FROM post)
SELECT COALESCE(a.lang, b.lang) AS lang, COALESCE(a.source, b.source) AS source,
       ROUND(a.accuracy, 6) AS before, ROUND(b.accuracy, 6) AS after, ROUND(b.accuracy - a.accuracy, 6) AS delta
FROM a FULL OUTER JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source""")
def q_before_after(spark, sf):
    """K6: two scenarios over different row sets (as the reference audits two
    different test sets), so some groups exist on one side only."""
    p = docs_pred(spark, sf)
    pre = mx.metric_frame(p.where(F.col("score") < 0.7), ["lang", "source"], ["accuracy"])
    post_pred = p.where(F.col("score") > 0.3).withColumn("y_pred", (F.col("score") > 0.55).cast("int"))
    post = mx.metric_frame(post_pred, ["lang", "source"], ["accuracy"])
    return round_doubles(fx.before_after(pre, post, ["lang", "source"], "accuracy"))


@register("before_after_recall", f"""{DP},
pre AS (SELECT lang, {counts_sql()} FROM p WHERE score < 0.7 GROUP BY ALL),
post AS (SELECT lang, {counts_sql('y_true', 'CAST(score > 0.55 AS INTEGER)')} FROM p WHERE score > 0.3 GROUP BY ALL),
a AS (SELECT lang, {div('tp', 'tp + fn', 0.0)} AS recall FROM pre),
b AS (SELECT lang, {div('tp', 'tp + fn', 0.0)} AS recall FROM post)
SELECT COALESCE(a.lang, b.lang) AS lang, ROUND(a.recall, 6) AS before, ROUND(b.recall, 6) AS after,
       ROUND(b.recall - a.recall, 6) AS delta FROM a FULL OUTER JOIN b ON a.lang IS NOT DISTINCT FROM b.lang""")
def q_before_after_recall(spark, sf):
    p = docs_pred(spark, sf)
    pre = mx.metric_frame(p.where(F.col("score") < 0.7), ["lang"], ["recall"])
    post_pred = p.where(F.col("score") > 0.3).withColumn("y_pred", (F.col("score") > 0.55).cast("int"))
    return round_doubles(fx.before_after(pre, mx.metric_frame(post_pred, ["lang"], ["recall"]), ["lang"], "recall"))


@register("fairness_bundle_groups", f"""{DP}, c AS (SELECT lang, source, {counts_sql()} FROM p GROUP BY ALL)
SELECT 'baseline' AS scenario, lang, source,
       {metrics_sql(['n', 'accuracy', 'recall', 'precision', 'f1', 'selection_rate', 'tpr', 'fpr'])} FROM c""")
def q_bundle_groups(spark, sf):
    return round_doubles(fx.scenario_groups(docs_pred(spark, sf), ["lang", "source"], "baseline"))


# Missing scores: the score is NULL for one lang and NaN for the rows of a source.
_AUC_HOLES = """q AS (SELECT y_true, CASE WHEN lang = 'fr' OR source = 'src1' THEN NULL ELSE score END AS score FROM {src})"""


@register("roc_auc_missing", f"""{DP}, {_AUC_HOLES.format(src='p')},
k AS (SELECT * FROM q WHERE score IS NOT NULL),
c AS (SELECT score, count_if(y_true = 1) AS pos, count_if(y_true <> 1) AS neg FROM k GROUP BY score),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT CAST((SELECT count(*) FROM q WHERE score IS NULL) AS BIGINT) AS n_missing,
       ROUND(sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg))::DOUBLE, 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM w""")
def q_roc_auc_missing(spark, sf):
    holes = F.when(F.col("lang") == "fr", F.lit(None)).when(F.col("source") == "src1", F.lit(float("nan"))) \
        .otherwise(F.col("score"))
    return round_doubles(mx.roc_auc(docs_pred(spark, sf).withColumn("score", holes), missing=True))


@register("group_share_missing", """WITH p AS (SELECT CASE WHEN source = 'src1' THEN NULL ELSE lang END AS lang FROM documents)
SELECT lang AS value, CAST(count(*) AS BIGINT) AS n,
       ROUND(count(*) * 100.0 / (SELECT count(lang) FROM p), 6) AS pct FROM p WHERE lang IS NOT NULL GROUP BY 1""")
def q_group_share_missing(spark, sf):
    d = read_table(spark, sf, "documents").select(F.when(F.col("source") != "src1", F.col("lang")).alias("lang"))
    return round_doubles(mx.group_share(d, "lang", ordered=True))


# -------------------------------------------------------------- N11, N13, N14
# An evaluation-history table derived from events: one "round" per day; the
# daily error share and mean value stand in for per-round metrics.
def events_history(spark, sf):
    e = read_table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("round")
    daily = e.groupBy(day).agg(
        F.avg((F.col("event_type") == "error").cast("double")).alias("error"),
        F.avg(F.col("value")).alias("mean_value"))
    return daily.select(F.lit("test").alias("split"), "round", F.explode(F.array(
        F.struct(F.lit("error").alias("metric"), F.col("error").alias("value")),
        F.struct(F.lit("mean_value").alias("metric"), F.col("mean_value").alias("value")))).alias("s")
    ).select("split", "round", "s.metric", "s.value")


_HIST_SQL = """h0 AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS round,
       avg(CAST(event_type = 'error' AS DOUBLE)) AS error, avg(value) AS mean_value FROM events GROUP BY 1),
h AS (SELECT 'test' AS split, round, 'error' AS metric, error AS value FROM h0
      UNION ALL SELECT 'test', round, 'mean_value', mean_value FROM h0)"""


@register("early_stop_round", f"""WITH {_HIST_SQL},
r AS (SELECT *, min(value) OVER (PARTITION BY split, metric ORDER BY round ROWS UNBOUNDED PRECEDING) AS best FROM h),
b AS (SELECT *, first_value(round) OVER (PARTITION BY split, metric, best ORDER BY round ROWS UNBOUNDED PRECEDING) AS best_round FROM r),
t AS (SELECT split, metric, min(CASE WHEN round - best_round >= 3 THEN round END) AS trig, max(round) AS last FROM b GROUP BY ALL)
SELECT t.split, t.metric, b.best_round, COALESCE(t.trig, t.last) AS stop_round, t.trig IS NOT NULL AS stopped,
       ROUND(b.best, 6) AS best_value
FROM t JOIN b ON t.split = b.split AND t.metric = b.metric AND b.round = COALESCE(t.trig, t.last)""")
def q_early_stop(spark, sf):
    return round_doubles(mx.early_stop(events_history(spark, sf), patience=3))


@register("leaderboard", f"""{OP},
u AS (SELECT 'price_rule' AS model, y_true, y_pred FROM p
      UNION ALL SELECT 'urgent_rule', y_true, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) FROM p),
c AS (SELECT model, {counts_sql()} FROM u GROUP BY model)
SELECT model, {metrics_sql(['n', 'accuracy', 'f1'])} FROM c""")
def q_leaderboard(spark, sf):
    p = orders_pred(spark, sf)
    u = p.select(F.lit("price_rule").alias("model"), "y_true", "y_pred").unionByName(
        p.select(F.lit("urgent_rule").alias("model"), "y_true",
                 F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y_pred")))
    return round_doubles(mx.leaderboard(u))


def _split_pred(spark, sf):
    """Prediction table with a train/test split column by a portable hash."""
    from parityframe.functions.hashing import hash32
    p = orders_pred(spark, sf)
    return p.withColumn("split", F.when(hash32("42|split", "id") % 5 == 0, F.lit("test")).otherwise(F.lit("train")))


@register("overfit_check", f"""{OP},
q AS (SELECT *, CASE WHEN ('0x' || substr(md5(concat_ws('|', '42', 'split', id)), 1, 8))::BIGINT % 5 = 0
                     THEN 'test' ELSE 'train' END AS split FROM p),
c AS (SELECT split, {counts_sql()} FROM q GROUP BY split),
m AS (SELECT split, {div('tp + tn', 'tn + fp + fn + tp', None)} AS accuracy, {div('tp', 'tp + fp', 0.0)} AS precision,
             {div('tp', 'tp + fn', 0.0)} AS recall, {div('2 * tp', '2 * tp + fp + fn', 0.0)} AS f1 FROM c),
s AS (SELECT split, score, count_if(y_true = 1) AS pos, count_if(y_true <> 1) AS neg FROM q GROUP BY ALL),
sc AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
a AS (SELECT split, sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM sc GROUP BY split),
w AS (SELECT
  max(CASE WHEN m.split = 'train' THEN accuracy END) AS accuracy_train, max(CASE WHEN m.split = 'test' THEN accuracy END) AS accuracy_test,
  max(CASE WHEN m.split = 'train' THEN precision END) AS precision_train, max(CASE WHEN m.split = 'test' THEN precision END) AS precision_test,
  max(CASE WHEN m.split = 'train' THEN recall END) AS recall_train, max(CASE WHEN m.split = 'test' THEN recall END) AS recall_test,
  max(CASE WHEN m.split = 'train' THEN f1 END) AS f1_train, max(CASE WHEN m.split = 'test' THEN f1 END) AS f1_test,
  max(CASE WHEN m.split = 'train' THEN auc END) AS auc_train, max(CASE WHEN m.split = 'test' THEN auc END) AS auc_test
  FROM m JOIN a ON m.split = a.split)
SELECT ROUND(accuracy_train, 6) AS accuracy_train, ROUND(accuracy_test, 6) AS accuracy_test,
  ROUND(precision_train, 6) AS precision_train, ROUND(precision_test, 6) AS precision_test,
  ROUND(recall_train, 6) AS recall_train, ROUND(recall_test, 6) AS recall_test,
  ROUND(f1_train, 6) AS f1_train, ROUND(f1_test, 6) AS f1_test, ROUND(auc_train, 6) AS auc_train, ROUND(auc_test, 6) AS auc_test,
  ROUND(accuracy_train - accuracy_test, 6) AS accuracy_gap, ROUND(precision_train - precision_test, 6) AS precision_gap,
  ROUND(recall_train - recall_test, 6) AS recall_gap, ROUND(f1_train - f1_test, 6) AS f1_gap, ROUND(auc_train - auc_test, 6) AS auc_gap,
  COALESCE(accuracy_train - accuracy_test > 0.05 OR f1_train - f1_test > 0.05 OR auc_train - auc_test > 0.05, false) AS overfit
FROM w""")
def q_overfit(spark, sf):
    return round_doubles(mx.overfit_check(_split_pred(spark, sf)))


@register("metric_frame_flagged", f"""{OP}, c AS (SELECT {', '.join(GROUPS)}, {counts_sql()} FROM p GROUP BY ALL),
f AS (SELECT {', '.join(GROUPS)}, CAST(tn + fp + fn + tp AS BIGINT) AS n, {div('2 * tp', '2 * tp + fp + fn', 0.0)} AS f1 FROM c)
SELECT {', '.join(GROUPS)}, n, ROUND(f1, 6) AS f1, ROUND((SELECT avg(f1) FROM f), 6) AS mean_f1,
       f1 < (SELECT avg(f1) FROM f) AS below_mean FROM f""")
def q_metric_frame_flagged(spark, sf):
    """Metric frame with the mean over groups and a below-mean flag."""
    from parityframe.plans.flows import flagged_frame
    fr = mx.metric_frame(orders_pred(spark, sf), GROUPS, ["n", "f1"])
    return round_doubles(flagged_frame(fr, "f1"))


def _gaps_sql(attrs, base):
    parts = [f"SELECT '{a}' AS attribute, {counts_sql()} FROM p GROUP BY {a}" for a in attrs]
    return f"""{base}, c AS ({' UNION ALL '.join(parts)}),
r AS (SELECT attribute, {div('tp + fp', 'tn + fp + fn + tp', None)} AS sr,
             COALESCE({div('tp', 'tp + fn', None)}, 0) AS tpr, COALESCE({div('fp', 'fp + tn', None)}, 0) AS fpr FROM c)
SELECT attribute, ROUND(max(sr) - min(sr), 6) AS parity_difference,
       ROUND(GREATEST(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS odds_difference FROM r GROUP BY attribute"""


@register("gaps_by_attribute", _gaps_sql(["lang", "source"], DP))
def q_gaps_by_attribute(spark, sf):
    return round_doubles(fx.gaps_by_attribute(docs_pred(spark, sf), ["lang", "source"]))


@register("metric_cube", f"""{DP}, c AS (SELECT lang, source, {counts_sql()} FROM p GROUP BY CUBE (lang, source))
SELECT lang, source, {metrics_sql(['n', 'accuracy', 'recall'])} FROM c""")
def q_metric_cube(spark, sf):
    """G8 with every partial level (per lang, per source, overall)."""
    return round_doubles(mx.metric_frame(docs_pred(spark, sf), ["lang", "source"], ["n", "accuracy", "recall"],
                                         levels="cube"))

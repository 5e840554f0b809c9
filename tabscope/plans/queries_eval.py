"""Registered bivariate and evaluation queries. Predictions come from fixed
rules over the driver tables (exactly checkable), not from fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import T_, r, register, round_half_up, rounded
from tabscope.operators import bivariate as BV
from tabscope.operators import metrics as V
from tabscope.operators import profile as P

# ------------------------------------------------------------------ C1-C6
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(cols, fn, name, src):
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {r(f'{fn}({a}, {b})', 9)} AS {name} FROM {src}")
    return " UNION ALL ".join(parts)


@register("corr_pearson", _pairs_sql(CORR_COLS, "corr", "r", "lineitem"))
def q_corr_pearson(spark, sf):
    return rounded(BV.corr_pearson(T_(spark, sf, "lineitem"), CORR_COLS), 9)


def _rank_src(cols):
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0e0 AS {c}"
                      for c in cols)
    return f"(SELECT {ranks} FROM lineitem)"


@register("corr_spearman", _pairs_sql(CORR_COLS, "corr", "rho", _rank_src(CORR_COLS)))
def q_corr_spearman(spark, sf):
    return rounded(BV.corr_spearman(T_(spark, sf, "lineitem"), CORR_COLS), 9)


_EVN = "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END"


@register("corr_spearman_nulls", """
WITH d AS (SELECT """ + _EVN + """ AS v, CAST(user_id AS DOUBLE) AS u FROM events),
c AS (SELECT v, u FROM d WHERE v IS NOT NULL AND u IS NOT NULL),
rv AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0e0 AS v FROM d WHERE v IS NOT NULL),
rk AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0e0 AS v,
              rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0e0 AS u FROM c),
ru AS (SELECT rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0e0 AS u FROM d WHERE u IS NOT NULL)
SELECT 'v' AS var1, 'v' AS var2, """ + r("corr(v, v)", 9) + """ AS rho FROM rv
UNION ALL SELECT 'u', 'u', """ + r("corr(u, u)", 9) + """ FROM ru
UNION ALL SELECT 'v', 'u', """ + r("corr(v, u)", 9) + """ FROM rk
UNION ALL SELECT 'u', 'v', """ + r("corr(v, u)", 9) + """ FROM rk
""")
def q_corr_spearman_nulls(spark, sf):
    d = T_(spark, sf, "events").select(F.expr(_EVN).alias("v"), F.col("user_id").cast("double").alias("u"))
    return rounded(BV.corr_spearman(d, ["v", "u"]), 9)


_KD = "(SELECT c_custkey AS k, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)"
_KT = f"""(SELECT s / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)) AS tau FROM
  (SELECT sum(sign(p.a - q.a) * sign(p.b - q.b)) AS s FROM {_KD} p JOIN {_KD} q ON p.k < q.k),
  (SELECT count(*) AS n FROM {_KD}),
  (SELECT sum(c * (c - 1) / 2) AS n1 FROM (SELECT count(*) AS c FROM {_KD} GROUP BY a)),
  (SELECT sum(c * (c - 1) / 2) AS n2 FROM (SELECT count(*) AS c FROM {_KD} GROUP BY b)))"""


@register("corr_kendall", f"""
SELECT 'c_acctbal' AS var1, 'c_nationkey' AS var2, {r('tau', 9)} AS tau FROM {_KT}
UNION ALL SELECT 'c_nationkey', 'c_acctbal', {r('tau', 9)} FROM {_KT}
UNION ALL SELECT 'c_acctbal', 'c_acctbal', 1.0e0 UNION ALL SELECT 'c_nationkey', 'c_nationkey', 1.0e0
""")
def q_corr_kendall(spark, sf):
    """Exact tau-b without forming pairs (oracle: all pairs in SQL)."""
    return rounded(BV.corr_kendall(T_(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]), 9)


STRONG_COLS = ["l_quantity", "l_extendedprice", "l_discount", "net_price"]
_NET = "l_extendedprice * (1 - l_discount)"


def _lineitem_net(spark, sf):
    li = T_(spark, sf, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", F.expr(_NET).alias("net_price"))


_STRONG_SRC = f"(SELECT l_quantity, l_extendedprice, l_discount, {_NET} AS net_price FROM lineitem)"
_STRONG_SQL = (f"SELECT * FROM ({_pairs_sql(STRONG_COLS, 'corr', 'r', _STRONG_SRC)}) "
               "WHERE var1 <> var2 AND abs(r) > 0.7")


@register("strong_pairs", _STRONG_SQL)
def q_strong_pairs(spark, sf):
    m = rounded(BV.corr_pearson(_lineitem_net(spark, sf), STRONG_COLS), 9)
    return BV.strong_pairs(m)


@register("top_pairs", f"SELECT * FROM ({_STRONG_SQL}) ORDER BY r DESC, var1, var2 LIMIT 4")
def q_top_pairs(spark, sf):
    m = rounded(BV.corr_pearson(_lineitem_net(spark, sf), STRONG_COLS), 9)
    return BV.top_pairs(m, 4)


_OLS_PAIRS = [("l_quantity", "l_extendedprice"), ("l_extendedprice", "net_price")]


@register("ols_trend", " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, {r(f'regr_slope({y}, {x})')} AS slope, "
    f"{r(f'regr_intercept({y}, {x})')} AS intercept, {r(f'regr_r2({y}, {x})', 9)} AS r2, "
    f"regr_count({y}, {x}) AS n FROM {_STRONG_SRC}" for x, y in _OLS_PAIRS))
def q_ols_trend(spark, sf):
    d = BV.ols_trend(_lineitem_net(spark, sf), _OLS_PAIRS)
    return d.select("x", "y", round_half_up(F.col("slope"), 6).alias("slope"), round_half_up(F.col("intercept"), 6).alias("intercept"),
                    round_half_up(F.col("r2"), 9).alias("r2"), F.col("n").cast("long").alias("n"))


@register("scatter_points", " UNION ALL ".join(
    f"SELECT '{x}' AS x_name, '{y}' AS y_name, {r('a')} AS x, {r('b')} AS y, {r('s * a + i', 4)} AS fitted FROM "
    f"(SELECT CAST({x} AS DOUBLE) AS a, CAST({y} AS DOUBLE) AS b FROM {_STRONG_SRC}) AS p "
    f"CROSS JOIN (SELECT regr_slope({y}, {x}) AS s, regr_intercept({y}, {x}) AS i FROM {_STRONG_SRC}) "
    f"WHERE a IS NOT NULL AND b IS NOT NULL" for x, y in _OLS_PAIRS))
def q_scatter_points(spark, sf):
    d = BV.scatter_points(_lineitem_net(spark, sf), _OLS_PAIRS)
    return d.select("x_name", "y_name", round_half_up(F.col("x"), 6).alias("x"), round_half_up(F.col("y"), 6).alias("y"),
                    round_half_up(F.col("fitted"), 4).alias("fitted"))


# ------------------------------------------------------------------ rule predictions
RULE = ("CASE WHEN value > 35 THEN 'purchase' WHEN value > 10 THEN 'click' ELSE 'view' END")
RULE2 = ("CASE WHEN value > 20 THEN 'purchase' WHEN user_id % 2 = 0 THEN 'error' ELSE 'signup' END")
CLASSES = ["click", "error", "purchase", "signup", "view"]
CENTERS = [5.0, 15.0, 25.0, 35.0, 45.0]
_S = [f"exp(-abs(value - {c}e0) / 10.0e0)" for c in CENTERS]
_TOT = "(" + " + ".join(_S) + ")"
PRED_SQL = f"SELECT event_id, event_type AS y, {RULE} AS prediction FROM events"
# probabilities rounded to 9 decimals in both engines so that ties agree
PROB_SQL = (f"SELECT event_id, event_type AS y, " + ", ".join(f"{r(s + ' / ' + _TOT, 9)} AS p{i}" for i, s in enumerate(_S))
            + " FROM events")


def rule_predictions(spark, sf):
    e = T_(spark, sf, "events")
    return e.select("event_id", F.col("event_type").alias("y"), F.expr(RULE).alias("prediction"),
                    F.array(*[round_half_up(F.expr(f"{s} / {_TOT}"), 9) for s in _S]).alias("probability"), "value", "user_id")


def two_models(spark, sf):
    e = T_(spark, sf, "events")
    a = e.select(F.lit("r1").alias("model"), F.col("event_type").alias("y"), F.expr(RULE).alias("prediction"))
    b = e.select(F.lit("r2").alias("model"), F.col("event_type").alias("y"), F.expr(RULE2).alias("prediction"))
    return a.unionByName(b)


# ------------------------------------------------------------------ V1-V4
@register("confusion_matrix", f"""
WITH p AS ({PRED_SQL}), cls AS (SELECT y AS c FROM p UNION SELECT prediction FROM p),
g AS (SELECT a.c AS actual, b.c AS predicted FROM cls a CROSS JOIN cls b),
n AS (SELECT y, prediction, count(*) AS n FROM p GROUP BY 1, 2)
SELECT actual, predicted, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON g.actual = n.y AND g.predicted = n.prediction
""")
def q_confusion_matrix(spark, sf):
    return V.confusion_matrix(rule_predictions(spark, sf))


def _per_class_sql(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    cls = (f"SELECT DISTINCT {b}y AS c FROM p UNION SELECT DISTINCT {b}prediction FROM p")
    join = f"p.{by} = cls.{by}" if by else "true"
    return f"""
p AS ({src}), cls AS ({cls}),
cc AS (SELECT {('cls.' + by + ', ') if by else ''}c AS class,
              count(CASE WHEN y = c AND prediction = c THEN 1 END) AS tp,
              count(CASE WHEN y = c THEN 1 END) AS support,
              count(CASE WHEN prediction = c THEN 1 END) AS predicted
       FROM cls JOIN p ON {join} GROUP BY {('cls.' + by + ', ') if by else ''}c),
pm AS (SELECT {b}class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0e0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0e0 END AS recall, support, tp FROM cc),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                      ELSE 0.0e0 END AS f1 FROM pm)"""


def _report_sql(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""WITH {_per_class_sql(src, by)}
SELECT {b}class, {r('precision', 9)} AS precision, {r('recall', 9)} AS recall, {r('f1', 9)} AS f1, support FROM pf
UNION ALL SELECT {b}'accuracy', NULL, NULL, {r('sum(tp) / sum(support)', 9)}, CAST(sum(support) AS BIGINT) FROM pf {g}
UNION ALL SELECT {b}'macro avg', {r('avg(precision)', 9)}, {r('avg(recall)', 9)}, {r('avg(f1)', 9)},
       CAST(sum(support) AS BIGINT) FROM pf {g}
UNION ALL SELECT {b}'weighted avg', {r('sum(precision * support) / sum(support)', 9)},
       {r('sum(recall * support) / sum(support)', 9)}, {r('sum(f1 * support) / sum(support)', 9)},
       CAST(sum(support) AS BIGINT) FROM pf {g}
"""


@register("classification_report", _report_sql(PRED_SQL))
def q_classification_report(spark, sf):
    return rounded(V.classification_report(rule_predictions(spark, sf)), 9)


@register("class_metrics_table", f"""WITH {_per_class_sql(PRED_SQL)}
SELECT class, {r('precision', 9)} AS precision, {r('recall', 9)} AS recall, {r('f1', 9)} AS f1, support FROM pf
""")
def q_class_metrics_table(spark, sf):
    return rounded(V.class_metrics_table(rule_predictions(spark, sf)), 9)


@register("global_metrics", f"""WITH {_per_class_sql(PRED_SQL)}
SELECT {r('sum(tp) / sum(support)', 9)} AS accuracy, {r('sum(precision * support) / sum(support)', 9)} AS precision,
       {r('sum(recall * support) / sum(support)', 9)} AS recall, {r('sum(f1 * support) / sum(support)', 9)} AS f1
FROM pf
""")
def q_global_metrics(spark, sf):
    return rounded(V.global_metrics(rule_predictions(spark, sf)), 9)


# ------------------------------------------------------------------ V5-V10
def _roc_sql(scored: str, keys: list[str], rnd: bool = True) -> str:
    rr = (lambda e, d: r(e, d)) if rnd else (lambda e, d: e)
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    jt = " AND ".join(f"c.{x} = t.{x}" for x in keys) or "true"
    return f"""
WITH s AS ({scored}),
a AS (SELECT {kc}score, sum(pos) AS tp, sum(1 - pos) AS fp FROM s GROUP BY {kc}score),
c AS (SELECT {kc}score, sum(tp) OVER ({part}ORDER BY score DESC) AS cum_tp,
             sum(fp) OVER ({part}ORDER BY score DESC) AS cum_fp,
             row_number() OVER ({part}ORDER BY score DESC) AS point FROM a),
t AS (SELECT {kc}sum(tp) AS P, sum(fp) AS N, count(*) AS M FROM a {('GROUP BY ' + k) if keys else ''}),
j AS (SELECT c.*, lag(cum_tp) OVER ({part}ORDER BY point) AS ptp, lead(cum_tp) OVER ({part}ORDER BY point) AS ntp,
             lag(cum_fp) OVER ({part}ORDER BY point) AS pfp, lead(cum_fp) OVER ({part}ORDER BY point) AS nfp FROM c),
kept AS (SELECT j.*, t.P, t.N, t.M FROM j JOIN t ON {jt.replace('c.', 'j.')}
         WHERE point = 1 OR point = t.M OR ntp - 2 * cum_tp + ptp <> 0 OR nfp - 2 * cum_fp + pfp <> 0)
SELECT {kc}point, {rr('score', 9)} AS threshold,
       {rr('CASE WHEN N > 0 THEN cum_fp / N END', 9)} AS fpr, {rr('CASE WHEN P > 0 THEN cum_tp / P END', 9)} AS tpr
FROM kept
UNION ALL SELECT {kc}0, CAST('Infinity' AS DOUBLE), CASE WHEN N > 0 THEN 0.0e0 END, CASE WHEN P > 0 THEN 0.0e0 END FROM t
"""


def _auc_sql(scored: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    return f"""
WITH s AS ({scored}),
a AS (SELECT {kc}score, sum(pos) AS tp, sum(1 - pos) AS fp FROM s GROUP BY {kc}score),
c AS (SELECT {kc}tp, fp, sum(tp) OVER ({part}ORDER BY score DESC) AS cum_tp FROM a)
SELECT {kc}{r('CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(fp * (cum_tp - tp + tp / 2.0e0)) / (sum(tp) * sum(fp)) END', 9)} AS auc
FROM c {('GROUP BY ' + k) if keys else ''}
"""


_BIN_SCORED = ("SELECT value AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS pos "
               "FROM events WHERE value IS NOT NULL")


@register("roc_curve_binary", _roc_sql(_BIN_SCORED, []))
def q_roc_curve_binary(spark, sf):
    return rounded(V.roc_curve_binary(T_(spark, sf, "events"), "event_type", "value", "purchase"), 9)


@register("auc", _auc_sql(_BIN_SCORED, []))
def q_auc(spark, sf):
    return rounded(V.auc_binary(T_(spark, sf, "events"), "event_type", "value", "purchase"), 9)


_OVR_SCORED = " UNION ALL ".join(
    f"SELECT '{c}' AS class, p{i} AS score, CASE WHEN y = '{c}' THEN 1 ELSE 0 END AS pos FROM ({PROB_SQL})"
    for i, c in enumerate(CLASSES))


@register("roc_one_vs_rest", _roc_sql(_OVR_SCORED, ["class"]))
def q_roc_one_vs_rest(spark, sf):
    return rounded(V.roc_one_vs_rest(rule_predictions(spark, sf), "y", "probability", CLASSES), 9)


@register("roc_micro", _roc_sql(_OVR_SCORED, []))
def q_roc_micro(spark, sf):
    return rounded(V.roc_micro(rule_predictions(spark, sf), "y", "probability", CLASSES), 9)


def _verdict_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} >= {t} THEN '{lab}'" for t, lab in V.AUC_VERDICTS)
    return f"CASE WHEN {x} IS NULL THEN NULL {parts} ELSE '{V.AUC_VERDICT_BELOW}' END"


def _grade_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} >= {t} THEN '{lab}'" for t, lab in V.AUC_GRADES)
    return f"CASE WHEN {x} IS NULL THEN NULL {parts} ELSE '{V.AUC_GRADE_BELOW}' END"


_PER_CLASS_AUC = _auc_sql(_OVR_SCORED, ["class"]).replace(f"{r('CASE', 9)[:6]}", "round(")


@register("auc_table", f"""
WITH per AS ({_auc_sql(_OVR_SCORED, ['class'])}),
mic AS ({_auc_sql(_OVR_SCORED, [])}),
allr AS (SELECT class, auc FROM per UNION ALL SELECT 'micro', auc FROM mic
         UNION ALL SELECT 'macro', CASE WHEN count(CASE WHEN auc IS NULL THEN 1 END) = 0 THEN avg(auc) END FROM per)
SELECT class, {r('auc', 9)} AS auc, {_verdict_sql('auc')} AS verdict, {_grade_sql('auc')} AS grade FROM allr
""")
def q_auc_table(spark, sf):
    t = V.auc_table(rule_predictions(spark, sf), "y", "probability", CLASSES)
    # verdicts are taken on the rounded value, as in the SQL
    t = t.withColumn("auc", round_half_up(F.col("auc"), 9))
    return t.select("class", "auc", F.when(F.col("auc").isNotNull(), V.auc_verdict(F.col("auc"))).alias("verdict"),
                    F.when(F.col("auc").isNotNull(), V.auc_grade(F.col("auc"))).alias("grade"))


# ------------------------------------------------------------------ V11-V14
_EM_SQ = "CAST(sum(CAST((prediction - y) * (prediction - y) AS DECIMAL(38,6))) AS DOUBLE) / count(*)"
_EM_ABS = "CAST(sum(CAST(abs(prediction - y) AS DECIMAL(38,6))) AS DOUBLE) / count(*)"
REG_RULE = "CASE WHEN o_orderstatus = 'F' THEN 150000.0e0 ELSE 140000.0e0 END"
REG_RULE2 = "o_totalprice * 0.9e0 + 10000.0e0"


def reg_predictions(spark, sf):
    o = T_(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_totalprice").alias("y"), F.expr(REG_RULE).alias("prediction"))


_REG_SRC = f"SELECT o_totalprice AS y, {REG_RULE} AS prediction FROM orders"


@register("regression_metrics", f"""
WITH p AS ({_REG_SRC})
SELECT {r(_EM_SQ)} AS mse, {r('sqrt(' + _EM_SQ + ')')} AS rmse,
       {r(_EM_ABS)} AS mae,
       {r('1 - sum((prediction - y) * (prediction - y)) / (var_pop(y) * count(*))', 9)} AS r2 FROM p
""")
def q_regression_metrics(spark, sf):
    m = V.regression_metrics(reg_predictions(spark, sf), mean_scale=6)
    return m.select(*[round_half_up(F.col(c), 6).alias(c) for c in ("mse", "rmse", "mae")], round_half_up(F.col("r2"), 9).alias("r2"))


@register("residual_histogram", f"""
WITH p AS (SELECT y - prediction AS x FROM ({_REG_SRC})),
s AS (SELECT min(x) AS mn, max(x) AS mx FROM p),
rg AS (SELECT CASE WHEN mn = mx THEN mn - 0.5e0 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5e0 ELSE mx END AS hi FROM s),
b AS (SELECT CAST(least(floor((x - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n FROM p, rg GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT g.bin AS bin, {r('lo + g.bin * ((hi - lo) / 30)')} AS bin_left, {r('lo + (g.bin + 1) * ((hi - lo) / 30)')} AS bin_right,
       coalesce(b.n, 0) AS n FROM g CROSS JOIN rg LEFT JOIN b ON g.bin = b.bin
""")
def q_residual_histogram(spark, sf):
    return rounded(V.residual_histogram(reg_predictions(spark, sf)))


@register("actual_vs_predicted", f"""
SELECT {r('least(min(y), min(prediction))')} AS lo, {r('greatest(max(y), max(prediction))')} AS hi FROM ({_REG_SRC})
""")
def q_actual_vs_predicted(spark, sf):
    return rounded(V.actual_vs_predicted_line(reg_predictions(spark, sf)))


@register("actual_vs_predicted_points", f"""
SELECT {r('y')} AS y, {r('prediction')} AS prediction, {r('y - prediction')} AS residual
FROM (SELECT CAST(y AS DOUBLE) AS y, CAST(prediction AS DOUBLE) AS prediction FROM ({_REG_SRC})) WHERE y - prediction IS NOT NULL
""")
def q_actual_vs_predicted_points(spark, sf):
    return rounded(V.actual_vs_predicted_points(reg_predictions(spark, sf)))


_TWO_SQL = (f"SELECT 'r1' AS model, event_type AS y, {RULE} AS prediction FROM events UNION ALL "
            f"SELECT 'r2', event_type, {RULE2} FROM events")


@register("model_comparison", f"""
WITH rep AS ({_report_sql(_TWO_SQL, 'model')}),
g AS (SELECT model, max(CASE WHEN class = 'accuracy' THEN f1 END) AS accuracy,
             max(CASE WHEN class = 'weighted avg' THEN recall END) AS recall,
             max(CASE WHEN class = 'weighted avg' THEN f1 END) AS f1 FROM rep GROUP BY model)
SELECT model, accuracy, recall, f1,
       accuracy = max(accuracy) OVER () AS best_accuracy, accuracy = min(accuracy) OVER () AS worst_accuracy,
       recall = max(recall) OVER () AS best_recall, recall = min(recall) OVER () AS worst_recall,
       f1 = max(f1) OVER () AS best_f1, f1 = min(f1) OVER () AS worst_f1 FROM g
""")
def q_model_comparison(spark, sf):
    rep = rounded(V.classification_report(two_models(spark, sf), by="model"), 9)
    return V.model_comparison_from_report(rep, "model")


_TWO_REG = (f"SELECT 'r1' AS model, o_totalprice AS y, {REG_RULE} AS prediction FROM orders UNION ALL "
            f"SELECT 'r2', o_totalprice, {REG_RULE2} FROM orders")


@register("model_comparison_regression", f"""
WITH m AS (SELECT model, {r(_EM_SQ)} AS mse,
                  {r('sqrt(' + _EM_SQ + ')')} AS rmse, {r(_EM_ABS)} AS mae,
                  {r('1 - sum((prediction - y) * (prediction - y)) / (var_pop(y) * count(*))', 9)} AS r2
           FROM ({_TWO_REG}) GROUP BY model)
SELECT model, mse, rmse, mae, r2, mse = min(mse) OVER () AS best_mse, rmse = min(rmse) OVER () AS best_rmse,
       mae = min(mae) OVER () AS best_mae, r2 = max(r2) OVER () AS best_r2 FROM m
""")
def q_model_comparison_regression(spark, sf):
    o = T_(spark, sf, "orders")
    a = o.select(F.lit("r1").alias("model"), F.col("o_totalprice").alias("y"), F.expr(REG_RULE).alias("prediction"))
    b = o.select(F.lit("r2").alias("model"), F.col("o_totalprice").alias("y"), F.expr(REG_RULE2).alias("prediction"))
    m = V.regression_metrics(a.unionByName(b), by="model", mean_scale=6)
    m = m.select("model", *[round_half_up(F.col(c), 6).alias(c) for c in ("mse", "rmse", "mae")], round_half_up(F.col("r2"), 9).alias("r2"))
    return V.flag_regression(m, "model")


@register("roc_macro", f"""
WITH curve AS ({_roc_sql(_OVR_SCORED, ['class'], rnd=False)}),
k AS (SELECT class, fpr, min(tpr) AS lo, max(tpr) AS hi FROM curve GROUP BY class, fpr),
x AS (SELECT DISTINCT fpr FROM curve),
q AS (SELECT c.class, x.fpr FROM (SELECT DISTINCT class FROM k) c CROSS JOIN x),
l AS (SELECT q.class, q.fpr, k.fpr AS lf, k.hi AS lhi FROM q ASOF LEFT JOIN k ON q.class = k.class AND q.fpr >= k.fpr),
rt AS (SELECT l.*, k2.fpr AS rf, k2.lo AS rlo FROM l ASOF LEFT JOIN k k2 ON l.class = k2.class AND l.fpr < k2.fpr),
v AS (SELECT fpr, CASE WHEN rf IS NULL THEN lhi ELSE lhi + (fpr - lf) * (rlo - lhi) / (rf - lf) END AS t FROM rt)
SELECT {r('fpr', 9)} AS fpr, {r('avg(t)', 9)} AS tpr FROM v GROUP BY fpr
""")
def q_roc_macro(spark, sf):
    return rounded(V.roc_macro(rule_predictions(spark, sf), "y", "probability", CLASSES), 9)

"""Registered source, cleaning, encoding, target and split queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.catalog import T_, r, register, rounded
from tabscope.operators import cleaning as C
from tabscope.operators import encoding as E
from tabscope.operators import split as L
from tabscope.operators import target as TG
from tabscope.session import ensure_checkpoint_dir
from tabscope.sources import files as S


def scratch_dir(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local
    on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ S1-S6
@register("csv_scan", """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey
FROM nation
""")
def q_csv_scan(spark, sf):
    path = scratch_dir(spark, "nation-csv")
    S.csv_sink(T_(spark, sf, "nation"), path)
    return S.csv_scan(spark, path)


@register("csv_sink", "SELECT r_regionkey, r_name FROM region")
def q_csv_sink(spark, sf):
    region = T_(spark, sf, "region")
    path = S.csv_sink(region, scratch_dir(spark, "region-csv"))
    return S.csv_scan(spark, path, schema=region.schema)


@register("preview_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview_head(spark, sf):
    return S.preview_head(T_(spark, sf, "orders"), "o_orderkey", 10)


@register("preview_tail", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def q_preview_tail(spark, sf):
    return S.preview_tail(T_(spark, sf, "orders"), "o_orderkey", 5)


@register("preview_sample", """
SELECT * FROM customer ORDER BY md5(concat('42:', CAST(c_custkey AS VARCHAR))), c_custkey LIMIT 10
""")
def q_preview_sample(spark, sf):
    return S.preview_sample(T_(spark, sf, "customer"), "c_custkey", 10, 42)


# ------------------------------------------------------------------ P1-P3
@register("select_features", "SELECT l_quantity, l_discount, l_returnflag FROM lineitem")
def q_select_features(spark, sf):
    return C.select_features(T_(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"])


@register("select_by_kind", "SELECT p_partkey, p_size, p_retailprice FROM part")
def q_select_by_kind(spark, sf):
    return C.select_by_kind(T_(spark, sf, "part"), "numeric")


DIRTY_EVENTS_SQL = ("SELECT event_id, user_id, "
                    "CASE WHEN event_id % 17 = 0 THEN NULL "
                    "WHEN event_id % 101 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS value, "
                    "CASE WHEN event_id % 23 = 0 THEN NULL ELSE props END AS props, "
                    "CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END AS event_type FROM events")


def dirty_events(spark, sf):
    """events with injected NULL, +inf and NULL target (same text in SQL)."""
    e = T_(spark, sf, "events")
    return e.select(
        "event_id", "user_id",
        F.expr("CASE WHEN event_id % 17 = 0 THEN NULL "
               "WHEN event_id % 101 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END").alias("value"),
        F.expr("CASE WHEN event_id % 23 = 0 THEN NULL ELSE props END").alias("props"),
        F.expr("CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END").alias("event_type"))


@register("drop_null_column", f"SELECT value FROM ({DIRTY_EVENTS_SQL}) WHERE value IS NOT NULL")
def q_drop_null_column(spark, sf):
    return C.drop_null_column(dirty_events(spark, sf), "value")


# ------------------------------------------------------------------ P4-P9
@register("infinite_row_filter", f"""
SELECT event_id, value, props, event_type FROM ({DIRTY_EVENTS_SQL})
WHERE NOT coalesce(isinf(value), false)
""")
def q_infinite_row_filter(spark, sf):
    d = dirty_events(spark, sf)
    return C.filter_infinite(d, ["value", "props"]).select("event_id", "value", "props", "event_type")


@register("infinite_to_null", f"""
SELECT event_id, CASE WHEN isinf(value) THEN NULL ELSE value END AS value FROM ({DIRTY_EVENTS_SQL})
""")
def q_infinite_to_null(spark, sf):
    return C.infinite_to_null(dirty_events(spark, sf), ["value"]).select("event_id", "value")


@register("null_row_filter", f"""
SELECT event_id, value, props, event_type FROM ({DIRTY_EVENTS_SQL})
WHERE value IS NOT NULL AND props IS NOT NULL AND event_type IS NOT NULL
""")
def q_null_row_filter(spark, sf):
    d = dirty_events(spark, sf)
    return C.null_row_filter(d, ["value", "props", "event_type"]).select("event_id", "value", "props", "event_type")


@register("missing_row_summary", f"""
SELECT count(CASE WHEN value IS NULL OR props IS NULL THEN 1 END) AS rows_missing_x,
       count(CASE WHEN event_type IS NULL THEN 1 END) AS rows_missing_y FROM ({DIRTY_EVENTS_SQL})
""")
def q_missing_row_summary(spark, sf):
    return C.missing_row_summary(dirty_events(spark, sf), ["value", "props"], "event_type")


@register("drop_null_target", f"""
SELECT event_id, event_type FROM ({DIRTY_EVENTS_SQL}) WHERE event_type IS NOT NULL
""")
def q_drop_null_target(spark, sf):
    return C.drop_null_target(dirty_events(spark, sf), "event_type").select("event_id", "event_type")


@register("cleaning_report", f"""
WITH d AS ({DIRTY_EVENTS_SQL}),
c AS (SELECT count(*) AS rows_before,
             count(CASE WHEN value IS NOT NULL AND NOT isinf(value) AND props IS NOT NULL
                        AND event_type IS NOT NULL THEN 1 END) AS rows_after FROM d)
SELECT rows_before, rows_after, rows_before - rows_after AS rows_removed,
       {r('100.0e0 * (rows_before - rows_after) / rows_before')} AS removed_pct,
       CASE WHEN 100.0e0 * (rows_before - rows_after) / rows_before > 30 THEN 'high'
            WHEN 100.0e0 * (rows_before - rows_after) / rows_before > 10 THEN 'moderate'
            WHEN rows_before - rows_after > 0 THEN 'low' ELSE 'none' END AS loss,
       CASE WHEN rows_after < 10 THEN 'stop' WHEN rows_after < 50 THEN 'warn' ELSE 'ok' END AS status
FROM c
""")
def q_cleaning_report(spark, sf):
    d = dirty_events(spark, sf)
    keep = (~C.infinite_mask(d, ["value"])) & F.col("value").isNotNull() & F.col("props").isNotNull() \
        & F.col("event_type").isNotNull()
    return rounded(C.cleaning_report(d, keep))


# ------------------------------------------------------------------ P10-P11
@register("impute_median", f"""
WITH d AS ({DIRTY_EVENTS_SQL}),
m AS (SELECT quantile_cont(value, 0.5) AS med FROM d WHERE NOT isinf(value))
SELECT event_id, {r('coalesce(value, (SELECT med FROM m))')} AS value
FROM d WHERE NOT coalesce(isinf(value), false)
""")
def q_impute_median(spark, sf):
    d = C.filter_infinite(dirty_events(spark, sf), ["value"])
    return rounded(C.impute_median(d, ["value"]).select("event_id", "value"))


_SEG_NULLS = "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END"


@register("impute_mode", f"""
WITH d AS (SELECT c_custkey, {_SEG_NULLS} AS seg FROM customer),
m AS (SELECT seg FROM d WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)
SELECT c_custkey, coalesce(d.seg, (SELECT seg FROM m)) AS seg FROM d
""")
def q_impute_mode(spark, sf):
    d = T_(spark, sf, "customer").select("c_custkey", F.expr(_SEG_NULLS).alias("seg"))
    return C.impute_mode(d, ["seg"])


# ------------------------------------------------------------------ P12-P15
_PRIO_Q = "CASE WHEN o_orderkey % 50 = 0 THEN ' ? ' ELSE o_orderpriority END"


@register("normalize_label", f"""
WITH d AS (SELECT o_orderkey, regexp_replace(regexp_replace(CAST({_PRIO_Q} AS VARCHAR), '^\\s+', ''),
                                             '\\s+$', '') AS y FROM orders)
SELECT o_orderkey, y FROM d WHERE y <> '?'
""")
def q_normalize_label(spark, sf):
    d = T_(spark, sf, "orders").select("o_orderkey", F.expr(_PRIO_Q).alias("y"))
    return C.normalize_label(d, "y")


@register("drop_rare_classes", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2)
""")
def q_drop_rare_classes(spark, sf):
    li = T_(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.drop_rare_classes(li, "l_orderkey", 2)


@register("rare_class_report", """
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT count(CASE WHEN n < 2 THEN 1 END) AS classes_removed,
       CAST(coalesce(sum(CASE WHEN n < 2 THEN n END), 0) AS BIGINT) AS rows_removed FROM c
""")
def q_rare_class_report(spark, sf):
    return C.rare_class_report(T_(spark, sf, "lineitem"), "l_orderkey", 2)


@register("schema_check", """
SELECT 'c_acctbal' AS column_name, true AS present, CAST(0 AS BIGINT) AS non_castable,
       CAST(NULL AS BIGINT) AS unseen_categories
UNION ALL SELECT 'c_nationkey', true, CAST(0 AS BIGINT), CAST(NULL AS BIGINT)
UNION ALL SELECT 'c_mktsegment', true, CAST(NULL AS BIGINT),
       (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
UNION ALL SELECT 'c_phone', false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
""")
def q_schema_check(spark, sf):
    cust = T_(spark, sf, "customer")
    trained = cust.where(F.col("c_mktsegment") != "HOUSEHOLD").select("c_mktsegment").distinct()
    types = {f.name: f.dataType for f in cust.schema.fields}
    return C.schema_check(cust, ["c_acctbal", "c_nationkey", "c_mktsegment", "c_phone"], types,
                          {"c_mktsegment": trained})


# ------------------------------------------------------------------ E1-E4
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot_drop_first", "SELECT c_custkey, c_acctbal, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in SEGMENTS[1:])
    + " FROM customer")
def q_one_hot_drop_first(spark, sf):
    c = T_(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return E.one_hot_drop_first(c, ["c_mktsegment"])


_NATION_TEXT = sorted(str(i) for i in range(25))


@register("one_hot_stringified", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN CAST(c_nationkey AS VARCHAR) = '{s}' THEN 1 ELSE 0 END AS c_nationkey_{s}"
    for s in _NATION_TEXT[1:]) + " FROM customer")
def q_one_hot_stringified(spark, sf):
    c = T_(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return E.one_hot_stringified(c, ["c_nationkey"])


_NEW_SEG = "CASE WHEN c_custkey % 7 = 0 THEN 'UNSEEN' ELSE c_mktsegment END"


@register("align_to_training", "SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_nationkey, " + ", ".join(
    f"CASE WHEN {_NEW_SEG} = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in SEGMENTS[1:])
    + " FROM customer")
def q_align_to_training(spark, sf):
    cust = T_(spark, sf, "customer")
    cats = E.fit_categories(cust, ["c_mktsegment"])
    x_cols = E.design_columns(cust, ["c_acctbal", "c_nationkey", "c_mktsegment"], cats)
    # new rows: other column order, an unseen category, the c_acctbal column missing
    new = cust.select(F.expr(_NEW_SEG).alias("c_mktsegment"), "c_nationkey", "c_custkey", "c_name")
    out = E.align_to_training(new, ["c_acctbal", "c_nationkey"], cats, x_cols)
    return out.select("c_custkey", *x_cols)


@register("feature_domain", f"""
SELECT 0 AS position, 'c_acctbal' AS feature, 'numeric' AS kind, {r('min(c_acctbal)')} AS min,
       {r('max(c_acctbal)')} AS max, {r('CAST(sum(CAST(c_acctbal AS DECIMAL(38,6))) AS DOUBLE) / count(c_acctbal)')} AS mean, CAST(NULL AS BIGINT) AS n_categories
FROM customer
UNION ALL SELECT 1, 'c_nationkey', 'numeric', {r('min(c_nationkey)')}, {r('max(c_nationkey)')},
       {r('CAST(sum(CAST(c_nationkey AS DECIMAL(38,6))) AS DOUBLE) / count(c_nationkey)')}, CAST(NULL AS BIGINT) FROM customer
UNION ALL SELECT 2, 'c_mktsegment', 'categorical', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       CAST(NULL AS DOUBLE), count(DISTINCT c_mktsegment) FROM customer
""")
def q_feature_domain(spark, sf):
    return rounded(E.feature_domain(T_(spark, sf, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment"],
                                    mean_scale=6))


@register("feature_categories", """
SELECT DISTINCT 'c_mktsegment' AS feature, c_mktsegment AS category FROM customer
""")
def q_feature_categories(spark, sf):
    return E.feature_categories(T_(spark, sf, "customer"), ["c_acctbal", "c_mktsegment"])


# ------------------------------------------------------------------ T1-T6
@register("target_profile", f"""
SELECT 'numeric' AS kind, count(DISTINCT o_totalprice) AS n_distinct, {r('min(o_totalprice)')} AS min,
       {r('max(o_totalprice)')} AS max, count(CASE WHEN o_totalprice IS NULL THEN 1 END) AS nulls
FROM orders
""")
def q_target_profile(spark, sf):
    return rounded(TG.target_profile(T_(spark, sf, "orders"), "o_totalprice"))


@register("target_outliers", f"""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
f AS (SELECT q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM q)
SELECT {r('any_value(lo)')} AS lower_fence, {r('any_value(hi)')} AS upper_fence,
       count(CASE WHEN o_totalprice < lo OR o_totalprice > hi THEN 1 END) AS n_outliers
FROM orders, f
""")
def q_target_outliers(spark, sf):
    return rounded(TG.target_outliers(T_(spark, sf, "orders"), "o_totalprice"))


def _ladder_sql(x: str, edges: list[str]) -> str:
    parts = [f"WHEN {x} >= {edges[0]} AND {x} <= {edges[1]} THEN 0"]
    for i in range(1, len(edges) - 1):
        parts.append(f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def _label_sql(edges: list[str]) -> str:
    parts = [f"WHEN {i} THEN printf('%.2f-%.2f', {edges[i]}, {edges[i + 1]})" for i in range(len(edges) - 1)]
    return "CASE bin_id " + " ".join(parts) + " END"


_EW = ["mn"] + [f"(mn + {i} * ((mx - mn) / 4))" for i in (1, 2, 3)] + ["mx"]
_EQ = [f"q{i}" for i in range(5)]
_EC = ["mn", "CAST(printf('%.2f', (mn + mx) / 2) AS DOUBLE)", "mx"]


def _binned_sql(edges_cte: str, edges: list[str]) -> str:
    return (f"WITH e AS ({edges_cte}), b AS (SELECT event_id, CAST({_ladder_sql('value', edges)} AS INTEGER) "
            f"AS bin_id, e.* FROM events, e) SELECT event_id, bin_id, {_label_sql(edges)} AS bin_label FROM b")


_EW_CTE = "SELECT min(value) AS mn, max(value) AS mx FROM events"
_EQ_CTE = "SELECT " + ", ".join(f"quantile_cont(value, {i / 4}) AS q{i}" for i in range(5)) + " FROM events"


@register("bin_equal_width", _binned_sql(_EW_CTE, _EW))
def q_bin_equal_width(spark, sf):
    out, _ = TG.bin_equal_width(T_(spark, sf, "events"), "value", 4)
    return out.select("event_id", "bin_id", "bin_label")


@register("bin_quantile", _binned_sql(_EQ_CTE, _EQ))
def q_bin_quantile(spark, sf):
    out, _ = TG.bin_quantile(T_(spark, sf, "events"), "value", 4)
    return out.select("event_id", "bin_id", "bin_label")


@register("bin_custom", _binned_sql(_EW_CTE, _EC))
def q_bin_custom(spark, sf):
    out, _ = TG.bin_custom(T_(spark, sf, "events"), "value")
    return out.select("event_id", "bin_id", "bin_label")


@register("class_distribution", f"""
WITH e AS ({_EW_CTE}), b AS (SELECT CAST({_ladder_sql('value', _EW)} AS INTEGER) AS bin_id FROM events, e),
g AS (SELECT CAST(range AS INTEGER) AS bin_id FROM range(4)),
c AS (SELECT bin_id, count(*) AS n FROM b WHERE bin_id IS NOT NULL GROUP BY bin_id)
SELECT g.bin_id, {_label_sql(_EW).replace('CASE bin_id', 'CASE g.bin_id')} AS bin_label, coalesce(c.n, 0) AS n
FROM g CROSS JOIN e LEFT JOIN c ON g.bin_id = c.bin_id
""")
def q_class_distribution(spark, sf):
    out, edges = TG.bin_equal_width(T_(spark, sf, "events"), "value", 4)
    return TG.class_distribution(out, edges)


# ------------------------------------------------------------------ L1-L4
@register("can_stratify", """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS n_classes, min(n) AS min_class_rows, count(*) >= 2 AND min(n) >= 2 AS can_stratify FROM c
""")
def q_can_stratify(spark, sf):
    return L.stratify_check(T_(spark, sf, "orders"), "o_orderpriority")


def split_sql(table: str, key: str, cls: str | None, test_size: float, seed: int, cols: str) -> str:
    c = cls or "NULL"
    return f"""
WITH base AS (SELECT *, {c} AS _c FROM {table}),
cc AS (SELECT _c, count(*) AS n FROM base GROUP BY _c),
tot AS (SELECT sum(n) AS n_all FROM cc),
nt AS (SELECT n_all, n_all - CAST(ceil({test_size!r}e0 * n_all) AS BIGINT) AS n_train FROM tot),
q0 AS (SELECT _c, n / n_all * n_train AS cont, floor(n / n_all * n_train) AS fl FROM cc, nt),
need AS (SELECT any_value(n_train) - sum(fl) AS k FROM q0, nt),
q1 AS (SELECT _c, fl, row_number() OVER (ORDER BY cont - fl DESC, _c) AS rk FROM q0),
quota AS (SELECT _c, fl + CASE WHEN rk <= (SELECT k FROM need) THEN 1 ELSE 0 END AS quota FROM q1),
ranked AS (SELECT base.*, row_number() OVER (PARTITION BY base._c
             ORDER BY md5(concat('{seed}:', CAST({key} AS VARCHAR))), {key}) AS rn FROM base)
SELECT {cols}, rn > quota AS is_test FROM ranked JOIN quota
  ON ranked._c IS NOT DISTINCT FROM quota._c
"""


@register("split_stratified", split_sql("orders", "o_orderkey", "o_orderpriority", 0.2, 42,
                                        "o_orderkey, o_orderpriority"))
def q_split_stratified(spark, sf):
    o = T_(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return L.split(o, "o_orderkey", 0.2, 42, "o_orderpriority")


@register("split_random", split_sql("orders", "o_orderkey", None, 0.25, 7, "o_orderkey"))
def q_split_random(spark, sf):
    o = T_(spark, sf, "orders").select("o_orderkey")
    return L.split_random(o, "o_orderkey", 0.25, 7)


_RARE = "CASE WHEN o_orderkey = 0 THEN 'RARE' ELSE o_orderpriority END"


@register("split_with_fallback", split_sql(f"(SELECT o_orderkey, {_RARE} AS y FROM orders)",
                                           "o_orderkey", None, 0.2, 42, "o_orderkey, y"))
def q_split_with_fallback(spark, sf):
    o = T_(spark, sf, "orders").select("o_orderkey", F.expr(_RARE).alias("y"))
    out, _ = L.split_with_fallback(o, "o_orderkey", "y", 0.2, 42)
    return out


@register("class_sufficiency", "WITH s AS (" + split_sql(
    "orders", "o_orderkey", "o_orderpriority", 0.2, 42, "o_orderpriority") + """)
SELECT 'all' AS scope, count(DISTINCT o_orderpriority) AS n_classes,
       count(DISTINCT o_orderpriority) >= 2 AS ok FROM s
UNION ALL
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END, count(DISTINCT o_orderpriority),
       count(DISTINCT o_orderpriority) >= 2 FROM s GROUP BY 1
""")
def q_class_sufficiency(spark, sf):
    o = T_(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    s = L.split(o, "o_orderkey", 0.2, 42, "o_orderpriority")
    return C.class_sufficiency(s, "o_orderpriority", "is_test")

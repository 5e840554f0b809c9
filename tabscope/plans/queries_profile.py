"""Registered profiling queries (U*, S7-S10) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import T_, long_sql, r, register, round_half_up, rounded
from tabscope.functions.normal import inv_norm_sql
from tabscope.operators import profile as P

# means from exact decimal sums: identical doubles in both engines
EXACT_MEAN = "CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) / count(value)"

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_DESCRIBE_SQL = f"""
WITH long AS ({long_sql('lineitem', LINEITEM_NUM)})
SELECT column_name, count(value) AS count, {r(EXACT_MEAN)} AS mean,
       {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min,
       {r('quantile_cont(value, 0.25)')} AS p25, {r('quantile_cont(value, 0.5)')} AS p50,
       {r('quantile_cont(value, 0.75)')} AS p75, {r('max(value)')} AS max
FROM long GROUP BY column_name
"""


@register("numeric_describe", _DESCRIBE_SQL)
def q_numeric_describe(spark, sf):
    return rounded(P.numeric_describe(T_(spark, sf, "lineitem"), LINEITEM_NUM, mean_scale=6))


# ------------------------------------------------------------------ derived inputs
# Driver tables hold no nulls: inject them by expression (same text in SQL).
EVENTS_NULLS_SQL = ("SELECT event_id, ts, user_id, event_type, "
                    "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, "
                    "CASE WHEN event_id % 23 = 0 THEN NULL ELSE props END AS props FROM events")
EVENTS_NULLS_SCHEMA = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                       ("event_type", "string"), ("value", "double"), ("props", "string")]


def events_with_nulls(spark, sf):
    e = T_(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.expr("CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END").alias("value"),
                    F.expr("CASE WHEN event_id % 23 = 0 THEN NULL ELSE props END").alias("props"))


def _per_column_sql(src: str, schema: list[tuple[str, str]]) -> str:
    counts = ", ".join(f"count({c}) AS c{i}" for i, (c, _) in enumerate(schema))
    return f"WITH e AS ({src}), c AS (SELECT count(*) AS rows_, {counts} FROM e)"


# ------------------------------------------------------------------ U1
@register("descriptive_stats", f"""
WITH e AS ({EVENTS_NULLS_SQL}),
long AS (SELECT 'value' AS column_name, CAST(value AS DOUBLE) AS value FROM e
         UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM e)
SELECT column_name, {r(EXACT_MEAN)} AS mean, {r('quantile_cont(value, 0.5)')} AS median,
       {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max,
       {r('skewness(value)')} AS skew, {r('kurtosis(value)')} AS kurtosis,
       count(*) - count(value) AS nulls
FROM long GROUP BY column_name
""")
def q_descriptive_stats(spark, sf):
    return rounded(P.descriptive_stats(events_with_nulls(spark, sf), ["value", "user_id"], mean_scale=6))


# ------------------------------------------------------------------ U2
@register("histogram", f"""
WITH s AS (SELECT min(value) AS mn, max(value) AS mx FROM events WHERE value IS NOT NULL),
rg AS (SELECT CASE WHEN mn = mx THEN mn - 0.5e0 ELSE mn END AS lo,
              CASE WHEN mn = mx THEN mx + 0.5e0 ELSE mx END AS hi FROM s),
b AS (SELECT CAST(least(floor((value - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n
      FROM events, rg WHERE value IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT g.bin AS bin, {r('lo + g.bin * ((hi - lo) / 30)')} AS bin_left,
       {r('lo + (g.bin + 1) * ((hi - lo) / 30)')} AS bin_right, coalesce(b.n, 0) AS n
FROM g CROSS JOIN rg LEFT JOIN b ON g.bin = b.bin
""")
def q_histogram(spark, sf):
    return rounded(P.histogram(T_(spark, sf, "events"), "value", 30))


# ------------------------------------------------------------------ U3 / U6
_FENCES_SQL = f"""
WITH long AS ({long_sql('events', ['value', 'user_id'])}),
q AS (SELECT column_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
             quantile_cont(value, 0.75) AS q3 FROM long GROUP BY column_name),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM q)
"""


@register("boxplot_summary", _FENCES_SQL + f"""
SELECT f.column_name, {r('any_value(q1)')} AS q1, {r('any_value(med)')} AS median,
       {r('any_value(q3)')} AS q3,
       {r('min(CASE WHEN value >= lo AND value <= hi THEN value END)')} AS whisker_low,
       {r('max(CASE WHEN value >= lo AND value <= hi THEN value END)')} AS whisker_high,
       count(CASE WHEN NOT (value >= lo AND value <= hi) THEN 1 END) AS n_fliers
FROM long JOIN f ON long.column_name = f.column_name GROUP BY f.column_name
""")
def q_boxplot_summary(spark, sf):
    return rounded(P.boxplot_summary(T_(spark, sf, "events"), ["value", "user_id"]))


@register("iqr_outliers", _FENCES_SQL + f"""
SELECT f.column_name, {r('any_value(q1)')} AS q1, {r('any_value(q3)')} AS q3,
       {r('any_value(iqr)')} AS iqr, {r('any_value(lo)')} AS lower_fence,
       {r('any_value(hi)')} AS upper_fence,
       count(CASE WHEN value < lo OR value > hi THEN 1 END) AS n_outliers
FROM long JOIN f ON long.column_name = f.column_name GROUP BY f.column_name
""")
def q_iqr_outliers(spark, sf):
    return rounded(P.iqr_outliers(T_(spark, sf, "events"), ["value", "user_id"]))


# ------------------------------------------------------------------ U4
@register("density_curve", f"""
WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
c AS (SELECT x, count(*) AS c FROM v GROUP BY x),
s AS (SELECT count(x) AS n, stddev_samp(x) * pow(CAST(count(x) AS DOUBLE), -0.2e0) AS bw,
             min(x) AS mn, max(x) AS mx FROM v),
s2 AS (SELECT n, bw, mn - 3.0e0 * bw AS g0, mx + 3.0e0 * bw AS g1 FROM s),
g AS (SELECT CAST(range AS INTEGER) AS i FROM range(200)),
t AS (SELECT i, CASE WHEN i = 199 THEN g1 ELSE g0 + i * ((g1 - g0) / 199) END AS gx, c, x, bw, n
      FROM c CROSS JOIN s2 CROSS JOIN g)
SELECT i AS point, {r('gx')} AS x,
       {r('sum(c * exp(-0.5e0 * ((gx - x) / bw) * ((gx - x) / bw))) / (n * bw * sqrt(6.283185307179586e0))', 10)} AS density
FROM t GROUP BY i, gx, n, bw
""")
def q_density_curve(spark, sf):
    d = P.density_curve(T_(spark, sf, "events"), "value")
    return d.select("point", round_half_up(F.col("x"), 6).alias("x"), round_half_up(F.col("density"), 10).alias("density"))


# ------------------------------------------------------------------ U5
_QQ_U = ("CASE WHEN pos = N - 1 THEN pow(0.5e0, 1.0e0 / N) "
         "WHEN pos = 0 THEN 1.0e0 - pow(0.5e0, 1.0e0 / N) "
         "ELSE (pos + 1 - 0.3175e0) / (N + 0.365e0) END")
_QQ_SQL = f"""
WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS pos, count(*) OVER () AS N
           FROM events WHERE value IS NOT NULL),
u AS (SELECT pos, value, {_QQ_U} AS u FROM o)
"""


@register("qq_points", _QQ_SQL + f"""
SELECT pos AS position, {r('value', 9)} AS sample, {r(inv_norm_sql('u'), 9)} AS theoretical FROM u
""")
def q_qq_points(spark, sf):
    return rounded(P.qq_points(T_(spark, sf, "events"), "value"), 9)


@register("qq_fit", _QQ_SQL + f"""
, p AS (SELECT value AS sample, {inv_norm_sql('u')} AS theoretical FROM u)
SELECT {r('regr_slope(sample, theoretical)')} AS slope,
       {r('regr_intercept(sample, theoretical)')} AS intercept, {r('corr(sample, theoretical)', 9)} AS r
FROM p
""")
def q_qq_fit(spark, sf):
    d = P.qq_fit(T_(spark, sf, "events"), "value")
    return d.select(round_half_up(F.col("slope"), 6).alias("slope"), round_half_up(F.col("intercept"), 6).alias("intercept"),
                    round_half_up(F.col("r"), 9).alias("r"))


# ------------------------------------------------------------------ U7-U10
@register("value_counts", """
SELECT p_type AS category, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY p_type
""")
def q_value_counts(spark, sf):
    return P.value_counts(T_(spark, sf, "part"), "p_type")


@register("category_shares", f"""
WITH c AS (SELECT l_returnflag AS category, count(*) AS n FROM lineitem
           WHERE l_returnflag IS NOT NULL GROUP BY 1)
SELECT category, n, {r('n / sum(n) OVER ()', 9)} AS share FROM c
WHERE (SELECT count(*) FROM c) <= 10
""")
def q_category_shares(spark, sf):
    return rounded(P.category_shares(T_(spark, sf, "lineitem"), "l_returnflag"), 9)


@register("top_categories", """
SELECT p_brand AS category, count(*) AS n FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY n DESC, category LIMIT 10
""")
def q_top_categories(spark, sf):
    return P.top_categories(T_(spark, sf, "part"), "p_brand", 10)


_CUST_NULLS = "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END"


@register("frequency_table", f"""
WITH c AS (SELECT {_CUST_NULLS} AS category FROM customer),
g AS (SELECT category, count(*) AS n FROM c GROUP BY category)
SELECT category, n, {r('100.0e0 * n / (SELECT count(*) FROM c)')} AS percent
FROM g WHERE category IS NOT NULL
""")
def q_frequency_table(spark, sf):
    c = T_(spark, sf, "customer").select(F.expr(_CUST_NULLS).alias("segment"))
    return rounded(P.frequency_table(c, "segment"))


# ------------------------------------------------------------------ U11 / U13 / S7-S10
def _null_report_sql(src, schema):
    parts = [f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS type, c{i} AS non_null, "
             f"rows_ - c{i} AS nulls, {r(f'100.0e0 * (rows_ - c{i}) / rows_')} AS null_pct FROM c"
             for i, (c, t) in enumerate(schema)]
    return _per_column_sql(src, schema) + " " + " UNION ALL ".join(parts)


@register("column_null_report", _null_report_sql(EVENTS_NULLS_SQL, EVENTS_NULLS_SCHEMA))
def q_column_null_report(spark, sf):
    return rounded(P.column_null_report(events_with_nulls(spark, sf)))


@register("null_share_ranking",
          "SELECT column_name, nulls, null_pct FROM ("
          + _null_report_sql(EVENTS_NULLS_SQL, EVENTS_NULLS_SCHEMA) + ") WHERE nulls > 0")
def q_null_share_ranking(spark, sf):
    return rounded(P.null_share_ranking(events_with_nulls(spark, sf)))


@register("dataset_counts", """
SELECT count(*) AS rows, 5 AS columns, 3 AS numeric_columns, 2 AS categorical_columns FROM customer
""")
def q_dataset_counts(spark, sf):
    return P.dataset_counts(T_(spark, sf, "customer"))


PART_SCHEMA = [("p_partkey", "bigint", 8), ("p_name", "string", None), ("p_brand", "string", None),
               ("p_type", "string", None), ("p_size", "int", 4), ("p_retailprice", "double", 8)]


def _bytes_sql():
    cols = []
    for i, (c, t, w) in enumerate(PART_SCHEMA):
        b = f"CAST(sum(strlen({c})) AS BIGINT)" if w is None else f"CAST({w} * count({c}) AS BIGINT)"
        cols.append(f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS type, {b} AS bytes FROM part")
    per = " UNION ALL ".join(cols)
    return (f"WITH per AS ({per}) SELECT * FROM per UNION ALL "
            f"SELECT {len(PART_SCHEMA)}, '__total__', 'all', CAST(sum(bytes) AS BIGINT) FROM per")


@register("column_storage_bytes", _bytes_sql())
def q_column_storage_bytes(spark, sf):
    return P.column_storage_bytes(T_(spark, sf, "part"))


@register("null_totals", _per_column_sql(EVENTS_NULLS_SQL, EVENTS_NULLS_SCHEMA) + f"""
SELECT CAST(6 * rows_ - ({' + '.join(f'c{i}' for i in range(6))}) AS BIGINT) AS total_nulls,
       CAST(6 * rows_ AS BIGINT) AS cells,
       {r(f"100.0e0 * (6 * rows_ - ({' + '.join(f'c{i}' for i in range(6))})) / (rows_ * 6)")} AS null_pct
FROM c
""")
def q_null_totals(spark, sf):
    return rounded(P.null_totals(events_with_nulls(spark, sf)))


@register("dtype_distribution", """
WITH t AS (SELECT 'bigint' AS type, count(p_partkey) AS nn FROM part
           UNION ALL SELECT 'string', count(p_name) FROM part
           UNION ALL SELECT 'string', count(p_brand) FROM part
           UNION ALL SELECT 'string', count(p_type) FROM part
           UNION ALL SELECT 'int', count(p_size) FROM part
           UNION ALL SELECT 'double', count(p_retailprice) FROM part)
SELECT type, count(*) AS n_columns, CAST(sum(nn) AS BIGINT) AS non_null_cells FROM t GROUP BY type
""")
def q_dtype_distribution(spark, sf):
    return P.dtype_distribution(T_(spark, sf, "part"))

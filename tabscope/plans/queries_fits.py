"""Fitted models whose first rounds SQL can repeat: stumps of boosting learners on lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import T_, r, register, rounded
from tabscope.operators import ensembles as EN
from tabscope.operators.trees import fit_tree
from tabscope.plans.queries_models import NET, lineitem_frame

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
CLASSES = ["A", "N", "R"]
ROUNDS = 3
RATE = 0.5


def _value_of(f: str) -> str:
    return "CASE " + f + " " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(FEATURES)) + " END"


def _name_of(f: str) -> str:
    return "CASE " + f + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURES)) + " END"


def _best(k: int, sums: list[str], gain: str) -> str:
    """CTEs v, c, s of round k: sums per value, running sums, the best cut of ``rows_k``."""
    long = " UNION ALL ".join(f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS x, {', '.join(sums)} FROM rows_{k}" for i, c in enumerate(FEATURES))
    run = ", ".join(f"sum({x}) OVER (PARTITION BY f ORDER BY x) AS l_{x}, sum({x}) OVER (PARTITION BY f) AS t_{x}" for x in sums)
    return f"""v{k} AS (SELECT f, x, {', '.join(f'sum({x}) AS {x}' for x in sums)} FROM ({long}) GROUP BY f, x),
c{k} AS (SELECT f, x, lead(x) OVER (PARTITION BY f ORDER BY x) AS nx, {run} FROM v{k}),
s{k} AS (SELECT *, x / 2.0e0 + nx / 2.0e0 AS threshold FROM c{k} WHERE nx IS NOT NULL ORDER BY round({gain}, 9) DESC, f, x LIMIT 1)"""


_SQUARED = "l_w * (t_w - l_w) * power(l_g / l_w - (t_g - l_g) / (t_w - l_w), 2) / power(t_w, 2)"


def _gbt_sql() -> str:
    ctes = [f"base AS (SELECT *, {NET} AS y FROM lineitem)", "start AS (SELECT avg(y) AS m FROM base)",
            "rows_0 AS (SELECT base.*, y - m AS g, 1.0e0 AS w FROM base, start)"]
    out = []
    for k in range(ROUNDS):
        side = f"CASE WHEN {_value_of('f')} <= threshold THEN left_value ELSE right_value END"
        ctes += [_best(k, ["w", "g"], _SQUARED),
                 f"u{k} AS (SELECT f, threshold, l_g / l_w AS left_value, (t_g - l_g) / (t_w - l_w) AS right_value FROM s{k})",
                 f"rows_{k + 1} AS (SELECT rows_{k}.* REPLACE (g - {RATE}e0 * ({side}) AS g) FROM rows_{k}, u{k})"]
        out.append(f"SELECT {k + 1} AS round, {_name_of('f')} AS feature, {r('threshold', 6)} AS threshold, "
                   f"{r('left_value', 4)} AS left_value, {r('right_value', 4)} AS right_value FROM u{k}")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(out)


def _round_values(df):
    return rounded(rounded(df, 6), 4, skip=("threshold",))


@register("gbt_regressor_stumps", _gbt_sql())
def q_gbt_regressor_stumps(spark, sf):
    """The first rounds of squared-error boosting on all of lineitem: cut and leaf values of each round."""
    li = T_(spark, sf, "lineitem").select(*FEATURES, F.expr(NET).alias("y"))
    model = EN.gbt_regressor(li, FEATURES, "y", ROUNDS, RATE, 1)
    rows = []
    for k, [(tree, values)] in enumerate(model.rounds):
        root = tree.nodes[1]
        rows.append((k + 1, FEATURES[root.feature], float(root.threshold), values[2], values[3]))
    return _round_values(spark.createDataFrame(rows, "round int, feature string, threshold double, left_value double, right_value double"))


def _ada_sql() -> str:
    w = [f"w{c}" for c in CLASSES]
    hot = ", ".join(f"CASE WHEN l_returnflag = '{c}' THEN 1.0e0 ELSE 0.0e0 END AS w{c}" for c in CLASSES)
    ctes = [f"rows_0 AS (SELECT *, {hot} FROM lineitem)"]
    tot, left = (" + ".join(f"{p}_{x}" for x in w) for p in "tl")
    side_l = " + ".join(f"l_{x} * l_{x}" for x in w)
    side_r = " + ".join(f"(t_{x} - l_{x}) * (t_{x} - l_{x})" for x in w)
    gain = f"(({side_l}) / ({left}) + ({side_r}) / (({tot}) - ({left}))) / ({tot})"
    most_l, most_r = (f"greatest({', '.join(p.format(x) for x in w)})" for p in ("l_{0}", "t_{0} - l_{0}"))

    def vote(p: str, most: str) -> str:
        return "CASE " + " ".join(f"WHEN {p.format(x)} = {most} THEN '{c}'" for x, c in zip(w, CLASSES)) + " END"
    out = []
    for k in range(ROUNDS):
        said = f"CASE WHEN {_value_of('f')} <= threshold THEN lv ELSE rv END"
        moved = ", ".join(f"{x} * (CASE WHEN {said} = l_returnflag THEN 1.0e0 ELSE exp(alpha) END) AS {x}" for x in w)
        ctes += [_best(k, w, gain),
                 f"u{k} AS (SELECT f, threshold, {RATE}e0 * (ln((1 - e) / e) + ln(2.0e0)) AS alpha, lv, rv FROM "
                 f"(SELECT *, 1 - ({most_l} + {most_r}) / ({tot}) AS e, {vote('l_{0}', most_l)} AS lv, {vote('t_{0} - l_{0}', most_r)} AS rv FROM s{k}))",
                 f"rows_{k + 1} AS (SELECT rows_{k}.* REPLACE ({moved}) FROM rows_{k}, u{k})"]
        out.append(f"SELECT {k + 1} AS round, {_name_of('f')} AS feature, {r('threshold', 6)} AS threshold, lv AS left_class, rv AS right_class, "
                   f"{r('alpha', 6)} AS alpha FROM u{k}")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(out)


@register("adaboost_classifier_stumps", _ada_sql())
def q_adaboost_classifier_stumps(spark, sf):
    """The first rounds of SAMME on all of lineitem: cut, votes and weight of each round."""
    li = T_(spark, sf, "lineitem").select(*FEATURES, "l_returnflag")
    model = EN.adaboost_classifier(li, FEATURES, "l_returnflag", ROUNDS, RATE, CLASSES)
    rows = []
    for k, (tree, alpha) in enumerate(model.trees):
        root = tree.nodes[1]
        rows.append((k + 1, FEATURES[root.feature], float(root.threshold), tree.leaf_value(tree.nodes[2])[0], tree.leaf_value(tree.nodes[3])[0], alpha))
    return rounded(spark.createDataFrame(rows, "round int, feature string, threshold double, left_class string, right_class string, alpha double"), 6)


@register("tree_regressor_stump", f"""
WITH rows_0 AS (SELECT *, {NET} AS g, 1.0e0 AS w FROM lineitem),
{_best(0, ["w", "g"], _SQUARED)}
SELECT {_name_of('f')} AS feature, {r('threshold', 6)} AS threshold, CAST(l_w AS BIGINT) AS n_left, CAST(t_w - l_w AS BIGINT) AS n_right,
       {r('l_g / l_w', 4)} AS left_value, {r('(t_g - l_g) / (t_w - l_w)', 4)} AS right_value FROM s0
""")
def q_tree_regressor_stump(spark, sf):
    """A plain forest of one cut on all rows equals the best squared-error cut."""
    li = T_(spark, sf, "lineitem").select(*FEATURES, F.expr(NET).alias("y"))
    tree = EN.forest_regressor(li, FEATURES, "y", 1, 1, bootstrap=False).trees[0]
    root, a, b = (tree.nodes[i] for i in (1, 2, 3))
    row = (FEATURES[root.feature], float(root.threshold), a.n, b.n, a.stats[1] / a.weight, b.stats[1] / b.weight)
    return _round_values(spark.createDataFrame([row], "feature string, threshold double, n_left long, n_right long, left_value double, right_value double"))


@register("fit_errors", "SELECT m AS model, m <> 'broken' AS fitted, CASE WHEN m = 'broken' THEN concat('unsupported loss ', chr(39), 'cube', chr(39)) END AS error "
          "FROM (VALUES ('stump'), ('broken')) t(m)")
def q_fit_errors(spark, sf):
    """Two configurations on all of lineitem, one of which cannot be fitted."""
    frame = lineitem_frame(spark, sf)
    configs = {"stump": lambda t: fit_tree(t, ["l_quantity", "l_discount"], "demand", "classification", "gini", 1),
               "broken": lambda t: EN.gbt_regressor(t, ["l_quantity"], "net_price", loss="cube")}
    _, _, errors = EN.fit_and_compare(frame, frame, ["l_quantity", "l_discount"], "demand", configs, "row_key")
    return EN.error_table(spark, list(configs), errors)

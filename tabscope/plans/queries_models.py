"""Registered model fitting, evaluation-with-models and scoring queries.

The driver tables hold independent random columns, so targets are derived
(see SURVEY §5): a binary ``demand`` class and a net price for regression.
Fitted models have no static SQL form; except for the root split (M14) these
queries carry rows-only checks and are covered by invariant tests.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tabscope.catalog import T_, r, register, rounded
from tabscope.operators import ensembles as EN
from tabscope.operators import metrics as V
from tabscope.operators import scoring as B
from tabscope.operators import split as L
from tabscope.operators.prepare import LABEL, STATUS, PreparationSpec
from tabscope.operators.trees import best_split, fit_tree

ROW_KEY = ("concat(cast(l_orderkey as string), ':', cast(l_partkey as string), ':', cast(l_suppkey as string), "
           "':', cast(l_linenumber as string), ':', cast(cast(round(l_extendedprice * 100) as bigint) as string))")
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
DEMAND = "CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 'high' ELSE 'low' END"
NET = "l_extendedprice * (1 - l_discount)"


def lineitem_frame(spark, sf):
    li = T_(spark, sf, "lineitem")
    return li.select(F.expr(ROW_KEY).alias("row_key"), *FEATURES, F.expr(DEMAND).alias("demand"),
                     F.expr(NET).alias("net_price"), "l_extendedprice")


def prepared(spark, sf, task: str = "classification", binning: dict | None = None):
    frame = lineitem_frame(spark, sf)
    target = "demand" if task == "classification" and binning is None else "net_price"
    feats = FEATURES + (["l_extendedprice"] if task == "regression" else [])
    spec = PreparationSpec.fit(frame, target, feats, task=task, binning=binning)
    # the split feeds several fits and is cached (an executor loss recomputes from lineage); its own counts
    # read a few columns of the table again, which is cheaper than a second cache of all prepared rows
    data = spec.transform(frame, keep=["row_key"])
    split, _ = L.split_with_fallback(data, "row_key", LABEL, 0.2, 42, classification=(task == "classification"))
    split = split.persist(StorageLevel.MEMORY_AND_DISK)
    split.count()
    return spec, split, frame


def _sides(split):
    return split.where(~F.col("is_test")).drop("is_test"), split.where(F.col("is_test")).drop("is_test")


def _test_predictions(model, test, task):
    out = model.transform(test)
    cols = ["row_key", F.col(LABEL).alias("y"), F.col("prediction").cast("string" if task == "classification"
                                                                         else "double").alias("prediction")]
    if task == "classification":
        cols.append("probability")
    return out.select(*cols)


# ------------------------------------------------------------------ M14 (SQL)
_BS_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_BS_CLASSES = ["A", "N", "R"]


def _gini(prefix: str, tot: str) -> str:
    return "(1 - (" + " + ".join(f"({prefix}{c} / {tot}) * ({prefix}{c} / {tot})" for c in _BS_CLASSES) + "))"


_BS_SQL = f"""
WITH long AS ({' UNION ALL '.join(f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS x, l_returnflag AS y FROM lineitem"
                                  for i, c in enumerate(_BS_FEATS))}),
v AS (SELECT f, x, count(*) AS n, {', '.join(f"count(CASE WHEN y = '{c}' THEN 1 END) AS k{c}" for c in _BS_CLASSES)}
      FROM long GROUP BY f, x),
c AS (SELECT f, x, lead(x) OVER (PARTITION BY f ORDER BY x) AS nx,
             sum(n) OVER (PARTITION BY f ORDER BY x) AS nl, sum(n) OVER (PARTITION BY f) AS nt,
             {', '.join(f"sum(k{c}) OVER (PARTITION BY f ORDER BY x) AS l{c}, sum(k{c}) OVER (PARTITION BY f) AS t{c}"
                        for c in _BS_CLASSES)} FROM v),
g AS (SELECT f, x / 2.0e0 + nx / 2.0e0 AS threshold, nl, nt - nl AS nr,
             {_gini('t', 'nt')} - (nl * {_gini('l', 'nl')} + (nt - nl) * {_gini('r', '(nt - nl)')}) / nt AS gain
      FROM (SELECT *, {', '.join(f't{c} - l{c} AS r{c}' for c in _BS_CLASSES)} FROM c) WHERE nx IS NOT NULL)
SELECT CASE f {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_BS_FEATS))} END AS feature,
       {r('threshold', 9)} AS threshold, {r('gain', 9)} AS improvement, nl AS n_left, nr AS n_right
FROM g ORDER BY round(gain, 12) DESC, f, threshold LIMIT 1
"""


@register("best_split", _BS_SQL)
def q_best_split(spark, sf):
    li = T_(spark, sf, "lineitem")
    return rounded(best_split(li, _BS_FEATS, "l_returnflag"), 9)


# ------------------------------------------------------------------ M1 / M2 / M12 / M13
def _tree_cls(spark, sf, criterion="gini", depth=5):
    spec, split, _ = prepared(spark, sf)
    train, test = _sides(split)
    model = fit_tree(train, spec.x_columns, LABEL, "classification", criterion, depth, 2, 1,
                     classes=spec.classes)
    return spec, model, test


@register("tree_classifier")
def q_tree_classifier(spark, sf):
    spec, model, test = _tree_cls(spark, sf)
    return _test_predictions(model, test, "classification")


@register("tree_classifier_entropy")
def q_tree_classifier_entropy(spark, sf):
    spec, model, test = _tree_cls(spark, sf, "entropy", 4)
    return _test_predictions(model, test, "classification")


def _tree_reg(spark, sf, criterion):
    spec, split, _ = prepared(spark, sf, "regression")
    train, test = _sides(split)
    model = fit_tree(train, spec.x_columns, LABEL, "regression", criterion, 4, 2, 5)
    return spec, model, test


@register("tree_regressor")
def q_tree_regressor(spark, sf):
    spec, model, test = _tree_reg(spark, sf, "squared_error")
    return _test_predictions(model, test, "regression")


@register("tree_regressor_poisson")
def q_tree_regressor_poisson(spark, sf):
    spec, model, test = _tree_reg(spark, sf, "poisson")
    return _test_predictions(model, test, "regression")


@register("tree_node_table")
def q_tree_node_table(spark, sf):
    """Fitted nodes plus the test rows routed to each node."""
    spec, model, test = _tree_cls(spark, sf, depth=3)
    nodes = model.node_table(spark)
    routed = model.transform(test, leaf="_leaf").groupBy(F.col("_leaf").alias("node_id")).agg(
        F.count(F.lit(1)).alias("test_rows"))
    return nodes.join(routed, "node_id", "left").orderBy("node_id")


@register("predict")
def q_predict(spark, sf):
    """Compiled tree (one CASE column) scoring every lineitem row."""
    spec, model, _ = _tree_cls(spark, sf, depth=4)
    frame = lineitem_frame(spark, sf)
    d = spec.transform(frame, keep=["row_key"], with_label=False)
    return model.transform(d).select("row_key", "prediction", "probability")


# ------------------------------------------------------------------ M3-M10
def _ensemble(spark, sf, task, fit):
    spec, split, _ = prepared(spark, sf, task)
    train, test = _sides(split)
    model = fit(spec, train)
    return _test_predictions(model, test, task)


#: Registered learners: task, fit, and the size of the reference's form (`configure_*`, 100 / 50 / 100 / 10); the small size is registered too.
_LEARNERS = {
    "forest_classifier": ("classification", lambda s, t, n: EN.forest_classifier(t, s.x_columns, LABEL, n, 5, classes=s.classes), 100, 20),
    "forest_regressor": ("regression", lambda s, t, n: EN.forest_regressor(t, s.x_columns, LABEL, n, 5), 100, 20),
    "adaboost_classifier": ("classification", lambda s, t, n: EN.adaboost_classifier(t, s.x_columns, LABEL, n, 0.5, classes=s.classes), 50, 10),
    "adaboost_regressor": ("regression", lambda s, t, n: EN.adaboost_regressor(t, s.x_columns, LABEL, n, 0.5), 50, 5),
    "gbt_classifier": ("classification", lambda s, t, n: EN.gbt_classifier(t, s.x_columns, LABEL, n, 0.1, 3, classes=s.classes), 100, 5),
    "gbt_regressor": ("regression", lambda s, t, n: EN.gbt_regressor(t, s.x_columns, LABEL, n, 0.1, 3), 100, 10),
    "gbt_regressor_huber": ("regression", lambda s, t, n: EN.gbt_regressor(t, s.x_columns, LABEL, n, 0.1, 3, loss="huber"), 100, 3),
    "gbt_regressor_quantile": ("regression", lambda s, t, n: EN.gbt_regressor(
        t, s.x_columns, LABEL, n, 0.1, 3, loss="quantile", alpha=0.9), 100, 3),
    "bagging_classifier": ("classification", lambda s, t, n: EN.bagging_classifier(t, s.x_columns, LABEL, n, 1.0, classes=s.classes), 10, 5),
    "bagging_regressor": ("regression", lambda s, t, n: EN.bagging_regressor(t, s.x_columns, LABEL, n, 1.0), 10, 5),
}


def _register_learner(name, task, fit, n):
    @register(name)
    def query(spark, sf):
        return _ensemble(spark, sf, task, lambda s, t: fit(s, t, n))
    query.__name__ = f"q_{name}"


for _name, (_task, _fit, _full, _small) in _LEARNERS.items():
    _register_learner(_name, _task, _fit, _full)
    _register_learner(f"{_name}_small", _task, _fit, _small)


# ------------------------------------------------------------------ M11 / V14 with models
def _compare(spark, sf):
    spec, split, _ = prepared(spark, sf)
    train, test = _sides(split)
    x = spec.x_columns
    configs = {
        "decision_tree": lambda t: fit_tree(t, x, LABEL, "classification", "gini", 5, classes=spec.classes),
        "random_forest": lambda t: EN.forest_classifier(t, x, LABEL, 100, 5, classes=spec.classes),
        "adaboost": lambda t: EN.adaboost_classifier(t, x, LABEL, 50, 0.5, classes=spec.classes),
        "gradient_boosting": lambda t: EN.gbt_classifier(t, x, LABEL, 100, 0.1, 3, classes=spec.classes),
        "bagging": lambda t: EN.bagging_classifier(t, x, LABEL, 10, 1.0, classes=spec.classes),
    }
    models, preds, errors = EN.fit_and_compare(train, test, x, LABEL, configs, "row_key")
    EN.all_fitted(errors)
    return spec, models, preds


@register("fit_and_compare")
def q_fit_and_compare(spark, sf):
    _, _, preds = _compare(spark, sf)
    return preds


@register("model_comparison_fitted")
def q_model_comparison_fitted(spark, sf):
    _, _, preds = _compare(spark, sf)
    return rounded(V.model_comparison(preds, "y", "prediction", "model"), 9)


# ------------------------------------------------------------------ B1-B7
def _new_rows(spark, sf):
    """New rows to score: the whole lineitem table without the target."""
    return lineitem_frame(spark, sf).drop("demand", "net_price")


@register("score_regression")
def q_score_regression(spark, sf):
    spec, model, _ = _tree_reg(spark, sf, "squared_error")
    return B.score_regression(_new_rows(spark, sf), spec, model, keep=["row_key"])


@register("score_classification")
def q_score_classification(spark, sf):
    spec, model, _ = _tree_cls(spark, sf, depth=4)
    return B.score_classification(_new_rows(spark, sf), spec, model, keep=["row_key"])


@register("prediction_distribution")
def q_prediction_distribution(spark, sf):
    spec, model, _ = _tree_cls(spark, sf, depth=4)
    scored = B.score_classification(_new_rows(spark, sf), spec, model, keep=["row_key"])
    return B.prediction_distribution(scored, B.PREDICTION_PREFIX + spec.target)


def _few_models(spark, sf):
    spec, split, _ = prepared(spark, sf)
    train, _ = _sides(split)
    x = spec.x_columns
    models = {"tree": fit_tree(train, x, LABEL, "classification", "gini", 5, classes=spec.classes),
              "forest": EN.forest_classifier(train, x, LABEL, 100, 5, classes=spec.classes)}
    return spec, models


@register("score_many_models")
def q_score_many_models(spark, sf):
    spec, models = _few_models(spark, sf)
    return B.score_many_models(_new_rows(spark, sf), spec, models, keep=["row_key"])


@register("score_points")
def q_score_points(spark, sf):
    """What-if points: every distinct (quantity, discount, flag, status)
    combination seen in lineitem, scored by all models."""
    spec, models = _few_models(spark, sf)
    pts = (T_(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_linestatus").distinct()
           .withColumn("l_tax", F.lit(0.04)).withColumn("l_linenumber", F.lit(1))
           .withColumn("point_id", F.concat_ws("|", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")))
    return B.score_points(pts, spec, models, keep=["point_id"])


def _scored_long(spark, sf):
    spec, models = _few_models(spark, sf)
    return spec, models, B.score_with_probabilities(_new_rows(spark, sf), spec, models, "row_key")


@register("ranked_probabilities")
def q_ranked_probabilities(spark, sf):
    spec, models, scored = _scored_long(spark, sf)
    return B.ranked_probabilities(scored, spec.classes, "row_key")


@register("point_comparison")
def q_point_comparison(spark, sf):
    spec, models, scored = _scored_long(spark, sf)
    return B.point_comparison(scored, "row_key")


@register("score_stream")
def q_score_stream(spark, sf):
    """Structured Streaming: lineitem read as a file stream, scored by the
    compiled tree micro-batch by micro-batch into a parquet sink (checkpoint
    in the shared folder); the sink is read back as the result."""
    import uuid

    from tabscope.plans.queries_prepare import scratch_dir
    from tabscope.streaming.scoring import score_stream, start_scoring
    spec, model, _ = _tree_cls(spark, sf, depth=4)
    schema = spark.read.parquet(f"{sf.rstrip('/')}/lineitem.parquet").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
              .parquet(sf.rstrip("/")))
    frame = stream.select(F.expr(ROW_KEY).alias("row_key"), *FEATURES)
    out = scratch_dir(spark, "scored-stream")
    q = start_scoring(score_stream(frame, spec, model, ["row_key"]), out, f"score_{uuid.uuid4().hex[:8]}",
                      trigger_once=True)
    q.awaitTermination()
    return spark.read.parquet(out)


_SCAN_COLS = ["row_key", *FEATURES, "net_price", "l_extendedprice"]


@register("scoring_scan", "SELECT " + ROW_KEY.replace("as string", "AS VARCHAR") + " AS row_key, "
          + ", ".join(FEATURES) + f", {NET} AS net_price, l_extendedprice FROM lineitem")
def q_scoring_scan(spark, sf):
    """New rows written as CSV and read back with the training schema minus
    the target (the reference's second upload)."""
    from tabscope.plans.queries_prepare import scratch_dir
    from tabscope.sources.files import csv_sink, scoring_scan
    frame = lineitem_frame(spark, sf)
    path = csv_sink(frame.drop("demand"), scratch_dir(spark, "new-rows"))
    return scoring_scan(spark, path, frame.schema, "demand")


# ------------------------------------------------------------------ scoring with fixed rule trees (SQL-checkable)
# The fitted preparation is real (categories and classes from lineitem); the
# trees are fixed rules, so the compiled CASE has an exact SQL twin.

def _rule_classifier(spec, q_cut: float = 25.5, d_cut: float = 0.055, counts=((10.0, 90.0), (20.0, 80.0), (70.0, 30.0))):
    from tabscope.operators.trees import Node, TreeModel
    fi = spec.x_columns.index
    m = TreeModel(spec.x_columns, "classification", "gini", spec.classes)
    m.nodes[1] = Node(1, 0, 0, 0.0, [0.0, 0.0], 0.0, feature=fi("l_quantity"), threshold=q_cut)
    m.nodes[2] = Node(2, 1, 0, 0.0, list(counts[0]), 0.0)
    m.nodes[3] = Node(3, 1, 0, 0.0, [0.0, 0.0], 0.0, feature=fi("l_discount"), threshold=d_cut)
    m.nodes[6] = Node(6, 2, 0, 0.0, list(counts[1]), 0.0)
    m.nodes[7] = Node(7, 2, 0, 0.0, list(counts[2]), 0.0)
    for nid in (2, 6, 7):
        m.nodes[nid].weight = sum(m.nodes[nid].stats)
    return m


def _rule_sql(q_cut, d_cut, counts, classes=("high", "low")):
    def probs(c):
        t = sum(c)
        return [x / t for x in c]
    leaves = [probs(c) for c in counts]

    def case(vals):
        return (f"CASE WHEN l_quantity <= {q_cut!r}e0 THEN {vals[0]} WHEN l_discount <= {d_cut!r}e0 THEN {vals[1]} "
                f"ELSE {vals[2]} END")
    pred = case([f"'{classes[max(range(2), key=lambda i: (p[i], -i))]}'" for p in leaves])
    pmax = case([f"{max(p)!r}e0" for p in leaves])
    pk = {c: case([f"{p[i]!r}e0" for p in leaves]) for i, c in enumerate(classes)}
    return pred, pmax, pk


_R1 = (25.5, 0.055, ((10.0, 90.0), (20.0, 80.0), (70.0, 30.0)))
_R2 = (10.5, 0.035, ((60.0, 40.0), (45.0, 55.0), (5.0, 95.0)))
_P1, _M1, _K1 = _rule_sql(*_R1)
_P2, _M2, _K2 = _rule_sql(*_R2)
_KEY_SQL = ROW_KEY.replace("as string", "AS VARCHAR")


def _cls_spec(spark, sf):
    return PreparationSpec.fit(lineitem_frame(spark, sf), "demand", FEATURES)


@register("predict_compiled_tree", f"SELECT {_KEY_SQL} AS row_key, {_P1} AS prediction, {_M1} AS max_probability FROM lineitem")
def q_predict_compiled_tree(spark, sf):
    spec = _cls_spec(spark, sf)
    d = spec.transform(_new_rows(spark, sf), keep=["row_key"], with_label=False)
    out = _rule_classifier(spec, *_R1).transform(d)
    return out.select("row_key", "prediction", F.array_max("probability").alias("max_probability"))


@register("score_classification_rule", f"SELECT {_KEY_SQL} AS row_key, {_P1} AS PREDICCION_demand, "
          f"{_M1} AS PROBABILIDAD_MAXIMA, {_K1['high']} AS PROB_high, {_K1['low']} AS PROB_low FROM lineitem")
def q_score_classification_rule(spark, sf):
    spec = _cls_spec(spark, sf)
    return B.score_classification(_new_rows(spark, sf), spec, _rule_classifier(spec, *_R1), keep=["row_key"]).drop(STATUS)


_DIRTY = {"l_quantity": "CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END",
          "l_discount": "CASE WHEN l_orderkey % 19 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE l_discount END"}


def _dirty_sql(spoilt):
    return " OR ".join(f"l_orderkey % {m} = 0" for m in spoilt)


@register("score_dirty_rows", f"""
SELECT row_key, {_P1} AS PREDICCION_demand, row_status FROM (
  SELECT {_KEY_SQL} AS row_key, CASE WHEN {_dirty_sql((17, 101, 19))} THEN 'imputed' ELSE 'scored' END AS row_status,
         CASE WHEN {_dirty_sql((17, 101))} THEN (SELECT median(l_quantity) FROM lineitem) ELSE l_quantity END AS l_quantity,
         CASE WHEN {_dirty_sql((19,))} THEN (SELECT median(l_discount) FROM lineitem) ELSE l_discount END AS l_discount
  FROM lineitem)
""")
def q_score_dirty_rows(spark, sf):
    """New rows with nulls and infinite values: every row comes back with its status."""
    spec = _cls_spec(spark, sf)
    new = T_(spark, sf, "lineitem").select(F.expr(ROW_KEY).alias("row_key"), *[F.expr(_DIRTY.get(c, c)).alias(c) for c in FEATURES])
    scored = B.score_classification(new, spec, _rule_classifier(spec, *_R1), keep=["row_key"])
    return scored.select("row_key", "PREDICCION_demand", STATUS)


@register("prediction_distribution_rule",
          f"SELECT {_P1} AS prediction, count(*) AS n FROM lineitem GROUP BY 1")
def q_prediction_distribution_rule(spark, sf):
    spec = _cls_spec(spark, sf)
    scored = B.score_classification(_new_rows(spark, sf), spec, _rule_classifier(spec, *_R1), keep=["row_key"])
    return B.prediction_distribution(scored, B.PREDICTION_PREFIX + spec.target)


@register("scored_rows_file", f"""
SELECT {_KEY_SQL} AS row_key, l_quantity, l_discount, l_tax, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus, l_extendedprice,
       {_P1} AS PREDICCION_demand, {_M1} AS PROBABILIDAD_MAXIMA, {_K1['high']} AS PROB_high, {_K1['low']} AS PROB_low, 'scored' AS row_status FROM lineitem
""")
def q_scored_rows_file(spark, sf):
    """All new rows with all their input columns and scores, written as CSV and read back."""
    from tabscope.plans.queries_prepare import scratch_dir
    from tabscope.sources.files import csv_scan, csv_sink
    spec = _cls_spec(spark, sf)
    scored = B.score_classification(_new_rows(spark, sf), spec, _rule_classifier(spec, *_R1))
    return csv_scan(spark, csv_sink(scored, scratch_dir(spark, "scored-rows")), schema=_long_numbers(scored.schema))


def _long_numbers(schema):
    """The same fields with every whole number as bigint."""
    from pyspark.sql import types as T
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegralType) else f.dataType) for f in schema.fields])


@register("score_regression_rule", f"SELECT {_KEY_SQL} AS row_key, CASE WHEN l_extendedprice <= 30000.5e0 "
          f"THEN 15000.0e0 ELSE 52000.0e0 END AS PREDICCION_net_price FROM lineitem")
def q_score_regression_rule(spark, sf):
    from tabscope.operators.trees import Node, TreeModel
    frame = lineitem_frame(spark, sf)
    spec = PreparationSpec.fit(frame, "net_price", FEATURES + ["l_extendedprice"], task="regression")
    m = TreeModel(spec.x_columns, "regression", "squared_error", None)
    m.nodes[1] = Node(1, 0, 0, 0.0, [0.0, 0.0, 0.0], 0.0, feature=spec.x_columns.index("l_extendedprice"),
                      threshold=30000.5)
    m.nodes[2] = Node(2, 1, 1, 1.0, [1.0, 15000.0, 0.0], 0.0)
    m.nodes[3] = Node(3, 1, 1, 1.0, [1.0, 52000.0, 0.0], 0.0)
    return B.score_regression(_new_rows(spark, sf), spec, m, keep=["row_key"]).drop(STATUS)


def _two_rules(spark, sf):
    spec = _cls_spec(spark, sf)
    return spec, {"tree1": _rule_classifier(spec, *_R1), "tree2": _rule_classifier(spec, *_R2)}


@register("score_many_models_rule",
          f"SELECT {_KEY_SQL} AS row_key, {_P1} AS PREDICCION_tree1, {_P2} AS PREDICCION_tree2 FROM lineitem")
def q_score_many_models_rule(spark, sf):
    spec, models = _two_rules(spark, sf)
    return B.score_many_models(_new_rows(spark, sf), spec, models, keep=["row_key"]).drop(STATUS)


_LONG_SQL = (f"SELECT 'tree1' AS model, {_KEY_SQL} AS row_key, 'high' AS class, {_K1['high']} AS probability FROM lineitem "
             f"UNION ALL SELECT 'tree1', {_KEY_SQL}, 'low', {_K1['low']} FROM lineitem "
             f"UNION ALL SELECT 'tree2', {_KEY_SQL}, 'high', {_K2['high']} FROM lineitem "
             f"UNION ALL SELECT 'tree2', {_KEY_SQL}, 'low', {_K2['low']} FROM lineitem")


@register("ranked_probabilities_rule", f"""
SELECT model, row_key, class, probability,
       row_number() OVER (PARTITION BY model, row_key ORDER BY probability DESC, class) AS rank
FROM ({_LONG_SQL})
""")
def q_ranked_probabilities_rule(spark, sf):
    spec, models = _two_rules(spark, sf)
    scored = B.score_with_probabilities(_new_rows(spark, sf), spec, models, "row_key")
    return B.ranked_probabilities(scored, spec.classes, "row_key")


@register("point_comparison_rule",
          f"SELECT 'tree1' AS model, {_KEY_SQL} AS row_key, {_P1} AS prediction, {_M1} AS max_probability FROM lineitem "
          f"UNION ALL SELECT 'tree2', {_KEY_SQL}, {_P2}, {_M2} FROM lineitem")
def q_point_comparison_rule(spark, sf):
    spec, models = _two_rules(spark, sf)
    scored = B.score_with_probabilities(_new_rows(spark, sf), spec, models, "row_key")
    return B.point_comparison(scored, "row_key")


_LEAF1 = "CASE WHEN l_quantity <= 25.5e0 THEN 2 WHEN l_discount <= 0.055e0 THEN 6 ELSE 7 END"


@register("tree_node_counts", f"""
WITH d AS (SELECT CAST({_LEAF1} AS BIGINT) AS leaf, {DEMAND} AS class FROM lineitem),
p AS (SELECT leaf AS node_id, class FROM d UNION ALL SELECT leaf // 2, class FROM d
      UNION ALL SELECT leaf // 4, class FROM d)
SELECT node_id, class, count(*) AS n FROM p WHERE node_id > 0 GROUP BY node_id, class
""")
def q_tree_node_counts(spark, sf):
    """M13 routing: rows per node and class for a tree over lineitem."""
    from tabscope.operators.trees import tree_node_counts
    spec = _cls_spec(spark, sf)
    frame = lineitem_frame(spark, sf)
    d = spec.transform(frame, keep=["row_key", "demand"], with_label=False)
    return tree_node_counts(_rule_classifier(spec, *_R1), d, "demand")

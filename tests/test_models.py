"""Trees and ensembles: brute-force split check and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import ensembles as EN
from tabscope.operators import metrics as V
from tabscope.operators.trees import best_split, fit_tree


def _gini(counts):
    n = counts.sum()
    return 1.0 - ((counts / n) ** 2).sum() if n else 0.0


def _brute_best(pdf, feats, y):
    best = None
    classes = sorted(pdf[y].unique())
    tot = np.array([(pdf[y] == c).sum() for c in classes], dtype=float)
    n = len(pdf)
    for fi, f in enumerate(feats):
        vals = np.sort(pdf[f].unique())
        for a, b in zip(vals, vals[1:]):
            thr = a / 2 + b / 2
            left = pdf[pdf[f] <= thr]
            lc = np.array([(left[y] == c).sum() for c in classes], dtype=float)
            rc = tot - lc
            gain = _gini(tot) - (lc.sum() * _gini(lc) + rc.sum() * _gini(rc)) / n
            key = (round(gain, 12), -fi, -thr)
            if best is None or key > best[0]:
                best = (key, f, thr, gain)
    return best


@pytest.fixture(scope="module")
def leaf_merge(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 1000, 1000)
    p = np.where(x < 500, 0.1, 0.334)
    lab = (rng.uniform(size=1000) < p).astype(int).astype(str)
    z = rng.integers(0, 5, 1000).astype(float)
    return pd.DataFrame({"x": x, "z": z, "label": lab})


def test_stump_equals_brute_force(spark, leaf_merge):
    pdf = leaf_merge
    df = spark.createDataFrame(pdf)
    row = best_split(df, ["x", "z"], "label", max_bins=2048).collect()[0]   # exact cuts
    _, f, thr, gain = _brute_best(pdf, ["x", "z"], "label")
    assert row["feature"] == f and row["threshold"] == pytest.approx(thr) and row["improvement"] == pytest.approx(gain)


def test_leaf_merge_split_is_kept(spark, leaf_merge):
    """Both leaves predict class 0, but the split must exist (no merging)."""
    m = fit_tree(spark.createDataFrame(leaf_merge[["x", "label"]]), ["x"], "label", max_depth=1)
    assert not m.nodes[1].is_leaf and m.n_leaves == 2


def test_tree_invariants(spark, leaf_merge):
    df = spark.createDataFrame(leaf_merge)
    m = fit_tree(df, ["x", "z"], "label", max_depth=4, min_samples_leaf=20)
    leaves = [n for n in m.nodes.values() if n.is_leaf]
    assert sum(n.n for n in leaves) == 1000
    assert all(n.n >= 20 for n in m.nodes.values())
    probs = m.transform(df).select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert probs.agg(F.min("s"), F.max("s")).first() == pytest.approx((1.0, 1.0))


def test_regression_r2_non_decreasing_in_depth(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 800)
    pdf = pd.DataFrame({"x": x, "y": np.sin(x) * 3 + rng.normal(0, 0.3, 800)})
    df = spark.createDataFrame(pdf)
    r2 = []
    for d in (1, 2, 3, 4):
        m = fit_tree(df, ["x"], "y", task="regression", max_depth=d)
        r2.append(V.regression_metrics(m.transform(df), "y", "prediction").first()["r2"])
    assert all(b >= a - 1e-12 for a, b in zip(r2, r2[1:]))


def test_min_samples_split_stops(spark, leaf_merge):
    df = spark.createDataFrame(leaf_merge)
    m = fit_tree(df, ["x", "z"], "label", max_depth=6, min_samples_split=400)
    assert all(n.is_leaf for n in m.nodes.values() if n.n < 400)


def test_adaboost_and_gbt_learn_a_rule(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 50, 600), rng.uniform(0, 0.1, 600)
    pdf = pd.DataFrame({"a": a, "b": b, "y": np.where((a > 25) & (b > 0.05), "hi", "lo")})
    df = spark.createDataFrame(pdf)
    for model in (EN.adaboost_classifier(df, ["a", "b"], "y", 6, 1.0),
                  EN.gbt_classifier(df, ["a", "b"], "y", 4, 0.5, 2)):
        acc = V.global_metrics(model.transform(df).select("y", "prediction")).first()["accuracy"]
        assert acc > 0.9


def test_forest_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.uniform(size=300), "y": rng.choice(["p", "q", "r"], 300)})
    m = EN.forest_classifier(spark.createDataFrame(pdf), ["a"], "y", 5, 3)
    s = m.transform(spark.createDataFrame(pdf)).select(F.aggregate("probability", F.lit(0.0), lambda x, y: x + y).alias("s"))
    lo, hi = s.agg(F.min("s"), F.max("s")).first()
    assert lo == pytest.approx(1.0) and hi == pytest.approx(1.0)


def test_quantile_and_huber_boosting(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, 600)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + rng.exponential(2.0, 600)})
    df = spark.createDataFrame(pdf)
    q = EN.gbt_regressor(df, ["x"], "y", 4, 1.0, 2, loss="quantile", alpha=0.9)
    below = q.transform(df).select((F.col("y") <= F.col("prediction")).cast("double").alias("b")).agg(F.avg("b")).first()[0]
    assert 0.8 < below < 0.97
    h = EN.gbt_regressor(df, ["x"], "y", 3, 0.5, 2, loss="huber")
    mae0 = float(np.mean(np.abs(pdf.y - pdf.y.median())))
    mae = V.regression_metrics(h.transform(df), "y", "prediction").first()["mae"]
    assert mae < mae0


def test_materialised_routing_and_join_transform_match(spark, monkeypatch):
    from tabscope.operators import trees as TR
    rng = np.random.default_rng(12)
    x = rng.uniform(0, 20, 800)
    pdf = pd.DataFrame({"x": x, "z": rng.uniform(size=800), "y": np.sin(x) + rng.normal(0, .1, 800)})
    df = spark.createDataFrame(pdf)
    a = fit_tree(df, ["x", "z"], "y", "regression", max_depth=6, min_samples_leaf=5)
    monkeypatch.setattr(TR, "ROUTE_EXPR_MAX_SPLITS", 2)
    b = fit_tree(df, ["x", "z"], "y", "regression", max_depth=6, min_samples_leaf=5)
    assert set(a.nodes) == set(b.nodes)
    assert all((a.nodes[k].feature, a.nodes[k].threshold, a.nodes[k].n) ==
               (b.nodes[k].feature, b.nodes[k].threshold, b.nodes[k].n) for k in a.nodes)
    p1 = a.transform(df).select("x", "z", F.col("prediction").alias("p")).toPandas()
    monkeypatch.setattr(TR, "COMPILE_MAX_NODES", 4)
    p2 = b.transform(df).select("x", "z", F.col("prediction").alias("p")).toPandas()
    m = p1.merge(p2, on=["x", "z"])
    assert len(m) == 800 and np.allclose(m.p_x, m.p_y)


def test_registered_learners_have_the_reference_sizes(monkeypatch):
    from tabscope.catalog import QUERIES
    from tabscope.plans import queries_models as Q
    sizes = {}
    monkeypatch.setattr(Q, "prepared", lambda spark, sf, task="classification", binning=None: (
        type("Spec", (), {"x_columns": [], "classes": []}), None, None))
    monkeypatch.setattr(Q, "_sides", lambda split: (None, None))
    monkeypatch.setattr(Q, "_test_predictions", lambda model, test, task: model)
    for learner in ("forest", "adaboost", "gbt", "bagging"):
        for kind in ("classifier", "regressor"):
            monkeypatch.setattr(Q.EN, f"{learner}_{kind}", lambda t, x, label, n, *a, **k: n)
            sizes[f"{learner}_{kind}"] = QUERIES[f"{learner}_{kind}"](None, "")
    assert sizes == {f"{m}_{k}": n for m, n in (("forest", 100), ("adaboost", 50), ("gbt", 100), ("bagging", 10)) for k in ("classifier", "regressor")}

"""Evaluation edge cases: report zeros, ROC ties and a class without positives."""

import pytest

from tabscope.operators import metrics as V


def test_report_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, prediction string")
    rep = {r["class"]: r for r in V.classification_report(df).collect()}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["recall"] == 0.0 and rep["c"]["f1"] == 0.0
    assert rep["accuracy"]["f1"] == pytest.approx(0.5)
    cm = V.confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r["n"] for r in cm) == 4


def test_roc_ties_and_auc(spark):
    rows = [("1", 0.9), ("0", 0.9), ("1", 0.8), ("0", 0.3), ("1", 0.3), ("0", 0.1)]
    df = spark.createDataFrame(rows, "y string, s double")
    auc = V.auc_binary(df, "y", "s", "1").first()["auc"]
    # brute force: P(score_pos > score_neg) + 0.5 P(tie)
    pos = [s for y, s in rows if y == "1"]
    neg = [s for y, s in rows if y == "0"]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(exp)
    curve = V.roc_curve_binary(df, "y", "s", "1", drop_intermediate=False).orderBy("point").collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (0.0, 0.0) and (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)


def test_class_without_positives_null_auc(spark):
    df = spark.createDataFrame([("a", [0.7, 0.3, 0.0]), ("b", [0.2, 0.8, 0.0]), ("a", [0.6, 0.1, 0.3])],
                               "y string, p array<double>")
    t = {r["class"]: r["auc"] for r in V.auc_table(df, "y", "p", ["a", "b", "c"]).collect()}
    assert t["c"] is None and t["macro"] is None and t["a"] == pytest.approx(1.0)


def test_regression_metrics_constant_target(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, prediction double")
    assert V.regression_metrics(df).first()["r2"] == 1.0


def test_scatter_points_and_residuals(spark):
    from tabscope.operators import bivariate as BV
    d = spark.createDataFrame([(1.0, 3.0, 5.0), (2.0, 5.0, 5.0), (3.0, 7.0, None), (None, 1.0, 2.0)], "a double, b double, c double")
    got = sorted(tuple(r) for r in BV.scatter_points(d, [("a", "b"), ("c", "b")]).where("x_name = 'a'").collect())
    assert [(x, y) for _, _, x, y, _ in got] == [(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)]
    assert all(abs(f - y) < 1e-9 for _, _, _, y, f in got)
    points = V.actual_vs_predicted_points(d, "a", "c").collect()
    assert sorted(tuple(p) for p in points) == [(1.0, 5.0, -4.0), (2.0, 5.0, -3.0)]

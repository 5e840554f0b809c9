"""Cleaning, encoding, binning and split on hand fixtures."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import cleaning as C
from tabscope.operators import encoding as E
from tabscope.operators import split as L
from tabscope.operators import target as TG
from tabscope.operators.prepare import LABEL, PreparationSpec


def test_binning_edges_right_closed_first_closed(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 2.0, 3.0, 4.0]], "y double")
    out, edges = TG.bin_equal_width(df, "y", 4)
    got = [r["bin_id"] for r in out.orderBy("y").collect()]
    exp = pd.cut([0.0, 1.0, 2.0, 3.0, 4.0], bins=edges, include_lowest=True, labels=False).tolist()
    assert got == exp


def test_quantile_edges_duplicate_raise(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 1.0, 1.0, 2.0, 3.0]], "y double")
    with pytest.raises(ValueError):
        TG.bin_quantile(df, "y", 4)


def test_label_collision_keeps_bins(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 0.001, 0.002, 0.003]], "y double")
    out, edges = TG.bin_equal_width(df, "y", 2)
    labels = TG.bin_labels(edges)
    assert labels[0] == labels[1] == "0.00-0.00"
    assert sorted(r["bin_id"] for r in out.collect()) == [0, 0, 1, 1]


def test_custom_edges_cover_range():
    assert TG.custom_edges("5, 2,2", 0.0, 9.0) == [0.0, 2.0, 5.0, 9.0]
    with pytest.raises(ValueError):
        TG.custom_edges("3", 0.0, 9.0)


def test_normalize_label_strips_and_drops_question_mark(spark):
    df = spark.createDataFrame([(" a ",), ("?",), (" ? ",), ("\tb",), (None,)], "y string")
    assert sorted(r["y"] for r in C.normalize_label(df, "y").collect()) == ["a", "b"]


def test_one_hot_unseen_and_null_are_zero(spark):
    train = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    cats = E.fit_categories(train, ["c"])
    new = spark.createDataFrame([("y",), ("new",), (None,)], "c string")
    out = E.align_to_training(new, [], cats, E.design_columns(train, ["c"], cats)).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 0), (0, 0)]


def test_split_exact_quotas(spark):
    pdf = pd.DataFrame({"k": range(1003), "y": ["a"] * 700 + ["b"] * 290 + ["c"] * 13})
    df = spark.createDataFrame(pdf)
    s = L.split(df, "k", 0.2, 42, "y").toPandas()
    n_test = math.ceil(0.2 * 1003)
    assert s.is_test.sum() == n_test
    quotas = L.stratified_quotas({"a": 700, "b": 290, "c": 13}, 0.2)
    for c, q in quotas.items():
        assert (~s[s.y == c].is_test).sum() == q
    again = L.split(df.repartition(7), "k", 0.2, 42, "y").toPandas()
    assert set(again[again.is_test].k) == set(s[s.is_test].k)      # partition independent


def test_split_fallback_when_a_class_is_single(spark):
    pdf = pd.DataFrame({"k": range(50), "y": ["a"] * 49 + ["rare"]})
    out, stratified = L.split_with_fallback(spark.createDataFrame(pdf), "k", "y", 0.2, 1)
    assert not stratified and out.where(F.col("is_test")).count() == 10


def test_preparation_fill_and_score_new_rows(spark):
    rows = [(i, float(i % 7) if i % 5 else None, ["n", "s", "e"][i % 3] if i % 4 else None,
             "yes" if i % 2 else "no") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y string")
    spec = PreparationSpec.fit(df, "y", ["x", "c"], strategy="fill")
    assert spec.classes == ["no", "yes"]
    t = spec.transform(df, keep=["id"])
    assert t.count() == 60 and t.where(F.col("x").isNull()).count() == 0
    new = spark.createDataFrame([(100, None, "unseen")], "id long, x double, c string")
    scored = spec.transform(new, keep=["id"], with_label=False).collect()[0]
    assert scored["x"] == spec.medians["x"]
    assert all(scored[c] == 0 for c in spec.x_columns if c.startswith("c_"))


@pytest.mark.parametrize("strategy", ["drop", "fill"])
def test_scoring_returns_every_row(spark, strategy):
    from tabscope.operators.scoring import score_regression
    from tabscope.operators.trees import fit_tree
    schema = "id long, x double, n double, c string"
    df = spark.createDataFrame([(i, float(i % 7), float(i), "ab"[i % 2], float(i % 7)) for i in range(40)], schema + ", y double")
    spec = PreparationSpec.fit(df, "y", ["x", "n", "c"], strategy=strategy)
    model = fit_tree(spec.transform(df), spec.x_columns, "label", "regression", "squared_error", 3)
    inf = float("inf")
    new = spark.createDataFrame([(1, 2.0, 1.0, "a"), (2, None, 1.0, "a"), (3, inf, 1.0, "b"), (4, 1.0, -inf, None), (5, float("nan"), 1.0, "z")], schema)
    got = {r["id"]: r for r in score_regression(new, spec, model, ["id"]).collect()}
    assert {i: r["row_status"] for i, r in got.items()} == {1: "scored", 2: "imputed", 3: "imputed", 4: "imputed", 5: "imputed"}
    assert all(r["PREDICCION_y"] is not None for r in got.values())
    spec.medians["x"] = None  # nothing to impute with
    got = {r["id"]: r for r in score_regression(new, spec, model, ["id"]).collect()}
    assert len(got) == 5 and [i for i, r in sorted(got.items()) if r["PREDICCION_y"] is None and r["row_status"] == "refused"] == [2, 3, 5]


def test_scored_rows_keep_their_input_columns(spark):
    from tabscope.operators.scoring import score_classification, score_many_models, score_regression
    from tabscope.operators import trees as TR
    rows = [(i, float(i % 7), "ab"[i % 2], "hi" if i % 7 > 3 else "lo") for i in range(70)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y string")
    spec = PreparationSpec.fit(df, "y", ["x", "c"])
    model = TR.fit_tree(spec.transform(df), spec.x_columns, "label", "classification", classes=spec.classes)
    new = spark.createDataFrame([(1, None, "a", "old", 5), (2, 6.0, "z", "old", 6)], "id long, x double, c string, PREDICCION_y string, `a.b` int")
    got = score_classification(new, spec, model)
    assert got.columns == ["id", "x", "c", "a.b", "PREDICCION_y", "PROBABILIDAD_MAXIMA", "PROB_hi", "PROB_lo", "row_status"]
    by = {r["id"]: r for r in got.collect()}
    assert (by[1]["x"], by[1]["c"], by[1]["a.b"], by[1]["row_status"]) == (None, "a", 5, "imputed")
    assert (by[2]["x"], by[2]["c"], by[2]["PREDICCION_y"], by[2]["row_status"]) == (6.0, "z", "hi", "scored")
    assert score_many_models(new, spec, {"m": model}, ["c"]).columns == ["c", "PREDICCION_m", "row_status"]
    assert score_classification(new, spec, model, []).columns[0] == "PREDICCION_y"
    codes = df.withColumn("label", F.when(F.col("y") == "hi", 7).otherwise(3)).select("label", "x")
    small = TR.fit_tree(codes, ["x"], "label", "classification")
    joined = small._transform_by_joins(codes, "prediction", None, None)
    assert joined.schema["prediction"].dataType == small.transform(codes).schema["prediction"].dataType
    assert joined.filter("prediction <> label").count() == 0


def test_csv_columns_without_values_are_numeric(spark, tmp_path):
    from tabscope.sources.files import csv_scan
    (tmp_path / "t.csv").write_text("a,b,c\n1,,x\n2,NA,\n")
    got = csv_scan(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "double", "string"]

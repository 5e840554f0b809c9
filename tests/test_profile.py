"""Profiling operators on fixtures with nulls, NaN, ties and constants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import profile as P
from tabscope.operators import cleaning as C


@pytest.fixture
def missing_mix(spark):
    pdf = pd.DataFrame({"id": range(8),
                        "x": [1.0, None, float("nan"), 4.0, 4.0, 10.0, -2.0, 4.0],
                        "c": ["a", None, "b", "a", "b", "c", None, "a"]})
    return spark.createDataFrame(pdf)


def test_descriptive_stats_matches_pandas(spark, missing_mix):
    row = P.descriptive_stats(missing_mix, ["x"]).collect()[0]
    s = pd.Series([1.0, None, None, 4.0, 4.0, 10.0, -2.0, 4.0])
    assert row["mean"] == pytest.approx(s.mean())
    assert row["median"] == pytest.approx(s.median())
    assert row["std"] == pytest.approx(s.std())
    assert row["skew"] == pytest.approx(s.skew())
    assert row["kurtosis"] == pytest.approx(s.kurtosis())
    assert row["nulls"] == 2


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    h = P.histogram(df, "x", 30).toPandas()
    assert len(h) == 30 and h.n.sum() == 4
    assert h.loc[h.n > 0, "bin"].tolist() == [15]          # numpy puts it in the middle bin


def test_histogram_matches_numpy(spark):
    vals = np.random.default_rng(0).gamma(2.0, 3.0, 3000)
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    h = P.histogram(df, "x", 30).toPandas().sort_values("bin")
    counts, _ = np.histogram(vals, bins=30)
    assert h.n.tolist() == counts.tolist()


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "a", "b", "c"]], "c string")
    assert C.mode_table(df, "c").first()["mode"] == "a"


def test_mode_all_null_unknown(spark):
    df = spark.createDataFrame([(None,), (None,)], "c string")
    assert C.fit_modes(df, ["c"]) == {"c": C.UNKNOWN_CATEGORY}


def test_null_report_counts_nan_as_null(spark, missing_mix):
    rep = {r["column_name"]: r for r in P.column_null_report(missing_mix).collect()}
    assert rep["x"]["nulls"] == 2 and rep["c"]["nulls"] == 2 and rep["id"]["nulls"] == 0


def test_density_integrates_to_one(spark):
    vals = np.random.default_rng(5).normal(0, 1, 2000)
    d = P.density_curve(spark.createDataFrame(pd.DataFrame({"x": vals})), "x").toPandas()
    area = np.trapezoid(d.density, d.x)
    assert area == pytest.approx(1.0, abs=0.01)


@pytest.mark.parametrize("shape", ["normal", "ties", "far"])
def test_density_equals_the_exact_sum(spark, shape):
    rng = np.random.default_rng(6)
    vals = {"normal": rng.normal(3, 2, 700), "ties": rng.integers(0, 4, 700).astype(float),
            "far": np.concatenate([rng.normal(0, 1e-3, 700), [1e6]])}[shape]
    d = P.density_curve(spark.createDataFrame(pd.DataFrame({"x": vals})), "x").toPandas()
    bw = vals.std(ddof=1) * len(vals) ** -0.2
    assert np.allclose(d.x, np.linspace(vals.min() - 3 * bw, vals.max() + 3 * bw, 200))
    want = np.exp(-0.5 * ((d.x.to_numpy()[:, None] - vals) / bw) ** 2).sum(1) / (len(vals) * bw * np.sqrt(2 * np.pi))
    assert np.allclose(d.density * bw, want * bw, rtol=0, atol=1e-13)


def test_density_without_spread_has_no_points(spark):
    for vals in ([2.0] * 5, [1.0], []):
        assert P.density_curve(spark.createDataFrame([(v,) for v in vals], "x double"), "x").count() == 0


def test_qq_points_hot_value_chunks(spark):
    vals = [1.0] * 50 + [2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    pts = P.qq_points(df, "x", chunk=7).toPandas().sort_values("position")
    assert pts.position.tolist() == list(range(52))
    assert pts["sample"].tolist() == sorted(vals)


def test_kendall_matches_brute_force(spark):
    from tabscope.operators.bivariate import _kendall_pair
    rng = np.random.default_rng(0)
    x = rng.integers(0, 40, 300).astype(float)
    y = (x * 0.3 + rng.integers(0, 7, 300)).astype(float)
    got = _kendall_pair(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", fanout=4).first()["tau"]
    s = sum(np.sum(np.sign(x[i] - x[i + 1:]) * np.sign(y[i] - y[i + 1:])) for i in range(300))
    n0 = 300 * 299 / 2
    n1 = sum(c * (c - 1) / 2 for c in pd.Series(x).value_counts())
    n2 = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    assert got == pytest.approx(s / np.sqrt((n0 - n1) * (n0 - n2)), abs=1e-12)


def test_category_shares_declined_above_ten(spark):
    rows = [(f"c{i % 12}",) for i in range(120)]
    df = spark.createDataFrame(rows, "c string")
    assert P.category_shares(df, "c").count() == 0
    few = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    shares = {r["category"]: r["share"] for r in P.category_shares(few, "c").collect()}
    assert shares == {"a": 2 / 3, "b": 1 / 3}


def test_probability_plot_tasks_follow_the_rows(spark, monkeypatch):
    """Positions are expanded in tasks that hold a bounded number of them, however few bytes the values take."""
    monkeypatch.setattr(P, "TASK_POSITIONS", 100)
    df = spark.range(1000).select((F.col("id") % 400).cast("double").alias("v"))
    pts = P.qq_points(df, "v")
    assert sorted((r["position"], r["sample"]) for r in pts.collect()) == list(enumerate(sorted(float(i % 400) for i in range(1000))))
    assert pts.groupBy(F.spark_partition_id()).count().count() >= 6

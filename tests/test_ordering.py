"""Exact quantiles, prefix sums and ranks against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators.bivariate import rank_table
from tabscope.plans import ordering as O


def _df(spark, values, name="x"):
    return spark.createDataFrame(pd.DataFrame({name: values}))


@pytest.mark.parametrize("values", [
    [1.0, 1.0, 1.0, 1.0, 2.0, 3.0],
    [5.0],
    [3.0, None, 1.0, float("nan"), 2.0],
    list(np.random.default_rng(1).exponential(3.0, 5000)),
    [7.0] * 3000 + list(np.arange(1000, dtype=float)),     # one hot value, a third or more of all rows
])
def test_exact_quantiles_match_pandas(spark, values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in O.exact_quantiles(_df(spark, values), ["x"], probs).collect()}
    exp = pd.Series(values, dtype="float64").dropna().quantile(probs)
    for p in probs:
        assert got[p] == pytest.approx(exp[p], rel=1e-12, abs=1e-12)


def test_exact_quantiles_refine_small_buckets(spark):
    # force the nested refinement with a tiny bucket bound
    rng = np.random.default_rng(7)
    values = list(rng.lognormal(0, 2, 4000))
    probs = [0.01, 0.5, 0.99]
    got = {r["prob"]: r["quantile"] for r in
           O.exact_quantiles(_df(spark, values), ["x"], probs, buckets=8, max_bucket_rows=10).collect()}
    exp = pd.Series(values).quantile(probs)
    for p in probs:
        assert got[p] == pytest.approx(exp[p], rel=1e-12)


def test_exact_quantiles_all_null_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    rows = O.exact_quantiles(df, ["a", "b"], [0.5]).collect()
    assert {r["column_name"] for r in rows} == {"a"}


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 2000), "v": rng.integers(0, 50, 2000).astype(float),
                        "m": rng.integers(1, 5, 2000)})
    df = spark.createDataFrame(pdf)
    out = O.prefix_sums(df, ["k"], "v", ["m"], buckets=8).toPandas()
    for _, row in out.sample(50, random_state=1).iterrows():
        exp = pdf[(pdf.k == row.k) & (pdf.v <= row.v)].m.sum()
        assert row.cum_m == exp
    desc = O.prefix_sums(df, [], "v", ["m"], descending=True, buckets=4).toPandas()
    for _, row in desc.sample(30, random_state=2).iterrows():
        assert row.cum_m == pdf[pdf.v >= row.v].m.sum()


def test_rank_ties_average(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    rt = {r["value"]: r["avg_rank"] for r in rank_table(_df(spark, vals), "x").collect()}
    exp = pd.Series(vals).rank(method="average")
    for v, rk in zip(vals, exp):
        assert rt[v] == rk


def test_inverse_normal(spark):
    import statistics
    ps = [1e-10, 0.001, 0.2, 0.5, 0.8, 0.999999]
    from tabscope.functions.normal import inv_norm
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(inv_norm("p")).collect()]
    for p, g in zip(ps, got):
        assert g == pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-12)


def test_next_row_of_a_key_across_buckets(spark):
    """``following`` reads the next row, whether it stands in the same bucket or not, without a join."""
    df = spark.range(90).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"), (F.col("id") * 7 % 11).alias("m"))
    for descending in (False, True):
        out = O.prefix_sums(df, ["k"], "v", ["m"], descending, 8, ["m"])
        rows = {(r["k"], r["v"]): r["next_m"] for r in out.collect()}
        step = -2 if descending else 2
        assert rows == {(i % 2, float(i)): (i + step) * 7 % 11 if 0 <= i + step < 90 else None for i in range(90)}
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0

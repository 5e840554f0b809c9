"""Steps that the learners share: split, cuts, packing and bootstrap counts do their work once a row."""

import math

import numpy as np
from pyspark.sql import functions as F

from tabscope.operators import split as L
from tabscope.operators.joint_trees import blocks, pack, poisson_counts, uniforms
from tabscope.operators.trees import fit_cuts
from tabscope.plans import ordering


def test_split_hashes_a_row_once_per_branch(spark):
    df = spark.range(5_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 3).cast("string").alias("y"))
    for stratify in (None, "y"):
        out = L.split(df, "key", stratify=stratify)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 2
        got = out.collect()
        assert len(got) == 5_000 and sum(r["is_test"] for r in got) == 1_000


def test_split_of_rows_without_a_key_and_with_one_key(spark):
    rows = [(None, "a")] * 3 + [("same", "a")] * 40 + [(f"k{i}", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "key string, y string")
    out = L.split(df, "key")
    assert out.count() == 100  # rows without a key are on no side
    kept = df.where("key is not null")
    assert L.split(kept, "key").where("is_test").count() == 20
    # a class whose quota falls into one bucket of equal keys is cut there
    assert {r[0]: r[1] for r in L.split(kept, "key", 0.25, stratify="y").where("is_test").groupBy("y").count().collect()} == {"a": 10, "b": 15}


def test_quantile_passes_read_open_columns_only(spark, monkeypatch):
    seen = []
    real = ordering._exploded_paths

    def spy(dbl, cols, bounds, depth, buckets, only):
        seen.append([cols[i] for i in sorted(only)])
        return real(dbl, cols, bounds, depth, buckets, only)
    monkeypatch.setattr(ordering, "_exploded_paths", spy)
    df = spark.range(4_001).select((F.col("id") % 5).cast("double").alias("few"), (F.col("id") * F.col("id")).cast("double").alias("many"))
    got = {r["column_name"]: r["quantile"] for r in ordering.exact_quantiles(df, ["few", "many"], [0.5]).collect()}
    assert got == {"few": 2.0, "many": 4_000_000.0}
    assert seen == [["few", "many"], ["many"]]


def test_cuts_and_bins(spark):
    values = [(-0.0, 1.0, 7.0), (0.0, 2.0, 7.0), (4.0, 3.0, 7.0), (2.0, math.inf, 7.0)] + [(2.0, float(i), 7.0) for i in range(4, 400)]
    df = spark.createDataFrame(values, "a double, b double, c double").coalesce(1)
    cuts = fit_cuts(df, ["a", "b", "c"])
    assert cuts[0] == [1.0, 3.0] and cuts[2] == [] and 200 < len(cuts[1]) <= 255
    packed = pack(df, ["a", "b", "c"], F.col("a"), cuts)
    x = np.concatenate([b[0] for b in blocks(packed.df.toArrow().to_batches(), 3, packed.kind)])
    raw = np.array(values)
    for i in range(3):
        assert (np.sort(x[:, i]) == np.sort([sum(c < v for c in cuts[i]) for v in raw[:, i]])).all()


def test_bootstrap_counts_are_the_inverse_of_the_distribution():
    keys = np.random.default_rng(5).integers(-1 << 62, 1 << 62, 50_000)
    for rate in (0.1, 1.0, 30.0):
        p, cdf = math.exp(-rate), [math.exp(-rate)]
        while cdf[-1] < 1 - 1e-12 and len(cdf) < 400:
            p *= rate / len(cdf)
            cdf.append(cdf[-1] + p)
        assert (poisson_counts(keys, 3, 9, rate) == (uniforms(keys, 3, 9)[:, None] >= np.array(cdf)).sum(1)).all()

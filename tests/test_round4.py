"""Findings of round 4."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabscope import catalog
from tabscope.operators import ensembles as EN
from tabscope.operators import joint_trees as J
from tabscope.operators.trees import _impurity_py, fit_cuts, fit_tree


def _lineitem(spark, path, n: int = 400):
    (spark.range(n).selectExpr("id AS l_orderkey", "id % 20 AS l_partkey", "id % 7 AS l_suppkey", "cast(id % 5 + 1 as int) AS l_linenumber",
                               "cast(id % 50 + 1 as double) AS l_quantity", "cast(1000 + (id * 37) % 901 as double) AS l_extendedprice",
                               "(id * 3) % 11 / 100 AS l_discount", "id % 9 / 100 AS l_tax", "substring('ANR', cast(id % 3 as int) + 1, 1) AS l_returnflag",
                               "substring('OF', cast(id % 2 as int) + 1, 1) AS l_linestatus").write.parquet(f"{path}/lineitem.parquet"))
    return str(path)


@pytest.mark.parametrize("query", ["fit_and_compare", "model_comparison_fitted"])
def test_comparison_without_a_model_is_no_result(spark, monkeypatch, tmp_path, query):
    """a learner that cannot be fitted fails the query; before, its rows were just missing."""
    def stump(train, features, label, *a, classes, **k):
        return fit_tree(train, features, label, "classification", "gini", 1, classes=classes)

    def broken(*a, **k):
        raise ValueError("no better than chance")
    for name in ("forest_classifier", "adaboost_classifier", "gbt_classifier", "bagging_classifier"):
        monkeypatch.setattr(EN, name, stump)
    sf = _lineitem(spark, tmp_path)
    models = {r[0] for r in catalog.QUERIES[query](spark, sf).select("model").distinct().collect()}
    assert models == {"decision_tree", "random_forest", "adaboost", "gradient_boosting", "bagging"}
    monkeypatch.setattr(EN, "adaboost_classifier", broken)
    with pytest.raises(RuntimeError, match="not fitted: adaboost: no better than chance"):
        catalog.QUERIES[query](spark, sf)


def test_failed_job_is_not_a_models_error(spark):
    """what fails in Spark is raised, not put down to the estimator."""
    df = spark.range(20).selectExpr("cast(id as double) AS a", "cast(id % 2 as string) AS k", "id")
    tree = lambda t: fit_tree(t, ["a"], "k", max_depth=1)
    with pytest.raises(PySparkException, match="lost"):
        EN.fit_and_compare(df, df, ["a"], "k", {"tree": tree, "x": lambda t: t.select(F.raise_error(F.lit("lost"))).collect()}, "id")
    assert not df.is_cached


def test_plans_do_not_hold_the_bit_set(spark):
    """op11's driver kept the set of possible repeats as text and numbers in every plan that used it."""
    from tabscope.llm.filter_audit import possible_repeats
    rows = spark.range(50_000).select(F.xxhash64(F.col("id") % 49_000).alias("h"))
    kept = rows.filter(possible_repeats(rows)(F.col("h")))
    assert len(kept._jdf.queryExecution().toString()) < 20_000
    assert kept.groupBy("h").count().filter("count > 1").count() == 1_000


def _grown(rng, splits: int, bins: int):
    grove, open_ = J.Grove(1), [0]
    for _ in range(splits):
        node = open_.pop(rng.integers(len(open_)))
        open_ += grove.split(node, int(rng.integers(4)), int(rng.integers(bins)))
    return grove


def test_trees_by_tables_are_trees_by_comparisons():
    """F2-F9: trees of up to eight tests are walked by looking up the bins."""
    rng = np.random.default_rng(4)
    for k in range(60):
        grove = _grown(rng, k % 12, 300 if k % 2 else 20)
        x = rng.integers(0, 256 if k % 2 else 22, (4, 300)).astype(np.uint8).T
        routes = grove.arrays()
        want = routes.node_of(x.astype(np.uint16), 0)
        assert (routes.node_of(x, 0) == want).all()
        place = rng.random(len(grove.tree))
        assert (J.placer(routes.walk(0), place)(x) == place[want]).all()


def test_blocks_pass_to_python_in_small_batches(spark, monkeypatch):
    """F2-F9: a task's blocks were one Arrow batch; the session's setting comes back, also with several threads."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(J, "BLOCK_ROWS", 1 << 6)
    monkeypatch.setattr(J, "BATCH_BYTES", "1k")
    df = spark.range(0, 4000, numPartitions=1).selectExpr("cast(id % 5 as double) AS a", "cast(id as double) AS y")
    packed = J.pack(df, ["a"], F.col("y"), [[0.5, 1.5]])

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["k"])
    with ThreadPoolExecutor(3) as pool:
        tables = list(pool.map(lambda _: packed.fetch(packed.df.mapInArrow(sizes, "k long")), range(6)))
    for t in tables:
        assert max(t.column("k").to_pylist()) <= 2 and sum(t.column("k").to_pylist()) == packed.df.count()
    assert spark.conf.get(name) == before


def test_tasks_come_in_whole_waves(spark, monkeypatch):
    """F2-F9: where a core takes several tasks, all cores take as many."""
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(1)
    monkeypatch.setattr(J, "PART_MOST", 1 << 15)
    assert J._parts(df, cores << 15) == cores and J._parts(df, (cores << 15) + 1) == 2 * cores
    assert J._parts(df, 100) == 1 and J._parts(df, J.PART_ROWS + 1) == 2


def test_impurities_of_many_nodes_are_those_of_each(spark):
    """nodes of a tail are told apart by columns, not one by one; the trees are those of Spark's levels."""
    rng = np.random.default_rng(6)
    for task, criterion in (("classification", "gini"), ("classification", "entropy"), ("regression", "squared_error"), ("regression", "poisson")):
        s = rng.integers(0, 4, (3, 60)).astype(float)
        got = J._node_impurity(s, task, criterion)
        want = [_impurity_py(v.tolist(), v.sum() if task == "classification" else v[0], task, criterion) for v in s.T]
        assert np.allclose(got, want, rtol=0, atol=1e-12)
    df = spark.range(600).selectExpr("cast(id % 23 as double) AS a", "cast((id * 13) % 17 as double) AS b", "cast((id * id) % 97 as double) AS y")
    packed = J.pack(df, ["a", "b"], F.col("y"), fit_cuts(df, ["a", "b"]))

    def leaves(local):
        stats = EN._bootstrap(2, True, 1.0, 3, None)
        trees = J.grow(packed, 2, stats, 3, 3, "regression", "squared_error", 60, local_rows=local)
        forest, x = J.Forest(trees, EN._means), np.array([(a, b) for a in range(23) for b in range(17)], float)
        return forest.each(x).tolist()
    assert all(t.tails for t in J.grow(packed, 2, EN._bootstrap(2, True, 1.0, 3, None), 3, 3, "regression", "squared_error", 60, local_rows=100))
    assert np.allclose(leaves(100), leaves(0))


def test_guided_quantiles_are_exact(spark, monkeypatch):
    """with rows that tell where a quantile is, one pass finds it; a bad guess costs a pass, never the result."""
    rng = np.random.default_rng(8)
    y = np.concatenate([rng.normal(0, 1e3, 1500), np.zeros(200), [-0.0, 1e300, -1e300, 5e-324], np.repeat(2.5, 40)])
    df = spark.createDataFrame([(float(i % 3), float(v)) for i, v in enumerate(y)], "g double, y double").repartition(3)
    packed = J.pack(df, ["g"], F.col("y"), fit_cuts(df, ["g"]))
    monkeypatch.setattr(J, "PICK_ROWS", 100)
    monkeypatch.setattr(J, "GUIDE_ROWS", 300)
    values, passes, fetch = (lambda x, y, key, state: (x[:, 0].astype(np.int64), y)), [], J.Packed.fetch
    guided = J.guide(packed)
    assert 200 <= len(guided[1]) <= 600
    far = (*guided[:1], guided[1] + 1e6, *guided[2:])
    monkeypatch.setattr(J.Packed, "fetch", lambda self, t: passes.append(1) or fetch(self, t))
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = {k: pytest.approx(np.quantile(y[k::3], q)) for k in range(3)}
        passes.clear()
        assert J.group_quantiles(packed, values, q, guided) == want and len(passes) == 1
        assert J.group_quantiles(packed, values, q, far) == want
        one_group = tuple(v[guided[0][:, 0] == 0] for v in guided)
        assert J.group_quantiles(packed, values, q, one_group) == want
    monkeypatch.setattr(J, "GUIDED_ROWS", 10)  # too many expected: the other way
    assert J.group_quantiles(packed, values, 0.5, guided) == {k: pytest.approx(np.quantile(y[k::3], 0.5)) for k in range(3)}


@pytest.mark.parametrize("loss", ["huber", "quantile", "absolute_error"])
def test_guided_boosting_is_the_same(spark, monkeypatch, loss):
    df = spark.range(900).selectExpr("cast(id % 20 as double) AS a", "cast((id * 7) % 13 as double) AS b", "cast((id * 37) % 101 as double) + id % 20 AS y")

    def fit():
        m = EN.gbt_regressor(df, ["a", "b"], "y", 3, 0.3, 2, loss=loss)
        return m.init, [[(i, n.feature, n.n, v.get(i)) for i, n in sorted(t.nodes.items())] for r in m.rounds for t, v in r]
    monkeypatch.setattr(EN, "SNAPSHOT", 2)
    want = fit()
    monkeypatch.setattr(J, "PICK_ROWS", 50)
    monkeypatch.setattr(J, "GUIDE_ROWS", 200)
    assert fit() == want

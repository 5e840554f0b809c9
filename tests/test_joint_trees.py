"""Jointly grown trees and boosting against numpy brute force."""

import gc
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import ensembles as EN
from tabscope.operators import joint_trees as J
from tabscope.operators.trees import fit_cuts, fit_tree


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 700
    pdf = pd.DataFrame({"a": rng.integers(0, 40, n) / 4, "b": rng.integers(0, 9, n).astype(float), "c": rng.integers(0, 3, n).astype(float)})
    pdf["y"] = 3 * (pdf.a > 5) + pdf.b * (pdf.c == 1) + rng.normal(0, 0.5, n)
    pdf["k"] = np.where(pdf.a > 6, "p", np.where(pdf.b > 4, "q", "r"))
    pdf["id"] = np.arange(n)
    return pdf, spark.createDataFrame(pdf).repartition(3).cache()


def stump(x, g, w=None):
    """Best squared-error cut by brute force: (feature, threshold, left mean, right mean)."""
    w = np.ones(len(g)) if w is None else w
    best = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[:-1] + v[1:]) / 2:
            m = x[:, f] <= t
            wl, wr = w[m].sum(), w[~m].sum()
            a, b = (w[m] * g[m]).sum() / wl, (w[~m] * g[~m]).sum() / wr
            gain = wl * wr * (a - b) ** 2
            if best is None or gain > best[0] * (1 + 1e-12):
                best = (gain, f, t, a, b)
    return best[1:]


def predict_stump(x, s):
    return np.where(x[:, s[0]] <= s[1], s[2], s[3])


@pytest.mark.parametrize("loss", ["squared_error", "absolute_error", "huber", "quantile"])
def test_boosting_rounds_match_brute_force(table, monkeypatch, loss):
    pdf, df = table
    monkeypatch.setattr(EN, "SNAPSHOT", 2)  # the state is written inside the run
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf.y.to_numpy()
    alpha, rate, rounds = 0.8, 0.4, 5
    f = np.full(len(y), y.mean() if loss == "squared_error" else np.quantile(y, alpha if loss == "quantile" else 0.5))
    for _ in range(rounds):
        d = y - f
        delta = np.quantile(np.abs(d), alpha)
        g = {"squared_error": d, "absolute_error": np.sign(d), "quantile": np.where(d > 0, alpha, alpha - 1), "huber": np.clip(d, -delta, delta)}[loss]
        s = stump(x, g)
        left = x[:, s[0]] <= s[1]
        step = np.zeros(len(y))
        for m in (left, ~left):
            if loss == "squared_error":
                step[m] = d[m].mean()
            elif loss == "huber":
                med = np.median(d[m])
                step[m] = med + np.clip(d[m] - med, -delta, delta).mean()
            else:
                step[m] = np.quantile(d[m], alpha if loss == "quantile" else 0.5)
        f = f + rate * step
    m = EN.gbt_regressor(df, ["a", "b", "c"], "y", rounds, rate, 1, loss, alpha=alpha)
    got = m.transform(df).orderBy("id").select("prediction").toPandas().prediction.to_numpy()
    assert np.allclose(got, f)


def test_multiclass_boosting_matches_brute_force(table, monkeypatch):
    pdf, df = table
    monkeypatch.setattr(EN, "SNAPSHOT", 2)
    x, classes = pdf[["a", "b", "c"]].to_numpy(), ["p", "q", "r"]
    hot = np.stack([(pdf.k == c).to_numpy() for c in classes], 1).astype(float)
    raw = np.tile(np.log(hot.mean(0)), (len(x), 1))
    for _ in range(3):
        p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
        r = hot - p
        nxt = raw.copy()
        for k in range(3):
            s = stump(x, r[:, k])
            left = x[:, s[0]] <= s[1]
            for m in (left, ~left):
                a = np.abs(r[m, k])
                nxt[m, k] += 0.3 * 2 / 3 * r[m, k].sum() / (a * (1 - a)).sum()
        raw = nxt
    want = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
    m = EN.gbt_classifier(df, ["a", "b", "c"], "k", 3, 0.3, 1, classes=classes)
    rows = m.transform(df).orderBy("id").select("probability", "prediction").collect()
    assert np.allclose([r["probability"] for r in rows], want)
    assert [r["prediction"] for r in rows] == [classes[i] for i in want.argmax(1)]


def test_adaboost_weights_match_brute_force(table, monkeypatch):
    pdf, df = table
    monkeypatch.setattr(EN, "SNAPSHOT", 2)
    x, y, classes = pdf[["a", "b", "c"]].to_numpy(), pdf.k.to_numpy(), ["p", "q", "r"]
    w, alphas = np.ones(len(y)), []
    m = EN.adaboost_classifier(df, ["a", "b", "c"], "k", 4, 0.7, classes)
    for tree, alpha in m.trees:
        root = tree.nodes[1]
        left = x[:, root.feature] <= root.threshold
        vote = np.empty(len(y), object)
        for side in (left, ~left):
            vote[side] = max(classes, key=lambda c: w[side & (y == c)].sum())
        err = w[vote != y].sum() / w.sum()
        alphas.append((alpha, 0.7 * (math.log((1 - err) / err) + math.log(2))))
        assert sum(sum(n.stats) for n in tree.nodes.values() if n.is_leaf) == pytest.approx(len(y))  # normalised
        w = w * np.where(vote != y, math.exp(alpha), 1)
    assert len(alphas) == 4 and all(a == pytest.approx(b) for a, b in alphas)


def test_adaboost_regression_follows_its_weights(table):
    pdf, df = table
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf.y.to_numpy()
    w, preds, betas = np.ones(len(y)), [], []
    for _ in range(4):
        s = stump(x, y, w)
        e = np.abs(predict_stump(x, s) - y)
        avg = (w * e / e.max()).sum() / w.sum()
        beta = avg / (1 - avg)
        preds.append(predict_stump(x, s))
        betas.append(0.5 * math.log(1 / beta))
        w = w * beta ** (0.5 * (1 - e / e.max()))
    each, weight = np.stack(preds, 1), np.array(betas)
    order = np.argsort(each, 1, kind="stable")
    reached = np.cumsum(weight[order], 1) >= 0.5 * weight.sum()
    want = each[np.arange(len(y)), order[np.arange(len(y)), reached.argmax(1)]]
    m = EN.adaboost_regressor(df, ["a", "b", "c"], "y", 4, 0.5, max_depth=1)
    assert np.allclose(m.transform(df).orderBy("id").toPandas().prediction, want)


@pytest.mark.parametrize("task,criterion", [("classification", "gini"), ("classification", "entropy"), ("regression", "squared_error"), ("regression", "poisson")])
def test_one_plain_tree_equals_the_single_tree_learner(table, task, criterion):
    pdf, df = table
    label = "k" if task == "classification" else "z"
    df = df.withColumn("z", F.abs("y"))
    single = fit_tree(df, ["a", "b", "c"], label, task, criterion, 5, 12, 4)
    fit = EN.forest_classifier if task == "classification" else EN.forest_regressor
    joint = fit(df, ["a", "b", "c"], label, 2, 5, 4, criterion, "all", bootstrap=False, min_samples_split=12)
    for tree in joint.trees:
        assert {i: (n.feature, n.threshold, n.n) for i, n in tree.nodes.items()} == {i: (n.feature, n.threshold, n.n) for i, n in single.nodes.items()}


@pytest.mark.parametrize("max_features", ["all", "sqrt"])
def test_nodes_finished_locally_equal_level_wise_growth(table, monkeypatch, max_features):
    """Fully grown trees: joint levels, several jobs a level, distributed cuts and local tails give one model."""
    pdf, df = table
    df = df.withColumn("k", F.when(F.col("id") % 5 == 0, "q").otherwise(F.col("k")))
    fit = lambda: EN.forest_classifier(df, ["a", "b", "c"], "k", 3, 20, 1, "gini", max_features, key="id")
    monkeypatch.setattr(EN, "LOCAL_ROWS", 0)
    want = [r["probability"] for r in fit().transform(df).orderBy("id").collect()]
    monkeypatch.setattr(EN, "LOCAL_ROWS", 150)
    local = fit()
    assert any(t.tails for t in local.trees)
    assert np.allclose([r["probability"] for r in local.transform(df).orderBy("id").collect()], want)
    monkeypatch.setattr(J, "CELLS", 1000)
    monkeypatch.setattr(J, "FEW_CELLS", 50)
    monkeypatch.setattr(J, "PART_ROWS", 100)
    monkeypatch.setattr(EN, "LOCAL_ROWS", 40)
    assert np.allclose([r["probability"] for r in fit().transform(df).orderBy("id").collect()], want)


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_tails_that_stay_in_spark_score_like_fetched_ones(table, monkeypatch, task):
    """Fully grown trees above NEAR_ROWS: no tail comes to the driver, rows meet them in a join; rows may repeat."""
    pdf, df = table
    df = df.unionByName(df.where("id < 40")).withColumn("k", F.when(F.col("id") % 5 == 0, "q").otherwise(F.col("k")))
    fit, label, out = ((EN.bagging_classifier, "k", "probability") if task == "classification" else (EN.bagging_regressor, "y", "prediction"))
    monkeypatch.setattr(EN, "LOCAL_ROWS", 150)
    near = fit(df, ["a", "b", "c"], label, 3, key="id")
    want = near.transform(df).orderBy("id").select("id", out).collect()
    monkeypatch.setattr(J, "NEAR_ROWS", 0)
    far = fit(df, ["a", "b", "c"], label, 3, key="id")
    assert any(t.tails for t in near.trees) and not any(t.tails for t in far.trees) and far.trees.far.count() > 0
    got = far.transform(df).orderBy("id")
    assert got.columns == near.transform(df).columns
    got = got.select("id", out).collect()
    assert [r["id"] for r in got] == [r["id"] for r in want]
    assert np.allclose([r[out] for r in got], [r[out] for r in want], rtol=0, atol=1e-12)


def test_walks_by_columns_equal_walks_by_rows(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.asfortranarray(rng.integers(0, 200, (500, 3)).astype("<u1"))
    grove, open_ = J.Grove(2), [1]
    for k in range(120):
        open_ += grove.split(open_.pop(int(rng.integers(len(open_)))), int(rng.integers(3)), int(rng.integers(199)))
    want = []
    for row in x:
        i = 1
        while grove.feature[i] >= 0:
            i = grove.left[i] if row[grove.feature[i]] <= grove.bin[i] else grove.right[i]
        want.append(i)
    assert grove.arrays().node_of(x, 1).tolist() == want and set(grove.arrays().node_of(x, 0)) == {0}
    monkeypatch.setattr(J, "FEW_NODES", 10)
    assert grove.arrays().node_of(x, 1).tolist() == want


def test_blocks_hold_rows_by_column(table):
    """Packed rows stand in blocks, not one record each, whatever the partitions."""
    pdf, df = table
    packed = J.pack(df.repartition(2), ["a", "b", "c"], F.col("y"), fit_cuts(df, ["a", "b", "c"]), [0.0])
    assert packed.df.count() <= 2 and packed.rows == len(pdf)
    moved = packed.with_state(lambda x, y, key, state: state + 1)
    assert J.group_sums(moved, lambda x, y, key, state: (x[:, 2].astype(np.int64), state[:, 0])) == {
        c: (float(n), n) for c, n in pdf.c.astype(int).value_counts().items()}


def test_packed_rows_reach_every_task(spark, monkeypatch):
    """Filled partitions beside many empty ones, as a split leaves them: every task still gets its share."""
    monkeypatch.setattr(J, "PART_ROWS", 100)
    monkeypatch.setattr(J, "BLOCK_ROWS", 100)
    empty = spark.range(0).repartition(40)
    df = empty.unionByName(spark.range(60_000).repartition(2)).select(F.col("id").cast("double").alias("a"))
    packed = J.pack(df, ["a"], F.col("a"), [[10.0, 20.0]])
    sizes = [r[1] for r in packed.df.groupBy(F.spark_partition_id()).agg(F.sum("n")).collect()]
    assert packed.rows == sum(sizes) == 60_000 and len(sizes) >= 3 and max(sizes) <= 20_000


def test_forest_keeps_leaves_of_one_class_apart(spark):
    """Three classes: a cut whose two leaves predict the same class stays, and moves the probabilities."""
    rows = [(float(x), "a" if j < (6 if x < 5 else 9) else "b" if j < 10 else "c") for x in range(10) for j in range(12)]
    df = spark.createDataFrame(rows, "x double, k string")
    for criterion in ("gini", "entropy"):
        m = EN.forest_classifier(df, ["x"], "k", 1, 1, 1, criterion, bootstrap=False)
        got = {r["x"]: r["probability"] for r in m.transform(df).collect()}
        assert got[0.0] == pytest.approx([6 / 12, 4 / 12, 2 / 12]) and got[9.0] == pytest.approx([9 / 12, 1 / 12, 2 / 12])


def test_bootstrap_counts_do_not_depend_on_partitions(table):
    pdf, df = table
    a = EN.forest_regressor(df, ["a", "b", "c"], "y", 5, 4, key="id")
    b = EN.forest_regressor(df.repartition(7, "b"), ["a", "b", "c"], "y", 5, 4, key="id")
    assert [[(i, n.n, n.feature) for i, n in t.nodes.items()] for t in a.trees] == [[(i, n.n, n.feature) for i, n in t.nodes.items()] for t in b.trees]
    w = J.poisson_counts(np.arange(200_000), 1, 2, 1.0)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


@pytest.mark.parametrize("few", [1 << 16, 40, 0])
def test_group_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(J, "PICK_ROWS", few)
    rng = np.random.default_rng(8)
    y = np.concatenate([rng.normal(0, 1e3, 300), np.zeros(50), [-0.0, 1e300, -1e300, 5e-324], np.repeat(2.5, 40)])
    df = spark.createDataFrame([(float(i % 3), float(v)) for i, v in enumerate(y)], "g double, y double").repartition(3)
    packed = J.pack(df, ["g"], F.col("y"), fit_cuts(df, ["g"]))
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = J.group_quantiles(packed, lambda x, y, key, state: (x[:, 0].astype(np.int64), y), q)
        assert got == {k: pytest.approx(np.quantile(y[k::3], q)) for k in range(3)}


def test_fit_and_compare_reports_failures(table):
    pdf, df = table

    def broken(t):
        raise ValueError("no")
    models, preds, errors = EN.fit_and_compare(df, df, ["a"], "k", {"x": broken, "tree": lambda t: fit_tree(t, ["a"], "k", max_depth=1)}, "id")
    assert set(models) == {"tree"} and errors == {"x": "no"} and preds.count() == len(pdf)
    models, preds, errors = EN.fit_and_compare(df, df, ["a"], "k", {"x": broken}, "id")
    assert models == {} and preds.collect() == [] and set(errors) == {"x"}
    assert EN.error_table(df.sparkSession, ["x", "tree"], errors).collect()[0]["error"] == "no"


def test_rows_keep_their_places_when_classes_are_filtered(spark):
    """two classes do not gather all rows in two tasks."""
    from tabscope.operators.prepare import PreparationSpec
    df = spark.range(0, 6000, numPartitions=6).selectExpr("cast(id % 7 as double) AS a", "CASE WHEN id % 4 = 0 THEN ' yes' ELSE 'no\\t' END AS t",
                                                          "cast(id as string) AS k")
    out = PreparationSpec.fit(df, "t", ["a"]).transform(df, keep=["k"])
    assert out.groupBy(F.spark_partition_id()).count().count() == 6
    assert {(r[0], r[1]) for r in out.groupBy("label").count().collect()} == {("yes", 1500), ("no", 4500)}


def test_stripped_text_is_what_two_replacements_give(spark):
    from tabscope.operators.cleaning import strip_text
    texts = ["a", "", " ", " a", "a ", "a b", "\ta\n", "a \x85", "a ", " a  ", " a ", "\x0ba\f\r", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", r"^\s+", ""), r"\s+$", "")
    assert df.where(~strip_text(F.col("t")).eqNullSafe(plain)).count() == 0


def test_blocks_are_cached_while_in_use(spark):
    """F3-F6: levels read the packed rows from memory, and leave none behind."""
    df = spark.range(100).selectExpr("cast(id % 5 as double) AS a", "cast(id as double) AS y")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    packed = J.pack(df, ["a"], F.col("y"), [[0.5, 1.5]])
    assert packed.df.storageLevel.useMemory and packed.df.storageLevel.useDisk
    assert packed.df.agg(F.sum("n")).first()[0] == 100
    del packed
    gc.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_adaboost_round_is_its_levels_and_one_pass(spark, monkeypatch):
    """the largest error comes with the sums."""
    passes, gather = [], J.Packed.gather
    monkeypatch.setattr(J.Packed, "gather", lambda self, *a: passes.append(1) or gather(self, *a))
    df = spark.range(400).selectExpr("cast(id % 20 as double) AS a", "cast((id * 37) % 101 as double) + id % 20 AS y")
    model = EN.adaboost_regressor(df, ["a"], "y", 3, 0.5, max_depth=1)
    assert len(model.trees) == 3 and len(passes) == 6


def test_few_cells_reach_the_driver_and_cuts_are_the_same(spark, monkeypatch):
    """at most some 8 MB of cells are fetched at once; chosen in tasks the cuts are the same."""
    assert J.FEW_CELLS * 8 * 6 <= 8 << 20
    df = spark.range(3000).selectExpr("cast(id % 23 as double) AS a", "cast((id * 13) % 17 as double) AS b", "cast((id * id) % 97 as double) AS y")

    def nodes():
        model = EN.forest_regressor(df, ["a", "b"], "y", 3, 4)
        return [(i, n.feature, n.threshold, n.n, round(n.stats[1], 6)) for t in model.trees for i, n in sorted(t.nodes.items())]
    here = nodes()
    monkeypatch.setattr(J, "FEW_CELLS", 1)
    assert nodes() == here

"""Ensembles (M3-M11) on jointly grown trees.

Every learner bins and packs its rows once (``joint_trees.pack``). Forests and
bagging grow all trees together, level by level, with bootstrap counts and
feature subsets from hashes. AdaBoost and gradient boosting keep their weights
or scores as a state column: a round's jobs read the last written state and
add the few trees grown since, and every ``SNAPSHOT`` rounds the state is
written to the session's shared checkpoint folder. So the plan of a round never
grows with the number of rounds.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from py4j.protocol import Py4JError
from pyspark import StorageLevel, cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.operators.joint_trees import (Forest, Packed, Trees, far_scores, group_most, group_quantiles, group_sums, grow, guide, pack,
                                            poisson_counts, score_column)
from tabscope.operators.trees import TreeModel, fit_cuts
from tabscope.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as in joint_trees

#: Rounds between two written states.
SNAPSHOT = 10
#: Rows below which a deep tree's node is finished in one task.
LOCAL_ROWS = 1 << 14


def _classes_of(df: DataFrame, label: str) -> list:
    return [r[0] for r in df.select(label).distinct().orderBy(label).collect()]


def _class_index(label: str, classes: Sequence) -> Column:
    e = None
    for i, c in enumerate(classes):
        e = F.when(F.col(label) == F.lit(c), F.lit(float(i))) if e is None else e.when(F.col(label) == F.lit(c), F.lit(float(i)))
    return e


def _argmax_label(prob: Column, classes: Sequence) -> Column:
    """Class of the largest probability (first on ties, as numpy argmax)."""
    mx = F.array_max(prob)
    idx = F.array_position(prob, mx)
    return F.element_at(F.array(*[F.lit(c) for c in classes]), idx.cast("int"))


@dataclass
class MatrixModel:
    """A fitted ensemble whose output is a function of the feature matrix.

    ``of_matrix`` gives class probabilities, or the prediction in one column;
    it runs in Arrow batches and holds the trees as flat arrays.
    """
    name: str
    task: str
    features: list[str]
    classes: list | None
    of_matrix: Callable[[np.ndarray], np.ndarray]
    trees: list = field(default_factory=list)

    def transform(self, df: DataFrame, prediction: str = "prediction", probability: str | None = "probability",
                  leaf: str | None = None) -> DataFrame:
        out = self._outputs(df)
        if self.task == "regression":
            return out.withColumn(prediction, F.col("_out")[0]).drop("_out")
        out = out.withColumn(prediction, _argmax_label(F.col("_out"), self.classes))
        return out.withColumnRenamed("_out", probability) if probability else out.drop("_out")


    def _outputs(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_out", score_column(self.features, self.of_matrix))


@dataclass
class FarModel(MatrixModel):
    """Mean of trees whose lower parts are a table (``Trees.far``): rows meet them in a join, no process holds a whole tree.

    The scored rows are written to the checkpoint folder once, numbered.
    """
    top: Forest | None = None
    values: Callable | None = None
    n_stats: int = 3

    def _outputs(self, df: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(df.sparkSession)
        rows = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
        each = far_scores(rows, "_row", self.features, self.trees, self.top, self.values, self.n_stats)
        ordered = F.array_sort(F.collect_list(F.struct("tree", "v")))
        zero = F.array_repeat(F.lit(0.0), 1 if self.classes is None else len(self.classes))
        total = F.aggregate(ordered, zero, lambda acc, e: F.zip_with(acc, e["v"], lambda a, b: a + b))
        mean = each.groupBy("_row").agg(F.transform(total, lambda v: v / len(self.trees)).alias("_out"))
        return rows.join(mean, "_row").drop("_row")


def _forest_model(name: str, task: str, features: list[str], classes: list | None, trees: Trees, values: Callable, n_stats: int) -> MatrixModel:
    top, width = Forest(trees, values), 1 if classes is None else len(classes)
    if trees.far is None:
        return MatrixModel(name, task, features, classes, _mean_of(top, width), trees)

    def nowhere(x: np.ndarray) -> np.ndarray:
        raise ValueError("this model's trees are a table; use transform")
    return FarModel(name, task, features, classes, nowhere, trees, top, values, n_stats)


def _mean_of(forest: Forest, width: int) -> Callable:
    def of_matrix(x: np.ndarray) -> np.ndarray:
        return forest.add(x, np.zeros((len(x), width))) / max(1, len(forest.roots))
    return of_matrix


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


# ------------------------------------------------------------------ M3 / M4 / M9 / M10

def _n_features(max_features: str | int | float | None, n: int) -> int | None:
    if max_features in (None, "all", "auto"):
        return None
    if max_features == "sqrt":
        return max(1, int(math.sqrt(n)))
    if max_features == "log2":
        return max(1, int(math.log2(n)))
    return max(1, int(max_features * n)) if isinstance(max_features, float) else int(max_features)


def _bootstrap(n_trees: int, bootstrap: bool, rate: float, seed: int, n_classes: int | None) -> Callable:
    """Statistics of a bootstrap sample per tree: class weights, or (w, w y, w y^2)."""
    def stats(x, y, key, state):
        hot = None if n_classes is None else (y[None, :] == np.arange(n_classes)[:, None]).astype(float)

        def of(t: int) -> np.ndarray:
            w = poisson_counts(key, seed, t, rate) if bootstrap else np.ones(len(y))
            if hot is not None:
                return hot * w
            out = np.empty((3, len(y)))
            out[0] = w
            np.multiply(w, y, out[1])
            np.multiply(out[1], y, out[2])
            return out
        return of
    return stats


def forest_classifier(train: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100,
                      max_depth: int = 5, min_samples_leaf: int = 1, criterion: str = "gini",
                      max_features: str = "sqrt", bootstrap: bool = True, max_samples: float = 1.0,
                      seed: int = 42, classes: Sequence | None = None, max_bins: int = 256,
                      name: str = "random_forest", min_samples_split: int = 2, key: str | None = None) -> MatrixModel:
    """Bootstrap trees with soft voting for any number of classes, gini or entropy.

    The bootstrap draws Poisson(``max_samples``) copies of each row by a hash
    of (seed, tree, row); ``key`` names a column that identifies rows, by
    default their place in the scan does.
    """
    features = list(features)
    classes = list(classes) if classes is not None else _classes_of(train, label)
    criterion = "entropy" if criterion in ("entropy", "log_loss") else "gini"
    cuts = fit_cuts(train, features, max_bins)
    packed = pack(train, features, _class_index(label, classes), cuts, key=key)
    k = len(classes)
    trees = grow(packed, n_estimators, _bootstrap(n_estimators, bootstrap, max_samples, seed, k), k, k, "classification", criterion,
                 max_depth, min_samples_split, min_samples_leaf, classes, _n_features(max_features, len(features)), seed,
                 local_rows=LOCAL_ROWS if max_depth > 8 else 0)

    def shares(t, stats, ids):
        total = stats.sum(1, keepdims=True)
        return np.where(total > 0, stats / np.where(total > 0, total, 1), 1 / k)
    return _forest_model(name, "classification", features, classes, trees, shares, k)


def forest_regressor(train: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100,
                     max_depth: int = 5, min_samples_leaf: int = 1, criterion: str = "squared_error",
                     max_features: str = "all", bootstrap: bool = True, max_samples: float = 1.0,
                     seed: int = 42, max_bins: int = 256, name: str = "random_forest", min_samples_split: int = 2,
                     key: str | None = None) -> MatrixModel:
    """Mean of bootstrap trees. A classification criterion is replaced by
    squared error (as the reference does); squared and friedman errors rank
    splits identically."""
    if criterion not in ("squared_error", "friedman_mse", "poisson", "gini", "entropy", "log_loss"):
        raise NotImplementedError(f"forest criterion {criterion!r} is not available")
    criterion = criterion if criterion == "poisson" else "squared_error"
    features = list(features)
    packed = pack(train, features, F.col(label), fit_cuts(train, features, max_bins), key=key)
    trees = grow(packed, n_estimators, _bootstrap(n_estimators, bootstrap, max_samples, seed, None), 3, 3, "regression", criterion,
                 max_depth, min_samples_split, min_samples_leaf, None, _n_features(max_features, len(features)), seed,
                 local_rows=LOCAL_ROWS if max_depth > 8 else 0)
    return _forest_model(name, "regression", features, None, trees, _means, 3)


def _means(t, stats: np.ndarray, ids) -> np.ndarray:
    return (stats[:, 1] / np.where(stats[:, 0] > 0, stats[:, 0], 1))[:, None]


#: The deepest tree of bagging: node numbers stay within 62 bits.
UNLIMITED = 60


def bagging_classifier(train: DataFrame, features: Sequence[str], label: str, n_estimators: int = 10,
                       max_samples: float = 1.0, seed: int = 42, classes: Sequence | None = None,
                       max_bins: int = 256, name: str = "bagging", key: str | None = None) -> MatrixModel:
    """Bootstrap samples of ``max_samples`` x n rows, all features, fully grown
    trees, mean probability."""
    return forest_classifier(train, features, label, n_estimators, UNLIMITED, 1, "gini", "all", True,
                             max_samples, seed, classes, max_bins, name, key=key)


def bagging_regressor(train: DataFrame, features: Sequence[str], label: str, n_estimators: int = 10,
                      max_samples: float = 1.0, seed: int = 42, max_bins: int = 256,
                      name: str = "bagging", key: str | None = None) -> MatrixModel:
    return forest_regressor(train, features, label, n_estimators, UNLIMITED, 1, "squared_error", "all", True,
                            max_samples, seed, max_bins, name, key=key)


# ------------------------------------------------------------------ boosting state

class _State:
    """Packed rows whose state lags behind by the trees grown since it was last written; so does that of the ``guide``'s rows."""

    def __init__(self, packed: Packed, advance: Callable, guide: tuple | None = None):
        self.packed, self.advance, self.since, self.guide = packed, advance, [], guide

    def current(self) -> Callable:
        """The up-to-date state of a batch as a function of (x, y, state); travels into tasks."""
        since, advance = list(self.since), self.advance

        def now(x, y, state):
            for step in since:
                state = advance(step, x, y, state)
            return state
        return now

    def add(self, step) -> None:
        self.since.append(step)
        if len(self.since) >= SNAPSHOT:
            now = self.current()
            self.packed = self.packed.with_state(lambda x, y, key, state: now(x, y, state))
            if self.guide is not None:
                x, y, key, given = self.guide
                self.guide = x, y, key, now(x, y, given)
            self.since = []


def _add_scores(step, x, y, state):
    return step.add(x, state.copy())


# ------------------------------------------------------------------ M7 / M8

@dataclass
class BoostedModel(MatrixModel):
    """Additive model: ``init`` plus the learning rate times leaf values, per output."""
    init: list[float] = field(default_factory=list)
    #: Per round and output: the tree and its leaf values by node id.
    rounds: list = field(default_factory=list)


def _round_forest(trees: list[TreeModel], values: list[dict], rate: float, cuts) -> Forest:
    """One round: output t gets the scaled values of tree t."""
    def vector(t, stats, ids):
        out = np.zeros((len(ids), len(trees)))
        out[:, t] = [rate * values[t].get(i, 0.0) for i in ids]
        return out
    return Forest(trees, vector, cuts)


def _raw_of(init: Sequence[float], rounds: list, rate: float) -> Callable:
    forests, start = [_round_forest([t for t, _ in r], [v for _, v in r], rate, None) for r in rounds], np.array(init, float)

    def raw(x: np.ndarray) -> np.ndarray:
        out = np.tile(start, (len(x), 1))
        for f in forests:
            f.add(x, out)
        return out
    return raw


def gbt_classifier(train: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100,
                   learning_rate: float = 0.1, max_depth: int = 3, min_samples_leaf: int = 1,
                   classes: Sequence | None = None, max_bins: int = 256,
                   name: str = "gradient_boosting", min_samples_split: int = 2) -> BoostedModel:
    """Log-loss gradient boosting with prior initialisation, one regression
    tree per class and round (one for binary), all trees of a round grown
    together, Newton leaf values sum(r) / sum(|r| (1-|r|)) (x (K-1)/K for
    K > 2), as in the published multinomial deviance algorithm. The sums of a
    leaf come with its cut, so a round is one job per level."""
    features = list(features)
    classes = list(classes) if classes is not None else _classes_of(train, label)
    k = len(classes)
    cuts = fit_cuts(train, features, max_bins)
    prior = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n = sum(prior.values())
    if k == 2:
        p = prior.get(classes[1], 0) / n
        init = [math.log(p / (1 - p))]
    else:
        init = [math.log(max(prior.get(c, 0), 1e-300) / n) for c in classes]
    state = _State(pack(train, features, _class_index(label, classes), cuts, init), _add_scores)
    factor, outputs, rounds = (k - 1) / k if k > 2 else 1.0, len(init), []
    for _ in range(n_estimators):
        now = state.current()

        def stats(x, y, key, given, now=now):
            raw = now(x, y, given)
            if outputs == 1:
                r = (y - 1 / (1 + np.exp(-raw[:, 0])))[:, None]
            else:
                r = (y[:, None] == np.arange(outputs)) - _softmax(raw)
            return lambda t: np.stack([np.ones(len(y)), r[:, t], r[:, t] ** 2, np.abs(r[:, t]) * (1 - np.abs(r[:, t]))])
        trees = grow(state.packed, outputs, stats, 4, 3, "regression", "friedman_mse", max_depth, min_samples_split, min_samples_leaf)
        values = [{i: factor * m.stats[1] / m.stats[3] if abs(m.stats[3]) > 1e-150 else 0.0 for i, m in t.nodes.items() if m.is_leaf}
                  for t in trees]
        rounds.append(list(zip(trees, values)))
        state.add(_round_forest(trees, values, learning_rate, cuts))
    raw = _raw_of(init, rounds, learning_rate)

    def probabilities(x: np.ndarray) -> np.ndarray:
        out = raw(x)
        if outputs > 1:
            return _softmax(out)
        p1 = 1 / (1 + np.exp(-out[:, 0]))
        return np.stack([1 - p1, p1], 1)
    return BoostedModel(name, "classification", features, classes, probabilities, [t for r in rounds for t, _ in r], init, rounds)


def gbt_regressor(train: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100,
                  learning_rate: float = 0.1, max_depth: int = 3, loss: str = "squared_error",
                  seed: int = 42, max_bins: int = 256, name: str = "gradient_boosting", alpha: float = 0.9,
                  min_samples_leaf: int = 1, min_samples_split: int = 2) -> BoostedModel:
    """Gradient boosting for squared_error, absolute_error, huber and quantile losses.

    Squared error starts at the mean and keeps the leaves' mean residuals.
    Else init: median (absolute, huber) or alpha-quantile (quantile). Each round
    fits a friedman-MSE tree to the negative gradient, then sets each leaf to:
    the median of the residuals (absolute); the median plus the mean of the
    residuals' deviations clipped at the huber delta, delta being the
    alpha-quantile of |residual| (huber); the alpha-quantile of the residuals
    (quantile). Quantiles are exact and distributed (``group_quantiles``)."""
    features = list(features)
    if loss not in ("squared_error", "absolute_error", "huber", "quantile"):
        raise ValueError(f"unsupported loss {loss!r}")
    cuts = fit_cuts(train, features, max_bins)
    start = pack(train, features, F.col(label), cuts, [0.0])
    everything = lambda x, y, key, given: (np.zeros(len(y), np.int64), y)
    if loss == "squared_error":
        total, n = group_sums(start, everything).get(0, (0.0, 0))
        init = total / max(1, n)
    else:
        init = group_quantiles(start, everything, alpha if loss == "quantile" else 0.5).get(0, 0.0)
    state, rounds = _State(start, _add_scores, None if loss == "squared_error" else guide(start)), []
    for _ in range(n_estimators):
        now = state.current()

        def diff(x, y, given, now=now):
            return y - init - now(x, y, given)[:, 0]
        delta = None
        if loss == "huber":
            delta = group_quantiles(state.packed, lambda x, y, key, given: (np.zeros(len(y), np.int64), np.abs(diff(x, y, given))), alpha, state.guide).get(0, 0.0)

        def stats(x, y, key, given, diff=diff, delta=delta):
            d = diff(x, y, given)
            g = (d if loss == "squared_error" else np.sign(d) if loss == "absolute_error"
                 else np.where(d > 0, alpha, alpha - 1) if loss == "quantile" else np.clip(d, -delta, delta))
            return lambda t: np.stack([np.ones(len(y)), g, g * g])
        tree = grow(state.packed, 1, stats, 3, 3, "regression", "friedman_mse", max_depth, min_samples_split, min_samples_leaf)[0]
        if loss == "squared_error":
            values = {i: m.stats[1] / m.weight if m.weight else 0.0 for i, m in tree.nodes.items() if m.is_leaf}
        else:
            ids = sorted(tree.nodes)
            place = Forest([tree], lambda t, s, ids: np.array(ids, float)[:, None], cuts)

            def by_leaf(x, y, key, given, diff=diff, place=place):
                return place.each(x)[:, 0].astype(np.int64), diff(x, y, given)
            values = group_quantiles(state.packed, by_leaf, alpha if loss == "quantile" else 0.5, state.guide)
            if loss == "huber":
                middle = np.array([values.get(i, 0.0) for i in ids])
                order = np.array(ids)

                def clipped(x, y, key, given, by_leaf=by_leaf, middle=middle, order=order, delta=delta):
                    leaf, d = by_leaf(x, y, key, given)
                    return leaf, np.clip(d - middle[np.searchsorted(order, leaf)], -delta, delta)
                values = {i: values.get(i, 0.0) + s / n for i, (s, n) in group_sums(state.packed, clipped).items()}
        rounds.append([(tree, values)])
        state.add(_round_forest([tree], [values], learning_rate, cuts))
    return BoostedModel(name, "regression", features, None, _raw_of([init], rounds, learning_rate), [r[0][0] for r in rounds], [init], rounds)


# ------------------------------------------------------------------ M5 / M6 AdaBoost

def adaboost_classifier(train: DataFrame, features: Sequence[str], label: str, n_estimators: int = 50,
                        learning_rate: float = 0.1, classes: Sequence | None = None, max_bins: int = 256,
                        name: str = "adaboost") -> MatrixModel:
    """SAMME with weighted depth-1 trees: err = sum(w miss) / sum(w), read off
    the leaves' class weights; alpha = lr (ln((1-err)/err) + ln(K-1));
    w *= exp(alpha miss), then normalised; stops at err = 0 or err >= 1 - 1/K.
    A round is one job."""
    features = list(features)
    classes = list(classes) if classes is not None else _classes_of(train, label)
    k = len(classes)
    cuts = fit_cuts(train, features, max_bins)
    start = pack(train, features, _class_index(label, classes), cuts, [1.0])

    def advance(step, x, y, state):
        votes, alpha, scale = step
        return state * np.where(votes.each(x)[:, 0] != y, math.exp(alpha), 1.0)[:, None] * scale

    state, stumps, norm = _State(start, advance), [], None
    top = lambda t, stats, ids: stats.argmax(1)[:, None].astype(float)
    for _ in range(n_estimators):
        now = state.current()

        def stats(x, y, key, given, now=now):
            w = now(x, y, given)[:, 0]
            return lambda t: (y[None, :] == np.arange(k)[:, None]) * w
        stump = grow(state.packed, 1, stats, k, k, "classification", "gini", 1, 2, 1, classes)[0]
        leaves = [n for n in stump.nodes.values() if n.is_leaf]
        total = sum(sum(n.stats) for n in leaves)
        err = sum(sum(n.stats) - max(n.stats) for n in leaves) / total
        norm = norm or total
        if err <= 1e-15:
            stumps.append((stump, 1.0))
            break
        if err >= 1.0 - 1.0 / k:
            if not stumps:
                raise ValueError("the first weak learner is no better than chance")
            break
        alpha = learning_rate * (math.log((1 - err) / err) + math.log(k - 1))
        stumps.append((stump, alpha))
        # the next total is known from the leaves, so weights keep the sum they started with
        nxt = total * (1 - err + err * math.exp(alpha))
        state.add((Forest([stump], top, cuts), alpha, norm / nxt))
    weight = sum(a for _, a in stumps) or 1.0

    def votes(t, stats, ids):
        out = np.full((len(stats), k), -stumps[t][1] / (k - 1))
        out[np.arange(len(stats)), stats.argmax(1)] = stumps[t][1]
        return out / weight
    forest = Forest([s for s, _ in stumps], votes)

    def probabilities(x: np.ndarray) -> np.ndarray:
        d = forest.add(x, np.zeros((len(x), k)))
        half = (d[:, 1] - d[:, 0]) / 2 if k == 2 else None
        return _softmax(np.stack([-half, half], 1) if k == 2 else d / (k - 1))
    return MatrixModel(name, "classification", features, classes, probabilities, stumps)


def adaboost_regressor(train: DataFrame, features: Sequence[str], label: str, n_estimators: int = 50,
                       learning_rate: float = 0.1, loss: str = "linear", max_depth: int = 3,
                       max_bins: int = 256, name: str = "adaboost") -> MatrixModel:
    """AdaBoost.R2 with sample weights in place of weighted resampling (a
    deterministic, documented divergence): loss linear / square /
    exponential of |error| / max|error|; stop at average loss >= 0.5;
    beta = err / (1 - err); w *= beta^((1 - loss) lr), then normalised; weight
    lr ln(1/beta); the prediction is the weighted median of the trees."""
    features = list(features)
    if loss not in ("linear", "square", "exponential"):
        raise ValueError(f"unsupported loss {loss!r}")
    cuts = fit_cuts(train, features, max_bins)
    start = pack(train, features, F.col(label), cuts, [1.0])

    def losses(error: np.ndarray, most: float) -> np.ndarray:
        rel = error / most
        return rel if loss == "linear" else rel * rel if loss == "square" else 1 - np.exp(-rel)

    def advance(step, x, y, state):
        values, most, beta, scale = step
        return state * (beta ** (learning_rate * (1 - losses(np.abs(values.each(x)[:, 0] - y), most))) * scale)[:, None]

    state, trees = _State(start, advance), []
    for _ in range(n_estimators):
        now = state.current()

        def stats(x, y, key, given, now=now):
            w = now(x, y, given)[:, 0]
            return lambda t: np.stack([w, w * y, w * y * y])
        tree = grow(state.packed, 1, stats, 3, 3, "regression", "squared_error", max_depth)[0]
        values = Forest([tree], _means, cuts)
        error = lambda x, y, values=values: np.abs(values.each(x)[:, 0] - y)
        power = {"linear": 1, "square": 2}.get(loss)

        def moments(x, y, key, given, now=now, error=error):
            """Weights, weighted errors to the loss's power and errors, as groups 0 to 2."""
            w, e = now(x, y, given)[:, 0], error(x, y)
            return np.repeat([0, 1, 2], len(y)), np.concatenate([w, w * e ** power, e])

        def weighed(x, y, key, given, now=now, error=error):
            w = now(x, y, given)[:, 0]
            return np.repeat([0, 1], len(y)), np.concatenate([w, w * losses(error(x, y), most)])
        # one pass for the largest error and the sums where these do not depend on it
        sums = group_sums(state.packed, moments, most=True) if power else {}
        most = sums[2][2] if sums else group_most(state.packed, lambda x, y, key, given: (np.zeros(len(y), np.int64), error(x, y))).get(0, 0.0)
        if most <= 0:
            trees.append((tree, 1.0))
            break
        sums = sums or group_sums(state.packed, weighed)
        average = sums[1][0] / sums[0][0] / (most ** power if power else 1)
        if average >= 0.5:
            if not trees:
                trees.append((tree, 1.0))
            break
        if average <= 0:
            trees.append((tree, 1.0))
            break
        beta = average / (1.0 - average)
        trees.append((tree, learning_rate * math.log(1.0 / beta)))
        state.add((values, most, beta, sums[0][1] / sums[0][0]))
    forest, weight = Forest([t for t, _ in trees], _means), np.array([w for _, w in trees])

    def median(x: np.ndarray) -> np.ndarray:
        each = forest.each(x)
        order = np.argsort(each, 1, kind="stable")
        reached = np.cumsum(weight[order], 1) >= 0.5 * weight.sum()
        return np.take_along_axis(each, np.take_along_axis(order, reached.argmax(1)[:, None], 1), 1)
    return MatrixModel(name, "regression", features, None, median, trees)


# ------------------------------------------------------------------ M11

#: What Spark, its workers or the machine raise, whatever the estimator.
JOB_FAILURES = (PySparkException, Py4JError, OSError, EOFError, MemoryError)


def fit_and_compare(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                    configs: dict[str, Callable], key: str, threads: int = 4) -> tuple[dict, DataFrame, dict]:
    """Fit every configured estimator on the same (cached) training rows, a few
    at a time: their small jobs share the cluster. An estimator that cannot be
    fitted is reported and the others continue; a job that fails (``JOB_FAILURES``)
    says nothing about its estimator and is raised. Returns the models, the long
    predictions table ``(model, key, y, prediction[, probability])`` - without rows
    if every fit failed - and the errors by model, which the caller must look at
    (``all_fitted``): the table has no trace of them."""
    train = train.persist(StorageLevel.MEMORY_AND_DISK)

    def attempt(fit):
        try:
            return fit(train), None
        except JOB_FAILURES:
            raise
        except Exception as exc:  # noqa: BLE001 - reported per model, as the reference
            return None, str(exc)
    try:
        with ThreadPoolExecutor(threads) as pool:
            results = dict(zip(configs, pool.map(attempt, configs.values())))
    finally:
        train.unpersist()
    models = {name: m for name, (m, _) in results.items() if m is not None}
    errors = {name: e for name, (m, e) in results.items() if m is None}
    preds = None
    for name, m in models.items():
        p = m.transform(test).select(F.lit(name).alias("model"), F.col(key), F.col(label).alias("y"),
                                     F.col("prediction").cast("string" if m.task == "classification" else "double").alias("prediction"),
                                     *([F.col("probability")] if m.task == "classification" else []))
        preds = p if preds is None else preds.unionByName(p)
    if preds is None:
        preds = test.limit(0).select(F.lit("").alias("model"), F.col(key), F.col(label).alias("y"),
                                     F.lit(None).cast("string").alias("prediction"))
    return models, preds, errors


def all_fitted(errors: dict[str, str]) -> None:
    """Raise if a configured estimator was not fitted: a comparison without it is not the one asked for."""
    if errors:
        raise RuntimeError("not fitted: " + "; ".join(f"{name}: {error}" for name, error in errors.items()))


def error_table(spark, configs: Sequence[str], errors: dict[str, str]) -> DataFrame:
    """(model, fitted, error) per configured estimator."""
    return spark.createDataFrame([(c, c not in errors, errors.get(c)) for c in configs], "model string, fitted boolean, error string")

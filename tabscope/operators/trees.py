"""Level-wise histogram CART on DataFrames (M1, M2, M12-M14).

Every feature is cut once: when it has at most ``max_bins`` distinct values
the cuts are the midpoints between consecutive values (exact CART), else
approximate quantiles. Rows are bucketed (JVM ``Bucketizer``) and cached.
Per tree level one aggregation runs over the cached rows:

    node routing (a compiled ``when`` over bins) -> posexplode features ->
    groupBy(node, feature, bin) sums (partial aggregation map side) ->
    cumulative sums over bins (window partitions of <= max_bins rows) ->
    impurity decrease per cut -> best cut per node (``max_by``).

The shuffle per level is nodes x features x bins rows whatever the row count,
and only one row per open node reaches the driver. Supports sample weights,
gini / entropy / log_loss, squared_error / friedman_mse / poisson,
max_depth, min_samples_split and min_samples_leaf, without leaf merging.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSIFICATION_CRITERIA = ("gini", "entropy", "log_loss")
REGRESSION_CRITERIA = ("squared_error", "friedman_mse", "poisson")
EPS = 1e-12


@dataclass
class Node:
    node_id: int
    depth: int
    n: int
    weight: float
    stats: list[float]
    impurity: float
    feature: int | None = None
    threshold: float | None = None
    improvement: float | None = None

    @property
    def is_leaf(self) -> bool:
        return self.feature is None


@dataclass
class TreeModel:
    features: list[str]
    task: str
    criterion: str
    classes: list | None
    nodes: dict[int, Node] = field(default_factory=dict)
    #: Parts grown below bounded nodes by ``joint_trees``; single trees have none.
    tails: dict[int, object] = field(default_factory=dict)

    # ------------------------------------------------------------- values
    def leaf_value(self, node: Node):
        if self.task == "classification":
            tot = sum(node.stats) or 1.0
            probs = [s / tot for s in node.stats]
            best = max(range(len(probs)), key=lambda i: (probs[i], -i))
            return self.classes[best], probs
        return node.stats[1] / node.weight if node.weight > 0 else 0.0, None

    def _compile(self, node_id: int, leaf_expr) -> Column:
        node = self.nodes[node_id]
        if node.is_leaf:
            return leaf_expr(node)
        x = F.col(self.features[node.feature]).cast("double")
        return F.when(x <= F.lit(node.threshold), self._compile(2 * node_id, leaf_expr)) \
                .otherwise(self._compile(2 * node_id + 1, leaf_expr))

    def prediction_column(self) -> Column:
        """The tree as one nested CASE column (whole-stage codegen, no UDF)."""
        return self._compile(1, lambda n: F.lit(self.leaf_value(n)[0]))

    def probability_column(self) -> Column:
        return self._compile(1, lambda n: F.array(*[F.lit(float(p)) for p in self.leaf_value(n)[1]]))

    def leaf_column(self) -> Column:
        return self._compile(1, lambda n: F.lit(n.node_id).cast("long"))

    def transform(self, df: DataFrame, prediction: str = "prediction", probability: str | None = "probability",
                  leaf: str | None = None) -> DataFrame:
        if len(self.nodes) > COMPILE_MAX_NODES:
            return self._transform_by_joins(df, prediction, probability, leaf)
        out = df.withColumn(prediction, self.prediction_column())
        if self.task == "classification" and probability:
            out = out.withColumn(probability, self.probability_column())
        if leaf:
            out = out.withColumn(leaf, self.leaf_column())
        return out

    def _transform_by_joins(self, df: DataFrame, prediction: str, probability: str | None,
                            leaf: str | None) -> DataFrame:
        """Large trees: route rows one level per pass by joining each level's
        split table (node id -> feature, threshold), then attach the leaf
        values by node id; the tables are model sized (one row per node)."""
        spark = df.sparkSession
        xs = F.array(*[F.col(c).cast("double") for c in self.features])
        rows = df.withColumn("_node", F.lit(1).cast("long"))
        for d in range(self.depth):
            splits = [(nid, n.feature, float(n.threshold)) for nid, n in self.nodes.items()
                      if not n.is_leaf and n.depth == d]
            if not splits:
                continue
            tab = spark.createDataFrame(splits, "_node long, _sf int, _st double")
            j = rows.join(F.broadcast(tab), "_node", "left")
            moved = F.when(F.col("_sf").isNull(), F.col("_node")).when(
                F.element_at(xs, F.col("_sf") + 1) <= F.col("_st"), 2 * F.col("_node")).otherwise(2 * F.col("_node") + 1)
            rows = j.withColumn("_node", moved.cast("long")).drop("_sf", "_st")
        leaves = []
        for nid, n in self.nodes.items():
            if n.is_leaf:
                val, probs = self.leaf_value(n)
                leaves.append((nid, val, probs))
        if self.task == "classification":
            tab = spark.createDataFrame([(a, str(b), c) for a, b, c in leaves],
                                        "_node long, _pred string, _prob array<double>")
            # the class keeps the type that a compiled tree gives it
            tab = tab.withColumn("_pred", F.col("_pred").cast(spark.range(0).select(F.lit(self.classes[0])).schema[0].dataType))
        else:
            tab = spark.createDataFrame([(a, float(b)) for a, b, _ in leaves], "_node long, _pred double")
        out = rows.join(F.broadcast(tab), "_node", "left").withColumnRenamed("_pred", prediction)
        if self.task == "classification":
            out = out.withColumnRenamed("_prob", probability) if probability else out.drop("_prob")
        return out.withColumnRenamed("_node", leaf) if leaf else out.drop("_node")

    # ------------------------------------------------------------- tables
    def node_rows(self) -> list[tuple]:
        rows = []
        for nid in sorted(self.nodes):
            n = self.nodes[nid]
            rows.append((nid, n.depth, None if n.is_leaf else self.features[n.feature],
                         n.threshold, n.n, float(n.weight), float(n.impurity),
                         [float(s) for s in (n.stats if self.task == "classification"
                                             else [n.stats[1] / n.weight if n.weight else 0.0])],
                         n.is_leaf, n.improvement))
        return rows

    def node_table(self, spark) -> DataFrame:
        """Node id, depth, split feature/threshold, samples, impurity, value
        (class weights or mean), leaf flag. One row per node (model sized)."""
        return spark.createDataFrame(self.node_rows(), NODE_SCHEMA)

    @property
    def depth(self) -> int:
        return max(n.depth for n in self.nodes.values())

    @property
    def n_leaves(self) -> int:
        return sum(1 for n in self.nodes.values() if n.is_leaf)


COMPILE_MAX_NODES = 2047     # larger trees are applied by level-wise joins

NODE_SCHEMA = ("node_id long, depth int, feature string, threshold double, n_samples long, "
               "weighted_n double, impurity double, value array<double>, is_leaf boolean, improvement double")


# ------------------------------------------------------------------ binning

def fit_cuts(df: DataFrame, features: Sequence[str], max_bins: int = 256) -> list[list[float]]:
    """Split candidates per feature (sorted, distinct), in two passes: a
    distinct-count sketch, then the distinct values of the low-cardinality
    features (bounded by the check) and quantile sketches for the rest."""
    features = list(features)
    est = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(features)]).first()
    probs = [j / max_bins for j in range(1, max_bins)]

    def sketch(i: int) -> Column:
        return F.percentile_approx(F.col(features[i]).cast("double"), probs, 10000).alias(f"q{i}")
    # 0.0 is added to make -0.0 and 0.0 one value
    got = df.agg(*[F.collect_set(F.col(features[i]).cast("double") + 0.0).alias(f"v{i}") if est[f"d{i}"] <= max_bins else sketch(i)
                   for i in range(len(features))]).first().asDict() if features else {}
    high = [i for i in range(len(features)) if f"q{i}" in got or len(got[f"v{i}"]) > 2 * max_bins]
    missing = [i for i in high if f"q{i}" not in got]
    if missing:
        got |= df.agg(*[sketch(i) for i in missing]).first().asDict()
    cuts: list[list[float]] = [[] for _ in features]
    for i in range(len(features)):
        if i in high:
            cuts[i] = sorted(set(float(v) for v in got[f"q{i}"] or [] if v is not None))
            continue
        vals = sorted(got[f"v{i}"])
        cs = []
        for a, b in zip(vals, vals[1:]):
            m = a / 2.0 + b / 2.0
            cs.append(a if m == b else m)
        cuts[i] = cs
    return cuts


def bin_rows(df: DataFrame, features: Sequence[str], cuts: list[list[float]]) -> DataFrame:
    """Add ``_b{i}`` (int): number of cuts strictly below the value, so that
    ``bin <= j`` is exactly ``x <= cuts[j]``."""
    ins, outs, splits = [], [], []
    out = df
    for i, (c, cs) in enumerate(zip(features, cuts)):
        if not cs:
            out = out.withColumn(f"_b{i}", F.lit(0))
            continue
        out = out.withColumn(f"_x{i}", F.col(c).cast("double"))
        ins.append(f"_x{i}")
        outs.append(f"_bd{i}")
        splits.append([-math.inf] + [math.nextafter(v, math.inf) for v in cs] + [math.inf])
    if ins:
        out = Bucketizer(splitsArray=splits, inputCols=ins, outputCols=outs).transform(out)
        for name in outs:
            i = int(name[3:])
            out = out.withColumn(f"_b{i}", F.col(name).cast("int")).drop(name, f"_x{i}")
    return out


# ------------------------------------------------------------------ impurity

def _impurity_cls(stats: Sequence[Column], tot: Column, criterion: str) -> Column:
    if criterion == "gini":
        return 1.0 - sum((s / tot) * (s / tot) for s in stats)
    return -sum(F.when(s > 0, (s / tot) * F.log2(s / tot)).otherwise(0.0) for s in stats)


def _impurity_py(stats: list[float], w: float, task: str, criterion: str) -> float:
    if w <= 0:
        return 0.0
    if task == "classification":
        ps = [s / w for s in stats]
        if criterion == "gini":
            return 1.0 - sum(p * p for p in ps)
        return -sum(p * math.log2(p) for p in ps if p > 0)
    _, sy, syy = stats
    mean = sy / w
    if criterion == "poisson":
        # second-order form of the half Poisson deviance: 0 for a pure node, positive else
        return 0.0 if mean <= 0 else max(syy / w - mean * mean, 0.0) / (2 * mean)
    return max(syy / w - mean * mean, 0.0)


# ------------------------------------------------------------------ fitting

def fit_tree(df: DataFrame, features: Sequence[str], label: str, task: str = "classification",
             criterion: str | None = None, max_depth: int = 5, min_samples_split: int = 2,
             min_samples_leaf: int = 1, weight: str | None = None, max_bins: int = 256,
             classes: Sequence | None = None, cuts: list[list[float]] | None = None,
             prebinned: bool = False) -> TreeModel:
    """Fit one tree. ``prebinned``: ``df`` already holds the ``_b{i}`` bin
    columns of ``bin_rows`` for ``cuts`` and is cached by the caller (used by
    the boosting loops, which re-weight the same binned rows every round)."""
    features = list(features)
    criterion = criterion or ("gini" if task == "classification" else "squared_error")
    if criterion == "log_loss":
        criterion = "entropy"
    if task == "classification" and criterion not in CLASSIFICATION_CRITERIA:
        raise ValueError(f"criterion {criterion!r} is not a classification criterion")
    if task == "regression" and criterion not in REGRESSION_CRITERIA:
        raise ValueError(f"criterion {criterion!r} is not supported for regression "
                         f"(supported: {', '.join(REGRESSION_CRITERIA)})")
    if not 1 <= max_depth <= 30:
        raise ValueError("max_depth must be in 1..30")
    if task == "classification" and classes is None:
        classes = [r[0] for r in df.select(label).distinct().orderBy(label).limit(10_001).collect()]
        if len(classes) > 10_000:
            raise ValueError("too many classes")
    stat_cols = stat_columns(task, label, classes, weight)
    n_stats = len(stat_cols)
    if cuts is None:
        cuts = fit_cuts(df, features, max_bins)
    bins = [f"_b{i}" for i in range(len(features))]
    if prebinned:
        binned = df.select(*bins, *stat_cols)
    else:
        rows = df.select(*features, *stat_cols)
        binned = bin_rows(rows, features, cuts).select(*bins, *[f"_s{k}" for k in range(n_stats)])
        binned = binned.persist(StorageLevel.MEMORY_AND_DISK)
    model = TreeModel(features, task, criterion, list(classes) if classes is not None else None)
    try:
        _grow(model, binned, cuts, n_stats, max_depth, min_samples_split, min_samples_leaf)
    finally:
        if not prebinned:
            binned.unpersist()
    return model


def stat_columns(task: str, label: str, classes: Sequence | None, weight: str | None) -> list[Column]:
    """Additive statistics per row: class weights, or (w, w y, w y^2)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if task == "classification":
        y = F.col(label)
        return [F.when(y == F.lit(c), w).otherwise(0.0).alias(f"_s{k}") for k, c in enumerate(classes)]
    y = F.col(label).cast("double")
    return [w.alias("_s0"), (w * y).alias("_s1"), (w * y * y).alias("_s2")]


def _route(model: TreeModel, node_id: int) -> Column:
    node = model.nodes.get(node_id)
    if node is None or node.is_leaf:
        return F.lit(node_id).cast("long")
    b = F.col(f"_b{node.feature}")
    return F.when(b <= F.lit(node._bin), _route(model, 2 * node_id)).otherwise(_route(model, 2 * node_id + 1))


def _grow(model: TreeModel, binned: DataFrame, cuts, n_stats, max_depth, mss, msl) -> None:
    """One job per level with splittable nodes: each job returns, per open
    node, its totals and best cut *with the left-side sums*, so the
    children's statistics are known without another pass."""
    task, criterion = model.task, model.criterion
    nf = len(model.features)
    s = [f"_s{k}" for k in range(n_stats)]
    known: dict[int, tuple[int, list[float]]] = {}
    frontier = [1]
    # Routing: a compiled CASE over the splits made so far while the tree is
    # small; beyond ROUTE_EXPR_MAX_SPLITS splits the node id is materialised
    # and advanced one level per pass by joining the level's split table.
    materialised = None
    for depth in range(0, max_depth + 1):
        if not frontier:
            break
        need = [nid for nid in frontier if nid not in known]
        eligible = []
        for nid in frontier:
            if nid in known:
                n, st = known[nid]
                wsum = st[0] if task == "regression" else sum(st)
                imp = _impurity_py(st, wsum, task, criterion)
                model.nodes[nid] = Node(nid, depth, n, wsum, st, imp)
                if depth < max_depth and n >= mss and n >= 2 * msl and imp > EPS * model.nodes[1].impurity:
                    eligible.append(nid)
        query = need + eligible
        if depth == max_depth or not query:
            break
        n_splits = sum(1 for n in model.nodes.values() if not n.is_leaf)
        if materialised is None and n_splits > ROUTE_EXPR_MAX_SPLITS:
            materialised = _materialise(binned.withColumn("_node", _route(model, 1)), 0)
        elif materialised is not None:
            materialised = _advance(model, materialised, nf, depth)
        base = materialised if materialised is not None else binned.withColumn("_node", _route(model, 1))
        routed = base.where(F.col("_node").isin(query))
        summary = _level_summary(routed, nf, s, task, criterion, msl)
        nxt = []
        for nid, (n, st, best) in summary.items():
            if nid in need:
                wsum = st[0] if task == "regression" else sum(st)
                imp = _impurity_py(st, wsum, task, criterion)
                model.nodes[nid] = Node(nid, depth, n, wsum, st, imp)
                if not (depth < max_depth and n >= mss and n >= 2 * msl and imp > EPS * model.nodes[1].impurity):
                    continue
            if best is None:
                continue
            f, b, gain, nl, lst = best
            node = model.nodes[nid]
            node.feature, node._bin, node.threshold, node.improvement = f, b, cuts[f][b], gain
            known[2 * nid] = (nl, lst)
            known[2 * nid + 1] = (n - nl, [t - l for t, l in zip(st, lst)])
            nxt += [2 * nid, 2 * nid + 1]
        frontier = nxt
    if materialised is not None:
        materialised.unpersist()
    # children created at the last level are leaves with known statistics
    for nid in frontier:
        if nid not in model.nodes and nid in known:
            n, st = known[nid]
            wsum = st[0] if task == "regression" else sum(st)
            model.nodes[nid] = Node(nid, model.nodes[nid // 2].depth + 1, n, wsum, st,
                                    _impurity_py(st, wsum, task, criterion))


ROUTE_EXPR_MAX_SPLITS = 32
CHECKPOINT_LEVELS = 4


def _materialise(df: DataFrame, level: int) -> DataFrame:
    """Cache the rows with their node id; every few levels write a reliable
    checkpoint (shared checkpoint folder) so lineage stays short."""
    if level and level % CHECKPOINT_LEVELS == 0:
        return df.checkpoint(eager=True)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def _advance(model: TreeModel, rows: DataFrame, nf: int, depth: int) -> DataFrame:
    """Move rows whose node was split at the previous level to a child: join
    the level's split table (one row per split node) on the node id."""
    spark = rows.sparkSession
    splits = [(nid, n.feature, n._bin) for nid, n in model.nodes.items()
              if not n.is_leaf and n.depth == depth - 1]
    if not splits:
        return rows
    tab = spark.createDataFrame(splits, "_node long, _sf int, _sb int")
    # the split table is bounded by the frontier of one level; AQE broadcasts it when small
    j = rows.join(tab, "_node", "left")
    bins = F.array(*[F.col(f"_b{i}") for i in range(nf)])
    moved = F.when(F.col("_sf").isNull(), F.col("_node")).when(
        F.element_at(bins, F.col("_sf") + 1) <= F.col("_sb"), 2 * F.col("_node")).otherwise(2 * F.col("_node") + 1)
    nxt = _materialise(j.withColumn("_node", moved.cast("long")).drop("_sf", "_sb"), depth)
    rows.unpersist()
    return nxt


def _level_summary(routed: DataFrame, nf: int, s: list[str], task: str, criterion: str, msl: int) -> dict:
    """{node: (rows, totals, best (feature, bin, gain) or None)}."""
    exploded = routed.select("_node", F.posexplode(F.array(*[F.col(f"_b{i}") for i in range(nf)])).alias("_f", "_bin"),
                             *s)
    hist = exploded.groupBy("_node", "_f", "_bin").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(c) for c in s])
    w = Window.partitionBy("_node", "_f").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wt = Window.partitionBy("_node", "_f")
    cum = hist.select("_node", "_f", "_bin",
                      F.sum("_c").over(w).alias("_nl"), F.sum("_c").over(wt).alias("_nt"),
                      *[F.sum(c).over(w).alias(f"l{c}") for c in s], *[F.sum(c).over(wt).alias(f"t{c}") for c in s])
    L = [F.col(f"l{c}") for c in s]
    Tt = [F.col(f"t{c}") for c in s]
    R = [t - l for t, l in zip(Tt, L)]
    if task == "classification":
        wl, wr, wt_ = sum(L), sum(R), sum(Tt)
        parent = _impurity_cls(Tt, wt_, criterion)
        il = _impurity_cls(L, wl, criterion)
        ir = _impurity_cls(R, wr, criterion)
        gain = parent - (wl * il + wr * ir) / wt_
        valid_w = (wl > 0) & (wr > 0)
    else:
        wl, wr, wt_ = L[0], R[0], Tt[0]
        if criterion == "poisson":
            # Poisson deviance reduction: sum y ln(mean) over children minus parent
            def term(sy, ww):
                return F.when(sy > 0, sy * F.log(sy / ww)).otherwise(0.0)
            gain = (term(L[1], wl) + term(R[1], wr) - term(Tt[1], wt_)) / wt_
            valid_w = (wl > 0) & (wr > 0) & (L[1] > 0) & (R[1] > 0)
        else:
            # SSE reduction per unit weight = w_l w_r / w^2 (mean_l - mean_r)^2
            # (friedman_mse ranks cuts identically)
            gain = (wl * wr / wt_) * F.pow(L[1] / wl - R[1] / wr, 2) / wt_
            valid_w = (wl > 0) & (wr > 0)
    valid = (valid_w & (F.col("_nl") >= msl) & (F.col("_nt") - F.col("_nl") >= msl)).cast("int")
    scored = cum.select("_node", "_f", "_bin", "_nt", "_nl", *[f"t{c}" for c in s], *[f"l{c}" for c in s],
                        valid.alias("_ok"), F.when(valid == 1, gain).alias("_gain"))
    best = scored.groupBy("_node").agg(
        F.max_by(F.struct("_f", "_bin", "_gain", "_ok", "_nl", *[f"l{c}" for c in s]),
                 F.struct(F.col("_ok"), F.coalesce(F.col("_gain"), F.lit(-1.0)), -F.col("_f"), -F.col("_bin"))
                 ).alias("b"),
        F.first("_nt").alias("_nt"), *[F.first(f"t{c}").alias(f"t{c}") for c in s])
    out = {}
    for r in best.collect():
        b = r["b"]
        chosen = ((b["_f"], b["_bin"], b["_gain"], b["_nl"], [float(b[f"l{c}"]) for c in s])
                  if b["_ok"] == 1 else None)
        out[r["_node"]] = (r["_nt"], [float(r[f"t{c}"]) for c in s], chosen)
    return out


def best_split(df: DataFrame, features: Sequence[str], label: str, task: str = "classification",
               criterion: str | None = None, min_samples_leaf: int = 1, max_bins: int = 256) -> DataFrame:
    """M14: the root's best cut: feature, threshold, impurity decrease and
    the left / right sample counts (a depth-1 fit)."""
    m = fit_tree(df, features, label, task, criterion, 1, 2, min_samples_leaf, max_bins=max_bins)
    root = m.nodes[1]
    spark = df.sparkSession
    if root.is_leaf:
        row = (None, None, None, root.n, 0)
    else:
        row = (m.features[root.feature], float(root.threshold), float(root.improvement),
               m.nodes[2].n, m.nodes[3].n)
    return spark.createDataFrame([row], "feature string, threshold double, improvement double, "
                                        "n_left long, n_right long")


def tree_node_counts(model: TreeModel, df: DataFrame, label: str | None = None) -> DataFrame:
    """Rows (and rows per class) reaching every node of the tree, internal
    nodes included: each row's leaf id expands to its ancestor path
    (``leaf // 2^k``) by a generator, then one grouped count. Works for any
    table with the model's feature columns (training or test rows)."""
    depth = model.depth
    leaf = model.leaf_column()
    path = F.filter(F.transform(F.sequence(F.lit(0), F.lit(depth)),
                                lambda k: F.floor(leaf / F.pow(F.lit(2.0), k)).cast("long")),
                    lambda v: v > 0)
    cols = [F.explode(path).alias("node_id")]
    if label:
        cols.append(F.col(label).cast("string").alias("class"))
    keys = ["node_id"] + (["class"] if label else [])
    return df.select(*cols).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

"""Evaluation (V1-V14). Input: a predictions DataFrame with the true label,
the prediction and optionally a probability array; ``by`` names a grouping
column (e.g. ``model``) so several models are scored in the same pass.

Counting metrics are one partial aggregate each; ROC curves use the
distributed prefix sums over distinct scores (no global window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.plans.ordering import prefix_sums

# --- fixed values: AUC verdicts and quality grades shown by the reference -----
AUC_VERDICTS = [(0.9, "Excelente discriminación"), (0.8, "Muy buena discriminación"),
                (0.7, "Discriminación aceptable"), (0.6, "Discriminación pobre"),
                (0.5, "No mejor que aleatorio")]
AUC_VERDICT_BELOW = "Peor que aleatorio"
AUC_GRADES = [(0.9, "Excelente"), (0.8, "Buena"), (0.7, "Aceptable")]
AUC_GRADE_BELOW = "Pobre"
# -------------------------------------------------------------------------------


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


# ------------------------------------------------------------------ V1

def confusion_matrix(pred: DataFrame, y: str = "y", prediction: str = "prediction",
                     by=None, labels: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(by..., actual, predicted, n)`` over the full label grid
    (sorted union of true and predicted labels, or ``labels``); zeros kept.
    The grid is generated from the (bounded) label array, not by a join."""
    k = _keys(by)
    d = pred.select(*k, F.col(y).cast("string").alias("a"), F.col(prediction).cast("string").alias("p"))
    counts = d.groupBy(*k, "a", "p").agg(F.count(F.lit(1)).alias("n"))
    if labels is not None:
        lab = d.groupBy(*k).agg(F.count(F.lit(1)).alias("_c")).select(
            *k, F.array(*[F.lit(str(v)) for v in labels]).alias("cls"))
    else:
        lab = d.groupBy(*k).agg(F.array_sort(F.array_union(F.collect_set("a"), F.collect_set("p"))).alias("cls"))
    grid = (lab.select(*k, F.explode("cls").alias("actual"), "cls")
            .select(*k, "actual", F.explode("cls").alias("predicted")))
    cj = counts.withColumnRenamed("a", "actual").withColumnRenamed("p", "predicted")
    return (grid.join(cj, [*k, "actual", "predicted"], "left")
            .select(*k, "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy(*k, "actual", "predicted"))


def confusion_matrix_wide(pred: DataFrame, labels: Sequence[str], y: str = "y",
                          prediction: str = "prediction") -> DataFrame:
    """Wide form: one row per actual label, one column per predicted label."""
    cm = confusion_matrix(pred, y, prediction, labels=labels)
    return cm.groupBy("actual").pivot("predicted", [str(v) for v in labels]).agg(F.sum("n")).orderBy("actual")


# ------------------------------------------------------------------ V2-V4

def class_counts(pred: DataFrame, y: str = "y", prediction: str = "prediction", by=None) -> DataFrame:
    """Per label: true positives, support and predicted count (one pass)."""
    k = _keys(by)
    a, p = F.col(y).cast("string"), F.col(prediction).cast("string")
    hit = F.when(a == p, 1).otherwise(0)
    rows = pred.select(*k, F.explode(F.array(
        F.struct(a.alias("cls"), F.lit(1).alias("sup"), F.lit(0).alias("prd"), hit.alias("tp")),
        F.struct(p.alias("cls"), F.lit(0).alias("sup"), F.lit(1).alias("prd"), F.lit(0).alias("tp")))).alias("s"))
    return (rows.select(*k, "s.*").groupBy(*k, "cls")
            .agg(F.sum("tp").cast("long").alias("tp"), F.sum("sup").cast("long").alias("support"),
                 F.sum("prd").cast("long").alias("predicted")))


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_metrics_table(pred: DataFrame, y: str = "y", prediction: str = "prediction", by=None) -> DataFrame:
    """Per label precision, recall, F1 and support; 0/0 -> 0."""
    k = _keys(by)
    c = class_counts(pred, y, prediction, by)
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    t = c.select(*k, F.col("cls").alias("class"), prec.alias("precision"), rec.alias("recall"), "support")
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.select(*k, "class", "precision", "recall", f1.alias("f1"), "support").orderBy(*k, "class")


def classification_report(pred: DataFrame, y: str = "y", prediction: str = "prediction", by=None) -> DataFrame:
    """Per-label rows plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    k = _keys(by)
    per = class_metrics_table(pred, y, prediction, by)
    tp = class_counts(pred, y, prediction, by).groupBy(*k).agg(F.sum("tp").alias("_tp"))
    s = per.groupBy(*k).agg(
        F.sum("support").alias("_n"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        F.sum(F.col("precision") * F.col("support")).alias("_wp"),
        F.sum(F.col("recall") * F.col("support")).alias("_wr"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf"))
    s = s.join(tp, k, "inner") if k else s.withColumn("_j", F.lit(0)).join(
        tp.withColumn("_j", F.lit(0)), "_j").drop("_j")
    n = F.col("_n")
    acc = s.select(*k, F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), _safe_div(F.col("_tp"), n).alias("f1"),
                   n.cast("long").alias("support"))
    macro = s.select(*k, F.lit("macro avg").alias("class"), F.col("_mp").alias("precision"),
                     F.col("_mr").alias("recall"), F.col("_mf").alias("f1"), n.cast("long").alias("support"))
    weighted = s.select(*k, F.lit("weighted avg").alias("class"), _safe_div(F.col("_wp"), n).alias("precision"),
                        _safe_div(F.col("_wr"), n).alias("recall"), _safe_div(F.col("_wf"), n).alias("f1"),
                        n.cast("long").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def global_metrics(pred: DataFrame, y: str = "y", prediction: str = "prediction", by=None) -> DataFrame:
    """accuracy and weighted precision / recall / F1, one row (per group)."""
    k = _keys(by)
    rep = classification_report(pred, y, prediction, by)
    return rep.groupBy(*k).agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("precision"))).alias("precision"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("recall"))).alias("recall"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("f1"))).alias("f1"))


# ------------------------------------------------------------------ V5-V10

def _curve(scored: DataFrame, keys: list[str], drop_intermediate: bool) -> DataFrame:
    """``scored``: (keys..., score, pos 0/1). Returns the ROC points per key
    with the (0, 0) start, ``threshold`` = inf there."""
    agg = scored.groupBy(*keys, "score").agg(
        F.sum("pos").cast("long").alias("tp"), F.sum(1 - F.col("pos")).cast("long").alias("fp"),
        F.lit(1).cast("long").alias("one"))
    cum = prefix_sums(agg, keys, "score", ["tp", "fp", "one"], descending=True, following=["tp", "fp"] if drop_intermediate else [])
    tot = agg.groupBy(*keys).agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"),
                                 F.count(F.lit(1)).alias("M"))
    jk = keys or ["_j"]
    if not keys:
        cum, tot = cum.withColumn("_j", F.lit(0)), tot.withColumn("_j", F.lit(0))
    # totals: one row per key, bounded by the number of keys
    pts = cum.join(F.broadcast(tot), jk)
    if drop_intermediate:
        # second differences of the cumulative counts at point i reduce to
        # differences of the per-score counts: tp[i+1] - tp[i] (same for fp)
        keep = ((F.col("cum_one") == 1) | (F.col("cum_one") == F.col("M"))
                | (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp")))
        pts = pts.where(keep)
    body = pts.select(*jk, F.col("score").cast("double").alias("threshold"),
                      F.col("cum_one").alias("point"), "cum_tp", "cum_fp", "P", "N")
    start = tot.select(*jk, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("point"),
                       F.lit(0).cast("long").alias("cum_tp"), F.lit(0).cast("long").alias("cum_fp"), "P", "N")
    out = body.unionByName(start).select(
        *jk, "point", "threshold",
        F.when(F.col("N") > 0, F.col("cum_fp") / F.col("N")).alias("fpr"),
        F.when(F.col("P") > 0, F.col("cum_tp") / F.col("P")).alias("tpr"))
    return out.drop("_j") if not keys else out


def roc_curve_binary(pred: DataFrame, y: str, score: str, positive, by=None,
                     drop_intermediate: bool = True) -> DataFrame:
    """ROC points (point, threshold, fpr, tpr) for ``y == positive``."""
    k = _keys(by)
    s = pred.select(*k, F.col(score).cast("double").alias("score"),
                    F.when(F.col(y).cast("string") == F.lit(str(positive)), 1).otherwise(0).alias("pos"))
    return _curve(s.where(F.col("score").isNotNull()), k, drop_intermediate)


def _auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid area from per-score counts: sum fp_i * (tp_before + tp_i / 2) / (P N)."""
    agg = scored.groupBy(*keys, "score").agg(
        F.sum("pos").cast("long").alias("tp"), F.sum(1 - F.col("pos")).cast("long").alias("fp"))
    cum = prefix_sums(agg, keys, "score", ["tp"], descending=True)
    area = cum.groupBy(*keys).agg(
        F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") + F.col("tp") / 2.0)).alias("_a"),
        F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    return area.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                     F.col("_a") / (F.col("P").cast("double") * F.col("N"))).alias("auc"))


def auc_binary(pred: DataFrame, y: str, score: str, positive, by=None) -> DataFrame:
    k = _keys(by)
    s = pred.select(*k, F.col(score).cast("double").alias("score"),
                    F.when(F.col(y).cast("string") == F.lit(str(positive)), 1).otherwise(0).alias("pos"))
    return _auc(s.where(F.col("score").isNotNull()), k)


def _exploded(pred: DataFrame, y: str, probability: str, classes: Sequence[str], by=None) -> DataFrame:
    """(by..., class, score, pos): one row per (row, class) of the probability array."""
    k = _keys(by)
    names = F.array(*[F.lit(str(c)) for c in classes])
    e = pred.select(*k, F.col(y).cast("string").alias("_y"),
                    F.posexplode(F.col(probability)).alias("_i", "score"))
    return e.select(*k, F.element_at(names, F.col("_i") + 1).alias("class"), F.col("score").cast("double"),
                    F.when(F.col("_y") == F.element_at(names, F.col("_i") + 1), 1).otherwise(0).alias("pos"))


def roc_one_vs_rest(pred: DataFrame, y: str, probability: str, classes: Sequence[str], by=None,
                    drop_intermediate: bool = True) -> DataFrame:
    k = _keys(by)
    return _curve(_exploded(pred, y, probability, classes, by), [*k, "class"], drop_intermediate)


def auc_one_vs_rest(pred: DataFrame, y: str, probability: str, classes: Sequence[str], by=None) -> DataFrame:
    k = _keys(by)
    return _auc(_exploded(pred, y, probability, classes, by), [*k, "class"])


def roc_micro(pred: DataFrame, y: str, probability: str, classes: Sequence[str], by=None,
              drop_intermediate: bool = True) -> DataFrame:
    k = _keys(by)
    return _curve(_exploded(pred, y, probability, classes, by), k, drop_intermediate)


def auc_micro(pred: DataFrame, y: str, probability: str, classes: Sequence[str], by=None) -> DataFrame:
    k = _keys(by)
    return _auc(_exploded(pred, y, probability, classes, by), k)


def auc_verdict(c: F.Column) -> F.Column:
    e = None
    for t, label in AUC_VERDICTS:
        e = F.when(c >= t, label) if e is None else e.when(c >= t, label)
    return e.otherwise(AUC_VERDICT_BELOW)


def auc_grade(c: F.Column) -> F.Column:
    e = None
    for t, label in AUC_GRADES:
        e = F.when(c >= t, label) if e is None else e.when(c >= t, label)
    return e.otherwise(AUC_GRADE_BELOW)


def auc_table(pred: DataFrame, y: str, probability: str, classes: Sequence[str], by=None) -> DataFrame:
    """AUC per class, micro and macro average, with verdict and grade.

    Macro: the mean of the per-class TPRs interpolated on the union of FPRs
    integrates exactly to the mean of the per-class areas (each curve is
    piecewise linear and the union grid refines its knots), so it is the
    mean of the class AUCs; NULL when a class has no positives."""
    k = _keys(by)
    per = auc_one_vs_rest(pred, y, probability, classes, by)
    micro = auc_micro(pred, y, probability, classes, by).withColumn("class", F.lit("micro"))
    macro = per.groupBy(*k).agg(
        F.when(F.count(F.when(F.col("auc").isNull(), 1)) == 0, F.avg("auc")).alias("auc")
    ).withColumn("class", F.lit("macro"))
    allr = per.unionByName(micro).unionByName(macro)
    return allr.select(*k, "class", "auc", F.when(F.col("auc").isNotNull(), auc_verdict(F.col("auc"))).alias("verdict"),
                       F.when(F.col("auc").isNotNull(), auc_grade(F.col("auc"))).alias("grade"))


# ------------------------------------------------------------------ V11-V14

def _mean(c: Column, scale: int | None) -> Column:
    if scale is None:
        return F.avg(c)
    return F.sum(c.cast(f"decimal(38,{scale})")).cast("double") / F.count(c)


def regression_metrics(pred: DataFrame, y: str = "y", prediction: str = "prediction", by=None,
                       mean_scale: int | None = None) -> DataFrame:
    """MSE, RMSE, MAE and R^2 = 1 - SSE/SST (one aggregate). ``mean_scale``:
    averages from exact decimal sums (partitioning-independent)."""
    k = _keys(by)
    e = F.col(prediction).cast("double") - F.col(y).cast("double")
    m = pred.groupBy(*k).agg(_mean(e * e, mean_scale).alias("mse"), _mean(F.abs(e), mean_scale).alias("mae"),
                             F.sum(e * e).alias("_sse"),
                             (F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))).alias("_sst"))
    r2 = (F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
          .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return m.select(*k, "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def residual_histogram(pred: DataFrame, y: str = "y", prediction: str = "prediction", bins: int = 30) -> DataFrame:
    from tabscope.operators.profile import histogram
    resid = (F.col(y).cast("double") - F.col(prediction).cast("double"))
    return histogram(pred, "resid", bins, value=resid)


def actual_vs_predicted_line(pred: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """End points of the y = x reference line: min / max over both columns."""
    a, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    return pred.agg(F.least(F.min(a), F.min(p)).alias("lo"), F.greatest(F.max(a), F.max(p)).alias("hi"))


def actual_vs_predicted_points(pred: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """The points of the actual-vs-predicted and residual charts, one per row with both values."""
    a, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    return pred.select(a.alias("y"), p.alias("prediction"), (a - p).alias("residual")).where(F.col("residual").isNotNull())


def flag_regression(m: DataFrame, by: str = "model") -> DataFrame:
    """Best flags over a per-model table (errors: lowest, R^2: highest).
    The window spans the model table only (one row per model)."""
    w = Window.partitionBy(F.lit(0))
    return m.select(by, "mse", "rmse", "mae", "r2",
                    *[(F.col(c) == F.min(c).over(w)).alias(f"best_{c}") for c in ("mse", "rmse", "mae")],
                    (F.col("r2") == F.max("r2").over(w)).alias("best_r2"))


def model_comparison_from_report(rep: DataFrame, by: str = "model") -> DataFrame:
    """Per-model accuracy, weighted recall and F1 with best / worst flags."""
    g = rep.groupBy(by).agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("recall"))).alias("recall"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("f1"))).alias("f1"))
    w = Window.partitionBy(F.lit(0))
    flags = []
    for c in ("accuracy", "recall", "f1"):
        flags += [(F.col(c) == F.max(c).over(w)).alias(f"best_{c}"),
                  (F.col(c) == F.min(c).over(w)).alias(f"worst_{c}")]
    return g.select(by, "accuracy", "recall", "f1", *flags)


def model_comparison(pred: DataFrame, y: str = "y", prediction: str = "prediction",
                     by: str = "model", regression: bool = False, mean_scale: int | None = None) -> DataFrame:
    """One row per model with best (and for classification worst) flags."""
    if regression:
        return flag_regression(regression_metrics(pred, y, prediction, by, mean_scale), by)
    return model_comparison_from_report(classification_report(pred, y, prediction, by), by)


# ------------------------------------------------------------------ V9 macro curve

def _asof(queries: DataFrame, knots: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """For each query row ``(keys, x)`` the nearest knot at or left of x
    (``lf``, ``lhi``) and strictly right of x (``rf``, ``rlo``) within the same
    key. x and knot positions are rates in [0, 1]: rows are bucketed by
    ``floor(x * buckets)`` so every window partition is one bucket of one key;
    buckets without a knot inherit the neighbours' knots through a window
    over the small (key x bucket) table."""
    b = F.least(F.floor(F.col("x") * buckets), F.lit(buckets - 1)).cast("int")
    q = queries.select(*keys, "x", F.lit(1).alias("_q"), F.lit(None).cast("double").alias("_lo"),
                       F.lit(None).cast("double").alias("_hi"))
    k = knots.select(*keys, "x", F.lit(0).alias("_q"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    u = q.unionByName(k).withColumn("_b", b)
    part = [*keys, "_b"]
    wl = Window.partitionBy(*part).orderBy("x", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wr = Window.partitionBy(*part).orderBy("x", "_q").rowsBetween(1, Window.unboundedFollowing)
    knot_x = F.when(F.col("_q") == 0, F.col("x"))
    u = u.select("*", F.last(knot_x, ignorenulls=True).over(wl).alias("lf"),
                 F.last("_hi", ignorenulls=True).over(wl).alias("lhi"),
                 F.first(knot_x, ignorenulls=True).over(wr).alias("rf"),
                 F.first("_lo", ignorenulls=True).over(wr).alias("rlo"))
    # knots carried across buckets: keys x buckets rows
    per = k.withColumn("_b", b).groupBy(*part).agg(
        F.max_by(F.struct(F.col("x").alias("px"), F.col("_hi").alias("phi")), F.col("x")).alias("last"),
        F.min_by(F.struct(F.col("x").alias("nx"), F.col("_lo").alias("nlo")), F.col("x")).alias("first"))
    grid = per.select(*keys)
    # attach the carries of the nearest knot buckets; the carry table has at
    # most keys x buckets rows. A query bucket without knots uses the
    # buckets around it: fill it from the all-bucket grid of the key.
    qb = u.where(F.col("_q") == 1)
    allb = grid.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b"))
    wpb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wnb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = per.select(*part, "last", "first")
    step = (allb.join(own, part, "left")
            .select(*part, F.last("last", ignorenulls=True).over(wpb).alias("upto"),
                    F.first("first", ignorenulls=True).over(wnb).alias("from_")))
    wb = Window.partitionBy(*keys).orderBy("_b")
    filled = step.select(*part, F.lag("upto").over(wb).alias("prev"), F.lead("from_").over(wb).alias("next"))
    j = qb.join(F.broadcast(filled.select(*part, "prev", "next")), part, "left")
    return j.select(
        *keys, "x",
        F.coalesce("lf", F.col("prev.px")).alias("lf"), F.coalesce("lhi", F.col("prev.phi")).alias("lhi"),
        F.coalesce("rf", F.col("next.nx")).alias("rf"), F.coalesce("rlo", F.col("next.nlo")).alias("rlo"))


def roc_macro(pred: DataFrame, y: str, probability: str, classes: Sequence[str],
              drop_intermediate: bool = True) -> DataFrame:
    """Macro-average ROC: mean over classes of each class's TPR linearly
    interpolated (numpy ``interp``: at a repeated FPR the last, top point) on
    the union of all classes' FPRs. Returns ``(fpr, tpr)``."""
    curves = roc_one_vs_rest(pred, y, probability, classes, drop_intermediate=drop_intermediate)
    knots = curves.groupBy("class", F.col("fpr").alias("x")).agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi"))
    xs = curves.select(F.col("fpr").alias("x")).distinct()
    names = F.array(*[F.lit(str(c)) for c in classes])
    queries = xs.select("x", F.explode(names).alias("class"))
    a = _asof(queries, knots, ["class"])
    t = F.when(F.col("rf").isNull(), F.col("lhi")).otherwise(
        F.col("lhi") + (F.col("x") - F.col("lf")) * (F.col("rlo") - F.col("lhi")) / (F.col("rf") - F.col("lf")))
    return a.groupBy(F.col("x").alias("fpr")).agg(F.avg(t).alias("tpr")).orderBy("fpr")

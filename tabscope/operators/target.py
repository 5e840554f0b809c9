"""Target preparation (T1-T6): profile, outliers and binning.

Bin edges are a handful of numbers (<= 11) computed by one aggregate and
applied as a right-closed ``when`` ladder (first bin closed on both sides),
matching ``pd.cut(..., include_lowest=True)``; values outside the edges get
no bin. Labels are formatted on the driver with Python's ``%.2f`` rounding.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.kinds import is_numeric, nan_to_null
from tabscope.plans.ordering import exact_quantiles


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Kind, distinct count, min and max of the target."""
    numeric = is_numeric(df.schema[target].dataType)
    y = nan_to_null(F.col(target).cast("double")) if numeric else F.col(target)
    return df.agg(
        F.lit("numeric" if numeric else "categorical").alias("kind"),
        F.count_distinct(y).alias("n_distinct"),
        (F.min(y) if numeric else F.lit(None).cast("double")).alias("min"),
        (F.max(y) if numeric else F.lit(None).cast("double")).alias("max"),
        F.count(F.when(y.isNull(), 1)).alias("nulls"))


def target_outliers(df: DataFrame, target: str) -> DataFrame:
    """Rows of the target strictly outside the Tukey fences."""
    from tabscope.operators.profile import iqr_outliers
    return iqr_outliers(df, [target]).select("lower_fence", "upper_fence", "n_outliers")


def _range(df: DataFrame, col: str) -> tuple[float, float]:
    row = df.agg(F.min(nan_to_null(F.col(col).cast("double"))).alias("mn"),
                 F.max(nan_to_null(F.col(col).cast("double"))).alias("mx")).first()
    return row["mn"], row["mx"]


def equal_width_edges(mn: float, mx: float, n_bins: int = 4) -> list[float]:
    return [float(x) for x in np.linspace(mn, mx, n_bins + 1)]


def quantile_edges(df: DataFrame, col: str, n_bins: int = 4) -> list[float]:
    probs = [i / n_bins for i in range(n_bins + 1)]
    rows = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [col], probs).collect()}
    edges = [float(rows[float(p)]) for p in probs]
    if len(set(edges)) != len(edges):
        raise ValueError(f"Bin edges must be unique: {edges}")
    return edges


def custom_edges(text: str | Sequence[float], mn: float, mx: float) -> list[float]:
    """Parse a comma list, dedupe, sort; extend to cover [min, max]."""
    pts = [float(x.strip()) for x in text.split(",")] if isinstance(text, str) else [float(x) for x in text]
    pts = sorted(set(pts))
    if len(pts) < 2:
        raise ValueError("at least 2 cut points are needed")
    if pts[0] > mn:
        pts.insert(0, mn)
    if pts[-1] < mx:
        pts.append(mx)
    return pts


def default_custom_text(mn: float, mx: float) -> str:
    return f"{mn},{(mn + mx) / 2:.2f},{mx}"


def bin_labels(edges: Sequence[float]) -> list[str]:
    return [f"{edges[i]:.2f}-{edges[i + 1]:.2f}" for i in range(len(edges) - 1)]


def bin_index(col: F.Column, edges: Sequence[float]) -> F.Column:
    """0-based bin of ``col`` for (a, b] bins, first bin [a, b]; NULL outside."""
    expr = F.when(col.isNull(), F.lit(None))
    expr = expr.when((col >= F.lit(edges[0])) & (col <= F.lit(edges[1])), F.lit(0))
    for i in range(1, len(edges) - 1):
        expr = expr.when((col > F.lit(edges[i])) & (col <= F.lit(edges[i + 1])), F.lit(i))
    return expr.otherwise(F.lit(None)).cast("int")


def apply_bins(df: DataFrame, col: str, edges: Sequence[float], out: str = "bin_id",
               label: str | None = "bin_label") -> DataFrame:
    y = nan_to_null(F.col(col).cast("double"))
    idx = bin_index(y, edges)
    res = df.withColumn(out, idx)
    if label:
        labels = bin_labels(edges)
        res = res.withColumn(label, F.element_at(F.array(*[F.lit(s) for s in labels]), F.col(out) + 1))
    return res


def bin_equal_width(df: DataFrame, col: str, n_bins: int = 4) -> tuple[DataFrame, list[float]]:
    if not 2 <= n_bins <= 10:
        raise ValueError("n_bins must be in 2..10")
    mn, mx = _range(df, col)
    if mn is None or mn == mx:
        raise ValueError("bins must increase monotonically (constant or empty column)")
    edges = equal_width_edges(mn, mx, n_bins)
    return apply_bins(df, col, edges), edges


def bin_quantile(df: DataFrame, col: str, n_bins: int = 4) -> tuple[DataFrame, list[float]]:
    if not 2 <= n_bins <= 10:
        raise ValueError("n_bins must be in 2..10")
    edges = quantile_edges(df, col, n_bins)
    return apply_bins(df, col, edges), edges


def bin_custom(df: DataFrame, col: str, text: str | Sequence[float] | None = None
               ) -> tuple[DataFrame, list[float]]:
    mn, mx = _range(df, col)
    edges = custom_edges(text if text is not None else default_custom_text(mn, mx), mn, mx)
    return apply_bins(df, col, edges), edges


def class_distribution(binned: DataFrame, edges: Sequence[float], bin_col: str = "bin_id") -> DataFrame:
    """Rows per bin in bin order, empty bins kept with 0 (bin dictionary left
    join the per-bin counts; both sides have len(edges)-1 rows)."""
    spark = binned.sparkSession
    labels = bin_labels(edges)
    bins = spark.createDataFrame([(i, labels[i]) for i in range(len(labels))], "bin_id int, bin_label string")
    counts = binned.where(F.col(bin_col).isNotNull()).groupBy(F.col(bin_col).alias("bin_id")).agg(
        F.count(F.lit(1)).alias("n"))
    return (bins.join(counts, "bin_id", "left")
            .select("bin_id", "bin_label", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin_id"))

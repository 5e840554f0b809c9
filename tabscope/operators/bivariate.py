"""Bivariate profiling (C1, C2, C4-C6): correlations as long tables.

Pearson for all pairs is one aggregate pass (pairwise-complete, as pandas).
Spearman is the Pearson correlation of average ranks; ranks come from the
distributed prefix sums over distinct values, joined back by value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.kinds import nan_to_null
from tabscope.plans.ordering import prefix_sums


def _clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])


def _long_matrix(one_row: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Reshape a one-row aggregate with ``c_i_j`` cells to ``(var1, var2, name)``
    for every ordered pair, diagonal included."""
    structs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            cell = f"c_{min(i, j)}_{max(i, j)}"
            structs.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                    F.col(cell).alias(name)))
    return one_row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def corr_pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cols = list(cols)
    d = _clean(df, cols)
    aggs = [F.corr(a, b).alias(f"c_{i}_{j}") for (i, a), (j, b)
            in ((x, y) for x in enumerate(cols) for y in enumerate(cols) if x[0] <= y[0])]
    return _long_matrix(d.agg(*aggs), cols, "r")


def rank_table(df: DataFrame, col: str) -> DataFrame:
    """``(value, avg_rank)`` over the non-null values of ``col`` (1-based,
    ties get the mean of their positions)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, [], "value", ["n"])
    return ranked.select("value", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def rank_tables(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(c, value, avg_rank)`` for all columns at once: one distinct-value
    count in long form and one keyed prefix-sum pass (one sketch job)."""
    long = d.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("value"))
                                        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    counts = long.where(F.col("value").isNotNull()).groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, ["c"], "value", ["n"])
    return ranked.select("c", "value", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def _with_ranks(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows plus ``_r_<col>`` average ranks; the rank table (distinct values
    of all columns) is built once, cached, and joined back per column."""
    from pyspark import StorageLevel
    rt = rank_tables(d, cols).persist(StorageLevel.MEMORY_AND_DISK)
    out = d
    for i, c in enumerate(cols):
        one = rt.where(F.col("c") == i).select(F.col("value").alias(c), F.col("avg_rank").alias(f"_r_{c}"))
        out = out.join(one, c, "left")
    return out


def corr_spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Spearman rho per pair on the rows complete for that pair (pandas).
    When no selected column holds nulls, ranks are computed once per column;
    otherwise each pair re-ranks its complete rows."""
    cols = list(cols)
    d = _clean(df, cols)
    nulls = d.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first()
    if all(nulls[c] == 0 for c in cols):
        rk = _with_ranks(d, cols)
        aggs = [F.corr(f"_r_{a}", f"_r_{b}").alias(f"c_{i}_{j}")
                for (i, a), (j, b) in ((x, y) for x in enumerate(cols) for y in enumerate(cols) if x[0] <= y[0])]
        return _long_matrix(rk.agg(*aggs), cols, "rho")
    cells = []
    for (i, a), (j, b) in ((x, y) for x in enumerate(cols) for y in enumerate(cols) if x[0] <= y[0]):
        sub = d.select(a, b) if a != b else d.select(a)
        sub = sub.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        rk = _with_ranks(sub, [a] if a == b else [a, b])
        cells.append(rk.agg(F.corr(f"_r_{a}", f"_r_{b}").alias(f"c_{i}_{j}")).withColumn("_k", F.lit(0)))
    row = cells[0]
    for c in cells[1:]:
        row = row.join(c, "_k")
    return _long_matrix(row, cols, "rho")


def strong_pairs(matrix: DataFrame, threshold: float = 0.7, value: str = "r") -> DataFrame:
    """Off-diagonal pairs with |r| > threshold, strongest first; both (A, B)
    and (B, A) appear, as in the unstacked matrix."""
    return (matrix.where((F.col("var1") != F.col("var2")) & (F.abs(F.col(value)) > threshold))
            .orderBy(F.desc(value), "var1", "var2"))


def top_pairs(matrix: DataFrame, k: int = 4, threshold: float = 0.7, value: str = "r",
              unique: bool = False) -> DataFrame:
    s = strong_pairs(matrix, threshold, value)
    if unique:
        s = s.where(F.col("var1") < F.col("var2"))
    return s.limit(k)


def ols_trend(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Least-squares line ``y = slope * x + intercept`` per (x, y) pair, with
    R^2 and the number of complete rows; one aggregate pass for all pairs."""
    cols = sorted({c for p in pairs for c in p})
    d = _clean(df, cols)
    aggs = []
    for i, (x, y) in enumerate(pairs):
        aggs += [F.regr_slope(y, x).alias(f"s{i}"), F.regr_intercept(y, x).alias(f"i{i}"),
                 F.regr_r2(y, x).alias(f"r{i}"), F.regr_count(y, x).alias(f"n{i}")]
    row = d.agg(*aggs)
    structs = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"s{i}").alias("slope"),
                        F.col(f"i{i}").alias("intercept"), F.col(f"r{i}").alias("r2"),
                        F.col(f"n{i}").alias("n")) for i, (x, y) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def scatter_points(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The points of the scatter charts with their trend line: one row per pair
    and complete row, with the fitted value (NULL where x is constant). One pass
    for the lines and one for the points; only the lines, a row per pair, are broadcast."""
    lines = ols_trend(df, pairs).select(F.col("x").alias("x_name"), F.col("y").alias("y_name"), "slope", "intercept")
    d = _clean(df, sorted({c for p in pairs for c in p}))
    points = [F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
              for x, y in pairs]
    long = d.select(F.explode(F.array(*points)).alias("p")).select("p.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return long.join(F.broadcast(lines), ["x_name", "y_name"]).select(
        "x_name", "y_name", "x", "y", (F.col("slope") * F.col("x") + F.col("intercept")).alias("fitted"))


def all_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


# ------------------------------------------------------------------ C3 Kendall tau-b

KENDALL_FANOUT = 16


def _kendall_pair(d: DataFrame, x: str, y: str, fanout: int = KENDALL_FANOUT) -> DataFrame:
    """One row ``(tau)``: Kendall tau-b of complete (x, y) rows, exact.

    S = sum over rows i of C_i - D_i with C_i / D_i counted against rows of
    smaller x, which equals 2 * sum(dom_i) + (pairs tied in y only) - (pairs
    with different x), dom_i = #{j: x_j < x_i, y_j < y_i}. The dominance sum
    is computed without forming pairs: distinct x values get their dense
    rank (distributed prefix sums); its base-``fanout`` digits define nested
    x groups; at each digit level, rows are grouped by (parent group, y) with
    one count per child digit, and prefix sums over y inside each parent give
    for every child the rows of *smaller* children below the current y. The
    last level separates single x values, so every pair with different x is
    counted exactly once. Cost: levels = ceil(log_fanout(distinct x)) passes.
    """
    pts = d.select(F.col(x).alias("x"), F.col(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    cxy = pts.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    xs = cxy.groupBy("x").agg(F.sum("n").alias("nx"), F.lit(1).cast("long").alias("one"))
    ranked = prefix_sums(xs, [], "x", ["one"]).select("x", (F.col("cum_one") - 1).alias("dr"), "nx")
    ties = {}
    ties.update(cxy.agg(F.sum("n").alias("N"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n3")).first().asDict())
    ties.update(xs.agg(F.count(F.lit(1)).alias("D"), F.sum(F.col("nx") * (F.col("nx") - 1) / 2).alias("n1")).first().asDict())
    ties.update(cxy.groupBy("y").agg(F.sum("n").alias("ny")).agg(
        F.sum(F.col("ny") * (F.col("ny") - 1) / 2).alias("n2")).first().asDict())
    n_all, n_x = int(ties["N"] or 0), int(ties["D"] or 0)
    spark = d.sparkSession
    if n_all < 2:
        return spark.createDataFrame([(None,)], "tau double")
    levels = 1
    while fanout ** levels < n_x:
        levels += 1
    base = cxy.join(ranked.select("x", "dr"), "x").select("y", "n", "dr")
    dom = 0
    for lvl in range(1, levels + 1):
        hi = fanout ** (levels - lvl + 1)
        lo = fanout ** (levels - lvl)
        rows = base.select(F.floor(F.col("dr") / hi).alias("parent"), "y", "n",
                           (F.floor(F.col("dr") / lo) % fanout).cast("int").alias("sub"))
        m = [f"m{b}" for b in range(fanout)]
        g = rows.groupBy("parent", "y").agg(*[F.sum(F.when(F.col("sub") == b, F.col("n")).otherwise(0)).alias(m[b])
                                              for b in range(fanout)])
        c = prefix_sums(g, ["parent"], "y", m, buckets=16)
        less = [F.col(f"cum_{mb}") - F.col(mb) for mb in m]
        contrib = None
        suffix = None
        for b in range(fanout - 1, 0, -1):
            suffix = F.col(m[b]) if suffix is None else suffix + F.col(m[b])
            term = less[b - 1] * suffix
            contrib = term if contrib is None else contrib + term
        dom += int(c.agg(F.sum(contrib).alias("s")).first()["s"] or 0)
    n0 = n_all * (n_all - 1) // 2
    n1, n2, n3 = int(ties["n1"]), int(ties["n2"]), int(ties["n3"])
    s = 2 * dom + (n2 - n3) - (n0 - n1)
    den = (n0 - n1) * (n0 - n2)
    tau = s / math.sqrt(den) if den > 0 else None
    return spark.createDataFrame([(tau, s)], "tau double, s long")


def corr_kendall(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Kendall tau-b matrix in long form ``(var1, var2, tau)`` (pandas
    ``corr(method='kendall')``), each pair on its complete rows."""
    cols = list(cols)
    d = _clean(df, cols)
    spark = df.sparkSession
    vals = {}
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            if i == j:
                nd = d.where(F.col(a).isNotNull()).select(a).distinct().limit(2).count()
                vals[(a, a)] = 1.0 if nd > 1 else None
            else:
                vals[(a, b)] = _kendall_pair(d, a, b).first()["tau"]
    rows = [(a, b, vals[(a, b)] if (a, b) in vals else vals[(b, a)]) for a in cols for b in cols]
    return spark.createDataFrame(rows, "var1 string, var2 string, tau double")

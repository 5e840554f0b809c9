"""Scalable ordering: exact ranks, prefix sums and quantiles without a
single-partition window.

``Window.orderBy(x)`` without ``partitionBy`` moves every row to one task.
Instead every ordered computation here runs in four declarative steps:

1. pre-aggregate to distinct order values (map-side partial aggregation, so
   a hot value that holds a third of all rows becomes one row with a count);
2. cut the distinct values into ``buckets`` ranges whose edges come from
   ``percentile_approx`` (a fixed-size sketch per key);
3. per-bucket totals (keys x buckets rows) turned into exclusive offsets by a
   window over that small table;
4. a window partitioned by (key, bucket) plus the broadcast offset.

The result is exact whatever the quality of the edges: edges only decide how
the work is spread. Everything stays lazy; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.kinds import nan_to_null

DEFAULT_BUCKETS = 64
MAX_ROWS_PER_BUCKET = 1_000_000
_ONE = "_one_key"


def long_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric ``cols`` to ``(keep..., column, value double)``, nulls/NaN dropped."""
    cast = df.select(*keep, *[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    long = cast.unpivot(list(keep), list(cols), "column_name", "value")
    return long.where(F.col("value").isNotNull())


def distinct_value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, n)``: rows per distinct non-null value of each column."""
    return (long_values(df, cols)
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def with_bucket(df: DataFrame, order: str, edges: str, out: str, max_edges: int) -> DataFrame:
    """``out`` = number of entries of the sorted array ``edges`` strictly
    below ``order`` (equal values share a bucket), by binary search: one
    narrow projection per halving step, all inside whole-stage codegen."""
    step = 1
    while step * 2 <= max(max_edges, 1):
        step *= 2
    d = df.withColumn(out, F.lit(0))
    size = F.size(F.col(edges))
    while step >= 1:
        nxt = F.col(out) + step
        d = d.withColumn(out, F.when((nxt <= size) & (F.element_at(F.col(edges), nxt) < F.col(order)), nxt)
                         .otherwise(F.col(out)))
        step //= 2
    return d


def prefix_sums(df: DataFrame, keys: Sequence[str], order_col: str,
                measures: Sequence[str], descending: bool = False,
                buckets: int = DEFAULT_BUCKETS, following: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<m>``: sum of ``m`` over rows of the same key whose order value
    is <= the current one (>= when ``descending``), ties included. ``following``
    adds ``next_<m>``: ``m`` of the key's next row (order values must differ).

    Input rows should be few per distinct (keys, order value), i.e. already
    aggregated; the output keeps every input column.
    """
    keys = list(keys)
    o = F.col(order_col).cast("double")
    base = df.withColumn("_ord", -o if descending else o)
    jkeys = keys or [_ONE]
    if not keys:
        base = base.withColumn(_ONE, F.lit(0))
    probs = [i / buckets for i in range(1, buckets)]
    # one sketch row per key: keys x buckets doubles, bounded by the key count;
    # the row count rides along and, when a bucket would exceed
    # MAX_ROWS_PER_BUCKET rows, the sketch is redone with more buckets
    sk = base.groupBy(*jkeys).agg(F.percentile_approx("_ord", probs, 10000).alias("_edges"),
                                  F.count(F.lit(1)).alias("_rows")).collect()
    biggest = max((r["_rows"] for r in sk), default=0)
    if biggest > buckets * MAX_ROWS_PER_BUCKET:
        buckets = 1 << math.ceil(math.log2(biggest / MAX_ROWS_PER_BUCKET))
        probs = [i / buckets for i in range(1, buckets)]
        sk = base.groupBy(*jkeys).agg(F.percentile_approx("_ord", probs, 10000).alias("_edges")).collect()
    spark = df.sparkSession
    key_fields = [base.schema[k] for k in jkeys]
    schema = T.StructType([*key_fields, T.StructField("_edges", T.ArrayType(T.DoubleType()))])
    edges = spark.createDataFrame([tuple(r[k] for k in jkeys) + (r["_edges"],) for r in sk], schema)
    with_b = with_bucket(base.join(F.broadcast(edges), jkeys), "_ord", "_edges", "_b", buckets - 1).drop("_edges")
    totals = with_b.groupBy(*jkeys, "_b").agg(
        *[F.sum(m).alias(f"_t_{m}") for m in measures], *[F.min_by(m, "_ord").alias(f"_f_{m}") for m in following])
    w_off = (Window.partitionBy(*jkeys).orderBy("_b")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*jkeys, "_b", *[
        F.coalesce(F.sum(f"_t_{m}").over(w_off), F.lit(0)).alias(f"_off_{m}")
        for m in measures], *[F.lead(f"_f_{m}").over(Window.partitionBy(*jkeys).orderBy("_b")).alias(f"_nb_{m}") for m in following])
    w_next = Window.partitionBy(*jkeys, "_b").orderBy("_ord")
    w = (Window.partitionBy(*jkeys, "_b").orderBy("_ord")
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = with_b.join(F.broadcast(offsets), jkeys + ["_b"]).select(
        *[F.col(c) for c in base.columns],
        *[(F.sum(m).over(w) + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.coalesce(F.lead(m).over(w_next), F.col(f"_nb_{m}")).alias(f"next_{m}") for m in following])
    drop = ["_ord", "_b"] + ([_ONE] if not keys else [])
    return out.drop(*drop)


QUANTILE_BUCKETS = 1024
MAX_BUCKET_ROWS = 2_000_000
MAX_LEVELS = 4


def _path_columns(v: F.Column, lo: float, hi: float, depth: int, buckets: int) -> list[F.Column]:
    """Nested equal-width bucket indices of ``v`` for levels 1..depth: level
    L cuts the level L-1 bucket [lo, hi] into ``buckets`` equal parts
    (clamped, so every value of a bucket gets a sub-bucket)."""
    ks = []
    clo, chi = F.lit(float(lo)), F.lit(float(hi))
    for _ in range(depth):
        k = F.when(chi > clo, F.least(F.greatest(F.floor((v - clo) * float(buckets) / (chi - clo)), F.lit(0)),
                                      F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
        ks.append(k)
        w = (chi - clo) / float(buckets)
        clo, chi = clo + k * w, clo + (k + 1) * w
    return ks


def _bounds(lo: float, hi: float, path: tuple, buckets: int) -> tuple[float, float]:
    """Driver-side bounds of a bucket path (same arithmetic as the columns)."""
    for k in path:
        w = (hi - lo) / float(buckets)
        lo, hi = lo + k * w, lo + (k + 1) * w
    return lo, hi


def _exploded_paths(dbl: DataFrame, cols: list[str], bounds: dict, depth: int, buckets: int, only: set[int]) -> DataFrame:
    """``(c, k1..k_depth, value)`` rows: one per non-null cell of the columns numbered ``only``."""
    structs = []
    for i, c in enumerate(cols):
        if c not in bounds or i not in only:
            continue
        ks = _path_columns(F.col(c), *bounds[c], depth, buckets)
        structs.append(F.struct(F.lit(i).alias("c"), *[k.alias(f"k{j + 1}") for j, k in enumerate(ks)],
                                F.col(c).alias("value")))
    return dbl.select(F.explode(F.array(*structs)).alias("s")).select("s.*").where(F.col("value").isNotNull())


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    buckets: int = QUANTILE_BUCKETS, max_bucket_rows: int = MAX_BUCKET_ROWS,
                    stats: dict | None = None) -> DataFrame:
    """``(column_name, prob, quantile)``: linear-interpolated exact quantiles
    (pandas ``quantile``, SQL ``percentile_cont``) of each numeric column.

    Narrow passes only, none gathering a column in one task:
    (1) count / min / max per column;
    (2) rows per equal-width bucket (columns x buckets counts reach the
        driver and locate every wanted rank in one bucket); a bucket holding
        more than ``max_bucket_rows`` rows is cut again the same way, at most
        ``MAX_LEVELS`` times, scanning only the rows of such buckets;
    (3) only the rows of the final buckets: distinct values with counts (a
        hot value collapses to one row), ranked by a window per bucket.
    The result (columns x probs numbers) is returned as a small DataFrame.
    """
    cols = list(cols)
    probs = [float(p) for p in probs]
    spark = df.sparkSession
    dbl = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    if stats is not None:       # (count, min, max) per column, from the caller's own pass
        st = {k: v for i, c in enumerate(cols)
              for k, v in zip((f"n{i}", f"a{i}", f"b{i}"), stats[c])}
    else:
        st = dbl.agg(*[x for i, c in enumerate(cols) for x in
                       (F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]).first()
    plan, pend = {}, {}
    for i, c in enumerate(cols):
        total = st[f"n{i}"]
        if not total:
            continue
        for p in probs:
            h = (total - 1) * p
            lo = math.floor(h)
            hi = min(lo + 1, total - 1)
            plan[(c, p)] = (lo, hi, h - lo)
            for pos in (lo, hi):
                pend[(i, pos)] = [(), pos]          # bucket path so far, rank inside it
    bounds = {c: (st[f"a{i}"], st[f"b{i}"]) for i, c in enumerate(cols) if st[f"n{i}"]}
    if not pend:
        return spark.createDataFrame([], "column_name string, prob double, quantile double")
    open_ = set(pend)
    resolved: dict[tuple, float] = {}
    for depth in range(1, MAX_LEVELS + 1):
        if not open_:
            break
        prefixes = sorted({(i, pend[key][0]) for key in open_ for i in [key[0]]})
        ex = _exploded_paths(dbl, cols, bounds, depth, buckets, {i for i, _ in prefixes})
        kc = [f"k{j}" for j in range(1, depth)]
        if depth > 1:
            pdf = spark.createDataFrame([(i, *path) for i, path in prefixes],
                                        ", ".join(["c int"] + [f"{k} int" for k in kc]))
            ex = ex.join(F.broadcast(pdf), ["c", *kc])
        rows = ex.groupBy("c", *kc, f"k{depth}").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("vmin"),
                                                     F.max("value").alias("vmax")).collect()
        counts: dict[tuple, dict[int, int]] = {}
        single: dict[tuple, float] = {}
        for r in rows:
            counts.setdefault((r["c"], tuple(r[k] for k in kc)), {})[r[f"k{depth}"]] = r["n"]
            if r["vmin"] == r["vmax"]:
                single[(r["c"], tuple(r[k] for k in kc) + (r[f"k{depth}"],))] = r["vmin"]
        still = set()
        for key in open_:
            path, local = pend[key]
            per = counts[(key[0], path)]
            acc = 0
            for k in sorted(per):
                if acc + per[k] > local:
                    break
                acc += per[k]
            pend[key] = [path + (k,), local - acc]
            if (key[0], path + (k,)) in single:          # one distinct value: rank resolved
                resolved[key] = single[(key[0], path + (k,))]
                continue
            lo, hi = _bounds(*bounds[cols[key[0]]], path + (k,), buckets)
            if per[k] > max_bucket_rows and hi > lo and depth < MAX_LEVELS:
                still.add(key)
        open_ = still
    # pick: distinct values of the final buckets, ranked inside each bucket
    # (buckets holding a single distinct value were resolved above)
    picked = []
    todo = {k: v for k, v in pend.items() if k not in resolved}
    for depth in sorted({len(v[0]) for v in todo.values()}):
        kc = [f"k{j}" for j in range(1, depth + 1)]
        keys = [(i, pos, path, local) for (i, pos), (path, local) in todo.items() if len(path) == depth]
        tdf = spark.createDataFrame([(i, *path, int(local), int(pos)) for i, pos, path, local in keys],
                                    ", ".join(["c int"] + [f"{k} int" for k in kc] + ["local long", "pos long"]))
        wanted = tdf.select("c", *kc).distinct()
        sub = (_exploded_paths(dbl, cols, bounds, depth, buckets, {k[0] for k in keys}).join(F.broadcast(wanted), ["c", *kc])
               .groupBy("c", *kc, "value").agg(F.count(F.lit(1)).alias("n")))
        w = Window.partitionBy("c", *kc).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = (sub.withColumn("cum", F.sum("n").over(w)).join(F.broadcast(tdf), ["c", *kc])
               .where((F.col("cum") - F.col("n") <= F.col("local")) & (F.col("local") < F.col("cum"))))
        picked.append(hit.select("c", "pos", "value"))
    val = {(cols[i], pos): v for (i, pos), v in resolved.items()}
    if picked:
        allp = picked[0]
        for p in picked[1:]:
            allp = allp.unionByName(p)
        val.update({(cols[r["c"]], r["pos"]): r["value"] for r in allp.collect()})
    rows = []
    for (c, p), (lo, hi, frac) in plan.items():
        xlo, xhi = val[(c, lo)], val[(c, hi)]
        rows.append((c, p, xlo + (xhi - xlo) * frac))
    return spark.createDataFrame(rows, "column_name string, prob double, quantile double")


def quantiles_from_counts(counts: DataFrame, probs: Sequence[float],
                          buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Quantiles from a ``(column, value, n)`` table."""
    ranked = prefix_sums(counts, ["column_name"], "value", ["n"], buckets=buckets)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("_N"))
    targets = (totals
               .select("column_name", "_N", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
               .withColumn("_h", (F.col("_N") - 1) * F.col("prob"))
               .withColumn("_lo", F.floor("_h"))
               .withColumn("_frac", F.col("_h") - F.col("_lo"))
               .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_N") - 1))
               .select("column_name", "prob", "_frac",
                       F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("_lo").alias("pos")),
                                         F.struct(F.lit(1).alias("which"), F.col("_hi").alias("pos"))))
                       .alias("_t"))
               .select("column_name", "prob", "_frac", "_t.which", "_t.pos"))
    # targets: columns x probs x 2 rows -> broadcast; range condition on the ranks
    rk, tg = ranked.alias("rk"), targets.alias("tg")
    hit = rk.join(
        F.broadcast(tg),
        (F.col("rk.column_name") == F.col("tg.column_name"))
        & (F.col("rk.cum_n") - F.col("rk.n") <= F.col("tg.pos"))
        & (F.col("tg.pos") < F.col("rk.cum_n")),
    ).select(F.col("tg.column_name").alias("column_name"), F.col("tg.prob").alias("prob"),
             F.col("tg._frac").alias("_frac"), F.col("tg.which").alias("which"),
             F.col("rk.value").alias("value"))
    picked = hit.groupBy("column_name", "prob").agg(
        F.max(F.when(F.col("which") == 0, F.col("value"))).alias("_xlo"),
        F.max(F.when(F.col("which") == 1, F.col("value"))).alias("_xhi"),
        F.max("_frac").alias("_frac"))
    return picked.select(
        "column_name", "prob",
        (F.col("_xlo") + (F.col("_xhi") - F.col("_xlo")) * F.col("_frac")).alias("quantile"))


def pivot_quantiles(q: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``(column, name_1, ..., name_k)`` from the long quantile table."""
    return q.groupBy("column_name").agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n)
        for p, n in zip(probs, names)])

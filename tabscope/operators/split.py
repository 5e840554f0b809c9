"""Exact, seeded, stratified train/test split (L1-L4).

Counts per class follow the quota rule of a stratified shuffle split:
``n_test = ceil(test_size * n)``, ``n_train = n - n_test``; each class gets
``floor(n_train * n_c / n)`` train rows and the remaining train rows go to
the largest remainders (ties by class label); the rest of a class is test.

Rows are ordered inside their class by ``md5("seed:key")``. To avoid a
window over a whole class, the hash prefix cuts each class into buckets; the
per-(class, bucket) counts give every bucket its offset, so whole buckets are
train or test at once and only the one bucket per class that straddles the
quota is ranked by a window. The counts are a job of their own whose result is
one row per class, so the split itself is a narrow pass over the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.sources.files import sample_order

ROWS_PER_BUCKET = 1_000_000


def class_counts(df: DataFrame, stratify: str | None) -> dict:
    """Rows per class (classes are a bounded set: a classification target)."""
    if stratify is None:
        return {None: df.count()}
    return {r[0]: r[1] for r in df.groupBy(stratify).count().collect()}


def stratified_quotas(counts: dict, test_size: float) -> dict:
    """Train rows per class by the largest-remainder rule."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    labels = sorted(counts, key=lambda v: (v is None, v))
    cont = {c: counts[c] / n * n_train for c in labels}
    floored = {c: math.floor(cont[c]) for c in labels}
    need = int(n_train - sum(floored.values()))
    order = sorted(labels, key=lambda c: (-(cont[c] - floored[c]), labels.index(c)))
    for c in order[:max(need, 0)]:
        floored[c] += 1
    return floored


def can_stratify(counts: dict) -> bool:
    return len(counts) >= 2 and min(counts.values()) >= 2


def stratified_is_valid(counts: dict, test_size: float) -> bool:
    """Conditions under which a stratified split succeeds."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    k = len(counts)
    return can_stratify(counts) and n_train >= k and n_test >= k


def _assign(df: DataFrame, key: str, seed: int, stratify: str | None, quotas: dict,
            max_class: int) -> DataFrame:
    spark = df.sparkSession
    # 16^digits buckets per class: <= 65,536, so a straddling bucket holds
    # max_class / 65,536 rows and the bucket table stays classes x 65,536 rows
    digits = min(4, max(2, math.ceil(math.log(max(max_class / ROWS_PER_BUCKET, 1), 16))))
    h = sample_order(key, seed)
    cls = F.col(stratify) if stratify else F.lit(None).cast("string")
    # a generated column is computed once a row; a projected one again in every filter and column that uses it
    base = df.select("*", F.explode(F.array(h)).alias("_h")).withColumn("_c", cls.cast("string")) \
             .withColumn("_bk", F.substring("_h", 1, digits))
    q = spark.createDataFrame([(None if c is None else str(c), int(v)) for c, v in quotas.items()],
                              "_c string, _quota long")
    per = base.groupBy("_c", "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy("_c").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
           .join(F.broadcast(q), per["_c"].eqNullSafe(q["_c"])).drop(q["_c"]))
    # buckets come in order: whole train up to one, whole test after the one that straddles the quota;
    # rows without a key have no bucket and are on no side
    train, edge = F.col("_off") + F.col("_cnt") <= F.col("_quota"), F.col("_off") < F.col("_quota")
    sides = per.where(F.col("_bk").isNotNull()).groupBy("_c").agg(
        F.max(F.when(train, F.col("_bk"))).alias("_train"), F.max(F.when(~train & edge, F.struct("_bk", "_off", "_quota"))).alias("_edge"))
    # one row per class: null-safe, rows without a class are a class of their own
    sides = spark.createDataFrame([(r["_c"], r["_train"] or "", r["_edge"] or ("", 0, 0)) for r in sides.collect()],
                                  "_pc string, _train string, _edge struct<_bk: string, _off: long, _quota: long>")
    found = base.join(F.broadcast(sides), base["_c"].eqNullSafe(sides["_pc"])) if stratify else base.crossJoin(F.broadcast(sides))
    tagged = found.where(F.col("_bk").isNotNull())
    plain = tagged.where(F.col("_bk") != F.col("_edge._bk")).withColumn("is_test", F.col("_bk") > F.col("_train"))
    rw = Window.partitionBy("_c", "_bk").orderBy("_h", key)
    edge = (tagged.where(F.col("_bk") == F.col("_edge._bk"))
            .withColumn("is_test", F.col("_edge._off") + F.row_number().over(rw) > F.col("_edge._quota")))
    out = plain.unionByName(edge)
    return out.select(*df.columns, "is_test")


def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
          stratify: str | None = None) -> DataFrame:
    """``df`` plus boolean ``is_test``; exact per-class counts."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    counts = class_counts(df, stratify)
    if stratify is not None and not stratified_is_valid(counts, test_size):
        raise ValueError("stratified split impossible: a class has fewer than 2 rows "
                         "or a side is smaller than the number of classes")
    quotas = stratified_quotas(counts, test_size)
    return _assign(df, key, seed, stratify, quotas, max(counts.values()))


def split_random(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    return split(df, key, test_size, seed, None)


def split_with_fallback(df: DataFrame, key: str, target: str, test_size: float = 0.2,
                        seed: int = 42, classification: bool = True) -> tuple[DataFrame, bool]:
    """Stratified when possible, else unstratified; returns (df, stratified?)."""
    if classification:
        counts = class_counts(df, target)
        if stratified_is_valid(counts, test_size):
            quotas = stratified_quotas(counts, test_size)
            return _assign(df, key, seed, target, quotas, max(counts.values())), True
    return split_random(df, key, test_size, seed), False


def stratify_check(df: DataFrame, target: str) -> DataFrame:
    """One row: number of classes, smallest class, can stratify."""
    c = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_class_rows")).select(
        "n_classes", "min_class_rows",
        ((F.col("n_classes") >= 2) & (F.col("min_class_rows") >= 2)).alias("can_stratify"))

"""Projections, filters and cleaning (P1-P15). All narrow or one-pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.kinds import (categorical_columns, floating_columns, is_infinite,
                                      nan_to_null, numeric_columns)
from tabscope.plans.ordering import exact_quantiles

# --- fixed values --------------------------------------------------------------
UNKNOWN_CATEGORY = "DESCONOCIDO"   # fill value of an all-null categorical column
MISSING_LABEL = "?"                # label text that means "missing"
HIGH_LOSS_PCT = 30.0
MODERATE_LOSS_PCT = 10.0
MIN_ROWS = 10
WARN_ROWS = 50
# -------------------------------------------------------------------------------


def select_features(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """Target plus chosen predictors (default: every other column)."""
    feats = list(features) if features is not None else [c for c in df.columns if c != target]
    if not feats:
        raise ValueError("select at least one predictor")
    return df.select(*feats, target)


def select_by_kind(df: DataFrame, kind: str) -> DataFrame:
    cols = numeric_columns(df) if kind == "numeric" else categorical_columns(df)
    return df.select(*cols)


def drop_null_column(df: DataFrame, col: str) -> DataFrame:
    c = nan_to_null(F.col(col)) if col in floating_columns(df) else F.col(col)
    return df.select(F.col(col)).where(c.isNotNull())


def _any(conds: list[F.Column]) -> F.Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def infinite_mask(df: DataFrame, cols: Sequence[str] | None = None) -> F.Column:
    """True when any floating predictor holds +-inf (integers cannot)."""
    flo = set(floating_columns(df))
    cs = [c for c in (cols if cols is not None else df.columns) if c in flo]
    return _any([F.coalesce(is_infinite(F.col(c)), F.lit(False)) for c in cs])


def filter_infinite(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with +-inf in any floating predictor (the target is not tested)."""
    return df.where(~infinite_mask(df, cols))


def infinite_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    flo = set(floating_columns(df))
    cs = set(c for c in (cols if cols is not None else df.columns) if c in flo)
    return df.select(*[F.when(is_infinite(F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in cs else F.col(c) for c in df.columns])


def _null(df: DataFrame, c: str) -> F.Column:
    col = nan_to_null(F.col(c)) if c in floating_columns(df) else F.col(c)
    return col.isNull()


def null_mask(df: DataFrame, cols: Sequence[str]) -> F.Column:
    """True when any of ``cols`` is null (or NaN)."""
    return _any([_null(df, c) for c in cols])


def null_row_filter(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null (or NaN) in any of ``cols``."""
    return df.where(~null_mask(df, cols))


def missing_row_summary(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows with any null predictor, rows with a null target (one pass)."""
    return df.agg(
        F.count(F.when(_any([_null(df, c) for c in features]), 1)).alias("rows_missing_x"),
        F.count(F.when(_null(df, target), 1)).alias("rows_missing_y"))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(~_null(df, target))


def cleaning_report(df: DataFrame, keep: F.Column) -> DataFrame:
    """Rows before/after a cleaning predicate, removed share, severity and the
    row-floor verdict, from two conditional counts in one pass."""
    c = df.agg(F.count(F.lit(1)).alias("rows_before"),
               F.count(F.when(keep, 1)).alias("rows_after"))
    removed = F.col("rows_before") - F.col("rows_after")
    pct = F.when(F.col("rows_before") > 0, 100.0 * removed / F.col("rows_before")).otherwise(0.0)
    return c.select(
        "rows_before", "rows_after", removed.alias("rows_removed"), pct.alias("removed_pct"),
        F.when(pct > HIGH_LOSS_PCT, "high").when(pct > MODERATE_LOSS_PCT, "moderate")
        .when(removed > 0, "low").otherwise("none").alias("loss"),
        F.when(F.col("rows_after") < MIN_ROWS, "stop").when(F.col("rows_after") < WARN_ROWS, "warn")
        .otherwise("ok").alias("status"))


# ------------------------------------------------------------------ imputation

def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians (linear interpolation) of numeric columns; a small dict."""
    if not cols:
        return {}
    rows = exact_quantiles(df, cols, [0.5]).collect()
    got = {r["column_name"]: r["quantile"] for r in rows}
    return {c: got.get(c) for c in cols}


def mode_table(df: DataFrame, col: str) -> DataFrame:
    """One row ``(mode)``: most frequent non-null value, ties -> smallest.

    Distinct values are counted by a shuffle on the value, then reduced with
    ``min_by`` (fixed-size buffer), so no task ever holds all values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    out = {}
    for c in cols:
        m = mode_table(df, c).first()["mode"]
        out[c] = m if m is not None else UNKNOWN_CATEGORY
    return out


def fill_values(df: DataFrame, values: dict) -> DataFrame:
    """Replace NULL/NaN by the fitted value per column (one projection)."""
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in values and values[c] is not None:
            col = _null(df, c)
            out.append(F.when(col, F.lit(values[c]).cast(f.dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fill_values(df, fit_medians(df, cols))


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fill_values(df, fit_modes(df, cols))


# ------------------------------------------------------------------ labels / classes

def strip_text(c: F.Column) -> F.Column:
    """Python ``str.strip``: remove leading and trailing whitespace (text without any is not searched)."""
    stripped = F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
    return F.when(F.btrim(c, F.lit(" \t\n\x0b\f\r\x85\u2028\u2029")) == c, c).otherwise(stripped)


def normalize_label(df: DataFrame, target: str) -> DataFrame:
    """Categorical target: text, stripped, ``?`` -> NULL, NULL rows dropped."""
    y = strip_text(F.col(target).cast("string"))
    y = F.when(y == MISSING_LABEL, F.lit(None)).otherwise(y)
    return df.withColumn(target, y).where(F.col(target).isNotNull())


def drop_rare_classes(df: DataFrame, target: str, min_rows: int = 2) -> DataFrame:
    """Keep classes with at least ``min_rows`` rows (left-semi join; the class
    table is broadcast only when AQE measures it small)."""
    keep = (df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") >= min_rows).select(target))
    return df.join(keep, target, "left_semi")


def rare_class_report(df: DataFrame, target: str, min_rows: int = 2) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    rare = F.col("n") < min_rows
    return counts.agg(F.count(F.when(rare, 1)).alias("classes_removed"),
                      F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("rows_removed"))


def class_sufficiency(df: DataFrame, target: str, split_col: str | None = None) -> DataFrame:
    """Distinct classes overall (and per split side); ok when >= 2."""
    parts = [df.agg(F.lit("all").alias("scope"), F.count_distinct(target).alias("n_classes"))]
    if split_col:
        side = F.when(F.col(split_col), "test").otherwise("train")
        parts.append(df.groupBy(side.alias("scope")).agg(F.count_distinct(target).alias("n_classes")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("ok", F.col("n_classes") >= 2)


def schema_check(new: DataFrame, required: Sequence[str], types: dict[str, T.DataType],
                 categories: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per required predictor: present?, non-castable cells, unseen categories.

    ``categories`` maps a categorical column to a one-column DataFrame of
    trained values; unseen values are found with a left-anti join."""
    present = set(new.columns)
    rows = []
    aggs = []
    for c in required:
        if c in present and not isinstance(types.get(c), T.StringType):
            col = F.col(c)
            aggs.append(F.count(F.when(col.isNotNull() & col.cast("string").try_cast(types[c]).isNull(), 1))
                        .alias(f"bad_{c}"))
    bad = new.agg(*aggs).first() if aggs else None
    spark = new.sparkSession
    for c in required:
        if c not in present:
            rows.append((c, False, None, None))
            continue
        nb = bad[f"bad_{c}"] if bad is not None and f"bad_{c}" in bad.asDict() else None
        unseen = None
        if categories and c in categories:
            known = categories[c].select(F.col(categories[c].columns[0]).alias(c))
            unseen = (new.where(F.col(c).isNotNull()).select(c).distinct()
                      .join(known, c, "left_anti").count())
        rows.append((c, True, None if nb is None else int(nb), unseen))
    return spark.createDataFrame(rows, "column_name string, present boolean, "
                                       "non_castable long, unseen_categories long")

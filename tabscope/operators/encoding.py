"""Feature encoding (E1-E4): one-hot with the first category dropped.

Category lists are fitted once (a distinct per column, bounded and checked)
and then applied as plain ``when`` columns in one projection, so encoding new
rows uses the *training* categories and stays in whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.kinds import categorical_columns, is_numeric, numeric_columns

MAX_CATEGORIES = 1000


def fit_categories(df: DataFrame, cols: Sequence[str], max_categories: int = MAX_CATEGORIES,
                   stringify: bool = False) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column, all columns in one job:
    (column, value) pairs are de-duplicated by a shuffle and at most
    ``len(cols) * (max_categories + 1)`` pairs reach the driver (checked
    with a limit before collecting)."""
    cols = list(cols)
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), (F.col(c).cast("string") if stringify else F.col(c).cast("string")).alias("v"))
        for i, c in enumerate(cols)])).alias("s")).select("s.c", "s.v").where(F.col("v").isNotNull()).distinct()
    rows = pairs.limit(len(cols) * (max_categories + 1)).collect()
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[cols[r["c"]]].append(r["v"])
    for c in cols:
        if len(out[c]) > max_categories:
            raise ValueError(f"column {c!r} has more than {max_categories} categories")
        if not stringify and not isinstance(df.schema[c].dataType, T.StringType):
            # keep the column's own type for non-string categoricals
            out[c] = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
        else:
            out[c] = sorted(out[c])
    return out


def dummy_name(col: str, value) -> str:
    return f"{col}_{value}"


def one_hot_columns(categories: dict[str, list], drop_first: bool = True,
                    stringify: bool = False) -> list[F.Column]:
    """0/1 integer columns ``{col}_{value}``; NULL and unseen values -> all zeros."""
    out = []
    for c, values in categories.items():
        src = F.col(c).cast("string") if stringify else F.col(c)
        for v in (values[1:] if drop_first else values):
            out.append(F.when(src == F.lit(v), 1).otherwise(0).alias(dummy_name(c, v)))
    return out


def one_hot_drop_first(df: DataFrame, cols: Sequence[str] | None = None,
                       categories: dict[str, list] | None = None) -> DataFrame:
    """Non-encoded columns first, then the dummies of each categorical."""
    cols = list(cols if cols is not None else categorical_columns(df))
    cats = categories if categories is not None else fit_categories(df, cols)
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *one_hot_columns(cats))


def one_hot_stringified(df: DataFrame, cols: Sequence[str],
                        categories: dict[str, list] | None = None) -> DataFrame:
    """Fallback path: categories compared as text (NULL stays all zeros)."""
    cats = categories if categories is not None else fit_categories(df, cols, stringify=True)
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *one_hot_columns(cats, stringify=True))


def align_to_training(new: DataFrame, numeric: Sequence[str], categories: dict[str, list],
                      x_columns: Sequence[str]) -> DataFrame:
    """Encode new rows with the trained category lists: missing dummy columns
    are 0, extra columns dropped, order = training design columns."""
    present = set(new.columns)
    exprs = {}
    for c in numeric:
        exprs[c] = F.col(c) if c in present else F.lit(None).cast("double").alias(c)
    for c, values in categories.items():
        for v in values[1:]:
            name = dummy_name(c, v)
            exprs[name] = (F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(name)
                           if c in present else F.lit(0).alias(name))
    passthrough = [c for c in new.columns if c not in exprs and c not in categories]
    return new.select(*passthrough, *[exprs[c].alias(c) if c in numeric else exprs[c]
                                      for c in x_columns if c in exprs])


def feature_domain(df: DataFrame, features: Sequence[str],
                   max_categories: int = MAX_CATEGORIES, mean_scale: int | None = None) -> DataFrame:
    """Per predictor: kind, min/max/mean (numeric) or sorted distinct values
    (categorical), one aggregate pass. ``collect_set`` is bounded by the
    category check of ``fit_categories`` (vocabularies above it are refused)."""
    num = [c for c in features if is_numeric(df.schema[c].dataType)]
    cat = [c for c in features if c not in num]
    aggs = []
    for c in num:
        aggs += [F.min(F.col(c).cast("double")).alias(f"mn_{c}"),
                 F.max(F.col(c).cast("double")).alias(f"mx_{c}"),
                 (F.avg(F.col(c).cast("double")) if mean_scale is None else
                  F.sum(F.col(c).cast(f"decimal(38,{mean_scale})")).cast("double") / F.count(c)).alias(f"av_{c}")]
    for c in cat:
        aggs += [F.count_distinct(F.col(c)).alias(f"nd_{c}")]
    row = df.agg(*aggs)
    structs = []
    for i, c in enumerate(features):
        if c in num:
            structs.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                                    F.lit("numeric").alias("kind"), F.col(f"mn_{c}").alias("min"),
                                    F.col(f"mx_{c}").alias("max"), F.col(f"av_{c}").alias("mean"),
                                    F.lit(None).cast("long").alias("n_categories")))
        else:
            structs.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                                    F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("min"),
                                    F.lit(None).cast("double").alias("max"), F.lit(None).cast("double").alias("mean"),
                                    F.col(f"nd_{c}").alias("n_categories")))
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def feature_categories(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long form ``(feature, category)`` of the distinct values of categorical
    predictors, as distinct rows (no list is built in one task)."""
    cat = [c for c in features if not is_numeric(df.schema[c].dataType)]
    parts = [df.select(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
             .where(F.col("category").isNotNull()).distinct() for c in cat]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def design_columns(df: DataFrame, features: Sequence[str], categories: dict[str, list]) -> list[str]:
    num = [c for c in features if c not in categories]
    dums = [dummy_name(c, v) for c, vs in categories.items() for v in vs[1:]]
    return num + dums


__all__ = ["fit_categories", "one_hot_drop_first", "one_hot_stringified", "align_to_training",
           "feature_domain", "feature_categories", "design_columns", "numeric_columns"]

"""PreparationSpec: the reference's cleaning -> encoding -> target steps,
fitted once (a few small aggregates) and applied as one narrow projection.

The fitted spec is plain data (medians, modes, category lists, bin edges,
classes), so the same transformation scores new rows with the *training*
categories and statistics.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.kinds import floating_columns, is_numeric
from tabscope.operators import cleaning as C
from tabscope.operators import encoding as E
from tabscope.operators import target as TG

LABEL = "label"
STATUS = "row_status"


@dataclass
class PreparationSpec:
    target: str
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    task: str                      # "classification" | "regression"
    strategy: str = "drop"         # "drop" | "fill"
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)
    binning: dict | None = None    # {"method", "edges", "labels"}
    classes: list | None = None
    x_columns: list[str] = field(default_factory=list)

    # ---------------------------------------------------------------- fit
    @classmethod
    def fit(cls, df: DataFrame, target: str, features: list[str] | None = None, strategy: str = "drop",
            task: str | None = None, binning: dict | None = None, min_class_rows: int = 2) -> "PreparationSpec":
        """``binning``: None, or {"method": "equal_width"|"quantile"|"custom",
        "n_bins": 4, "cuts": "a,b,c"} to turn a numeric target into classes."""
        feats = list(features) if features is not None else [c for c in df.columns if c != target]
        if not feats:
            raise ValueError("select at least one predictor")
        schema = df.schema
        numeric = [c for c in feats if is_numeric(schema[c].dataType)]
        categorical = [c for c in feats if c not in numeric]
        y_numeric = is_numeric(schema[target].dataType)
        if task is None:
            task = "regression" if (y_numeric and binning is None) else "classification"
        if strategy not in ("drop", "fill"):
            raise ValueError("strategy must be 'drop' or 'fill'")
        spec = cls(target, feats, numeric, categorical, task, strategy)
        base = df.select(*feats, target)
        base = C.filter_infinite(base, numeric) if strategy == "drop" else C.infinite_to_null(base, numeric)
        # statistics over all rows, before rows with nulls are dropped (as the reference); scoring needs them under both strategies
        spec.medians = C.fit_medians(base, numeric)
        spec.modes = C.fit_modes(base, categorical)
        base = spec._clean(base)
        spec.categories = E.fit_categories(base, categorical) if categorical else {}
        if task == "classification" and y_numeric:
            method = (binning or {}).get("method", "equal_width")
            n_bins = (binning or {}).get("n_bins", 4)
            if method == "equal_width":
                mn, mx = TG._range(base, target)
                edges = TG.equal_width_edges(mn, mx, n_bins)
            elif method == "quantile":
                edges = TG.quantile_edges(base, target, n_bins)
            else:
                mn, mx = TG._range(base, target)
                edges = TG.custom_edges((binning or {}).get("cuts") or TG.default_custom_text(mn, mx), mn, mx)
            labels = TG.bin_labels(edges)
            spec.binning = {"method": method, "edges": edges, "labels": labels, "by_id": len(set(labels)) < len(labels)}
        if task == "classification":
            lab = spec._label(base)
            counts = lab.groupBy(LABEL).count().where(F.col("count") >= min_class_rows)
            spec.classes = sorted(r[0] for r in counts.select(LABEL).collect())
            if len(spec.classes) < 2:
                raise ValueError("at least 2 classes with 2 or more rows are needed")
        spec.x_columns = E.design_columns(base, feats, spec.categories)
        return spec

    # ---------------------------------------------------------------- steps
    def _clean(self, d: DataFrame) -> DataFrame:
        feats = self.numeric + self.categorical
        if self.strategy == "drop":
            return C.null_row_filter(d, feats + ([self.target] if self.target in d.columns else []))
        d = C.fill_values(d, {**self.medians, **self.modes})
        return C.drop_null_target(d, self.target) if self.target in d.columns else d

    def _label(self, d: DataFrame) -> DataFrame:
        if self.task == "regression":
            return d.withColumn(LABEL, F.col(self.target).cast("double")).where(F.col(LABEL).isNotNull())
        if self.binning is not None:
            b = TG.apply_bins(d, self.target, self.binning["edges"], out="_bin", label=LABEL)
            if self.binning.get("by_id"):  # bins too narrow for two decimals keep their own class
                b = b.withColumn(LABEL, F.concat(F.lpad(F.col("_bin").cast("string"), 6, "0"), F.lit(": "), F.col(LABEL)))
            return b.drop("_bin").where(F.col(LABEL).isNotNull())
        return C.normalize_label(d.withColumn(LABEL, F.col(self.target)), LABEL)

    def transform(self, df: DataFrame, keep: list[str] | None = None, with_label: bool = True) -> DataFrame:
        """Design columns (+ ``label``) for training or scoring rows.

        Training rows: same filters as at fit time, rare classes removed.
        Scoring rows (``with_label=False``): every row stays, infinite values
        count as nulls, nulls are imputed with the trained statistics under
        both strategies (a missing numeric column is all null, a missing
        categorical one all zeros), categories are encoded with the trained
        lists (unseen -> all zeros). ``STATUS`` tells per row: scored, imputed,
        or refused (a null without a trained statistic; such rows go through
        the models on zeros and get no prediction)."""
        keep = [c for c in (keep or []) if c in df.columns and c not in self.features]
        cols = [c for c in self.features if c in df.columns]
        tgt = [self.target] if (with_label and self.target in df.columns) else []
        d = df.select(*keep, *cols, *tgt)
        missing = [] if with_label else [c for c in self.features if c not in cols]
        for c in missing:
            if c in self.numeric:
                d, cols = d.withColumn(c, F.lit(None).cast("double")), [*cols, c]
        flo = [c for c in self.numeric if c in floating_columns(d)]
        d = C.filter_infinite(d, flo) if self.strategy == "drop" and with_label else C.infinite_to_null(d, flo)
        if with_label:
            d = self._clean(d)
        else:
            d = d.withColumn(STATUS, F.when(C.null_mask(d, cols) | F.lit(bool(missing)), "imputed").otherwise("scored"))
            d = C.fill_values(d, {**self.medians, **self.modes})
            d = d.withColumn(STATUS, F.when(C.null_mask(d, cols), "refused").otherwise(F.col(STATUS)))
            keep = [*keep, STATUS]
        if with_label:
            d = self._label(d)
            if self.task == "classification":
                known = d.sparkSession.createDataFrame([(c,) for c in self.classes], T.StructType([T.StructField(LABEL, d.schema[LABEL].dataType)]))
                # the classes came from the driver: without the hint all rows are exchanged by class, a few tasks hold them
                d = d.join(F.broadcast(known), LABEL, "left_semi").select(d.columns)
        enc = E.align_to_training(d, self.numeric, self.categories, self.x_columns)
        x = {c: F.col(c).cast("double") for c in self.x_columns}
        if not with_label:
            x = {c: F.when(F.col(STATUS) == "refused", F.lit(0.0)).otherwise(v) for c, v in x.items()}
        return enc.select(*keep, *[v.alias(c) for c, v in x.items()],
                          *([LABEL] if with_label else []))

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

"""Batch scoring (B1-B7): prepared new rows -> one or many models.

Every model contributes columns to the same rows (a chain of projections,
no join); long forms use ``unpivot`` / ``posexplode``. Every input row comes
back with its ``STATUS``; refused rows have null predictions. ``keep`` names the
input columns of the result, features included (None: all of them, as they were
read); an input column named like a result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.operators.prepare import STATUS, PreparationSpec

# --- fixed values: output column names of the reference's scoring files ------
PREDICTION_PREFIX = "PREDICCION_"
MAX_PROBABILITY = "PROBABILIDAD_MAXIMA"
PROBABILITY_PREFIX = "PROB_"
# -------------------------------------------------------------------------------


def answered(c: F.Column | str) -> F.Column:
    """The column, null for refused rows."""
    return F.when(F.col(STATUS) != "refused", F.col(c) if isinstance(c, str) else c)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _carried(new: DataFrame, spec: PreparationSpec, keep: Sequence[str] | None) -> tuple[DataFrame, str, list[str]]:
    """Design columns of the new rows beside their input columns, packed in one struct since both may share names."""
    names = list(new.columns if keep is None else keep)
    packed = "_input"
    while packed in new.columns or packed in spec.x_columns:
        packed += "_"
    given = [c for c in spec.features if c in new.columns]
    rows = new.select(F.struct(*[F.col(_quoted(c)) for c in names], F.lit(0).alias(packed)).alias(packed), *map(_quoted, given))
    return spec.transform(rows, keep=[packed], with_label=False), packed, names


def _with_input(out: DataFrame, packed: str, names: list[str], results: dict[str, F.Column]) -> DataFrame:
    taken = {c.lower() for c in [*results, STATUS]}
    kept = [F.col(packed).getField(c).alias(c) for c in names if c.lower() not in taken]
    return out.select(*kept, *[c.alias(n) for n, c in results.items()], STATUS)


def score_regression(new: DataFrame, spec: PreparationSpec, model, keep: Sequence[str] | None = None) -> DataFrame:
    """Input columns (``keep``) + ``PREDICCION_{target}`` and the row's status."""
    d, packed, names = _carried(new, spec, keep)
    out = model.transform(d, prediction="_said", probability=None)
    return _with_input(out, packed, names, {PREDICTION_PREFIX + spec.target: answered("_said")})


def score_classification(new: DataFrame, spec: PreparationSpec, model, keep: Sequence[str] | None = None) -> DataFrame:
    """+ ``PREDICCION_{target}``, ``PROBABILIDAD_MAXIMA``, ``PROB_{class}`` and the row's status."""
    d, packed, names = _carried(new, spec, keep)
    out = model.transform(d, prediction="_said", probability="_prob")
    results = {PREDICTION_PREFIX + spec.target: answered("_said"), MAX_PROBABILITY: answered(F.array_max("_prob"))}
    results |= {f"{PROBABILITY_PREFIX}{c}": answered(F.element_at("_prob", i + 1)) for i, c in enumerate(model.classes)}
    return _with_input(out, packed, names, results)


def prediction_distribution(scored: DataFrame, prediction: str) -> DataFrame:
    """Rows per predicted class, most frequent first; refused rows count under null."""
    return (scored.groupBy(F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "prediction"))


def score_many_models(new: DataFrame, spec: PreparationSpec, models: dict, keep: Sequence[str] | None = None) -> DataFrame:
    """+ ``PREDICCION_{model}`` per model, all on the same prepared rows, and the row's status."""
    out, packed, names = _carried(new, spec, keep)
    for i, m in enumerate(models.values()):
        out = m.transform(out, prediction=f"_said{i}", probability=None)
    return _with_input(out, packed, names, {PREDICTION_PREFIX + n: answered(f"_said{i}") for i, n in enumerate(models)})


def score_points(points: DataFrame, spec: PreparationSpec, models: dict, keep: Sequence[str] | None = None) -> DataFrame:
    """Score any DataFrame of feature points (e.g. a what-if table) by every
    model; the points go through the trained preparation like new rows."""
    return score_many_models(points, spec, models, keep)


def score_with_probabilities(new: DataFrame, spec: PreparationSpec, models: dict, key: str) -> DataFrame:
    """Long form ``(model, key, prediction, probability)`` for classifiers."""
    d, packed, _ = _carried(new, spec, [key])
    parts = []
    for name, m in models.items():
        parts.append(m.transform(d, prediction="prediction", probability="probability")
                     .select(F.lit(name).alias("model"), F.col(packed).getField(key).alias(key), answered("prediction").cast("string").alias("prediction"),
                             answered("probability").alias("probability")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked_probabilities(scored: DataFrame, classes: Sequence[str], key: str, by: str = "model") -> DataFrame:
    """Class / probability rows per scored row and model, highest first.
    The rank window is partitioned by (model, key): K rows per partition."""
    names = F.array(*[F.lit(str(c)) for c in classes])
    e = scored.select(by, key, F.posexplode_outer("probability").alias("_i", "probability"))
    e = e.select(by, key, F.element_at(names, F.col("_i") + 1).alias("class"), "probability")
    w = Window.partitionBy(by, key).orderBy(F.desc("probability"), "class")
    return e.withColumn("rank", F.row_number().over(w))


def point_comparison(scored: DataFrame, key: str, by: str = "model") -> DataFrame:
    """Per row and model: predicted class and its (maximum) probability."""
    return scored.select(by, key, "prediction", F.array_max("probability").alias("max_probability"))


def point_comparison_wide(scored_wide: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    """Long form of ``score_many_models`` output via ``unpivot``."""
    cols = [PREDICTION_PREFIX + m for m in models]
    cast = scored_wide.select(key, *[F.col(c).cast("string").alias(c) for c in cols])
    return (cast.unpivot([key], cols, "model", "prediction")
            .withColumn("model", F.expr(f"substring(model, {len(PREDICTION_PREFIX) + 1})")))

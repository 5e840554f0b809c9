"""CSV sources and sinks, previews.

The reference reads one CSV with pandas defaults. Here the file is read as
strings, pandas' missing-value tokens become NULL, and each column's type is
inferred by one distributed pass (bigint if every non-null cell casts to a
long, double if every cell casts to a double, else string).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: pandas' default missing-value tokens for read_csv ---------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]
# -----------------------------------------------------------------------------


#: What counts as a number; Java would also read the suffixes of ``10d`` and ``5f``.
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"(?i)^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def _na_to_null(c: F.Column) -> F.Column:
    return F.when(c.isin(NA_TOKENS), F.lit(None)).otherwise(c)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Cells as text; quotes are doubled inside quoted cells, which may hold newlines."""
    return (spark.read.option("header", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"')
            .option("multiLine", True).option("encoding", "UTF-8").option("nullValue", None).option("emptyValue", "").csv(path))


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV, comma separated, UTF-8; a malformed file fails the read.

    With ``schema`` the given types are applied (cells that do not cast fail
    the job, as pandas rejects the file). Without it types are inferred as
    described in the module doc.
    """
    raw = _raw(spark, path)
    names = raw.columns
    cleaned = raw.select(*[_na_to_null(F.col(f"`{c}`")).alias(c) for c in names])
    if schema is not None:
        return cleaned.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
                                for f in schema.fields])
    return infer_types(cleaned)


def infer_types(df: DataFrame) -> DataFrame:
    """One aggregate pass decides bigint / double / string per string column."""
    names = df.columns
    checks = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        checks += [F.count(col).alias(f"n{i}"),
                   F.count(F.when(col.rlike(_INTEGER), col.try_cast("bigint"))).alias(f"l{i}"),
                   F.count(F.when(col.rlike(_NUMBER), col.try_cast("double"))).alias(f"d{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *checks).first()
    out = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        n = row[f"n{i}"]
        if n > 0 and row[f"l{i}"] == n:
            out.append(col.try_cast("bigint").alias(c))
        elif n > 0 and row[f"d{i}"] == n:
            out.append(col.try_cast("double").alias(c))
        elif n == 0 and row["rows"]:  # a column without any value counts as numeric
            out.append(col.try_cast("double").alias(c))
        else:
            out.append(col.alias(c))
    return df.select(*out)


def scoring_scan(spark: SparkSession, path: str, training_schema: T.StructType,
                 target: str) -> DataFrame:
    """Second CSV of new rows, read with the training schema minus the target.
    Columns are matched by name; missing ones are reported by ``schema_check``."""
    raw = _raw(spark, path)
    present = set(raw.columns)
    cols = []
    for f in training_schema.fields:
        if f.name == target or f.name not in present:
            continue
        cols.append(_na_to_null(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def csv_sink(df: DataFrame, path: str) -> str:
    """Write rows with a header, no index; a directory of part files written
    in parallel (no coalesce to one file)."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def preview_head(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First ``n`` rows by ``key`` (file order does not exist in Spark)."""
    return df.orderBy(F.col(key)).limit(n)


def preview_tail(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Last ``n`` rows by ``key``, shown in ascending order."""
    return df.orderBy(F.col(key).desc()).limit(n).orderBy(F.col(key))


def sample_order(key: str, seed: int = 42) -> F.Column:
    """Seeded, partition-independent random order: md5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def preview_sample(df: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` rows drawn without replacement by seeded hash order (fewer when
    the table is smaller)."""
    return df.orderBy(sample_order(key, seed), F.col(key)).limit(n)

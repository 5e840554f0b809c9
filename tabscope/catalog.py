"""Registered queries: one Spark plan per operator plus its SQL oracle.

Each entry reads the driver tables (or data Spark derives from them) in full.
Floating results are rounded with the same ``round`` in Spark and in SQL so
that sums taken in different orders compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round_half_up(c, digits: int = DIGITS):
    """floor(x * 10^d + 0.5) / 10^d with IEEE double operations only, so that
    Spark and the SQL oracle (``r``) round identical doubles identically
    (the engines' own ``round`` functions differ at exact midpoints)."""
    y = c.cast("double") * F.lit(float(10 ** digits)) + F.lit(0.5)
    fl = F.when(F.abs(y) < F.lit(1e15), y - F.pmod(y, F.lit(1.0))).otherwise(y)
    return fl / F.lit(float(10 ** digits))


def rounded(df: DataFrame, digits: int = DIGITS, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column (same rule as SQL ``r(x, digits)``)."""
    return df.select(*[
        round_half_up(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip
        else F.col(f.name) for f in df.schema.fields])


def r(expr: str, digits: int = DIGITS) -> str:
    y = f"(CAST({expr} AS DOUBLE) * {float(10 ** digits)!r}e0 + 0.5e0)"
    return f"((CASE WHEN abs({y}) < 1e15 THEN floor({y}) ELSE {y} END) / {float(10 ** digits)!r}e0)"


def long_sql(tbl: str, cols: list[str], where: str = "") -> str:
    """``(column_name, value double)`` rows of ``tbl`` with nulls dropped."""
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {tbl} "
             f"WHERE {c} IS NOT NULL {('AND ' + where) if where else ''}" for c in cols]
    return " UNION ALL ".join(parts)


def T_(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


# ensure the query modules register themselves
from tabscope.plans import queries_eval, queries_fits, queries_models, queries_prepare, queries_profile  # noqa: E402,F401

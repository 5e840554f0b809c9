"""Inverse standard normal CDF as a SQL expression (runs in Spark and DuckDB).

Fixed values: the coefficients of Wichura's published algorithm AS 241
(PPND16, Applied Statistics 37(3), 1988), accurate to about 1e-16. Written
as one SQL text so the Spark column and the SQL oracle evaluate the same
formula.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (AS 241), highest power first ---------------------------
CENTRAL_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
               45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
               133.14166789178437745, 3.387132872796366608]
CENTRAL_DEN = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
               21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
               42.313330701600911252, 1.0]
NEAR_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
            1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
            4.6303378461565452959, 1.42343711074968357734]
NEAR_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
            0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
            2.05319162663775882187, 1.0]
TAIL_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
            0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
            5.4637849111641143699, 6.6579046435011037772]
TAIL_DEN = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
            7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
            0.59983220655588793769, 1.0]
# ---------------------------------------------------------------------------


def _d(x: float) -> str:
    # exponent form is a DOUBLE literal in both Spark SQL and DuckDB
    return format(x, ".17E")


def _horner(coefs: list[float], x: str) -> str:
    acc = _d(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc}) * {x} + {_d(c)}"
    return f"({acc})"


def inv_norm_sql(p: str) -> str:
    """SQL text of the standard normal quantile of expression ``p`` (0<p<1)."""
    q = f"(({p}) - {_d(0.5)})"
    rc = f"({_d(0.180625)} - {q} * {q})"
    central = f"({q} * {_horner(CENTRAL_NUM, rc)} / {_horner(CENTRAL_DEN, rc)})"
    rr = f"sqrt(-ln(least(({p}), {_d(1.0)} - ({p}))))"
    near_r = f"({rr} - {_d(1.6)})"
    tail_r = f"({rr} - {_d(5.0)})"
    near = f"({_horner(NEAR_NUM, near_r)} / {_horner(NEAR_DEN, near_r)})"
    tail = f"({_horner(TAIL_NUM, tail_r)} / {_horner(TAIL_DEN, tail_r)})"
    sign = f"(CASE WHEN {q} < {_d(0.0)} THEN {_d(-1.0)} ELSE {_d(1.0)} END)"
    return (f"(CASE WHEN abs({q}) <= {_d(0.425)} THEN {central} "
            f"WHEN {rr} <= {_d(5.0)} THEN {sign} * {near} ELSE {sign} * {tail} END)")


def inv_norm(p: str) -> Column:
    return F.expr(inv_norm_sql(p))

"""Division and rounding with the null and zero rules the metrics need.

Operands are SQL expressions, mostly column names. The ``*_sql`` functions return
the text, to be put into a larger expression; the others return a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_sql(numerator: str, denominator: str) -> str:
    """``n / d`` that never raises: NULL for 0/0, signed infinity for n/0.

    Spark's ANSI mode raises on a zero divisor even for doubles, so the zero
    case is taken before the division.
    """
    n, d = f"CAST({numerator} AS double)", f"CAST({denominator} AS double)"
    return (
        f"CASE WHEN {d} <> 0 THEN {n} / {d} "
        f"WHEN {d} = 0 AND {n} > 0 THEN double('infinity') "
        f"WHEN {d} = 0 AND {n} < 0 THEN double('-infinity') END"
    )


def percent_sql(numerator: str, denominator: str) -> str:
    return f"({ratio_sql(numerator, denominator)}) * 100"


def half_even_sql(value: str, digits: int) -> str:
    """Round half to even (``round`` is half up)."""
    return f"bround({value}, {digits})"


def ratio(numerator: str, denominator: str) -> Column:
    return F.expr(ratio_sql(numerator, denominator))


def percent(numerator: str, denominator: str) -> Column:
    """``ratio`` in percent."""
    return F.expr(percent_sql(numerator, denominator))


def guarded_percent(numerator: str, denominator: str) -> Column:
    """Percentage that is 0 when the denominator is 0."""
    return F.expr(
        f"CASE WHEN {denominator} > 0 THEN "
        f"CAST({numerator} AS double) / {denominator} * 100 ELSE 0.0D END"
    )


def half_even(value: str, digits: int) -> Column:
    return F.expr(half_even_sql(value, digits))

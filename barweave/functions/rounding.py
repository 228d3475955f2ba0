"""Rounding of doubles as they are stored."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` places, halves away from zero, judged on the double x * 10**digits. Spark's own rounding judges the
    shortest decimal that reads back as x instead, so that it and other engines differ on 211.7 * 1.0025."""
    k = float(10**digits)
    return F.round(x * k) / k


def rounded_sql(x: str, digits: int) -> str:
    """The same as an expression."""
    return f"(round(({x}) * {10**digits}) / {10**digits})"

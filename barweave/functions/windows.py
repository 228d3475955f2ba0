"""Window functions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def percentile_rank(x: str, by: list[str]) -> Column:
    """Rank over the number of non-null values, ties by their average rank; null stays null."""
    inside = Window.partitionBy(*by, F.col(x).isNull()).orderBy(x)
    peers, whole = Window.partitionBy(*by, x), Window.partitionBy(*by)
    r = F.rank().over(inside) + (F.count("*").over(peers) - 1) / 2
    return F.when(F.col(x).isNotNull(), r / F.count(x).over(whole))


def ffd_weights(d: float, least: float = 1e-4, most: int = 200) -> list[float]:
    """Fixed-width weights of fractional differencing, oldest first: the binomial series of (1 - B)**d
    until a weight is below ``least`` or there are ``most``."""
    w = [1.0]
    for k in range(1, most):
        nxt = w[-1] * (k - 1 - d) / k
        if abs(nxt) < least:
            break
        w.append(nxt)
    return w[::-1]

"""Positions and running sums over a whole table without sending it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, key: Column, order: list, sums: dict[str, Column], buckets: int = 256) -> DataFrame:
    """``rows`` with running sums (the row included) in the order of ``order``, whose first part is ascending ``key``, a number.

    Rows are dealt into ranges of the key by approximate quantiles; sums run inside a range and start from the totals
    of the ranges before it. Rows of one key are one range's, so ties of most rows should be summed up first.
    """
    edges = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    literal = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.expr("cast(array() as array<double>)")
    tagged = rows.withColumn("_range", F.size(F.filter(literal, lambda e: e < key)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range: ``buckets`` at most
    totals = tagged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    start = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = tagged.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()])
    joined = own.join(F.broadcast(start), "_range")
    return joined.select(*rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])


def tile_of(row: Column, total: Column, k: int) -> Column:
    """The number (from 1) of the part among ``k`` even parts that position ``row`` (from 1) of ``total`` falls into."""
    base, rest = F.floor(total / k), total % k
    long = rest * (base + 1)
    return F.when(row <= long, F.floor((row - 1) / (base + 1)) + 1).otherwise(rest + F.floor((row - 1 - long) / F.greatest(base, F.lit(1))) + 1).cast("int")


def tiles(rows: DataFrame, k: int, key: Column, order: list, name: str = "tile") -> DataFrame:
    """``rows`` with the number (from 1) of their part among ``k`` even parts, as ntile gives it."""
    total = rows.agg(F.count("*").alias("_n"))
    at = running(rows, key, order, {"_row": F.lit(1)}).crossJoin(F.broadcast(total))  # one row
    return at.select(*rows.columns, tile_of(F.col("_row"), F.col("_n"), k).alias(name))

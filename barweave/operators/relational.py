"""Joins and set operations with defined order among duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_one(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``: unlike dropDuplicates it does not depend on partitions."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], tiebreak: list | None = None) -> DataFrame:
    """Union in which a row of ``new`` replaces the row of ``old`` with its keys."""
    both = old.withColumn("_prio", F.lit(0)).unionByName(new.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, [F.col("_prio").desc(), *(tiebreak or [])]).drop("_prio")


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of the first source that has any row of a key."""
    both = None
    for i, s in enumerate(sources):
        tagged = s.withColumn("_prio", F.lit(i))
        both = tagged if both is None else both.unionByName(tagged, allowMissingColumns=True)
    w = Window.partitionBy(key)
    return both.withColumn("_least", F.min("_prio").over(w)).filter("_prio = _least").drop("_prio", "_least")


def first_failure(gates: list[tuple[str, object]]):
    """Name of the first gate whose condition (a rejection) holds, else null; null conditions do not reject."""
    return F.coalesce(*[F.when(reject, F.lit(name)) for name, reject in gates])


def funnel(rows: DataFrame, reason: str = "drop_reason") -> DataFrame:
    return rows.groupBy(F.coalesce(reason, F.lit("pass")).alias(reason)).agg(F.count("*").alias("n"))

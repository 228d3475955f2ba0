"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """v, label for every vertex of ``edges`` (a, b): the smallest vertex it is connected with.

    Every round links larger neighbours to the smallest one (large star), then smaller ones (small
    star); each star needs a minimum per vertex, which Spark combines before the shuffle, and one join.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}_edges")
    seen, before = None, None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        before, e = e, written(small, f"{name}_round")
        dropped(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return written(e.select(F.col("u").alias("v"), F.col("v").alias("label")).union(e.select("v", F.col("v").alias("label")).distinct()), name)

"""Bar, benchmark, membership and fundamentals tables derived from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from . import storage

#: Bytes of line items (Parquet) for each part of the bars, some 200,000 rows.
PART_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars(symbol, dt, open, high, low, close, volume): a deterministic walk per supplier."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("dt"), (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("step"), "l_quantity", "l_tax",
    )
    # dealt by symbol once, in as many parts as the table's bytes ask for: days, walks and all windows by symbol stay in their task
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), storage.size(spark, f"{sf_dir}/lineitem.parquet") // PART_BYTES)
    daily = lines.repartition(parts, "symbol").groupBy("symbol", "dt").agg(F.sum("step").cast("long").alias("step"), F.sum("l_quantity").alias("volume"), F.max("l_tax").alias("t"))
    w = Window.partitionBy("symbol").orderBy("dt")
    run = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    closed = daily.select("symbol", "dt", "volume", "t", rounded(100 * F.exp(run / 200), 4).alias("close"))
    opened = closed.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    return opened.select(
        "symbol", "dt", "open",
        rounded(F.greatest("open", "close") * (1 + F.col("t") / 8), 4).alias("high"),
        rounded(F.least("open", "close") * (1 - F.col("t") / 8), 4).alias("low"), "close", "volume",
    )


def membership(bars: DataFrame) -> DataFrame:
    """(symbol, grp): five even groups."""
    return bars.select("symbol").distinct().select("symbol", F.concat(F.lit("G"), (F.col("symbol") % 5).cast("string")).alias("grp"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector, market_cap, pe, roe of every supplier; some values missing."""
    s = table(spark, sf_dir, "supplier")
    bal = F.col("s_acctbal").cast("double")
    return s.select(
        F.col("s_suppkey").alias("symbol"), F.concat(F.lit("S"), (F.col("s_nationkey") % 6).cast("string")).alias("sector"),
        F.when(F.col("s_suppkey") % 7 != 0, bal).alias("market_cap"), (F.col("s_suppkey") % 13).cast("double").alias("pe"),
        F.when(F.col("s_suppkey") % 5 != 0, F.round(bal / 100)).alias("roe"),
    )

"""Queries over landed candles: monthly price candles of every customer's orders, landed in three batches of which each revises the
ones before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..sources import candles, storage
from ..sources.fixtures import table
from .registry import query

#: Candles of a batch: the orders known by then. ``o_orderkey % 3`` says with which batch an order became known.
_LANDED = """ca AS (SELECT k AS batch, 'C' || o_custkey AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
      min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders, range(3) r(k) WHERE o_orderkey % 3 <= k GROUP BY ALL)"""
_LATEST = f"{_LANDED}, la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, dt ORDER BY batch DESC) AS j FROM ca) WHERE j = 1)"
_SHOWN = "ticker, dt, open, high, low, close, volume"


def month_candles(spark, sf_dir, batch: int):
    known = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 3 <= batch)
    price = F.col("o_totalprice").cast("double")
    g = known.groupBy(F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.trunc("o_orderdate", "month").alias("dt"))
    return g.agg(
        F.min_by(price, "o_orderkey").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def landed(spark, sf_dir, batches=(0, 1, 2)) -> str:
    path = storage.scratch(spark, "candles")
    for b in batches:
        candles.land(month_candles(spark, sf_dir, b), path, b)
    return path


@query("s23_candle_fetch", f"WITH {_LATEST} SELECT {_SHOWN} FROM la WHERE ticker IN ('C1', 'C7', 'C10') AND dt >= DATE '1995-01-01' AND dt <= DATE '1996-12-31'")
def fetch(spark, sf_dir):
    """Three tickers over two years, one of which may not be there; the filters reach the reader."""
    return candles.fetch(spark, landed(spark, sf_dir), ["C1", "C7", "C10"], dt.date(1995, 1, 1), dt.date(1996, 12, 31))


@query("s24_bulk_candles", f"WITH {_LATEST} SELECT {_SHOWN} FROM la")
def bulk(spark, sf_dir):
    """All tickers, the last batch's candle of each month."""
    return candles.fetch(spark, landed(spark, sf_dir), None)


@query("s24_pruned_partitions", f"WITH {_LANDED} SELECT 8 AS groups, 1 AS groups_read, count(*) AS rows_read FROM ca WHERE ticker = 'C1'")
def pruned(spark, sf_dir):
    """Partitions of the whole source, those left for one ticker, and the rows that they give."""
    path = landed(spark, sf_dir)
    one = candles.read(spark, path).filter("ticker = 'C1'")
    parts = [F.lit(x.rdd.getNumPartitions()).alias(n) for x, n in ((candles.read(spark, path), "groups"), (one, "groups_read"))]
    return one.agg(F.count("*").alias("rows_read")).select(*parts, "rows_read")


@query("s30_resumed_load", f"WITH {_LANDED} SELECT batch, count(*) AS n, count(DISTINCT ticker) AS tickers, CAST(sum(volume) AS BIGINT) AS orders FROM ca GROUP BY batch")
def resumed(spark, sf_dir):
    """A load of the first batch, then of the two landed after it: every batch once."""
    path, out, mark = landed(spark, sf_dir, (0,)), storage.scratch(spark, "candle_table"), storage.scratch(spark, "candle_mark")
    candles.load(spark, path, out, mark)
    for b in (1, 2):
        candles.land(month_candles(spark, sf_dir, b), path, b)
    candles.load(spark, path, out, mark)
    t = spark.read.schema(candles.SCHEMA).parquet(out)
    return t.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"), F.sum("volume").cast("long").alias("orders"))

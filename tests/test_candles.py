"""Landed candles: pruning, repeats, missing tickers, and loads that go on where they stopped."""

import datetime as dt

import pytest
from barweave.sources import candles
from pyspark.sql import functions as F

DAY = dt.date(2024, 1, 1)


def rows(tickers, days, price):
    return [(t, DAY + dt.timedelta(days=i), price, price + 1, price - 1, price, 10.0) for t in tickers for i in range(days)]


@pytest.fixture()
def folder(spark, tmp_path):
    path = f"file://{tmp_path}/landed"
    make = lambda r: spark.createDataFrame(r, "ticker string, dt date, open double, high double, low double, close double, volume double")
    candles.land(make(rows("ABCDEFGH", 5, 1.0)), path, 0)
    candles.land(make(rows("AB", 3, 2.0) + rows("Ü", 1, 7.0)), path, 1)
    return path, make


def test_last_batch_stands(spark, folder):
    path, _ = folder
    got = {(r.ticker, r.dt): r.close for r in candles.fetch(spark, path, None).collect()}
    want = {(r[0], r[1]): r[5] for r in [*rows("ABCDEFGH", 5, 1.0), *rows("AB", 3, 2.0), *rows("Ü", 1, 7.0)]}
    assert got == want


def test_filters_cut_partitions_and_rows(spark, folder):
    path, _ = folder
    every = candles.read(spark, path)
    one = every.filter("ticker = 'A'")
    two = every.filter(F.col("ticker").isin("A", "Ü") & (F.col("dt") >= F.lit(DAY + dt.timedelta(days=2))))
    assert every.rdd.getNumPartitions() == candles.GROUPS and one.rdd.getNumPartitions() == 1
    assert two.rdd.getNumPartitions() == len({candles.group_of(t) for t in "AÜ"})
    assert one.count() == 8 and {(r.dt.day, r.batch) for r in two.collect()} == {(3, 0), (4, 0), (5, 0), (3, 1)}
    assert candles.fetch(spark, path, ["A"], DAY, DAY).collect()[0].close == 2.0
    assert every.filter("close > 6").count() == 1  # Spark's own filter


def test_nothing_landed(spark, folder, tmp_path):
    path, _ = folder
    assert candles.fetch(spark, path, ["nobody"]).collect() == [] and candles.fetch(spark, path, []).collect() == []
    assert candles.fetch(spark, f"file://{tmp_path}/elsewhere", None).collect() == []


def test_unfinished_batch_is_not_seen(spark, folder, tmp_path):
    path, make = folder
    candles.land(make(rows("Z", 2, 9.0)), path, 2)
    (tmp_path / "landed/batch=2/_SUCCESS").unlink()
    assert candles.landed(path) == [0, 1] and candles.fetch(spark, path, ["Z"]).count() == 0


def test_load_goes_on(spark, folder, tmp_path):
    """Loads between landings, one of them broken in the middle, give what one unbroken load gives."""
    path, make = folder
    table, mark = f"file://{tmp_path}/table", f"file://{tmp_path}/mark"
    candles.load(spark, path, table, mark)
    assert spark.read.parquet(table).count() == 40 + 7
    candles.land(make(rows("CD", 4, 3.0)), path, 2)

    def broken(batch, n):
        batch.filter("ticker = 'C'").count()
        raise RuntimeError("lost")

    cut = candles.stream(spark, path).writeStream.foreachBatch(broken).option("checkpointLocation", mark + "2").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        cut.awaitTermination()
    seen = []
    again = candles.stream(spark, path).writeStream.foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", mark + "2").trigger(availableNow=True).start()
    again.awaitTermination()
    candles.land(make(rows("E", 4, 4.0)), path, 3)
    candles.load(spark, path, table, mark)
    candles.load(spark, path, table, mark)  # nothing new
    got, want = spark.read.parquet(table), candles.read(spark, path)
    assert got.count() == want.count() == 40 + 7 + 8 + 4 and not got.exceptAll(want).count()
    assert sorted(map(str, seen)) == sorted(str(tuple(r)) for r in want.filter("batch <= 2").collect())

"""Streams against their batch form, readers and sinks on landed files."""

import datetime as dt
import json
import time

import pytest
from barweave.operators import labels
from barweave.sources import readers, sinks
from barweave.streaming import bars as streams
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The events as three files, streamed one at a time."""
    folder = str(tmp_path_factory.mktemp("events") / "in")
    e = spark.read.parquet(f"{SF}/events.parquet")
    lo, hi = e.agg(F.min("event_id"), F.max("event_id")).first()
    for k in range(3):  # one file after the other: the source takes the oldest first
        own = e.filter(F.floor((F.col("event_id") - lo) * 3 / (hi - lo + 1)) == k)
        own.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return e, lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, tmp_path, mode="append"):
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.read.parquet(f"{tmp_path}/out")


def test_weekly_totals_stream(events, tmp_path):
    batch, stream = events
    got = {(r["week_start"], r["event_type"], r["n"]) for r in drain(streams.weekly_totals(stream()), tmp_path).collect()}
    want = {(r["week_start"], r["event_type"], r["n"]) for r in streams.weekly_totals(batch).collect()}
    assert got <= want and len(got) > 0  # the last weeks are still open behind the watermark


def test_upsert_stream(events, tmp_path):
    batch, stream = events
    s = stream().select("user_id", F.to_date("ts").alias("day"), "value", "event_id")
    q = s.writeStream.foreachBatch(streams.upsert_sink(f"{tmp_path}/t", ["user_id", "day"], "event_id")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = sorted((tmp_path / "t").iterdir(), key=lambda p: int(p.name[1:]))[-1]
    got = batch.sparkSession.read.parquet(str(last))
    assert got.count() == batch.select("user_id", F.to_date("ts")).distinct().count()


def test_cooldown_stream(events, tmp_path):
    batch, stream = events
    got = {(r["user_id"], r["ts"].date()) for r in drain(streams.cooldown(stream(), 3), tmp_path).collect()}
    want = labels.cooldown(batch.select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("dt")).distinct(), 3)
    assert got == {(r["symbol"], r["dt"]) for r in want.collect()}


def test_themes(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"one": {"description": "d", "constituents": [" a", "B", "a "]}, "two": ["c"], "none": {"constituents": []}}))
    assert sorted(map(tuple, readers.themes(spark, str(tmp_path / "t.json")).collect())) == [("one", "A"), ("one", "B"), ("two", "C")]


def test_price_bands(spark, tmp_path):
    row = lambda s, p: {"symbol": s, "series": "EQ", "ltp": "1,200.5", "pChange": p, "priceBand": "5"}
    (tmp_path / "all.json").write_text(json.dumps({"upper": {"AllSec": {"data": [row("aa", "5"), row("aa", "4"), row(" ", "1")]}}}))
    (tmp_path / "tiers.json").write_text(json.dumps({"upper": {"t5": {"data": [row("x", "5")]}, "t10": {"data": [row("y", "9")]}}}))
    assert [(r["symbol"], r["ltp"], r["pChange"]) for r in readers.price_band_json(spark, str(tmp_path / "all.json")).collect()] == [("AA", 1200.5, 5.0)]
    assert {r["symbol"] for r in readers.price_band_json(spark, str(tmp_path / "tiers.json")).collect()} == {"X", "Y"}
    (tmp_path / "b.csv").write_text('Symbol , Series,LTP,%chng,"Value (Rs Crores) "\nab , eq,"1,000",5.0,n/a\n')
    r = readers.price_band_csv(spark, str(tmp_path / "b.csv")).first()
    assert (r["Symbol"], r["Series"], r["LTP"], r["value_cr"]) == ("AB", "EQ", 1000.0, None)


def test_listings(spark, tmp_path):
    raw = spark.createDataFrame([("abc", " A b ", "X", "Active"), ("d", "D", "Z", "Active"), ("e", "E", "X", "Gone")], "symbol string, name string, GROUP string, Status string")
    assert [tuple(r) for r in readers.listing(readers.active_in_groups(raw, ["X"]), ".NS").collect()] == [("ABC.NS", "ABC", "A b")]
    fno = spark.createDataFrame([("1", "NIFTY50"), ("2", " abc ")], "n string, underlying string")
    assert [r[0] for r in readers.derivatives(fno).collect()] == ["ABC"]
    ins = spark.createDataFrame([("NSE", "1", "ABC-EQ", "ABC"), ("NSE", "2", "ABC", "ABC LTD")], "exch_seg string, token string, symbol string, name string").coalesce(1)
    assert {(r["key"], r["token"]) for r in readers.instruments(ins).collect()} == {("ABC-EQ", "1"), ("ABC", "2"), ("ABC LTD", "2")}
    assert readers.optional_csv(spark, str(tmp_path / "no.csv"), "a int").count() == 0
    assert readers.period_bounds("6mo", dt.date(2020, 7, 1))[0] == dt.date(2019, 12, 31)


def test_bars_and_wide(spark, tmp_path):
    rows = [("A", dt.datetime(2020, 1, 1, 15), 1.0, 2.0, 0.5, 1.5, 10.0, 1), ("A", dt.datetime(2020, 1, 1, 16), 1.0, 2.0, 0.5, 1.6, 10.0, 2), ("A", dt.datetime(2020, 1, 2), None, 2.0, 0.5, 1.6, 10.0, 3)]
    c = readers.canonical(spark.createDataFrame(rows, "symbol string, dt timestamp, open double, high double, low double, close double, volume double, at int"), "at")
    assert [(r["symbol"], r["dt"], r["close"]) for r in c.collect()] == [("A", dt.date(2020, 1, 1), 1.6)]
    sinks.snapshot(c, f"{tmp_path}/bars")
    plan = readers.bars(spark, f"{tmp_path}/bars", "A", ["dt", "close"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,A)" in plan and "open" not in plan.split("ReadSchema")[1]
    wide = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 9.0)], "dt date, `open|X` double, `high|X` double, `low|X` double, `close|X` double, `volume|X` double")
    assert readers.long_from_wide(wide).first()["close"] == 1.5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b.NS",), ("a.BO",), ("b.NS",)], "ticker string")
    sinks.watchlist(df, f"{tmp_path}/w")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/w").collect()] == ["BSE:a", "NSE:b"]
    assert sinks.workbook({"x" * 40: df, "gone": None}, f"{tmp_path}/book") == ["x" * 31] and spark.read.option("header", True).csv(f"{tmp_path}/book/{'x' * 31}").count() == 3
    sinks.append_log(df, f"{tmp_path}/log")
    sinks.append_log(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6

"""Readers of landed files: bars, listings, bands, themes, instruments.

Network connectors (scraping, broker login, rate limits) stay outside the engine: they land files, these read them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import keep_one

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("dt", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
THEMES = "map<string, struct<description:string, constituents:array<string>>>"
BANDS = "map<string, map<string, struct<data:array<struct<symbol:string,series:string,ltp:string,pChange:string,priceBand:string,totalTradedVol:string,turnover:string,yearHigh:string,yearLow:string>>>>>"
INDEX_PREFIXES = "^(NIFTY|BANKNIFTY|FINNIFTY|MIDCPNIFTY)"


def bars(spark: SparkSession, path: str, symbol: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Bars by the fixed schema; symbol filter and column choice reach the Parquet scan."""
    df = spark.read.schema(BARS).parquet(path)
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    return df.select(*columns) if columns else df


def symbols(bars_: DataFrame) -> DataFrame:
    return bars_.select("symbol").distinct()


def canonical(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Five columns at midnight without null rows, the last row of a (symbol, dt) by ``order`` kept."""
    df = raw.withColumn("dt", F.to_date("dt")).na.drop(subset=["symbol", "dt", "open", "high", "low", "close", "volume"])
    ranked = keep_one(df, ["symbol", "dt"], [F.col(order).desc()] if order else [F.col("volume").desc(), F.col("close")])
    return ranked.select([F.col(f.name).cast(f.dataType) for f in BARS])


def number(c) -> F.Column:
    """Numbers with thousands commas; junk is null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def price_band_csv(spark: SparkSession, path: str) -> DataFrame:
    """Band list: headers trimmed, value and volume columns named by prefix, keys in upper case."""
    raw = spark.read.option("header", True).csv(path)
    names = {c: "value_cr" if c.strip().startswith("Value") else "volume_lakh" if c.strip().startswith("Volume") else c.strip() for c in raw.columns}
    df = raw.withColumnsRenamed(names)
    keys = {c: F.upper(F.trim(c)) for c in ("Symbol", "Series")}
    return df.withColumns(keys | {c: number(F.col(c)) for c in ("LTP", "%chng", "Price Band %", "volume_lakh", "value_cr") if c in df.columns})


def price_band_json(spark: SparkSession, path: str, side: str = "upper") -> DataFrame:
    """Rows of one side: the list of all securities, else the union of the tiers; first row of a symbol kept."""
    tiers = spark.read.text(path, wholetext=True).select(F.from_json("value", BANDS)[side].alias("t")).filter("t is not null")
    all_, rest = F.col("t")["AllSec"]["data"], F.flatten(F.transform(F.map_entries("t"), lambda e: F.coalesce(e["value"]["data"], F.expr("cast(array() as array<struct<symbol:string,series:string,ltp:string,pChange:string,priceBand:string,totalTradedVol:string,turnover:string,yearHigh:string,yearLow:string>>)"))))
    rows = tiers.select(F.posexplode(F.coalesce(F.when(F.size(all_) > 0, all_), rest)).alias("pos", "r"))
    flat = rows.select("pos", F.upper(F.trim("r.symbol")).alias("symbol"), F.col("r.series").alias("series"), *[number(F.col(f"r.{c}")).alias(c) for c in ("ltp", "pChange", "priceBand", "totalTradedVol", "turnover", "yearHigh", "yearLow")]).filter("symbol <> ''")
    return keep_one(flat, ["symbol"], [F.col("pos")]).drop("pos")


def themes(spark: SparkSession, path: str) -> DataFrame:
    """(theme, symbol) of a JSON map whose values are objects with constituents or plain lists; names trimmed, upper, distinct."""
    text = spark.read.text(path, wholetext=True)
    entry = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("theme", "body"))
    listed = F.coalesce(F.from_json("body", "struct<constituents:array<string>>")["constituents"], F.from_json("body", "array<string>"))
    return entry.select("theme", F.explode(listed).alias("s")).select("theme", F.upper(F.trim("s")).alias("symbol")).filter("symbol <> ''").distinct()


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header, or an empty table where the file is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).option("header", True).csv(path) if there else spark.createDataFrame([], schema)


def tickers_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.trim("ticker").alias("ticker")).filter("ticker <> ''").distinct()


def sheets(frames: list[DataFrame], column: str) -> DataFrame:
    """Distinct values of one column over all sheets that have it."""
    out = None
    for f in frames:
        if column in f.columns:
            one = f.select(F.trim(column).alias(column))
            out = one if out is None else out.unionByName(one)
    return out.filter(F.col(column) != "").distinct()


def listing(raw: DataFrame, suffix: str, symbol: str = "symbol", name: str = "name") -> DataFrame:
    return raw.select(F.concat(F.upper(F.trim(symbol)), F.lit(suffix)).alias("ticker"), F.upper(F.trim(symbol)).alias("symbol"), F.trim(name).alias("name"))


def active_in_groups(raw: DataFrame, groups: list[str]) -> DataFrame:
    return raw.filter(F.col("GROUP").isin(groups) & (F.col("Status") == "Active"))


def derivatives(raw: DataFrame) -> DataFrame:
    """Underlyings: the second column, without index names."""
    return raw.select(F.upper(F.trim(raw.columns[1])).alias("symbol")).filter(~F.col("symbol").rlike(INDEX_PREFIXES) & (F.col("symbol") != "")).distinct()


def page_links(pages: DataFrame, pattern: str = r'<a href="/([^"/]+)"') -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("slug")).distinct()


def instruments(raw: DataFrame, line: str | None = None) -> DataFrame:
    """(exch_seg, key) to token over the full symbol, the symbol without its series and the name; the first row wins, by
    the column ``line`` (of one file read in order: its rows' own order)."""
    keyed = raw.withColumn("_at", F.col(line) if line else F.monotonically_increasing_id()).select("exch_seg", "token", "_at", F.posexplode(F.array(F.upper("symbol"), F.regexp_replace(F.upper("symbol"), "-[A-Z]{2}$", ""), F.upper("name"))).alias("_form", "key"))
    return keep_one(keyed.filter("key is not null"), ["exch_seg", "key"], [F.col("_form"), F.col("_at")]).select("exch_seg", "key", "token")


def to_suffixed(t) -> F.Column:
    return F.when(t.rlike(r"\.(NS|BO)$"), t).otherwise(F.concat(t, F.lit(".NS")))


def from_suffixed(t) -> F.Column:
    return F.regexp_replace(t, r"\.(NS|BO)$", "")


def market_cap(direct, shares, close) -> F.Column:
    """Capitalisation in units of 1e7."""
    return F.coalesce(direct, shares * close) / 1e7


def period_bounds(period: str, today: dt.date) -> tuple[dt.date, dt.date]:
    """Start and end of a period such as 5d, 2w, 6mo or 1y."""
    n, unit = int("".join(c for c in period if c.isdigit())), "".join(c for c in period if c.isalpha())
    days = {"d": 1, "w": 7, "wk": 7, "mo": 30.44, "y": 365}[unit] * n
    return today - dt.timedelta(days=round(days)), today


def period_start(period: F.Column, today: F.Column) -> F.Column:
    """The first day of a period such as 5d, 2w, 6mo or 1y that ends today."""
    n, unit = F.regexp_extract(period, r"^(\d+)", 1).cast("int"), F.regexp_extract(period, r"([a-z]+)$", 1)
    days = F.when(unit == "d", 1.0).when(unit.isin("w", "wk"), 7.0).when(unit == "mo", 30.44).when(unit == "y", 365.0)
    return F.date_sub(today, F.round(days * n).cast("int"))


def date_chunks(start, end, days: int) -> F.Column:
    """Array of (lo, hi) ranges of at most ``days`` days."""
    return F.transform(F.sequence(start, end, F.expr(f"interval {days} days")), lambda d: F.struct(d.alias("lo"), F.least(F.date_add(d, days - 1), end).alias("hi")))


def long_from_wide(wide: DataFrame, key: str = "dt") -> DataFrame:
    """Columns ``field|ticker`` as (dt, symbol, fields): wide frames never stay wide."""
    cells = wide.unpivot([key], [c for c in wide.columns if c != key], "cell", "value").select(key, F.split("cell", r"\|")[1].alias("symbol"), F.split("cell", r"\|")[0].alias("field"), "value")
    return cells.groupBy(key, "symbol").pivot("field", ["open", "high", "low", "close", "volume"]).agg(F.first("value")).na.drop()


def enough_history(bars_: DataFrame, least: int) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("symbol"))
    return bars_.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")

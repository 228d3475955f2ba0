"""Sinks: each writes a directory, the Spark form of the files and sheets it stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def bucketed_bars(df: DataFrame, table: str, buckets: int = 64) -> None:
    """Bars bucketed and sorted by symbol, so that windows and joins by symbol need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "dt").saveAsTable(table)


def workbook(sheets: dict[str, DataFrame | None], path: str, placeholder: str = "No matches") -> list[str]:
    """A directory per sheet, names cut to 31 characters, missing sheets skipped; an empty book gets a placeholder."""
    done = []
    for name, df in sheets.items():
        if df is not None:
            csv(df, f"{path}/{name[:31]}")
            done.append(name[:31])
    if not done:
        spark = next((d.sparkSession for d in sheets.values() if d is not None), None)
        if spark is not None:
            csv(spark.createDataFrame([(placeholder,)], "note string"), f"{path}/summary")
    return done


def screen_book(matches: DataFrame, path: str, placeholder: str = "No matches") -> None:
    """The screen's sheet, or a placeholder where nothing passed."""
    if matches.limit(1).count():
        csv(matches, f"{path}/summary")
    else:
        csv(matches.sparkSession.createDataFrame([(placeholder,)], "note string"), f"{path}/summary")


def scanner_book(rows: DataFrame, path: str, least: float = 65) -> list[str]:
    """Four sheets of scanner rows (score, high_conviction, triggered): all, those on the list (``least`` points or high
    conviction), the triggered ones among these, and high conviction alone. The names of the sheets."""
    listed = rows.filter((F.col("score") >= least) | F.col("high_conviction"))
    return workbook({"summary": rows, "watchlist": listed, "triggers": listed.filter("triggered"), "high_conviction": rows.filter("high_conviction")}, path)


def watchlist(df: DataFrame, path: str) -> None:
    """Exchange-prefixed tickers, one a line, distinct and sorted."""
    t = F.col("ticker")
    name = F.when(t.endswith(".NS"), F.concat(F.lit("NSE:"), F.regexp_replace(t, r"\.NS$", ""))).when(t.endswith(".BO"), F.concat(F.lit("BSE:"), F.regexp_replace(t, r"\.BO$", ""))).otherwise(t)
    df.select(name.alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def best_params(rows: DataFrame, path: str) -> None:
    rows.orderBy(F.col("score").desc()).limit(1).write.mode("overwrite").json(path)

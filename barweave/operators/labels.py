"""Outcome labels from the bars after an entry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_path(entries: DataFrame, bars: DataFrame, bars_ahead: int) -> DataFrame:
    """Entries (symbol, n, …) with each of the next ``bars_ahead`` bars (i, f_*): a range join on the bar number
    that hashes blocks of bar numbers, so it stays an equi-join within a symbol."""
    step = F.lit(max(bars_ahead, 1))
    fwd = bars.select("symbol", F.col("n").alias("f_n"), F.col("dt").alias("f_dt"), F.col("high").alias("f_high"), F.col("low").alias("f_low"), F.col("close").alias("f_close"), F.expr(f"n div {bars_ahead}").alias("blk"))
    e = entries.withColumn("blk", F.explode(F.sequence(F.floor((F.col("n") + 1) / step), F.floor((F.col("n") + step) / step))))
    j = e.join(fwd, ["symbol", "blk"]).filter((F.col("f_n") > F.col("n")) & (F.col("f_n") <= F.col("n") + bars_ahead))
    return j.withColumn("i", F.col("f_n") - F.col("n")).drop("blk", "f_n")


def triple_barrier(entries: DataFrame, bars: DataFrame, upper: float = 3.0, lower: float = 1.0, ahead: int = 10, confirm_within: int = 5, need_close: bool = True) -> DataFrame:
    """symbol, dt, label, exit_date, exit_price, r_multiple, days_held for entries (symbol, dt, n, close, atr, resistance).

    The stop wins a bar that pierces both barriers; an upper hit without a close over the resistance within
    ``confirm_within`` bars is labelled 0 and keeps its multiple; without a hit the last bar there is closes the trade.
    """
    e = entries.filter("atr > 0").withColumn("top", F.col("close") + upper * F.col("atr")).withColumn("bottom", F.col("close") - lower * F.col("atr"))
    hit = lambda c: F.min(F.when(c, F.col("i")))
    at = lambda c: F.min_by("f_dt", F.when(c, F.col("i")))
    low, high = F.col("f_low") <= F.col("bottom"), F.col("f_high") >= F.col("top")
    g = forward_path(e, bars, ahead).groupBy("symbol", "dt", "close", "atr", "top", "bottom").agg(
        hit(low).alias("i_low"), hit(high).alias("i_high"), at(low).alias("d_low"), at(high).alias("d_high"),
        F.max("i").alias("i_end"), F.max_by("f_dt", "i").alias("d_end"), F.max_by("f_close", "i").alias("c_end"),
        F.max(((F.col("i") <= confirm_within) & (F.col("f_close") > F.col("resistance"))).cast("int")).alias("confirmed"),
    )
    stop = F.col("i_low").isNotNull() & (F.col("i_high").isNull() | (F.col("i_low") <= F.col("i_high")))
    goal = F.col("i_high").isNotNull() & ~stop
    price = F.when(stop, F.col("bottom")).when(goal, F.col("top")).otherwise(F.col("c_end"))
    return g.select(
        "symbol", "dt",
        F.when(stop, -1).when(goal, F.when((F.col("confirmed") == 1) | F.lit(not need_close), 1).otherwise(0)).otherwise(0).cast("int").alias("label"),
        F.when(stop, F.col("d_low")).when(goal, F.col("d_high")).otherwise(F.col("d_end")).alias("exit_date"), price.alias("exit_price"),
        ((price - F.col("close")) / (lower * F.col("atr"))).alias("r_multiple"),
        F.when(stop, F.col("i_low")).when(goal, F.col("i_high")).otherwise(F.col("i_end")).cast("int").alias("days_held"),
    )


def _best_trends(close: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one series: the rows that have a trend, its horizon and its t. The sums of all horizons of a row are running
    sums over the bars ahead, around the row's own close; their numbers 1..h have known moments."""
    pad = np.concatenate([close, np.full(longest, np.nan)])
    y = np.lib.stride_tricks.sliding_window_view(pad, longest + 1)[:, 1:] - close[:, None]
    i = np.arange(1, longest + 1, dtype=float)
    sy, syy, sxy = np.cumsum(y, 1), np.cumsum(y * y, 1), np.cumsum(y * i, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (sxy / i - (i + 1) / 2 * sy / i) / np.sqrt((syy / i - (sy / i) ** 2) * (i * i - 1) / 12)
        t = r * np.sqrt(np.maximum(i - 2, 0)) / np.sqrt(1 - r * r)
    size = np.where(np.isfinite(t), np.round(np.abs(t), 4), -1.0)
    size[:, : shortest - 1] = -1.0
    best = size.argmax(1)  # the first, so the shortest, of equals
    on = np.flatnonzero(size[np.arange(len(close)), best] >= 0)
    return on, best[on] + 1, t[on, best[on]]


def trend_scan(bars: DataFrame, shortest: int = 5, longest: int = 30, t_least: float = 2.0) -> DataFrame:
    """Label of every bar by the most significant trend of the closes that follow: the horizon with the largest |t| of the
    regression slope (the shorter one on ties). Spark deals out the symbols; one symbol's closes are a vector each."""
    kind = bars.schema["symbol"].dataType.simpleString()

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day", ignore_index=True)
        close, day = group["close"].to_numpy(float), group["day"].to_numpy()
        at, h, t = _best_trends(close, shortest, longest)
        out = {"symbol": group["symbol"].iloc[:1].repeat(len(at)), "day": day[at], "close": close[at], "h": h, "t": t, "exit_day": day[at + h], "exit_close": close[at + h]}
        return pd.DataFrame({k: np.asarray(v) for k, v in out.items()})

    fits = bars.select("symbol", F.unix_date("dt").alias("day"), "close").groupBy("symbol").applyInPandas(
        scan, f"symbol {kind}, day int, close double, h int, t double, exit_day int, exit_close double"
    )
    t = F.round("t", 4)
    return fits.select(
        "symbol", F.date_from_unix_date("day").alias("dt"), F.when(F.abs(t) < t_least, 0).when(t > 0, 1).otherwise(-1).cast("int").alias("label"),
        F.col("h").alias("best_horizon"), t.alias("t_stat"), F.date_from_unix_date("exit_day").alias("exit_date"),
        ((F.col("exit_close") - F.col("close")) / F.greatest(F.col("close") * 0.01, F.lit(1e-6))).alias("r_multiple"),
    )


def to_binary(label):
    """1 for a positive label, else 0; null stays null."""
    return F.when(label.isNotNull(), (label == 1).cast("int"))


def cooldown(events: DataFrame, days: int = 15) -> DataFrame:
    """Greedy selection per symbol: an event is kept if at least ``days`` days have passed since the last kept one.
    The dates of one symbol are folded in order with the kept dates as state."""
    folded = events.groupBy("symbol").agg(F.array_sort(F.collect_set("dt")).alias("all")).select(
        "symbol",
        F.explode(F.aggregate(
            "all", F.expr("cast(array() as array<date>)"),
            lambda kept, d: F.when((F.size(kept) == 0) | (F.datediff(d, F.element_at(kept, -1)) >= days), F.concat(kept, F.array(d))).otherwise(kept),
        )).alias("dt"),
    )
    return events.join(folded, ["symbol", "dt"])

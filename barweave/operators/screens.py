"""Rule-only screens with named drop reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded_sql
from .indicators import lag
from .relational import first_failure


def higher_lows(bars: DataFrame, window: int = 50, order: int = 3) -> DataFrame:
    """symbol, hl_count, hl_base over the last ``window`` bars: swing lows after the first lowest bar that beat all before
    them (the records of a running maximum), and the lowest of the last ``order`` bars if it beats these as well."""
    back = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    last = bars.withColumn("age", F.row_number().over(back)).filter(F.col("age") <= window)
    w, own = Window.partitionBy("symbol").orderBy("dt"), Window.partitionBy("symbol")
    p = last.select(
        "symbol", "dt", "low", "age", F.count("*").over(own).alias("rows"), F.min(F.struct("low", "dt")).over(own).alias("base"),
        ((F.col("low") <= F.min("low").over(w.rowsBetween(-order, -1))) & (F.col("low") <= F.min("low").over(w.rowsBetween(1, order))) & (F.count("low").over(w.rowsBetween(-order, order)) == 2 * order + 1)).alias("swing"),
    ).filter(F.col("rows") == window)
    s = p.withColumn("level", F.when(F.col("swing") & (F.col("dt") > F.col("base.dt")), F.col("low")))
    seen = F.max("level").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("record", (F.col("level") > F.greatest(F.col("base.low"), seen)).cast("int"))
    g = s.groupBy("symbol").agg(F.sum("record").alias("k"), F.first("base.low").alias("hl_base"), F.max("level").alias("top"), F.min(F.when(F.col("age") <= order, F.col("low"))).alias("tail"))
    return g.select("symbol", (F.coalesce("k", F.lit(0)) + (F.col("tail") > F.greatest("hl_base", "top")).cast("int")).alias("hl_count"), "hl_base")


def pct_down(bars: DataFrame, caps: DataFrame, asof, index_return: float, min_close: float = 45, down: tuple[float, float] = (2, 21), buffer: float = 20, max_runup: float = 54, cap: tuple[float, float] = (350, 34000), apply_cap: bool = True, min_lows: int = 2) -> DataFrame:
    """One row per symbol with its figures at ``asof`` and drop_reason (null: passed), gates in fixed order."""
    b = bars.filter(F.col("dt") <= asof)
    year = F.col("dt") >= F.date_sub(asof, 365)
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    b = b.withColumn("age", F.row_number().over(w))
    g = b.groupBy("symbol").agg(
        F.max_by("close", "dt").alias("close"), F.count("*").alias("rows"), F.max(F.when(year, F.col("high"))).alias("hi"), F.min(F.when(year, F.col("low"))).alias("lo"),
        F.min_by("close", F.when(year, F.col("dt"))).alias("first_close"), F.max(F.when(F.col("age") == 50, F.col("close"))).alias("c50"), F.avg(F.when(F.col("age") <= 200, F.col("close"))).alias("m200"),
    )
    t = g.join(higher_lows(b), "symbol", "left").join(caps, "symbol", "left")
    pct = lambda x: (F.col("close") - F.col(x)) / F.col(x) * 100
    gates = [
        ("price", F.col("close") < min_close), ("no_52w_high", F.col("hi").isNull()), ("band52w", ~pct("hi").between(-down[1], -down[0])), ("low52w", pct("lo") <= buffer), ("runup", pct("first_close") > max_runup),
        ("rs", pct("c50") <= index_return), ("short_history", F.col("rows") < 200), ("below_200dma", F.col("close") <= F.col("m200")),
        ("no_higher_lows", F.coalesce("hl_count", F.lit(0)) < min_lows),
    ]
    if apply_cap:
        gates += [("no_mcap", F.col("market_cap").isNull()), ("mcap", ~F.col("market_cap").between(*cap))]
    return t.withColumn("pct_from_high", pct("hi")).withColumn("drop_reason", first_failure(gates))


def tags():
    """Comma-joined tags of a cohort row, ``none`` without any."""
    rules = [
        ("base_breakout", "base_len_5pct >= 40 and vol_x_avg20 >= 3"), ("momentum_run", "consec_up_days >= 4"), ("gap_up", "gap_pct >= 4"), ("hammer_reversal", "lower_wick_pct >= 50 and body_pct_range >= 25"),
        ("marubozu_strong", "body_pct_range >= 70 and upper_wick_pct <= 10"), ("new_52w_high", "is_52w_high"), ("vol_thrust", "vol_x_avg20 >= 5 and pct_chg_actual >= 5"), ("rsi_overbought_entry", "rsi14 >= 70"),
        ("near_pivot_breakout", "dist_52w_high_pct between -3 and 0 and base_len_5pct >= 20"),
    ]
    found = F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(t)) for t, c in rules])), ",")
    return F.when(found == "", "none").otherwise(found)


def cohort(ind: DataFrame, base: DataFrame, listed: DataFrame) -> DataFrame:
    """One row per row of ``listed`` (symbol and whatever else the day's list has): figures at the symbol's last bar and the
    tags; under 30 bars only the status. ``ind`` are indicator columns, ``base`` (symbol, base_length)."""
    last = ind.withColumns({f"c{k}": F.expr(lag("close", k)) for k in (5, 20, 60)}).filter("n = bars_total").join(base, "symbol")
    pct = lambda a, b: rounded_sql(f"({a} / {b} - 1) * 100", 2)
    # a mean that is not there yet gives no multiple; one below a share counts as one
    times = lambda mean: rounded_sql(f"volume / CASE WHEN {mean} < 1 THEN 1 ELSE {mean} END", 2)
    share = lambda part: rounded_sql(f"{part} / greatest(high - low, 1e-9) * 100", 1)
    ok = last.filter("n >= 30").selectExpr(
        "symbol", "'ok' AS status", "n AS bars", "dt AS last_date", *[f"{rounded_sql(c, 4)} AS {c}" for c in ("close", "open", "high", "low")], "CAST(volume AS BIGINT) AS volume",
        f"{pct('close', 'pc')} AS pct_chg_actual", f"{pct('open', 'pc')} AS gap_pct",
        f"{share('abs(close - open)')} AS body_pct_range", f"{share('(high - greatest(close, open))')} AS upper_wick_pct", f"{share('(least(close, open) - low)')} AS lower_wick_pct",
        f"{times('v20_full')} AS vol_x_avg20", f"{times('v50')} AS vol_x_avg50", f"{rounded_sql('wrsi14', 1)} AS rsi14", f"{rounded_sql('watr14 / close * 100', 2)} AS atr14_pct",
        "close > ma20 AS above_sma20", "close > ma50 AS above_sma50", "close > ma200 AS above_sma200", "ema9r > ema21r AND close > ema9r AS ema_stack_bull", f"{rounded_sql('bb_pos', 2)} AS bb_position",
        f"{pct('close', 'chi252')} AS dist_52w_high_pct", f"{pct('close', 'clo252')} AS dist_52w_low_pct", *[f"CASE WHEN n > {k + 1} THEN {pct('close', f'c{k}')} END AS ret_{k}d_pct" for k in (5, 20, 60)],
        "up_run AS consec_up_days", "base_length AS base_len_5pct", "close >= chi252 * 0.999 AS is_52w_high", f"{rounded_sql('v20_full / 1e5', 2)} AS vol_avg20_lakhs",
    ).withColumn("tags", tags())
    short = last.filter("n < 30").selectExpr("symbol", "n AS bars")
    out = listed.join(ok.unionByName(short, allowMissingColumns=True), "symbol", "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("insufficient_data")), "bars": F.coalesce("bars", F.lit(0))})

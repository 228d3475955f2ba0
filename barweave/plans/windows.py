"""Window queries: one per indicator family over all bars of all symbols."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.windows import ffd_weights, percentile_rank
from ..operators import frames
from ..operators.indicators import frame, roc, slope, staged_sql, tail, with_indicators
from ..sources.fixtures import fundamentals, walk_bars
from .registry import ORACLES, query, r6
from .window_sql import SQL

#: Output columns of each query: plain names are rounded indicator columns, pairs are (alias, expression).
FAMILIES: dict[str, list] = {
    "w01_lag": ["pc", "lag5"],
    "w02_difference": ["dlt"],
    "w03_percent_change": ["ret"],
    "w04_moving_mean": ["ma10", "ma20", "ma50", "ma200"],
    "w05_tail_mean": ["v5", "v10", "v20", "base_v"],
    "w06_true_range_atr": ["tr", "atr14", "atr20"],
    "w07_wilder_smoothing": ["watr14", "wrsi14"],
    "w08_rsi": ["rsi14"],
    "w09_adx": ["dx", "adx14"],
    "w10_obv": ["obv"],
    "w11_moving_std": ["sd20"],
    "w12_centred_min": [("is_swing", "CASE WHEN low11 THEN 1 ELSE 0 END")],
    "w13_fractal_pivot": [("pivot_k3", "CASE WHEN pivot3 THEN 1 ELSE 0 END"), ("pivot_k8", "CASE WHEN pivot8 THEN 1 ELSE 0 END")],
    "w14_swing_low": [("swing", "CASE WHEN swing_low3 THEN 1 ELSE 0 END")],
    "w16_ema_normalised": ["ema20", "ema50", "ema200"],
    "w17_ema_recursive": ["ema9r", "ema21r"],
    "w18_bollinger_width": ["bbw", "bbw_z"],
    "w19_bollinger_position": ["bb_pos"],
    "w20_squeeze": [("squeeze", "CASE WHEN bars_total >= 25 THEN sq ELSE 0 END")],
    "w21_squeeze_runs": ["sq_density", "sq_run", "since_release"],
    "w22_rolling_extremes": ["hi252", "lo252", "c50max", "c100max"],
    "w24_momentum": [(f"roc_{k}", r6(roc("close", k))) for k in (5, 20, 60, 120)],
    "w25_slope": ["obv_s10", "obv_s20", "obv_s50", "obv_s100", "ema200_s20", "c30_slope"],
    "w28_up_run": [("up_run", "CAST(up_run AS BIGINT)")],
    "w34_gap": [("gap_pct", r6("(open - pc) / pc * 100"))],
    "w35_inside_bar": [("inside_bar", "CASE WHEN high < ph AND low > pl THEN 1 ELSE 0 END"), ("nr7", "CASE WHEN n >= 8 AND rng < rng7max THEN 1 ELSE 0 END")],
    "w36_pocket_pivot": [("pocket", "CASE WHEN n >= 12 AND volume > down_v_max AND close > open AND high > low AND (close - low) / nullif(high - low, 0) >= 0.5 AND abs(hi252 - close) / close <= 0.05 THEN 1 ELSE 0 END")],
    "w37_obv_divergence": [("divergence", "CASE WHEN n >= 50 AND obv >= obv_max50 * 0.999 AND close < c50max * 0.99 THEN 1 ELSE 0 END")],
    "w38_amihud": ["amihud20"],
    "w39_liquidity": ["hl20", "dv50"],
    "w41_contraction": [("vdu", r6("1 - v10 / nullif(v50, 0)")), "atr14_10"],
    "w43_failed_breakout": [("failed", "CASE WHEN high > 1.005 * c100max AND fwd_low5 < 0.99 * c100max THEN 1 ELSE 0 END")],
}


def _columns(spec: list) -> list[tuple[str, str]]:
    return [(c, r6(c)) if isinstance(c, str) else c for c in spec]


def _register(name: str, spec: list) -> None:
    columns = _columns(spec)
    sql = SQL.get(name) or f"WITH {staged_sql()} SELECT symbol, dt, {', '.join(f'{e} AS {a}' for a, e in columns)} FROM ind"

    @query(name, sql)
    def run(spark, sf_dir):
        return with_indicators(walk_bars(spark, sf_dir)).select("symbol", "dt", *[F.expr(e).alias(a) for a, e in columns])


for _name, _spec in FAMILIES.items():
    _register(_name, _spec)

#: The slopes of w25: column, values, bars of the frame.
SLOPES = [("obv_s10", "obv", 10), ("obv_s20", "obv", 20), ("obv_s50", "obv", 50), ("obv_s100", "obv", 100), ("ema200_s20", "ema200", 20), ("c30_slope", "close", 30)]


@query("w25_slope", ORACLES["w25_slope"])
def slopes(spark, sf_dir):
    """The frames of all bars of a symbol at once; as window functions every bar would add up 230 rows again, twice."""
    bars = with_indicators(walk_bars(spark, sf_dir)).select("symbol", "dt", "n", "obv", "ema200", "close")
    made = frames.by_symbol(bars, ["n", "obv", "ema200", "close"], lambda b: {c: frames.slope(b[y], b["n"], k) for c, y, k in SLOPES}, ", ".join(f"{c} double" for c, *_ in SLOPES))
    return made.selectExpr("symbol", "dt", *[f"{r6(c)} AS {c}" for c, *_ in SLOPES])


@query("w15_pivot_lists", f"""
    WITH {staged_sql()}, p AS (SELECT symbol, dt, high, low,
      high = max(high) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AND count(high) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 11 AS h,
      low = min(low) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AND count(low) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) = 9 AS l FROM bars)
    SELECT symbol, array_to_string(list(CAST(high AS DECIMAL(18,4)) ORDER BY dt) FILTER (WHERE h), ',') AS highs, array_to_string(list(CAST(low AS DECIMAL(18,4)) ORDER BY dt) FILTER (WHERE l), ',') AS lows
    FROM p GROUP BY symbol""")  # fmt: skip
def pivot_lists(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("dt")
    h, low = w.rowsBetween(-5, 5), w.rowsBetween(-4, 4)
    p = walk_bars(spark, sf_dir).select(
        "symbol", "dt", "high", "low",
        ((F.col("high") == F.max("high").over(h)) & (F.count("high").over(h) == 11)).alias("h"),
        ((F.col("low") == F.min("low").over(low)) & (F.count("low").over(low) == 9)).alias("l"),
    )
    listed = lambda flag, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("dt", F.col(x).cast("decimal(18,4)").alias("v"))))), lambda s: s["v"].cast("string")), ",")
    return p.groupBy("symbol").agg(F.nullif(listed("h", "high"), F.lit("")).alias("highs"), F.nullif(listed("l", "low"), F.lit("")).alias("lows"))


@query("w23_calendar_window", f"""
    SELECT symbol, dt, {r6("max(high) OVER w")} AS high_365d, {r6("min(low) OVER w")} AS low_365d, {r6("first_value(close) OVER w")} AS first_close
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW)""")  # fmt: skip
def calendar_window(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy(F.unix_date("dt")).rangeBetween(-365, 0)
    out = walk_bars(spark, sf_dir).select("symbol", "dt", F.max("high").over(w).alias("a"), F.min("low").over(w).alias("b"), F.first("close").over(w).alias("c"))
    return out.select("symbol", "dt", F.expr(r6("a")).alias("high_365d"), F.expr(r6("b")).alias("low_365d"), F.expr(r6("c")).alias("first_close"))


_BENCH_SQL = "m AS (SELECT symbol, dt, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS ret FROM bars), b AS (SELECT dt, 100 + sum(avg(ret)) OVER (ORDER BY dt) * 100 AS bench FROM m WHERE ret IS NOT NULL GROUP BY dt)"


def benchmark(bars):
    """bench(dt, bench): 100 plus the running sum of the mean member return of each day."""
    w = Window.partitionBy("symbol").orderBy("dt")
    daily = bars.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1).filter("ret is not null").groupBy("dt").agg(F.avg("ret").alias("r"))
    return daily.select("dt", (100 + F.sum("r").over(Window.orderBy("dt")) * 100).alias("bench"))  # a row per day


def with_benchmark(bars, bench):
    """Benchmark (a row per day of the calendar, so it goes to the bars) on the symbol's own dates, then carried forward: days on which the symbol did not trade are never seen."""
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return bars.join(F.broadcast(bench), "dt", "left").withColumn("b", F.last("bench", ignorenulls=True).over(w)).drop("bench")


_ALIGNED = f"{_BENCH_SQL}, a AS (SELECT x.symbol, x.dt, x.close, last_value(b.bench IGNORE NULLS) OVER (PARTITION BY x.symbol ORDER BY x.dt ROWS UNBOUNDED PRECEDING) AS b FROM bars x LEFT JOIN b USING (dt))"


@query("w26_mansfield", f"""
    WITH {_ALIGNED}, r AS (SELECT *, close / b AS ratio, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n FROM a),
    s AS (SELECT *, ratio / ({tail("avg", "ratio", 252)}) * 100 - 100 AS level, CASE WHEN count(ratio) OVER {frame(252)} = 252 THEN ratio / ({tail("avg", "ratio", 252)}) * 100 - 100 END AS guarded FROM r)
    SELECT symbol, dt, {r6("level")} AS rs_mansfield, {r6(slope("guarded", "n", 20))} AS rs_slope_20 FROM s""")  # fmt: skip
def mansfield(spark, sf_dir):
    bars = walk_bars(spark, sf_dir)
    r = with_benchmark(bars, benchmark(bars)).selectExpr("symbol", "dt", "close / b AS ratio", "row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n")
    level = f"ratio / ({tail('avg', 'ratio', 252)}) * 100 - 100"
    s = r.selectExpr("*", f"{level} AS level", f"CASE WHEN count(ratio) OVER {frame(252)} = 252 THEN {level} END AS guarded")
    return s.selectExpr("symbol", "dt", f"{r6('level')} AS rs_mansfield", f"{r6(slope('guarded', 'n', 20))} AS rs_slope_20")


@query("w27_rs_rising", f"""
    WITH {_BENCH_SQL}, a AS (SELECT x.symbol, x.dt, x.close / b.bench AS rs, row_number() OVER (PARTITION BY x.symbol ORDER BY x.dt) AS n FROM bars x JOIN b USING (dt))
    SELECT symbol, dt, {r6(f"regr_slope(rs, n) OVER {frame(50)} / first_value(rs) OVER {frame(50)} * 1000")} AS slope_50 FROM a QUALIFY count(*) OVER {frame(50)} = 50""")  # fmt: skip
def rs_rising(spark, sf_dir):
    bars = walk_bars(spark, sf_dir)
    a = bars.join(benchmark(bars), "dt").selectExpr("symbol", "dt", "close / bench AS rs", "row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n")
    s = a.selectExpr("symbol", "dt", f"regr_slope(rs, n) OVER {frame(50)} AS s", f"first_value(rs) OVER {frame(50)} AS f", f"count(*) OVER {frame(50)} AS k").filter("k = 50")
    return s.selectExpr("symbol", "dt", f"{r6('s / f * 1000')} AS slope_50")


@query("w29_base_length", """
    WITH l AS (SELECT symbol, max(dt) AS last_dt, arg_max(close, dt) AS today, count(*) AS n FROM bars GROUP BY symbol),
    r AS (SELECT b.*, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS i FROM bars b)
    SELECT l.symbol, CAST(coalesce(n - 1 - max(i) FILTER (WHERE r.close > today * 1.05 AND r.dt < last_dt), least(n - 1, 250)) AS BIGINT) AS base_length
    FROM l JOIN r USING (symbol) GROUP BY l.symbol, n""")  # fmt: skip
def base_length(spark, sf_dir):
    """Bars since a close over 105 % of the last one: one pass joined with the last close per symbol."""
    w = Window.partitionBy("symbol").orderBy("dt")
    whole = Window.partitionBy("symbol")
    b = walk_bars(spark, sf_dir).select("symbol", "close", F.row_number().over(w).alias("i"), F.count("*").over(whole).alias("n"), F.max_by("close", "dt").over(whole).alias("today"))
    last = F.max(F.when((F.col("close") > F.col("today") * 1.05) & (F.col("i") < F.col("n")), F.col("i")))
    return b.groupBy("symbol", "n").agg(F.coalesce(F.col("n") - 1 - last, F.least(F.col("n") - 1, F.lit(250))).cast("long").alias("base_length")).select("symbol", "base_length")


@query("w30_rank_descending", "SELECT c_custkey, c_nationkey, CAST(CASE WHEN c_acctbal < 0 THEN -1 ELSE rank() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal >= 0 THEN c_acctbal END DESC NULLS LAST) END AS INTEGER) AS rnk FROM customer")
def rank_descending(spark, sf_dir):
    x = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    r = F.rank().over(Window.partitionBy("c_nationkey").orderBy(x.desc_nulls_last()))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", F.when(x.isNull(), -1).otherwise(r).cast("int").alias("rnk"))


_FUND = """f AS (SELECT s_suppkey AS symbol, 'S' || (s_nationkey % 6) AS sector, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_acctbal AS DOUBLE) END AS market_cap,
  CAST(s_suppkey % 13 AS DOUBLE) AS pe, CASE WHEN s_suppkey % 5 <> 0 THEN round(CAST(s_acctbal AS DOUBLE) / 100) END AS roe FROM supplier)"""
_PCT = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {p} {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {p} {x}) - 1) / 2.0) / CAST(count({x}) OVER (PARTITION BY {q}) AS DOUBLE) END"


@query("w31_percentile_rank", f"WITH {_FUND} SELECT symbol, {', '.join(f'{r6(_PCT.format(x=x, p=p, q=q))} AS {x}_{n}' for x in ('market_cap', 'pe', 'roe') for n, p, q in (('rank_sector', 'sector,', 'sector'), ('rank_all', '', '1')))} FROM f")
def percentile_ranks(spark, sf_dir):
    f = fundamentals(spark, sf_dir)
    cols = [(percentile_rank(x, p), f"{x}_{n}") for x in ("market_cap", "pe", "roe") for n, p in (("rank_sector", ["sector"]), ("rank_all", []))]
    return f.select("symbol", *[F.round(v + 1e-9, 6).alias(a) for v, a in cols])


@query("w32_forward_fill", f"WITH {_ALIGNED} SELECT symbol, dt, {r6('b')} AS bench FROM a")
def forward_fill(spark, sf_dir):
    bars = walk_bars(spark, sf_dir)
    return with_benchmark(bars, benchmark(bars)).selectExpr("symbol", "dt", f"{r6('b')} AS bench")


@query("w33_cumulative_product", f"WITH m AS (SELECT symbol, dt, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS ret FROM bars) SELECT symbol, dt, {r6('product(1 + coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) * 100')} AS level FROM m")
def cumulative_product(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("dt")
    m = walk_bars(spark, sf_dir).withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)
    level = F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100
    return m.select("symbol", "dt", F.round(level + 1e-9, 6).alias("level"))


def _frac_sql() -> str:
    parts = []
    for d, name in ((0.4, "fd_04"), (0.6, "fd_06")):
        w = ffd_weights(d)
        parts.append(f"CASE WHEN count(*) OVER {frame(len(w))} = {len(w)} THEN {r6(f'list_dot_product(list(close) OVER {frame(len(w))}, [{chr(44).join(f'{x:.17e}' for x in w)}])')} END AS {name}")
    return f"SELECT symbol, dt, {', '.join(parts)} FROM bars"


@query("w40_fractional_difference", _frac_sql())
def fractional_difference(spark, sf_dir):
    bars = walk_bars(spark, sf_dir)
    out = ["symbol", "dt"]
    for d, name in ((0.4, "fd_04"), (0.6, "fd_06")):
        w = ffd_weights(d)
        frame_ = Window.partitionBy("symbol").orderBy("dt").rowsBetween(1 - len(w), 0)
        dot = F.aggregate(F.zip_with(F.collect_list("close").over(frame_), F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        out.append(F.when(F.count("*").over(frame_) == len(w), F.round(dot + 1e-9, 6)).alias(name))
    return bars.select(*out)


@query("w44_last_row", f"SELECT symbol, max(dt) AS dt, {r6('arg_max(close, dt)')} AS close FROM bars GROUP BY symbol")
def last_row(spark, sf_dir):
    return walk_bars(spark, sf_dir).groupBy("symbol").agg(F.max("dt").alias("dt"), F.round(F.max_by("close", "dt") + 1e-9, 6).alias("close"))

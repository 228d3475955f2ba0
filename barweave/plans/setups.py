"""Detector, gate, screen, cohort and feature queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import percentile_rank
from ..operators import detect, features, labels, screens
from ..operators.indicators import frame, slope, staged_sql, with_indicators
from ..operators.relational import first_failure, funnel
from ..sources import storage
from ..sources.fixtures import fundamentals, table, walk_bars
from .cohort_sql import COHORT
from .detector_sql import setups_sql
from .groups import _index
from .labels import OUTCOME, OUTCOME_COLUMNS, PATH
from .registry import QUERIES, query, r6
from .windows import _BENCH_SQL, _FUND, benchmark, with_benchmark

#: The fixture's turnover is in thousands, so the replay's liquidity gate is scaled to it.
TURNOVER = 1000.0


def gated(spark, sf_dir):
    bars = walk_bars(spark, sf_dir)
    return detect.quality_gates(with_indicators(with_benchmark(bars, benchmark(bars))), min_turnover=TURNOVER), bars


_GATES = f"""{_BENCH_SQL}, al AS (SELECT x.*, last_value(b.bench IGNORE NULLS) OVER (PARTITION BY x.symbol ORDER BY x.dt ROWS UNBOUNDED PRECEDING) AS b FROM bars x LEFT JOIN b USING (dt)), {staged_sql("al")},
  gt AS (SELECT *, (close / lag(close, 64) OVER w - b / lag(b, 64) OVER w) * 100 AS rs FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
  gr AS (SELECT *, CASE WHEN dv50 * 1e7 < {TURNOVER} THEN 'turnover' WHEN n >= 21 AND atr20 / close * 100 > 6 THEN 'atr' WHEN n >= 50 AND v5 / v50 > 1.2 THEN 'dry_up' WHEN close < ma50 THEN 'trend' WHEN rs < 0 THEN 'strength' END AS drop_reason FROM gt)"""


@query("p06_quality_gates", f"WITH {_GATES} SELECT coalesce(drop_reason, 'pass') AS drop_reason, count(*) AS n FROM gr GROUP BY 1")
def quality_gates(spark, sf_dir):
    return funnel(gated(spark, sf_dir)[0])


def replay_setups(spark, sf_dir):
    """Setups, gated bars and bars; the first two are written once, as later steps read them several times."""
    ind, bars = gated(spark, sf_dir)
    ind = storage.written(ind.select("symbol", "n", "dt", "high", "low", "close", "atr20", "pivot3", "drop_reason"), "gated")
    return storage.written(detect.detect(ind, F.expr("drop_reason is null and n >= 250")), "setups"), ind, bars


_SETUP = f"symbol, CAST(n AS INTEGER) AS n, dt, {r6('r')} AS r, touches, base_start, base_len_days, {r6('distance_pct')} AS distance_pct, is_high"
_REPLAY = f"{_GATES}, {setups_sql('SELECT symbol, n, dt, close FROM gr WHERE drop_reason IS NULL AND n >= 250', detect.Setup())}"


def shown(setups):
    """Setups with their figures rounded."""
    return setups.withColumns({c: F.expr(r6(c)) for c in ("r", "distance_pct")})


@query("c01_resistance_detector", f"WITH RECURSIVE {_REPLAY} SELECT {_SETUP} FROM su")
def resistance(spark, sf_dir):
    return shown(replay_setups(spark, sf_dir)[0])


def last_setups(spark, sf_dir):
    ind = with_indicators(walk_bars(spark, sf_dir))
    return detect.detect(ind, F.expr("n = bars_total"), detect.SCANNER), ind


_SCANNED = f"{staged_sql()}, {setups_sql('SELECT symbol, n, dt, close FROM ind WHERE n = bars_total', detect.SCANNER)}"


@query("c02_scanner_detector", f"WITH RECURSIVE {_SCANNED} SELECT {_SETUP} FROM su")
def scanner_resistance(spark, sf_dir):
    return shown(last_setups(spark, sf_dir)[0])


_LEVELS = """lv AS (SELECT symbol, dt, close, max(close) OVER (PARTITION BY symbol ORDER BY dt ROWS 99 PRECEDING) AS r, max(high) OVER (PARTITION BY symbol ORDER BY dt ROWS 749 PRECEDING) AS top FROM bars)"""


def levels(spark, sf_dir):
    """Every bar with the highest close of 100 bars as its level r and the highest high of 750 bars as top."""
    w = Window.partitionBy("symbol").orderBy("dt")
    return walk_bars(spark, sf_dir).select("symbol", "dt", "close", F.max("close").over(w.rowsBetween(-99, 0)).alias("r"), F.max("high").over(w.rowsBetween(-749, 0)).alias("top"))


@query("p07_proximity_band", f"WITH {_LEVELS} SELECT symbol, dt FROM lv WHERE (r - close) / close >= -0.03 AND (r - close) / close <= 0.05")
def proximity(spark, sf_dir):
    return levels(spark, sf_dir).filter(detect.in_band(F.col("close"), F.col("r"), detect.Setup())).select("symbol", "dt")


@query("p08_distance_to_high", f"WITH {_LEVELS} SELECT symbol, count(*) FILTER (WHERE abs(r - top) / top * 100 <= 12) AS near_, count(*) FILTER (WHERE NOT abs(r - top) / top * 100 <= 12) AS far FROM lv GROUP BY symbol")
def near_high(spark, sf_dir):
    ok = detect.near_top(F.col("r"), F.col("top"), detect.Setup())
    return levels(spark, sf_dir).groupBy("symbol").agg(F.count_if(ok).alias("near_"), F.count_if(~ok).alias("far"))


@query("p09_touch_and_length", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n, count(*) OVER (PARTITION BY symbol) AS total FROM bars),
    p AS (SELECT x.symbol, x.dt, x.high FROM b x JOIN b y ON y.symbol = x.symbol AND y.n BETWEEN x.n - 3 AND x.n + 3 GROUP BY x.symbol, x.dt, x.high HAVING count(*) = 7 AND max(y.high) = x.high),
    l AS (SELECT symbol, max(close) AS r, max(dt) AS today FROM b WHERE n > total - 100 GROUP BY symbol)
    SELECT l.symbol, count(*) AS touches, CAST(max(today) - min(p.dt) AS INTEGER) AS days FROM l JOIN p ON p.symbol = l.symbol AND abs(p.high - r) / r <= 0.03 GROUP BY l.symbol HAVING count(*) >= 2 AND max(today) - min(p.dt) >= 30""")  # fmt: skip
def touches(spark, sf_dir):
    ind = with_indicators(walk_bars(spark, sf_dir))
    last = ind.filter("n > bars_total - 100").groupBy("symbol").agg(F.max("close").alias("r"), F.max("dt").alias("today"))
    hits = ind.filter("pivot3").select("symbol", "dt", "high").join(last, "symbol").filter(F.abs(F.col("high") - F.col("r")) / F.col("r") <= 0.03)
    g = hits.groupBy("symbol").agg(F.count("*").alias("touches"), F.datediff(F.max("today"), F.min("dt")).alias("days"))
    return g.filter(detect.held(F.col("touches"), F.col("days"), detect.Setup()))


def replay(setups, ind):
    """Setups with an outcome, thinned to one per cooldown."""
    e = setups.join(ind.select("symbol", "n", "close", F.col("atr20").alias("atr")), ["symbol", "n"]).withColumn("resistance", F.col("r"))
    outcome = labels.triple_barrier(e, ind.select("symbol", "n", "dt", "high", "low", "close"))
    return labels.cooldown(outcome.filter("label is not null"), 15)


@query("p10_replay_with_cooldown", f"""WITH RECURSIVE {_REPLAY}, e AS (SELECT su.symbol, su.dt, su.n, i.close, i.atr20 AS atr, su.r AS resistance, i.close + 3 * i.atr20 AS top, i.close - i.atr20 AS bottom FROM su JOIN ind i ON i.symbol = su.symbol AND i.n = su.n WHERE i.atr20 > 0),
    {PATH}, {OUTCOME}, oc AS MATERIALIZED (SELECT {OUTCOME_COLUMNS} FROM x),
    kd AS (SELECT symbol, min(dt) AS dt FROM oc GROUP BY symbol UNION ALL SELECT symbol, nx AS dt FROM (SELECT kd.symbol, (SELECT min(oc.dt) FROM oc WHERE oc.symbol = kd.symbol AND oc.dt >= kd.dt + 15) AS nx FROM kd) WHERE nx IS NOT NULL)
    SELECT oc.* FROM oc JOIN kd USING (symbol, dt)""")  # fmt: skip
def replay_with_cooldown(spark, sf_dir):
    return replay(*replay_setups(spark, sf_dir)[:2]).withColumns({c: F.expr(r6(c)) for c in ("exit_price", "r_multiple")})


@query("c09_symbol_scan")
def symbol_scan(spark, sf_dir):
    """Thinned setups with their outcome and all features; features are made of the thinned ones only."""
    setups, ind, bars = replay_setups(spark, sf_dir)
    thinned = storage.written(replay(setups, ind), "thinned")
    kept = storage.written(setups.join(thinned.select("symbol", "dt"), ["symbol", "dt"], "left_semi").select(setups.columns), "kept")
    return thinned.join(feature_rows(spark, sf_dir, kept, bars), ["symbol", "dt"])


_LAST = f"{staged_sql()}, la AS (SELECT * FROM ind WHERE n = bars_total)"


@query("p19_trend_gate", f"WITH {_LAST} SELECT symbol, CASE WHEN n < 60 THEN 'insufficient_history' WHEN coalesce(close <= ma50, true) THEN 'below_ma50' ELSE 'ok' END AS reason FROM la")
def trend_gate(spark, sf_dir):
    last = with_indicators(walk_bars(spark, sf_dir)).filter("n = bars_total")
    return last.select("symbol", F.coalesce(first_failure([("insufficient_history", F.col("n") < 60), ("below_ma50", F.coalesce(F.col("close") <= F.col("ma50"), F.lit(True)))]), F.lit("ok")).alias("reason"))


@query("p20_not_extended", f"WITH {_LAST} SELECT symbol, n >= 25 AND max_move5 <= 0.05 AND coalesce(rng <= 2.5 * atr20, true) AS ok FROM la")
def not_extended(spark, sf_dir):
    return with_indicators(walk_bars(spark, sf_dir)).filter("n = bars_total").selectExpr("symbol", "n >= 25 AND max_move5 <= 0.05 AND coalesce(rng <= 2.5 * atr20, true) AS ok")


@query("p21_failed_breakout", f"WITH {_LAST} SELECT symbol, h15max > 1.03 * c100max AND close < 0.98 * c100max AS failed FROM la")
def failed_breakout(spark, sf_dir):
    return with_indicators(walk_bars(spark, sf_dir)).filter("n = bars_total").selectExpr("symbol", "h15max > 1.03 * c100max AND close < 0.98 * c100max AS failed")


@query("p22_recent_test", f"WITH {_LAST} SELECT l.symbol, count(*) FILTER (WHERE i.high >= 0.96 * l.c100max) AS tests FROM la l JOIN ind i ON i.symbol = l.symbol AND i.n > l.n - 50 GROUP BY l.symbol")
def recent_test(spark, sf_dir):
    ind = with_indicators(walk_bars(spark, sf_dir))
    last = ind.filter("n = bars_total").select("symbol", "c100max")
    return ind.filter("n > bars_total - 50").select("symbol", "high").join(last, "symbol").groupBy("symbol").agg(F.count_if(F.col("high") >= 0.96 * F.col("c100max")).alias("tests"))


#: A deterministic base per symbol for the slice operators: from its highest close on, the level being the highest high.
_BASE = f"""{staged_sql()}, b0 AS (SELECT symbol, max(high) AS r FROM ind GROUP BY symbol), b1 AS (SELECT symbol, dt AS base_start FROM (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY close DESC, dt) AS k FROM ind WHERE n <= bars_total - 60) WHERE k = 1),
  sl AS (SELECT i.symbol, i.dt, i.high AS h, i.low AS l, i.close AS c, r, count(*) OVER (PARTITION BY i.symbol) AS size, row_number() OVER (PARTITION BY i.symbol ORDER BY i.dt) - 1 AS k FROM ind i JOIN b0 USING (symbol) JOIN b1 ON b1.symbol = i.symbol AND i.dt >= base_start)"""


def pseudo_base(spark, sf_dir):
    ind = with_indicators(walk_bars(spark, sf_dir))
    w = Window.partitionBy("symbol")
    s = ind.select("symbol", "n", "dt", "bars_total", F.max("high").over(w).alias("r"), F.min_by("dt", F.when(F.col("n") <= F.col("bars_total") - 60, F.struct((-F.col("close")).alias("c"), "dt"))).over(w).alias("base_start")).filter("n = bars_total").drop("bars_total")
    return detect.base_slice(s, ind.select("symbol", "n", "dt", "high", "low", "close", "volume", "atr14"))


@query("f28_base_metrics", f"WITH {_BASE} SELECT symbol, max(size) AS size, {r6('(max(h) - min(l)) / max(r)')} AS range_pct, {r6('(max(h) FILTER (WHERE size - k <= 25) - min(l) FILTER (WHERE size - k <= 25)) / max(r)')} AS trailing_pct, {r6('(max(r) - min(l)) / max(r) * 100')} AS height_pct FROM sl GROUP BY symbol")
def base_metrics(spark, sf_dir):
    return detect.base_features(pseudo_base(spark, sf_dir)).selectExpr("symbol", "size", *[f"{r6(c)} AS {c}" for c in ("range_pct", "trailing_pct", "height_pct")])


@query("p23_base_width", f"WITH {_BASE} SELECT symbol, {r6('(max(h) - min(l)) / max(r)')} AS range_pct FROM sl GROUP BY symbol HAVING (max(h) - min(l)) / max(r) <= 0.40")
def base_width(spark, sf_dir):
    return detect.base_features(pseudo_base(spark, sf_dir)).filter("range_pct <= 0.40").selectExpr("symbol", f"{r6('range_pct')} AS range_pct")



@query("w42_wyckoff_spring", f"WITH {_BASE}, m AS (SELECT *, min(CASE WHEN k < size - 5 THEN l END) OVER (PARTITION BY symbol) AS floor_ FROM sl) SELECT symbol, CAST(CASE WHEN max(size) >= 20 THEN max(CASE WHEN size - k <= 15 AND l < floor_ AND c > floor_ THEN 1 ELSE 0 END) ELSE 0 END AS INTEGER) AS spring FROM m GROUP BY symbol")
def spring(spark, sf_dir):
    return detect.base_features(pseudo_base(spark, sf_dir)).select("symbol", "spring")


@query("c15_cup_and_handle", f"""WITH {_BASE}, g AS (SELECT symbol, max(size) AS size, max(r) AS r, max(h) FILTER (WHERE size - k > 5) AS ch, min(l) FILTER (WHERE size - k > 5) AS cl, min(l) FILTER (WHERE size - k <= 15) AS hl,
      min(l) FILTER (WHERE k >= greatest(1, (size - 5) // 3) AND k < 2 * greatest(1, (size - 5) // 3)) AS ml, arg_max(c, k) AS c FROM sl GROUP BY symbol)
    SELECT symbol, coalesce(size >= 50 AND (ch - cl) / ch BETWEEN 0.12 AND 0.40 AND ml <= cl * 1.05 AND (ch - hl) / ch <= (ch - cl) / ch * 0.5 AND abs(r - c) / c <= 0.08, false) AS cup_handle FROM g""")  # fmt: skip
def cup(spark, sf_dir):
    return detect.base_features(pseudo_base(spark, sf_dir)).select("symbol", "cup_handle")


@query("c16_vcp_contractions", f"""WITH {_BASE}, p AS (SELECT symbol, k, h, row_number() OVER (PARTITION BY symbol ORDER BY k) AS j FROM (SELECT *, max(h) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m, count(*) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS z FROM sl WHERE size >= 30) WHERE h = m AND z = 11),
    q AS (SELECT a.symbol, a.j, (a.h - min(s.l)) / a.h AS pull FROM p a JOIN p b ON b.symbol = a.symbol AND b.j = a.j + 1 JOIN sl s ON s.symbol = a.symbol AND s.k BETWEEN a.k AND b.k GROUP BY a.symbol, a.j, a.h),
    t AS (SELECT symbol, pull < 0.85 * lag(pull) OVER (PARTITION BY symbol ORDER BY j) AND pull < 0.15 AS ok FROM q)
    SELECT symbol, count(*) FILTER (WHERE ok) AS vcp FROM t GROUP BY symbol HAVING count(*) > 0""")  # fmt: skip
def vcp(spark, sf_dir):
    base = pseudo_base(spark, sf_dir)
    out = detect.contractions(base)
    two = base.filter("size >= 30").withColumn("p", (F.col("b_high") == F.max("b_high").over(Window.partitionBy("symbol").orderBy("k").rowsBetween(-5, 5))) & (F.count("*").over(Window.partitionBy("symbol").orderBy("k").rowsBetween(-5, 5)) == 11))
    return out.join(two.groupBy("symbol").agg(F.count_if("p").alias("pivots")).filter("pivots >= 2"), "symbol").select("symbol", "vcp")


@query("c17_double_bottom", f"""WITH {_BASE}, p AS (SELECT symbol, k, l, r FROM (SELECT *, min(l) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m, count(*) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS z FROM sl WHERE size >= 25) WHERE l = m AND z = 9),
    e AS (SELECT symbol, arg_max(c, k) AS c FROM sl GROUP BY symbol),
    q AS (SELECT a.symbol, a.k AS k1, b.k AS k2, least(a.l, b.l) AS lo, a.r, max(s.h) AS peak FROM p a JOIN p b ON a.symbol = b.symbol AND b.k - a.k >= 5 AND (greatest(a.l, b.l) - least(a.l, b.l)) / least(a.l, b.l) <= 0.04 JOIN sl s ON s.symbol = a.symbol AND s.k > a.k AND s.k < b.k GROUP BY ALL)
    SELECT DISTINCT symbol FROM q JOIN e USING (symbol) WHERE (peak - lo) / lo >= 0.05 AND (c >= 0.97 * peak OR (r - c) / c BETWEEN -0.05 AND 0.04)""")  # fmt: skip
def double_bottom(spark, sf_dir):
    return detect.double_bottoms(pseudo_base(spark, sf_dir)).select("symbol")


def _lows(where: str = "") -> str:
    """Common table expressions up to ``hl`` (symbol, k: higher lows, base_low) over the last 50 bars."""
    return f"""hx AS (SELECT symbol, dt, low, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM bars {where}), y AS (SELECT * FROM hx WHERE age <= 50),
    z AS (SELECT *, low <= min(low) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND low <= min(low) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AND count(*) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 AS swing FROM y),
    bs AS (SELECT symbol, dt AS base_dt, low AS base_low FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY low, dt) AS k FROM y) WHERE k = 1),
    s AS (SELECT z.symbol, z.low, coalesce(max(z.low) OVER (PARTITION BY z.symbol ORDER BY z.dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base_low) AS seen, base_low FROM z JOIN bs ON bs.symbol = z.symbol AND z.dt > base_dt WHERE swing),
    cn AS (SELECT symbol, count(*) FILTER (WHERE low > greatest(seen, base_low)) AS k, max(low) AS top FROM s GROUP BY symbol), tl AS (SELECT symbol, min(low) AS tail FROM y WHERE age <= 3 GROUP BY symbol),
    hl AS (SELECT bs.symbol, coalesce(k, 0) + CASE WHEN tail > greatest(base_low, coalesce(top, base_low)) THEN 1 ELSE 0 END AS k, base_low FROM bs JOIN tl USING (symbol) LEFT JOIN cn USING (symbol))"""


@query("c18_higher_lows", f"WITH {_lows()} SELECT symbol, k AS hl_count, {r6('base_low')} AS hl_base FROM hl")
def higher_lows(spark, sf_dir):
    return screens.higher_lows(walk_bars(spark, sf_dir)).selectExpr("symbol", "CAST(hl_count AS BIGINT) AS hl_count", f"{r6('hl_base')} AS hl_base")


_ASOF = "DATE '1999-06-30'"

def _screen(buffer: int = 5, index: str = "0", lows: str = "") -> str:
    return f"""{_FUND}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM bars WHERE dt <= {_ASOF}),
  g AS (SELECT symbol, arg_max(close, dt) AS close, count(*) AS rows_, max(high) FILTER (WHERE dt >= {_ASOF} - 365) AS hi, min(low) FILTER (WHERE dt >= {_ASOF} - 365) AS lo, arg_min(close, dt) FILTER (WHERE dt >= {_ASOF} - 365) AS fc, max(close) FILTER (WHERE age = 50) AS c50, avg(close) FILTER (WHERE age <= 200) AS m200 FROM x GROUP BY symbol),
  sc AS (SELECT g.symbol, (close - hi) / hi * 100 AS pct, CASE WHEN close < 45 THEN 'price' WHEN hi IS NULL THEN 'no_52w_high' WHEN NOT (close - hi) / hi * 100 BETWEEN -21 AND -2 THEN 'band52w' WHEN (close - lo) / lo * 100 <= {buffer} THEN 'low52w' WHEN (close - fc) / fc * 100 > 54 THEN 'runup'
    WHEN (close - c50) / c50 * 100 <= {index} THEN 'rs' WHEN rows_ < 200 THEN 'short_history' WHEN close <= m200 THEN 'below_200dma' {lows} WHEN market_cap IS NULL THEN 'no_mcap' WHEN NOT market_cap BETWEEN 350 AND 34000 THEN 'mcap' END AS drop_reason FROM g LEFT JOIN f USING (symbol) {"LEFT JOIN hl USING (symbol)" if lows else ""})"""


_SCREEN = _screen()
_FULL = f"""{_BENCH_SQL}, ix AS (SELECT (arg_max(bench, dt) / arg_min(bench, dt) - 1) * 100 AS ret FROM (SELECT * FROM b WHERE dt <= {_ASOF} ORDER BY dt DESC LIMIT 50)),
  {_lows(f"WHERE dt <= {_ASOF}")}, {_screen(20, "(SELECT ret FROM ix)", "WHEN coalesce(hl.k, 0) < 2 THEN 'no_higher_lows'")}"""


@query("p16_pct_down_screen", f"WITH {_SCREEN} SELECT symbol, {r6('pct')} AS pct_from_high, drop_reason FROM sc")
def pct_down(spark, sf_dir):
    """The screen with the higher-lows gate off (c18 has its own query)."""
    asof = F.lit("1999-06-30").cast("date")
    out = screens.pct_down(walk_bars(spark, sf_dir), fundamentals(spark, sf_dir).select("symbol", "market_cap"), asof, 0.0, buffer=5, min_lows=0)
    return out.selectExpr("symbol", f"{r6('pct_from_high')} AS pct_from_high", "drop_reason")


@query("p16_full_pct_down_screen", f"WITH {_FULL} SELECT symbol, {r6('pct')} AS pct_from_high, drop_reason FROM sc")
def pct_down_full(spark, sf_dir):
    """The screen with all gates at their defaults, against the benchmark's return over 50 sessions."""
    asof = F.lit("1999-06-30").cast("date")
    bars = walk_bars(spark, sf_dir)
    last = [r["bench"] for r in benchmark(bars.filter(F.col("dt") <= asof)).orderBy(F.col("dt").desc()).limit(50).collect()]  # 50 rows at most
    index = (last[0] / last[-1] - 1) * 100 if len(last) == 50 else None
    out = screens.pct_down(bars, fundamentals(spark, sf_dir).select("symbol", "market_cap"), asof, index)
    return out.selectExpr("symbol", f"{r6('pct_from_high')} AS pct_from_high", "drop_reason")


@query("p26_full_gate_funnel", f"WITH {_FULL} SELECT coalesce(drop_reason, 'pass') AS drop_reason, count(*) AS n FROM sc GROUP BY 1")
def gate_funnel_full(spark, sf_dir):
    return funnel(pct_down_full(spark, sf_dir))


@query("p26_gate_funnel", f"WITH {_SCREEN} SELECT coalesce(drop_reason, 'pass') AS drop_reason, count(*) AS n FROM sc GROUP BY 1")
def gate_funnel(spark, sf_dir):
    return funnel(pct_down(spark, sf_dir))


_STEPS = ["price", "no_52w_high", "band52w", "low52w", "runup", "rs", "short_history", "below_200dma", "no_higher_lows", "no_mcap", "mcap"]


def _counters_sql(screen: str) -> str:
    steps = ", ".join(f"({i}, '{x}')" for i, x in enumerate(_STEPS))
    return f"""WITH {screen}, st AS (SELECT * FROM (VALUES {steps}) v(k, step)),
    hits AS (SELECT coalesce((SELECT k FROM st WHERE step = drop_reason), {len(_STEPS)}) AS k FROM sc)
    SELECT step, (SELECT count(*) FROM hits WHERE hits.k >= st.k) AS entered, (SELECT count(*) FROM hits WHERE hits.k = st.k) AS dropped FROM st"""


def counters(screened):
    """step, entered, dropped: symbols that enter each step of a screen and that it drops."""
    at = F.array_position(F.array(*[F.lit(x) for x in _STEPS]), F.col("drop_reason")) - 1
    numbered = funnel(screened).withColumn("at", F.when(F.col("drop_reason") == "pass", len(_STEPS)).otherwise(at))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(x).alias("step")) for i, x in enumerate(_STEPS)])).alias("s")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return numbered.select(steps, "at", "n").groupBy("s.step").agg(count(F.col("at") >= F.col("s.k")).alias("entered"), count(F.col("at") == F.col("s.k")).alias("dropped"))


@query("c20_screen_counters", _counters_sql(_SCREEN))
def screen_counters(spark, sf_dir):
    return counters(pct_down(spark, sf_dir))


@query("c20_full_screen_counters", _counters_sql(_FULL))
def screen_counters_full(spark, sf_dir):
    """All gates at their defaults."""
    return counters(pct_down_full(spark, sf_dir))


@query("p17_drawdown_duration", f"SELECT symbol, CAST({_ASOF} - arg_min(dt, -high) AS INTEGER) AS days FROM (SELECT * FROM bars WHERE dt <= {_ASOF} AND dt >= {_ASOF} - 365 ORDER BY symbol, dt) GROUP BY symbol")
def drawdown(spark, sf_dir):
    b = walk_bars(spark, sf_dir).filter(f"dt <= {_ASOF} and dt >= date_sub({_ASOF}, 365)")
    return b.groupBy("symbol").agg(F.datediff(F.lit("1999-06-30").cast("date"), F.min_by("dt", F.struct((-F.col("high")).alias("h"), "dt"))).alias("days"))


def cohort_list(spark, sf_dir):
    """The day's list: symbol, series and what the exchange reports."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS symbol", "CASE WHEN s_suppkey % 3 = 0 THEN 'BE' ELSE 'EQ' END AS series", "CAST(s_nationkey AS DOUBLE) AS csv_pct_chg", "s_nationkey % 4 * 5 AS csv_band_pct", "CAST(s_acctbal AS DOUBLE) AS csv_value_cr",
    )


@query("c19_cohort_features", COHORT)
def cohort(spark, sf_dir):
    return screens.cohort(with_indicators(walk_bars(spark, sf_dir)), QUERIES["w29_base_length"](spark, sf_dir), cohort_list(spark, sf_dir))


@query("f19_tag_rules", f"SELECT symbol, tags, pct_chg_actual, gap_pct, body_pct_range, upper_wick_pct, lower_wick_pct, vol_x_avg20 FROM ({COHORT})")
def tag_rules(spark, sf_dir):
    return cohort(spark, sf_dir).select("symbol", "tags", "pct_chg_actual", "gap_pct", "body_pct_range", "upper_wick_pct", "lower_wick_pct", "vol_x_avg20")


@query("f20_risk_plan", f"""WITH {_BASE}, g AS (SELECT symbol, max(r) AS r, min(l) AS bl, arg_max(c, k) AS c FROM sl GROUP BY symbol), z AS (SELECT g.*, greatest(0.99 * i.low20, g.c - i.atr20) AS stop FROM g JOIN ind i ON i.symbol = g.symbol AND i.n = i.bars_total)
    SELECT symbol, round(c, 2) AS entry, round(stop, 2) AS stop, round(r + (r - bl), 2) AS target, round((c - stop) / c * 100, 2) AS risk_pct, CASE WHEN c > stop THEN round((r + (r - bl) - c) / nullif(c - stop, 0), 2) END AS rr FROM z""")  # fmt: skip
def risk_plan(spark, sf_dir):
    g = pseudo_base(spark, sf_dir).groupBy("symbol", "r").agg(F.min("b_low").alias("bl"), F.max_by("b_close", "k").alias("c"))
    last = with_indicators(walk_bars(spark, sf_dir)).filter("n = bars_total").select("symbol", "low20", "atr20")
    j = g.join(last, "symbol")
    return j.select("symbol", *detect.risk_plan(F.col("c"), F.col("r"), F.col("bl"), F.greatest(0.99 * F.col("low20"), F.col("c") - F.col("atr20")))).drop("reward_pct")


@query("f21_scanner_risk_plan", f"""WITH {_BASE}, g AS (SELECT symbol, max(r) AS r, min(l) AS bl, arg_max(c, k) AS c, 0.99 * min(l) FILTER (WHERE size - k <= 20) AS stop FROM sl GROUP BY symbol)
    SELECT symbol, round(stop, 2) AS stop, round(r + (r - bl), 2) AS target, round((r + (r - bl) - c) / c * 100, 2) AS reward_pct FROM g""")  # fmt: skip
def scanner_risk(spark, sf_dir):
    g = pseudo_base(spark, sf_dir).groupBy("symbol", "r").agg(F.min("b_low").alias("bl"), F.max_by("b_close", "k").alias("c"), (0.99 * F.min(F.when(F.col("size") - F.col("k") <= 20, F.col("b_low")))).alias("s"))
    return g.select("symbol", *detect.risk_plan(F.col("c"), F.col("r"), F.col("bl"), F.col("s"))).select("symbol", "stop", "target", "reward_pct")


@query("f26_logical_stacks", f"WITH {staged_sql()} SELECT symbol, dt, coalesce(close > ema20 AND ema20 > ema50, false) AS stack, coalesce(n >= 200 AND close > ema20 AND ema20 > ema50 AND ema50 > ema200, false) AS full_stack FROM ind")
def stacks(spark, sf_dir):
    return with_indicators(walk_bars(spark, sf_dir)).selectExpr("symbol", "dt", "coalesce(close > ema20 AND ema20 > ema50, false) AS stack", "coalesce(n >= 200 AND close > ema20 AND ema20 > ema50 AND ema50 > ema200, false) AS full_stack")


def described_bars(spark, sf_dir, bars, grouped=True):
    """Indicators of the bars with their benchmark b and, if ``grouped``, their group's level g. Levels are a row per group and day of the calendar, so they go to the bars."""
    aligned = with_benchmark(bars, benchmark(bars))
    if not grouped:
        return with_indicators(aligned)
    _, members, index = _index(spark, sf_dir)
    g = index.withColumnRenamed("level", "glevel")
    joined = aligned.join(members, "symbol", "left").join(F.broadcast(g), ["grp", "dt"], "left")
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return with_indicators(joined.withColumn("g", F.last("glevel", ignorenulls=True).over(w)).drop("grp", "glevel"))


def feature_rows(spark, sf_dir, setups=None, bars=None):
    """Features of the setups given, of all of the replay without any."""
    if setups is None:
        setups, _, bars = replay_setups(spark, sf_dir)
    f = fundamentals(spark, sf_dir).withColumnsRenamed({"market_cap": "marketCap", "pe": "trailingPE", "roe": "returnOnEquity"})
    ranks = {f"{c}_rank_{k}": percentile_rank(c, by) for c in ("marketCap", "trailingPE", "returnOnEquity") for k, by in (("sector", ["sector"]), ("all", []))}
    return features.make_features(setups, described_bars(spark, sf_dir, bars), f.withColumns(ranks).drop("sector"))


_WEEKLY = f"""WITH RECURSIVE {_REPLAY},
  ws AS (SELECT a.symbol, a.n, CAST(b.dt + CAST((12 - dayofweek(b.dt)) % 7 AS INT) AS DATE) AS week, max(high) AS high, min(low) AS low, arg_max(b.close, b.dt) AS close, sum(volume) AS volume
    FROM su a JOIN bars b ON b.symbol = a.symbol AND b.dt <= a.dt GROUP BY ALL),
  wa AS (SELECT *, row_number() OVER w AS j, count(*) OVER (PARTITION BY symbol, n) AS total, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM ws WINDOW w AS (PARTITION BY symbol, n ORDER BY week)),
  wb AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
    CASE WHEN j > 1 THEN greatest(close - pc, 0) END AS up, CASE WHEN j > 1 THEN greatest(pc - close, 0) END AS dn,
    CASE WHEN j > 1 THEN CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END END AS pdm,
    CASE WHEN j > 1 THEN CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END END AS mdm FROM wa),
  wc AS (SELECT *, avg(up) OVER f14 AS up14, avg(dn) OVER f14 AS dn14, CASE WHEN j >= 15 THEN avg(pdm) OVER f14 END AS pdm14, CASE WHEN j >= 15 THEN avg(mdm) OVER f14 END AS mdm14,
    stddev_samp(close) OVER f20 AS sd20, avg(tr) OVER f20 AS atr20, max(high) OVER f52 AS hi52, avg(volume) OVER f4 AS v4, avg(volume) OVER f20 AS v20,
    lag(close, 4) OVER w AS c4, lag(close, 12) OVER w AS c12, lag(close, 26) OVER w AS c26, regr_slope(close, j) OVER f12 AS s12,
    sum(close * pow(9.0 / 11, total - j)) OVER e * (2.0 / 11) / (1 - pow(9.0 / 11, total)) AS e10, sum(close * pow(29.0 / 31, total - j)) OVER e * (2.0 / 31) / (1 - pow(29.0 / 31, total)) AS e30
    FROM wb WINDOW w AS (PARTITION BY symbol, n ORDER BY week), e AS (PARTITION BY symbol, n),
      {", ".join(f"f{k} AS (PARTITION BY symbol, n ORDER BY week ROWS {k - 1} PRECEDING)" for k in (4, 12, 14, 20, 52))}),
  wd AS (SELECT *, 100 * abs(pdm14 - mdm14) / nullif(pdm14 + mdm14, 0) AS dx FROM wc),
  we AS (SELECT *, CASE WHEN count(dx) OVER f = 14 THEN avg(dx) OVER f END AS adx14 FROM wd WINDOW f AS (PARTITION BY symbol, n ORDER BY week ROWS 13 PRECEDING))
  SELECT symbol, CAST(n AS INTEGER) AS n, {r6("100 - 100 / (1 + up14 / nullif(dn14, 0))")} AS wk_rsi_14, {r6("adx14")} AS wk_adx_14, CAST(CASE WHEN close > e10 AND e10 > e30 THEN 1 ELSE 0 END AS DOUBLE) AS wk_ema_stack,
    {", ".join(f"{r6(f'(close / nullif(c{k}, 0) - 1) * 100')} AS wk_roc_{k}" for k in (4, 12, 26))}, {r6("(hi52 - close) / hi52 * 100")} AS wk_dist_52w_high_pct, {r6("1 - v4 / nullif(v20, 0)")} AS wk_vdu,
    CAST(CASE WHEN s12 > 0 THEN 1 ELSE 0 END AS DOUBLE) AS wk_higher_lows, CAST(CASE WHEN 2 * sd20 < 1.5 * atr20 THEN 1 ELSE 0 END AS DOUBLE) AS wk_ttm_squeeze
  FROM we WHERE j = total AND total >= 30"""


@query("c08_weekly_block", _WEEKLY)
def weekly_block(spark, sf_dir):
    """The ten weekly columns of every setup; the SQL replays all weeks of a setup by themselves."""
    setups, _, bars = replay_setups(spark, sf_dir)
    out = features.weekly(bars, setups)
    return out.selectExpr("symbol", "CAST(n AS INTEGER) AS n", *[f"{r6(c)} AS {c}" for c in features.WEEKLY])


@query("c08_feature_builder")
def feature_builder(spark, sf_dir):
    return feature_rows(spark, sf_dir)


_AT = "(PARTITION BY symbol, n ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
_FIVE = " + ".join(f"CASE WHEN {c} > 0 THEN 5 ELSE 0 END" for c in ("(close / ema50 - 1)", "(close / ema200 - 1)", "ema200_s20", "mans", "rs_slope"))


@query("f24_feature_score", f"""WITH RECURSIVE {_REPLAY},
  fm AS (SELECT *, (close / b / (avg(close / b) OVER {frame(252)}) - 1) * 100 AS mans, CASE WHEN n >= 252 AND count(b) OVER {frame(252)} = 252 THEN (close / b / (avg(close / b) OVER {frame(252)}) - 1) * 100 END AS mans_full FROM ind),
  fs AS (SELECT *, {slope("mans_full", "n", 20)} AS rs_slope FROM fm),
  fb AS (SELECT su.symbol, su.n, i.low AS l, i.atr14, row_number() OVER (PARTITION BY su.symbol, su.n ORDER BY i.n) - 1 AS k, count(*) OVER (PARTITION BY su.symbol, su.n) AS size FROM su JOIN ind i ON i.symbol = su.symbol AND i.dt BETWEEN su.base_start AND su.dt),
  fl AS (SELECT symbol, n, l, row_number() OVER (PARTITION BY symbol, n ORDER BY k) AS j FROM (SELECT *, min(l) OVER {_AT} AS best, count(*) OVER {_AT} AS z FROM fb WHERE size >= 30) WHERE l = best AND z = 11),
  fh AS (SELECT symbol, n FROM fl GROUP BY symbol, n HAVING count(*) >= 5 AND regr_slope(l, j) > 0),
  fa AS (SELECT symbol, n, avg(atr14) FILTER (WHERE k < 20) AS atr_then, max(size) AS size FROM fb GROUP BY symbol, n),
  fj AS (SELECT fs.*, touches, base_len_days AS days, distance_pct * 100 / 100 AS d, CASE WHEN fh.n IS NOT NULL THEN 1.15 ELSE 1 END AS rising, 1 - coalesce(atr14_10 / nullif(CASE WHEN size >= 20 THEN atr_then ELSE atr14_10 END, 0), 0) AS vcr,
      1 - coalesce(v10 / nullif(v50, 0), 0) AS vdu, coalesce(nullif((hi252 - close) / hi252 * 100, 0), 100) / 100 AS off
    FROM su JOIN fs ON fs.symbol = su.symbol AND fs.n = su.n JOIN fa ON fa.symbol = su.symbol AND fa.n = su.n LEFT JOIN fh ON fh.symbol = su.symbol AND fh.n = su.n),
  fz AS (SELECT symbol, dt, 25 * least(days / 120, 1) * CASE WHEN touches >= 5 THEN 1.05 WHEN touches = 4 THEN 1 WHEN touches = 3 THEN 0.85 WHEN touches = 2 THEN 0.7 ELSE 0.5 END * rising + 10 * greatest(least(vcr / 0.30, 1), 0) + 5 * greatest(least(vdu / 0.20, 1), 0)
      + CASE WHEN d BETWEEN -0.03 AND 0.08 THEN 20 * greatest(1 - abs(d) / 0.08, 0) ELSE 0 END + {_FIVE} + CASE WHEN off <= 0.15 THEN 15 * (1 - off / 0.15) ELSE 0 END AS score FROM fj)
  SELECT symbol, dt, {r6("score")} AS coiled_spring_score FROM fz""")  # fmt: skip
def feature_score(spark, sf_dir):
    setups, _, bars = replay_setups(spark, sf_dir)
    scored = features.make_scores(setups, described_bars(spark, sf_dir, bars, grouped=False))
    return scored.selectExpr("symbol", "dt", f"{r6('coiled_spring_score')} AS coiled_spring_score")


def last_strength(bars):
    """symbol, dt, rs_slope, rs_level at each symbol's last day with a benchmark: of its last 50 and 252 such days only."""
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("dt").desc()))
    ratio = bars.join(benchmark(bars), "dt").select("symbol", "dt", (F.col("close") / F.col("bench")).alias("rs"), age.alias("age")).filter("age <= 252")
    in_50 = lambda x: F.when(F.col("age") <= 50, x)
    slope_50 = F.when(F.count_if(F.col("age") <= 50) == 50, F.regr_slope(in_50(F.col("rs")), in_50(-F.col("age"))))
    return ratio.groupBy("symbol").agg(F.max("dt").alias("dt"), slope_50.alias("rs_slope"), ((F.max_by("rs", "dt") / F.avg("rs") - 1) * 100).alias("rs_level"))


def scanner_rows(spark, sf_dir):
    """Scanner rows at the last bar with score, patterns, risk plan and drop_reason; null reason: on the list."""
    figures = ["close", "ma50", "ma200", "ma50_s20", "ma200_s20", "atr14_10", "v10", "v50", "hi252", "h15max", "max_move5", "rng", "atr20"]
    # written once, as each of the steps below reads them
    ind = storage.written(with_indicators(walk_bars(spark, sf_dir)).select("symbol", "n", "bars_total", "dt", "high", "low", "atr14", "pivot3", *figures), "scanned")
    setups = storage.written(detect.detect(ind, F.expr("n = bars_total"), detect.SCANNER), "setups")
    rising = last_strength(ind.select("symbol", "dt", "close"))
    base = storage.written(detect.base_slice(setups, ind.select("symbol", "n", "dt", "high", "low", "close", "atr14")), "bases")
    last = ind.filter("n = bars_total").select("symbol", "n", *figures)
    recent = ind.filter("n > bars_total - 50").groupBy("symbol").agg(F.max("high").alias("h50max"))
    j = last.join(recent, "symbol").join(setups, ["symbol", "n"], "left").join(rising, ["symbol", "dt"], "left").join(detect.base_features(base).drop("dt", "r"), ["symbol", "n"], "left")
    j = j.join(detect.contractions(base), ["symbol", "n"], "left").join(detect.double_bottoms(base).withColumn("w", F.lit(True)), ["symbol", "n"], "left")
    up = (F.col("close") > F.col("ma50")) & (F.col("ma50") > F.col("ma200")) & (F.col("ma50_s20") > 0)
    score = detect.scanner_score(
        F.col("touches"), F.col("base_len_days"), F.col("higher_lows"), up & F.col("base_len_days").between(30, 99), 1 - F.try_divide("atr14_10", "atr_then"), 1 - F.try_divide("v10", "v50"), F.col("distance_pct"),
        F.col("close") > F.col("ma50"), F.col("close") > F.col("ma200"), (F.col("ma50_s20") > 0) & (F.col("ma200_s20") > 0), F.col("rs_level"), F.col("rs_slope"), (F.col("hi252") - F.col("close")) / F.col("hi252"),
    )
    gates = [
        ("insufficient_history", F.col("n") < 100), ("stage2:below_ma50", F.coalesce(F.col("close") <= F.col("ma50"), F.lit(True))), ("extended_entry", (F.col("max_move5") > 0.05) | (F.col("rng") > 2.5 * F.col("atr20"))), ("no_resistance", F.col("r").isNull()),
        ("recent_failed_bo", (F.col("h15max") > 1.03 * F.col("r")) & (F.col("close") < 0.98 * F.col("r"))), ("r_test:no_recent_test", F.col("h50max") < 0.96 * F.col("r")), ("base_too_wide", F.col("range_pct") > 0.40), ("rs_not_rising_50d", ~F.coalesce(F.col("rs_slope") > 0, F.lit(False))),
    ]
    label = F.coalesce(F.when(F.col("touches") >= 2, "multi_touch"), F.when(F.col("vcp") >= 2, "vcp"), F.when(F.col("w"), "w_pattern"), F.when(F.col("cup_handle"), "cup_handle"), F.lit(""))
    return j.select("symbol", first_failure(gates).alias("drop_reason"), "r", "touches", "base_len_days", "distance_pct", F.when(F.col("r").isNotNull(), score).alias("score"), F.when(F.col("r").isNotNull(), label).alias("pattern"))


_W = lambda k: f"(PARTITION BY symbol ORDER BY k ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
_SCAN = f"""WITH RECURSIVE {_SCANNED}, {_BENCH_SQL},
  sl AS MATERIALIZED (SELECT i.symbol, i.high AS h, i.low AS l, i.close AS c, i.atr14, r, count(*) OVER (PARTITION BY i.symbol) AS size, row_number() OVER (PARTITION BY i.symbol ORDER BY i.dt) - 1 AS k
    FROM su JOIN ind i ON i.symbol = su.symbol AND i.dt BETWEEN su.base_start AND su.dt),
  sg AS (SELECT symbol, max(size) AS size, (max(h) - min(l)) / max(r) AS range_pct, max(r) AS r, arg_max(c, k) AS c, avg(atr14) FILTER (WHERE k < 20) AS atr_then, max(h) FILTER (WHERE size - k > 5) AS cup_top,
    min(l) FILTER (WHERE size - k > 5) AS cup_low, min(l) FILTER (WHERE size - k <= 15) AS handle, min(l) FILTER (WHERE k // greatest(1, (size - 5) // 3) = 1) AS mid FROM sl GROUP BY symbol),
  lw AS (SELECT symbol, l, row_number() OVER (PARTITION BY symbol ORDER BY k) AS j FROM (SELECT *, min(l) OVER {_W(5)} AS best, count(*) OVER {_W(5)} AS z FROM sl WHERE size >= 30) WHERE l = best AND z = 11),
  hw AS (SELECT symbol FROM lw GROUP BY symbol HAVING count(*) >= 5 AND regr_slope(l, j) > 0),
  pk AS (SELECT symbol, k, h, row_number() OVER (PARTITION BY symbol ORDER BY k) AS j FROM (SELECT *, max(h) OVER {_W(5)} AS best, count(*) OVER {_W(5)} AS z FROM sl WHERE size >= 30) WHERE h = best AND z = 11),
  pu AS (SELECT a.symbol, a.j, (a.h - min(s.l)) / a.h AS pull FROM pk a JOIN pk b ON b.symbol = a.symbol AND b.j = a.j + 1 JOIN sl s ON s.symbol = a.symbol AND s.k BETWEEN a.k AND b.k GROUP BY a.symbol, a.j, a.h),
  vc AS (SELECT symbol FROM (SELECT symbol, pull < 0.85 * lag(pull) OVER (PARTITION BY symbol ORDER BY j) AND pull < 0.15 AS ok FROM pu) GROUP BY symbol HAVING count(*) FILTER (WHERE ok) >= 2),
  l9 AS (SELECT symbol, k, l FROM (SELECT *, min(l) OVER {_W(4)} AS best, count(*) OVER {_W(4)} AS z FROM sl WHERE size >= 25) WHERE l = best AND z = 9),
  wq AS (SELECT a.symbol, a.k AS k1, b.k AS k2, least(a.l, b.l) AS lo, max(s.h) AS peak FROM l9 a JOIN l9 b ON b.symbol = a.symbol AND b.k - a.k >= 5 AND (greatest(a.l, b.l) - least(a.l, b.l)) / least(a.l, b.l) <= 0.04
    JOIN sl s ON s.symbol = a.symbol AND s.k > a.k AND s.k < b.k GROUP BY ALL),
  wp AS (SELECT DISTINCT symbol FROM wq JOIN sg USING (symbol) WHERE (peak - lo) / lo >= 0.05 AND (c >= 0.97 * peak OR (r - c) / c BETWEEN -0.05 AND 0.04)),
  ch AS (SELECT symbol FROM sg WHERE size >= 50 AND (cup_top - cup_low) / cup_top BETWEEN 0.12 AND 0.40 AND mid <= cup_low * 1.05 AND (cup_top - handle) / cup_top <= (cup_top - cup_low) / cup_top * 0.5 AND abs(r - c) / c <= 0.08),
  rt AS (SELECT x.symbol, x.dt, close / bench AS rs, row_number() OVER (PARTITION BY x.symbol ORDER BY x.dt) AS i FROM bars x JOIN b USING (dt)),
  ri AS (SELECT symbol, dt, CASE WHEN count(*) OVER {frame(50)} = 50 THEN regr_slope(rs, i) OVER {frame(50)} END AS rs_slope, (rs / avg(rs) OVER {frame(252)} - 1) * 100 AS rs_level FROM rt),
  sj AS (SELECT i.*, su.r, touches, base_len_days AS days, distance_pct AS dist, rs_slope, rs_level, range_pct, 1 - atr14_10 / nullif(atr_then, 0) AS vcr, 1 - v10 / nullif(v50, 0) AS vdu, (hi252 - i.close) / hi252 AS off,
      i.symbol IN (FROM hw) AS rising_lows, i.symbol IN (FROM vc) AS vcp, i.symbol IN (FROM wp) AS w, i.symbol IN (FROM ch) AS cup, (SELECT max(q.high) FROM ind q WHERE q.symbol = i.symbol AND q.n > i.n - 50) AS h50
    FROM ind i LEFT JOIN su ON su.symbol = i.symbol LEFT JOIN ri ON ri.symbol = i.symbol AND ri.dt = i.dt LEFT JOIN sg ON sg.symbol = i.symbol WHERE i.n = i.bars_total),
  sb AS (SELECT *, 25 * least(days / 120, 1) * CASE WHEN touches >= 5 THEN 1 ELSE least(0.75 + 0.075 * (touches - 2), 1) END AS base FROM sj),
  sr AS (SELECT symbol, r, touches, days AS base_len_days, dist AS distance_pct,
      CASE WHEN n < 100 THEN 'insufficient_history' WHEN close > ma50 IS NOT TRUE THEN 'stage2:below_ma50' WHEN max_move5 > 0.05 OR rng > 2.5 * atr20 THEN 'extended_entry' WHEN r IS NULL THEN 'no_resistance' WHEN h15max > 1.03 * r AND close < 0.98 * r THEN 'recent_failed_bo'
        WHEN h50 < 0.96 * r THEN 'r_test:no_recent_test' WHEN range_pct > 0.40 THEN 'base_too_wide' WHEN rs_slope > 0 IS NOT TRUE THEN 'rs_not_rising_50d' END AS drop_reason,
      CASE WHEN r IS NOT NULL THEN round(greatest(CASE WHEN rising_lows THEN least(base * 1.15, 25) ELSE base END, CASE WHEN close > ma50 AND ma50 > ma200 AND ma50_s20 > 0 AND days BETWEEN 30 AND 99 THEN 16 ELSE 0 END)
        + 10 * greatest(least(vcr / 0.30, 1), 0) + 5 * greatest(least(vdu / 0.20, 1), 0) + CASE WHEN dist BETWEEN -0.05 AND 0.04 THEN 20 * greatest(1 - abs(dist) / 0.04, 0) ELSE 0 END
        + 5 * (coalesce(CAST(close > ma50 AS INTEGER), 0) + coalesce(CAST(close > ma200 AS INTEGER), 0) + coalesce(CAST(ma50_s20 > 0 AND ma200_s20 > 0 AS INTEGER), 0) + coalesce(CAST(rs_level > 0 AS INTEGER), 0) + coalesce(CAST(rs_slope > 0 AS INTEGER), 0))
        + CASE WHEN off <= 0.15 THEN 15 * (1 - off / 0.15) ELSE 0 END, 2) END AS score,
      CASE WHEN r IS NOT NULL THEN CASE WHEN touches >= 2 THEN 'multi_touch' WHEN vcp THEN 'vcp' WHEN w THEN 'w_pattern' WHEN cup THEN 'cup_handle' ELSE '' END END AS pattern FROM sb)"""


@query("f25_scanner_score", f"{_SCAN} SELECT symbol, score, pattern FROM sr WHERE score IS NOT NULL")
def scanner_score(spark, sf_dir):
    return scanner_rows(spark, sf_dir).filter("score is not null").select("symbol", "score", "pattern")


@query("p25_min_score", f"{_SCAN} SELECT symbol, drop_reason, {r6('r')} AS r, touches, base_len_days, {r6('distance_pct')} AS distance_pct, score, pattern FROM sr WHERE drop_reason IS NULL AND score >= 40")
def min_score(spark, sf_dir):
    return shown(scanner_rows(spark, sf_dir).filter("drop_reason is null and score >= 40"))


@query("p24_rs_gate", f"{_SCAN} SELECT coalesce(drop_reason, 'pass') AS drop_reason, count(*) AS n FROM sr GROUP BY 1")
def rs_gate(spark, sf_dir):
    return funnel(scanner_rows(spark, sf_dir))


@query("a15_fundamental_ranks", f"WITH {_FUND} SELECT symbol, {r6('CASE WHEN market_cap IS NOT NULL THEN (rank() OVER (PARTITION BY sector, market_cap IS NULL ORDER BY market_cap) + (count(*) OVER (PARTITION BY sector, market_cap) - 1) / 2.0) / CAST(count(market_cap) OVER (PARTITION BY sector) AS DOUBLE) END')} AS cap_rank FROM f")
def fundamental_ranks(spark, sf_dir):
    return fundamentals(spark, sf_dir).select("symbol", F.round(percentile_rank("market_cap", ["sector"]) + 1e-9, 6).alias("cap_rank"))

"""SQL of the cohort's figures, written apart from the indicator expressions: recursion and sums up to the last bar."""

from .window_sql import _DN, _N, _UP


def _last(agg: str, k: int) -> str:
    """Aggregate over the last k bars, null if there are fewer."""
    return f"CASE WHEN total >= {k} THEN {agg} FILTER (WHERE n > total - {k}) END"


_TAGS = {
    "base_breakout": "base_len_5pct >= 40 AND vol_x_avg20 >= 3", "momentum_run": "consec_up_days >= 4", "gap_up": "gap_pct >= 4", "hammer_reversal": "lower_wick_pct >= 50 AND body_pct_range >= 25",
    "marubozu_strong": "body_pct_range >= 70 AND upper_wick_pct <= 10", "new_52w_high": "is_52w_high", "vol_thrust": "vol_x_avg20 >= 5 AND pct_chg_actual >= 5", "rsi_overbought_entry": "rsi14 >= 70",
    "near_pivot_breakout": "dist_52w_high_pct BETWEEN -3 AND 0 AND base_len_5pct >= 20",
}
_PCT = "round((close / {} - 1) * 100, 2)"

COHORT = f"""WITH RECURSIVE {_N},
  e AS (SELECT symbol, n, tr AS a, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS w, close AS e9, close AS e21 FROM m WHERE n = 1
    UNION ALL SELECT m.symbol, m.n, e.a + (m.tr - e.a) / 14, CASE WHEN m.n = 2 THEN {_UP} ELSE e.u + ({_UP} - e.u) / 14 END, CASE WHEN m.n = 2 THEN {_DN} ELSE e.w + ({_DN} - e.w) / 14 END,
      e.e9 + (m.close - e.e9) * 0.2, e.e21 + (m.close - e.e21) / 11.0 FROM e JOIN m ON m.symbol = e.symbol AND m.n = e.n + 1),
  l AS (SELECT symbol, max(n) AS total, arg_max(close, n) AS today FROM m GROUP BY symbol),
  g AS (SELECT symbol, total, today, {_last("avg(close)", 20)} AS s20, {_last("avg(close)", 50)} AS s50, {_last("avg(close)", 200)} AS s200, {_last("stddev_samp(close)", 20)} AS sd, {_last("avg(volume)", 20)} AS v20, {_last("avg(volume)", 50)} AS v50,
      max(close) FILTER (WHERE n > total - 252) AS top, min(close) FILTER (WHERE n > total - 252) AS bottom, {", ".join(f"max(close) FILTER (WHERE n = total - {k} AND total > {k + 1}) AS c{k}" for k in (5, 20, 60))},
      least(total - coalesce(max(n) FILTER (WHERE d <= 0 OR d IS NULL), 0), 15) AS run, coalesce(total - 1 - max(n) FILTER (WHERE close > today * 1.05), least(total - 1, 250)) AS base_length
    FROM m JOIN l USING (symbol) GROUP BY symbol, total, today),
  f AS (SELECT m.symbol, m.n AS bars, m.dt AS last_date, round(close, 4) AS close, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, CAST(volume AS BIGINT) AS volume, {_PCT.format("pc")} AS pct_chg_actual,
      round((open / pc - 1) * 100, 2) AS gap_pct, round(abs(close - open) / greatest(high - low, 1e-9) * 100, 1) AS body_pct_range, round((high - greatest(close, open)) / greatest(high - low, 1e-9) * 100, 1) AS upper_wick_pct,
      round((least(close, open) - low) / greatest(high - low, 1e-9) * 100, 1) AS lower_wick_pct, round(volume / CASE WHEN v20 < 1 THEN 1 ELSE v20 END, 2) AS vol_x_avg20, round(volume / CASE WHEN v50 < 1 THEN 1 ELSE v50 END, 2) AS vol_x_avg50,
      round(100 - 100 / (1 + u / nullif(w, 0)), 1) AS rsi14, round(a / close * 100, 2) AS atr14_pct, close > s20 AS above_sma20, close > s50 AS above_sma50, close > s200 AS above_sma200, e9 > e21 AND close > e9 AS ema_stack_bull,
      round((close - (s20 - 2 * sd)) / greatest(4 * sd, 1e-9), 2) AS bb_position, {_PCT.format("top")} AS dist_52w_high_pct, {_PCT.format("bottom")} AS dist_52w_low_pct, {", ".join(f"{_PCT.format(f'c{k}')} AS ret_{k}d_pct" for k in (5, 20, 60))},
      CAST(run AS INTEGER) AS consec_up_days, base_length AS base_len_5pct, close >= top * 0.999 AS is_52w_high, round(v20 / 1e5, 2) AS vol_avg20_lakhs
    FROM g JOIN m ON m.symbol = g.symbol AND m.n = g.total JOIN e ON e.symbol = g.symbol AND e.n = g.total WHERE total >= 30),
  t AS (SELECT *, coalesce(nullif(concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in _TAGS.items())}), ''), 'none') AS tags FROM f)
  SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN 'BE' ELSE 'EQ' END AS series, CAST(s_nationkey AS DOUBLE) AS csv_pct_chg, s_nationkey % 4 * 5 AS csv_band_pct, CAST(s_acctbal AS DOUBLE) AS csv_value_cr,
    CASE WHEN t.symbol IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status, CAST(coalesce(l.total, 0) AS INTEGER) AS bars, t.* EXCLUDE (symbol, bars) FROM supplier LEFT JOIN t ON t.symbol = s_suppkey LEFT JOIN l ON l.symbol = s_suppkey"""

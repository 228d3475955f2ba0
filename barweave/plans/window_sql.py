"""SQL of window queries written apart from the indicator expressions: recursion, lists and joins in place of frames."""

from .registry import r6

#: Bars with their number, true range and moves.
_N = """b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n FROM bars),
  m AS MATERIALIZED (SELECT x.symbol, x.dt, x.n, x.open, x.high, x.low, x.close, x.volume, p.close AS pc, x.close - p.close AS d,
    CASE WHEN p.close IS NULL THEN x.high - x.low ELSE greatest(x.high, p.close) - least(x.low, p.close) END AS tr,
    p.high AS ph, p.low AS pl FROM b x LEFT JOIN b p ON p.symbol = x.symbol AND p.n = x.n - 1)"""


def _recursive(start: str, step: str, columns: str, out: str) -> str:
    return f"""WITH RECURSIVE {_N}, e AS (SELECT symbol, dt, n, {start} FROM m WHERE n = 1
      UNION ALL SELECT m.symbol, m.dt, m.n, {step} FROM e JOIN m ON m.symbol = e.symbol AND m.n = e.n + 1)
      SELECT symbol, dt, {out} FROM (SELECT symbol, dt, n, {columns} FROM e)"""


def _mean(x: str, k: int) -> str:
    """Mean of the last k values as a list, null until there are k."""
    return f"(SELECT CASE WHEN count({x}) = {k} THEN avg({x}) END FROM m q WHERE q.symbol = m.symbol AND q.n BETWEEN m.n - {k - 1} AND m.n)"


def _pivot(side: str, best: str, k: int, strict: str = "=") -> str:
    return f"(SELECT count(*) = {2 * k + 1} AND bool_and(m.{side} {strict} q.{side}) FROM m q WHERE q.symbol = m.symbol AND q.n BETWEEN m.n - {k} AND m.n + {k})"


_UP, _DN = "greatest(m.d, 0)", "greatest(-m.d, 0)"
SQL = {
    "w06_true_range_atr": f"WITH {_N} SELECT symbol, dt, {r6('tr')} AS tr, {r6(_mean('tr', 14))} AS atr14, {r6(_mean('tr', 20))} AS atr20 FROM m",
    "w07_wilder_smoothing": _recursive(
        "tr AS a, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS w", f"e.a + (m.tr - e.a) / 14, CASE WHEN m.n = 2 THEN {_UP} ELSE e.u + ({_UP} - e.u) / 14 END, CASE WHEN m.n = 2 THEN {_DN} ELSE e.w + ({_DN} - e.w) / 14 END",
        "a, 100 - 100 / (1 + u / nullif(w, 0)) AS r", f"{r6('a')} AS watr14, {r6('r')} AS wrsi14",
    ),
    "w08_rsi": f"WITH {_N}, z AS (SELECT symbol, dt, {_mean('(CASE WHEN q.d > 0 THEN q.d ELSE q.d * 0 END)', 14)} AS u, {_mean('(CASE WHEN q.d < 0 THEN -q.d ELSE q.d * 0 END)', 14)} AS w FROM m) SELECT symbol, dt, {r6('100 - 100 / (1 + u / nullif(w, 0))')} AS rsi14 FROM z",
    "w12_centred_min": f"WITH {_N} SELECT symbol, dt, CAST({_pivot('low', 'min', 5, '<=')} AS INTEGER) AS is_swing FROM m",
    "w13_fractal_pivot": f"WITH {_N} SELECT symbol, dt, CAST({_pivot('high', 'max', 3, '>=')} AS INTEGER) AS pivot_k3, CAST({_pivot('high', 'max', 8, '>=')} AS INTEGER) AS pivot_k8 FROM m",
    "w14_swing_low": f"WITH {_N} SELECT symbol, dt, CAST({_pivot('low', 'min', 3, '<=')} AS INTEGER) AS swing FROM m",
    "w16_ema_normalised": _recursive(
        ", ".join(f"close AS s{k}, CAST(1 AS DOUBLE) AS c{k}" for k in (20, 50, 200)), ", ".join(f"m.close + e.s{k} * {k - 1} / {k + 1}.0, 1 + e.c{k} * {k - 1} / {k + 1}.0" for k in (20, 50, 200)),
        ", ".join(f"s{k} / c{k} AS v{k}" for k in (20, 50, 200)), ", ".join(f"{r6(f'v{k}')} AS ema{k}" for k in (20, 50, 200)),
    ),
    "w17_ema_recursive": _recursive("close AS p, close AS q", "e.p + (m.close - e.p) * 0.2, e.q + (m.close - e.q) / 11.0", "p, q", f"{r6('p')} AS ema9r, {r6('q')} AS ema21r"),
    "w22_rolling_extremes": f"""WITH {_N} SELECT symbol, dt, {', '.join(f"{r6(f'(SELECT {f}({x}) FROM m q WHERE q.symbol = m.symbol AND q.n BETWEEN m.n - {k - 1} AND m.n)')} AS {a}" for a, f, x, k in (('hi252', 'max', 'q.high', 252), ('lo252', 'min', 'q.low', 252), ('c50max', 'max', 'q.close', 50), ('c100max', 'max', 'q.close', 100)))} FROM m""",
}

"""SQL of the resistance detectors: the greedy clusters are grown by recursion, one pivot a step, highest first."""

from __future__ import annotations

from ..operators.detect import Setup


def setups_sql(asofs: str, p: Setup) -> str:
    """Common table expressions up to ``su``, the setups of the as-of bars (symbol, n, dt, close) that the select
    ``asofs`` gives; ``ind`` must be there. They need WITH RECURSIVE."""
    recent = f"dt - p_dt <= {p.base_most}" if p.base_most else "true"
    cut = f"dt - start > {p.base_most}" if p.base_most else "false"
    high = f"AND abs(r - top) / top * 100 <= {p.off_high}" if p.off_high is not None else ""
    days = "CAST(dt - base_start AS INTEGER)"
    order = f"touches DESC, {days} DESC, abs(dist)" if p.scanner else "r >= 0.98 * top DESC, touches DESC, abs(dist)"
    strong = "r > first_r * 1.02 AND touches >= greatest(2, floor(first_touches * 0.8)) AND len >= floor(first_len * 0.8)" if p.scanner else "false"
    return f"""
  pv AS MATERIALIZED (SELECT x.symbol, x.n AS i, x.dt AS p_dt, x.high FROM ind x JOIN ind y ON y.symbol = x.symbol AND y.n BETWEEN x.n - 3 AND x.n + 3 GROUP BY ALL HAVING count(*) = 7 AND max(y.high) = x.high),
  ev AS (SELECT a.*, (SELECT max(high) FROM ind i WHERE i.symbol = a.symbol AND i.n BETWEEN a.n - {p.lookback - 1} AND a.n) AS top FROM ({asofs}) a WHERE n >= {p.base_days + 20}),
  nr AS MATERIALIZED (SELECT e.*, p_dt, high, row_number() OVER (PARTITION BY e.symbol, e.n ORDER BY high DESC, p_dt) AS j, count(*) OVER (PARTITION BY e.symbol, e.n) AS m
    FROM ev e JOIN pv ON pv.symbol = e.symbol AND pv.i BETWEEN e.n - {p.lookback - 4} AND e.n - 3),
  cl AS (SELECT symbol, n, j, m, [struct_pack(total := high, cnt := 1)] AS st FROM nr WHERE j = 1 AND m >= {p.touches}
    UNION ALL
    SELECT symbol, n, j, m, CASE WHEN place > 0 THEN list_transform(st, lambda c, k: CASE WHEN k = place THEN struct_pack(total := c.total + high, cnt := c.cnt + 1) ELSE c END)
        ELSE list_append(st, struct_pack(total := high, cnt := 1)) END
    FROM (SELECT nr.symbol, nr.n, nr.j, nr.m, st, high, coalesce(list_position(list_transform(st, lambda c: abs(high - c.total / c.cnt) / (c.total / c.cnt) <= {p.band}), true), 0) AS place
      FROM cl JOIN nr ON nr.symbol = cl.symbol AND nr.n = cl.n AND nr.j = cl.j + 1)),
  lv AS (SELECT symbol, n, unnest(list_transform(st, lambda c, k: struct_pack(k := k, r := c.total / c.cnt, cnt := c.cnt)), max_depth := 2) FROM cl WHERE j = m),
  ct AS (SELECT symbol, n, k, r, cnt, dt, close, top, (r - close) / close AS dist, count(*) AS touches, min(p_dt) AS start, count(*) FILTER (WHERE {recent}) AS recent, min(p_dt) FILTER (WHERE {recent}) AS kept
    FROM lv JOIN nr USING (symbol, n) WHERE abs(high - r) / r <= {p.band} GROUP BY ALL),
  ok AS (SELECT *, CASE WHEN {cut} THEN kept ELSE start END AS base_start FROM ct
    WHERE cnt >= {p.touches} AND touches >= {p.touches} AND dist BETWEEN {p.nearest} AND {p.farthest} AND dt - start >= {p.base_days} AND (NOT ({cut}) OR recent >= {p.touches}) {high}),
  rk AS (SELECT *, {days} AS len, row_number() OVER (PARTITION BY symbol, n ORDER BY {order}, r DESC) AS place FROM ok),
  rf AS (SELECT a.*, b.r AS first_r, b.touches AS first_touches, b.len AS first_len FROM rk a JOIN rk b ON b.symbol = a.symbol AND b.n = a.n AND b.place = 1),
  su AS (SELECT symbol, n, dt, r, CAST(touches AS INTEGER) AS touches, base_start, len AS base_len_days, dist AS distance_pct, r >= 0.98 * top AS is_high FROM rf
    QUALIFY row_number() OVER (PARTITION BY symbol, n ORDER BY CASE WHEN {strong} THEN -r ELSE 0 END, place) = 1)"""

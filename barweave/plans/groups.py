"""Group index, rotation and membership queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups
from ..sources import storage
from ..sources.fixtures import membership, walk_bars
from .registry import query, r6
from .windows import _BENCH_SQL, benchmark

_INDEX = """mem AS (SELECT DISTINCT symbol, 'G' || (symbol % 5) AS grp FROM bars),
  rr AS (SELECT symbol, dt, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS ret, count(*) OVER (PARTITION BY symbol) AS k FROM bars),
  us AS (SELECT grp, count(*) AS members FROM mem WHERE symbol IN (SELECT symbol FROM rr WHERE k >= 250) GROUP BY grp HAVING count(*) >= 2),
  dy AS (SELECT grp, dt, sum(coalesce(ret, 0)) AS total FROM rr JOIN mem USING (symbol) WHERE k >= 250 GROUP BY grp, dt),
  idx AS (SELECT grp, dt, product(1 + total / members) OVER (PARTITION BY grp ORDER BY dt ROWS UNBOUNDED PRECEDING) * 100 AS level FROM dy JOIN us USING (grp))"""
_H = groups.HORIZONS
_RETS = ", ".join(f"(level / nullif(lag(level, {d}) OVER w, 0) - 1) * 100 AS r_{k}" for k, d in _H.items())
_FLAGS = ", ".join(f"CASE WHEN count(level) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN CAST(level > avg(level) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) END AS above_{n}dma" for n in (50, 200))
_FLAGS = _FLAGS.replace("(w ROWS", "(PARTITION BY label, grp ORDER BY dt ROWS")
_SCORE = " + ".join(f"{groups.MOMENTUM_WEIGHTS[k]} * coalesce((rs_{k} - avg(rs_{k}) OVER (PARTITION BY label)) / nullif(stddev_samp(rs_{k}) OVER (PARTITION BY label), 0), 0)" for k in _H)
_ROTATION = f"""{_BENCH_SQL}, {_INDEX},
  sn AS (SELECT label, max(dt) - days AS until FROM idx, (VALUES ('now', 0), ('5d', 10), ('20d', 40)) v(label, days) GROUP BY label, days),
  g1 AS (SELECT label, grp, dt, count(*) OVER (PARTITION BY label, grp) AS k, row_number() OVER (PARTITION BY label, grp ORDER BY dt DESC) AS last, {_RETS}, {_FLAGS} FROM idx JOIN sn ON dt <= until WINDOW w AS (PARTITION BY label, grp ORDER BY dt)),
  b1 AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY dt DESC) AS last, {_RETS.replace("level", "bench").replace("AS r_", "AS b_")} FROM b JOIN sn ON dt <= until WINDOW w AS (PARTITION BY label ORDER BY dt)),
  g2 AS (SELECT g1.*, {", ".join(f"r_{k} - b_{k} AS rs_{k}" for k in _H)} FROM g1 JOIN b1 ON g1.label = b1.label AND g1.last = 1 AND b1.last = 1 AND k >= 260),
  g3 AS (SELECT *, {_SCORE} AS mom_score FROM g2),
  g4 AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY round(mom_score, 9) DESC) AS rank FROM g3),
  br0 AS (SELECT symbol, close, avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS 49 PRECEDING) AS m50, avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS 199 PRECEDING) AS m200,
     row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n, count(*) OVER (PARTITION BY symbol) AS total FROM bars),
  br AS (SELECT grp, CASE WHEN count(*) >= 5 THEN avg(CAST(close > m50 AS DOUBLE)) * 100 END AS breadth_above_50dma, CASE WHEN count(*) >= 5 THEN avg(CAST(close > m200 AS DOUBLE)) * 100 END AS breadth_above_200dma
     FROM br0 JOIN mem USING (symbol) WHERE n = total AND n >= 200 GROUP BY grp),
  rot AS (SELECT a.*, p.rank - a.rank AS rank_chg_5d, q.rank - a.rank AS rank_chg_20d, breadth_above_50dma, breadth_above_200dma FROM g4 a LEFT JOIN g4 p ON p.label = '5d' AND p.grp = a.grp LEFT JOIN g4 q ON q.label = '20d' AND q.grp = a.grp LEFT JOIN br ON br.grp = a.grp WHERE a.label = 'now')"""
_NUMBERS = [*[f"r_{k}" for k in _H], "above_50dma", "above_200dma", *[f"rs_{k}" for k in _H], "mom_score", "breadth_above_50dma", "breadth_above_200dma"]
_OUT = f"grp, CAST(rank AS BIGINT) AS rank, CAST(rank_chg_5d AS BIGINT) AS rank_chg_5d, CAST(rank_chg_20d AS BIGINT) AS rank_chg_20d, {', '.join(f'{r6(c)} AS {c}' for c in _NUMBERS)}"


def _index(spark, sf_dir):
    bars = walk_bars(spark, sf_dir)
    members = membership(bars)
    return bars, members, groups.group_index(bars, members, min_members=2)


def _stored(spark, sf_dir):
    """Bars, members and index, the first and the last written once: a snapshot reads both several times."""
    bars = storage.written(walk_bars(spark, sf_dir), "bars")
    members = membership(bars)
    return bars, members, storage.written(groups.group_index(bars, members, min_members=2), "index")


def _bench(bars):
    return benchmark(bars).withColumnRenamed("bench", "level")


def _rotation(spark, sf_dir):
    bars, members, index = _stored(spark, sf_dir)
    return groups.rotation(bars, index, _bench(bars), members), members, bars


@query("c10_group_index", f"WITH {_INDEX} SELECT grp, dt, {r6('level')} AS level FROM idx")
def group_index(spark, sf_dir):
    return _index(spark, sf_dir)[2].selectExpr("grp", "dt", f"{r6('level')} AS level")


@query("c11_rotation_core", f"WITH {_ROTATION} SELECT label, grp, CAST(rank AS BIGINT) AS rank, {r6('mom_score')} AS mom_score FROM g4")
def rotation_core(spark, sf_dir):
    bars, _, index = _stored(spark, sf_dir)
    core = groups.rotation_core(index, _bench(bars), groups.snapshot_dates(index))
    return core.selectExpr("label", "grp", "CAST(rank AS BIGINT) AS rank", f"{r6('mom_score')} AS mom_score")


@query("c12_rotation_snapshot", f"WITH {_ROTATION} SELECT {_OUT} FROM rot")
def rotation_snapshot(spark, sf_dir):
    return _rotation(spark, sf_dir)[0].selectExpr(*_out())


def _out() -> list[str]:
    return ["grp", *[f"CAST({c} AS BIGINT) AS {c}" for c in ("rank", "rank_chg_5d", "rank_chg_20d")], *[f"{r6(c)} AS {c}" for c in _NUMBERS]]


@query("o03_leaderboard", f"""WITH {_ROTATION}, t AS (SELECT *, 'TOP' AS section FROM rot ORDER BY rank, grp LIMIT 2), u AS (SELECT *, 'BOTTOM' AS section FROM rot ORDER BY rank DESC, grp DESC LIMIT 2)
    SELECT section, grp, CAST(rank AS BIGINT) AS rank, {r6('mom_score')} AS mom_score FROM (SELECT * FROM t UNION ALL SELECT * FROM u)""")  # fmt: skip
def leaderboard(spark, sf_dir):
    return groups.leaderboard(_rotation(spark, sf_dir)[0], 2).selectExpr("section", "grp", "CAST(rank AS BIGINT) AS rank", f"{r6('mom_score')} AS mom_score")


@query("o04_top_by_rank_change", f"WITH {_ROTATION} SELECT grp, CAST(rank_chg_5d AS BIGINT) AS rank_chg_5d FROM rot ORDER BY rank_chg_5d DESC NULLS LAST, grp LIMIT 3")
def top_by_change(spark, sf_dir):
    return _rotation(spark, sf_dir)[0].orderBy(F.col("rank_chg_5d").desc_nulls_last(), "grp").limit(3).selectExpr("grp", "CAST(rank_chg_5d AS BIGINT) AS rank_chg_5d")


@query("c13_symbol_rotation", f"""WITH {_ROTATION} SELECT m.symbol, {r6('rank')} AS rot_rank, {r6('mom_score')} AS rot_mom_score, {r6('rank_chg_5d')} AS rot_chg_5d, {r6('breadth_above_50dma')} AS rot_breadth_50,
    CAST(coalesce(CAST(rank <= 3 AS INT), 0) AS DOUBLE) AS rot_top3, CAST(coalesce(CAST(rank > (SELECT count(*) FROM rot) - 3 AS INT), 0) AS DOUBLE) AS rot_bottom3, CAST(coalesce(CAST(rank_chg_5d >= 2 AS INT), 0) AS DOUBLE) AS rot_in
    FROM mem m LEFT JOIN rot USING (grp)""")  # fmt: skip
def symbol_rotation(spark, sf_dir):
    rot, members, bars = _rotation(spark, sf_dir)
    out = groups.symbol_features(bars.select("symbol").distinct(), rot, members)
    return out.selectExpr("symbol", *[f"{r6(c)} AS {c}" for c in ("rot_rank", "rot_mom_score", "rot_chg_5d", "rot_breadth_50")], "rot_top3", "rot_bottom3", "rot_in")


@query("j07_semi_join_top_groups", f"WITH {_ROTATION} SELECT m.symbol, m.grp FROM mem m WHERE grp IN (SELECT grp FROM rot ORDER BY rank, grp LIMIT 2)")
def top_group_members(spark, sf_dir):
    rot, members, _ = _rotation(spark, sf_dir)
    return members.join(F.broadcast(rot.orderBy("rank", "grp").limit(2).select("grp")), "grp", "left_semi").select("symbol", "grp")


@query("c14_membership_first_wins", "SELECT s_suppkey AS symbol, min(theme) AS theme FROM (SELECT s_suppkey, 'T' || (s_suppkey % 3) AS theme FROM supplier UNION ALL SELECT s_suppkey, 'T' || (s_suppkey % 4) FROM supplier) GROUP BY s_suppkey")
def first_membership(spark, sf_dir):
    """A symbol in two themes belongs to the first by position."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    both = s.select(F.col("s_suppkey").alias("symbol"), F.explode(F.array(F.concat(F.lit("T"), F.col("s_suppkey") % 3), F.concat(F.lit("T"), F.col("s_suppkey") % 4))).alias("theme"))
    return both.groupBy("symbol").agg(F.min_by("theme", "theme").alias("theme"))


@query("j11_past_rank_join", f"WITH {_ROTATION} SELECT a.grp, CAST(p.rank - a.rank AS BIGINT) AS improved FROM g4 a LEFT JOIN g4 p ON a.grp = p.grp AND p.label = '20d' WHERE a.label = 'now'")
def past_rank(spark, sf_dir):
    rot = _rotation(spark, sf_dir)[0]
    return rot.selectExpr("grp", "CAST(rank_chg_20d AS BIGINT) AS improved")


@query("k02_wide_group_pivot", f"WITH {_INDEX} SELECT dt, {', '.join(f'max(CASE WHEN grp = \'G{i}\' THEN {r6("level")} END) AS g{i}' for i in range(5))} FROM idx GROUP BY dt")
def wide_groups(spark, sf_dir):
    """The long index as one column per group, for a sink that wants it wide."""
    wide = _index(spark, sf_dir)[2].selectExpr("grp", "dt", f"{r6('level')} AS level").groupBy("dt").pivot("grp", [f"G{i}" for i in range(5)]).agg(F.max("level"))
    return wide.select("dt", *[F.col(f"G{i}").alias(f"g{i}") for i in range(5)])

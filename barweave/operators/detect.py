"""Horizontal-resistance detection over pivots, as folds over small arrays.

Gates are evaluated first as window columns. Bars that pass and see the same pivots are one set: it looks up the pivots of its
block of bars and of the block before, one row each, and clusters them (a few dozen) by a fold once. The bars meet the levels
of their set, and candidates are chosen by sorting an array of structs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from .relational import first_failure


@dataclass(frozen=True)
class Setup:
    """Parameters of a detector; the second edition truncates long bases and prefers the higher level."""

    lookback: int = 750
    band: float = 0.03
    nearest: float = -0.03
    farthest: float = 0.05
    touches: int = 2
    base_days: int = 30
    base_most: int | None = None
    off_high: float | None = 12.0
    scanner: bool = False


SCANNER = Setup(lookback=252, band=0.05, nearest=-0.05, farthest=0.04, base_days=20, base_most=180, off_high=None, scanner=True)


def quality_gates(ind: DataFrame, min_turnover: float = 0.5e7, max_atr_pct: float = 6.0, max_dry_up: float = 1.2, min_rs: float = 0.0) -> DataFrame:
    """``ind`` (indicators with b, the aligned benchmark) with drop_reason: first failed gate, each skipped when history is too short."""
    w = Window.partitionBy("symbol").orderBy("dt")
    rs = (F.try_divide("close", F.lag("close", 64).over(w)) - F.try_divide("b", F.lag("b", 64).over(w))) * 100
    gates = [
        ("turnover", F.col("dv50") * 1e7 < min_turnover),
        ("atr", (F.col("n") >= 21) & (F.col("atr20") / F.col("close") * 100 > max_atr_pct)),
        ("dry_up", (F.col("n") >= 50) & (F.try_divide("v5", "v50") > max_dry_up)),
        ("trend", F.col("close") < F.col("ma50")),
        ("strength", rs < min_rs),
    ]
    return ind.withColumn("drop_reason", first_failure(gates))


def cluster_levels(levels: Column, band: float) -> Column:
    """Greedy first-fit clusters of levels sorted downwards: a level joins the first cluster whose running mean is
    within ``band`` of it, else it opens one. array<struct<level,total,cnt>>.

    Levels come down and a mean only moves when a level joins, so a cluster that refused one level refuses all that
    follow: only the last cluster can take the next level, and a step of the fold looks at that one alone."""
    kind = "struct<level:double,total:double,cnt:int>"
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("done"), F.expr(f"cast(null as {kind})").alias("last"))

    def one(level, total, cnt):
        return F.struct(level.alias("level"), total.alias("total"), cnt.alias("cnt"))

    def place(state, lvl):
        last, done = state["last"], state["done"]
        joins = F.abs(lvl - last["level"]) / last["level"] <= band
        grown = one((last["total"] + lvl) / (last["cnt"] + 1), last["total"] + lvl, last["cnt"] + 1)
        closed = F.when(last.isNull(), done).otherwise(F.concat(done, F.array(last)))
        return F.when(joins, F.struct(done.alias("done"), grown.alias("last"))).otherwise(F.struct(closed.alias("done"), one(lvl, lvl, F.lit(1)).alias("last")))

    return F.aggregate(F.sort_array(levels, asc=False), start, place, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))


def in_band(close: Column, r: Column, p: Setup) -> Column:
    """Whether a level is near enough to the close."""
    return ((r - close) / close).between(p.nearest, p.farthest)


def near_top(r: Column, window_high: Column, p: Setup) -> Column:
    """Whether a level is near enough to the highest high of the window."""
    return F.abs(r - window_high) / window_high * 100 <= p.off_high


def held(touches: Column, days: Column, p: Setup) -> Column:
    """Whether a level was touched often enough over a long enough base."""
    return (touches >= p.touches) & (days >= p.base_days)


def lookback_pivots(bars: DataFrame, lookback: int) -> DataFrame:
    """symbol, blk, near: the pivots (k, p_dt, p_high; k numbers a symbol's pivots from 1) that the bars of each block of
    ``lookback`` bars can look back to, those of the block itself and of the one before. One row per block."""
    at = F.floor(F.col("n") / lookback)
    numbered = bars.filter("pivot3").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("dt")))
    pivot = F.struct("k", F.col("dt").alias("p_dt"), F.col("high").alias("p_high"))
    p = numbered.select("symbol", F.explode(F.array(at, at + 1)).alias("blk"), pivot.alias("p"))
    return p.groupBy("symbol", "blk").agg(F.collect_list("p").alias("near"))


def level_candidates(bars: DataFrame, sets: DataFrame, p: Setup) -> DataFrame:
    """symbol, lo, hi, r, days: of each set of pivots (those numbered lo + 1 to hi, seen from block blk) the levels of enough
    pivots, with the days of all pivots within the band of the level, ascending."""
    own = sets.join(lookback_pivots(bars, p.lookback), ["symbol", "blk"])
    seen = own.select("symbol", "lo", "hi", F.explode(F.filter("near", lambda x: (x["k"] > F.col("lo")) & (x["k"] <= F.col("hi")))).alias("x"))
    pivots = seen.groupBy("symbol", "lo", "hi").agg(F.collect_list(F.struct("x.p_dt", "x.p_high")).alias("pivots"))
    level = pivots.select("symbol", "lo", "hi", "pivots", F.explode(cluster_levels(F.transform("pivots", lambda x: x["p_high"]), p.band)).alias("c")).filter(F.col("c.cnt") >= p.touches)
    r = F.col("c.level")
    hits = F.transform(F.filter("pivots", lambda x: F.abs(x["p_high"] - r) / r <= p.band), lambda x: x["p_dt"])
    return level.select("symbol", "lo", "hi", r.alias("r"), F.sort_array(hits).alias("days"))


def detect(bars: DataFrame, when: Column, p: Setup = Setup()) -> DataFrame:
    """Setups (symbol, n, dt, r, touches, base_start, base_len_days, distance_pct, is_high) of the bars for which ``when`` holds;
    ``bars`` needs symbol, n (from 1, without gaps), dt, close, high and pivot3. A bar without a setup has no row.

    Levels depend on the pivots in sight only, and bars that follow each other see the same ones until a pivot is added or drops
    out: each set of pivots is clustered once, and its bars test the levels against their own close."""
    w = Window.partitionBy("symbol").orderBy("dt")
    b = bars.withColumn("pivots_seen", F.count_if("pivot3").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hi, lo = (F.coalesce(F.lag("pivots_seen", k).over(w), F.lit(0)) for k in (3, p.lookback - 3))
    # what is tested needs the highest high of the lookback: of a few rows, then of rows that far apart, as maxima may overlap
    e = b.withColumns({"hi": hi, "lo": lo, "_h": F.max("high").over(w.rowsBetween(-_step(p.lookback) + 1, 0))})
    e = e.withColumn("window_high", F.greatest(*[F.lag("_h", k).over(w) for k in _apart(p.lookback)]))
    e = e.filter(when & (F.col("n") >= p.base_days + 20) & (F.col("hi") - F.col("lo") >= p.touches)).select("symbol", "n", "dt", "close", "window_high", "lo", "hi")
    sets = e.groupBy("symbol", "lo", "hi").agg(F.floor(F.min("n") / p.lookback).alias("blk"))
    own = e.join(level_candidates(bars, sets, p), ["symbol", "lo", "hi"]).filter(in_band(F.col("close"), F.col("r"), p))

    r, start, touches = F.col("r"), F.element_at("days", 1), F.size("days")
    dist, long = (r - F.col("close")) / F.col("close"), F.datediff("dt", start)
    ok = held(touches, long, p)
    if p.off_high is not None:
        ok = ok & near_top(r, F.col("window_high"), p)
    base = start
    if p.base_most:
        recent = F.filter("days", lambda d: F.datediff("dt", d) <= p.base_most)
        ok = ok & (~(long > p.base_most) | (F.size(recent) >= p.touches))
        base = F.when(long > p.base_most, F.element_at(recent, 1)).otherwise(start)
    length, high = F.datediff("dt", base), r >= 0.98 * F.col("window_high")
    first = [-touches, -length, F.abs(dist)] if p.scanner else [F.when(high, 0).otherwise(1), -touches, F.abs(dist)]
    fits = own.filter(ok).select("symbol", "n", "dt", F.struct(*[x.alias(f"k{i}") for i, x in enumerate(first)], (-r).alias("k3"), r.alias("r"), touches.alias("touches"), base.alias("base_start"), length.alias("base_len_days"), dist.alias("distance_pct"), high.alias("is_high")).alias("c"))
    best = fits.groupBy("symbol", "n", "dt").agg(F.collect_list("c").alias("all")).withColumn("best", F.array_min("all"))
    if p.scanner:  # the highest level that is nearly as strong as the best one
        strong = F.filter("all", lambda c: (c["r"] > F.col("best.r") * 1.02) & (c["touches"] >= F.greatest(F.lit(2), F.floor(F.col("best.touches") * 0.8))) & (c["base_len_days"] >= F.floor(F.col("best.base_len_days") * 0.8)))
        top = F.array_min(F.transform(strong, lambda c: F.struct(c["k3"].alias("k"), c.alias("c"))))
        best = best.withColumn("best", F.coalesce(top["c"], F.col("best")))
    return best.select("symbol", "n", "dt", *[F.col(f"best.{c}").alias(c) for c in ("r", "touches", "base_start", "base_len_days", "distance_pct", "is_high")])


def _step(n: int) -> int:
    """Rows of the short frames that a frame of n rows is put together from."""
    return max(1, math.isqrt(n))


def _apart(n: int) -> list[int]:
    """How many rows back the short frames end that cover a frame of n rows; the last may overlap the one before."""
    return [*range(0, n - _step(n), _step(n)), n - _step(n)]


def base_slice(setups: DataFrame, bars: DataFrame, block: int = 256) -> DataFrame:
    """Bars of each setup's base, from base_start to the as-of bar, with k (0-based position) and size. A setup meets
    only the blocks of bar numbers that its base can reach: a base has no more bars than days."""
    fields = {"n": "b_n", "dt": "b_dt", "high": "b_high", "low": "b_low", "close": "b_close", "volume": "b_volume", "atr14": "b_atr14"}
    b = bars.select("symbol", F.expr(f"n div {block}").alias("blk"), *[F.col(c).alias(a) for c, a in fields.items() if c in bars.columns])
    first = F.greatest(F.lit(0).cast("long"), F.expr(f"(n - datediff(dt, base_start)) div {block}"))
    e = setups.withColumn("blk", F.explode(F.sequence(first, F.expr(f"n div {block}"))))
    j = e.join(b, ["symbol", "blk"]).drop("blk").filter((F.col("b_dt") >= F.col("base_start")) & (F.col("b_n") <= F.col("n")))
    own = Window.partitionBy("symbol", "n")
    return j.withColumn("size", F.count("*").over(own)).withColumn("k", F.row_number().over(own.orderBy("b_n")) - 1)


def base_features(base: DataFrame) -> DataFrame:
    """Per setup: geometry, touches of the level, spring, failed breakout, cup and handle, contraction figures."""
    own = Window.partitionBy("symbol", "n")
    at = own.orderBy("k")
    low11 = (F.min("b_low").over(at.rowsBetween(-5, 5)) == F.col("b_low")) & (F.count("b_low").over(at.rowsBetween(-5, 5)) == 11)
    b = base.select(
        "*", low11.alias("swing"), F.min("b_close").over(at.rowsBetween(1, 5)).alias("next5"),
        F.min(F.when(F.col("k") < F.col("size") - 5, F.col("b_low"))).over(own).alias("low_before"),
    )
    b = b.withColumn("swing_no", F.sum(F.col("swing").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    left, third = F.col("size") - F.col("k"), F.greatest(F.lit(1), F.expr("(size - 5) div 3"))
    fail = (F.col("b_high") > F.col("r") * 1.005) & (left > 5) & (F.col("next5") < F.col("r") * 0.99)
    swing = lambda x: F.when(F.col("swing"), x)
    cup = lambda f, x: f(F.when(left > 5, x))
    g = b.groupBy("symbol", "n", "dt", "r", "size").agg(
        F.min("b_low").alias("base_low"), F.max("b_high").alias("base_high"), F.count_if(F.col("b_close").between(F.col("r") * 0.99, F.col("r") * 1.01)).alias("close_touches"),
        F.count_if(F.col("b_high") > F.col("r")).alias("pierces"), F.regr_slope("b_close", "k").alias("slope"),
        F.min(F.when(fail, left - 1)).alias("since_fail"), F.max(((left <= 15) & (F.col("b_low") < F.col("low_before")) & (F.col("b_close") > F.col("low_before"))).cast("int")).alias("spring"),
        F.count(swing(F.col("b_low"))).alias("swings"), F.regr_slope(swing(F.col("b_low")), swing(F.col("swing_no"))).alias("swing_slope"),
        F.max(F.when(left <= 25, F.col("b_high"))).alias("trail_high"), F.min(F.when(left <= 25, F.col("b_low"))).alias("trail_low"),
        cup(F.max, F.col("b_high")).alias("cup_high"), cup(F.min, F.col("b_low")).alias("cup_low"), F.min(F.when(left <= 15, F.col("b_low"))).alias("handle_low"),
        F.min(F.when((F.col("k") >= third) & (F.col("k") < 2 * third), F.col("b_low"))).alias("mid_low"), F.max_by("b_close", "k").alias("last_close"),
        *([F.avg(F.when(F.col("k") < 20, F.col("b_atr14"))).alias("atr_then")] if "b_atr14" in base.columns else []),
    )
    depth = (F.col("cup_high") - F.col("cup_low")) / F.col("cup_high")
    return g.select(
        "symbol", "n", "dt", "r", "size", "base_low", "close_touches", "pierces", "slope", "swings", "swing_slope", *(["atr_then"] if "b_atr14" in base.columns else []),
        ((F.col("r") - F.col("base_low")) / F.col("r") * 100).alias("height_pct"), F.when(F.col("size") >= 6, F.coalesce("since_fail", F.lit(999))).otherwise(999).alias("since_fail"),
        F.when(F.col("size") >= 20, F.col("spring")).otherwise(0).alias("spring"), ((F.col("base_high") - F.col("base_low")) / F.col("r")).alias("range_pct"),
        ((F.col("trail_high") - F.col("trail_low")) / F.col("r")).alias("trailing_pct"), ((F.col("size") >= 30) & (F.col("swings") >= 5) & (F.col("swing_slope") > 0)).alias("higher_lows"),
        F.coalesce((F.col("size") >= 50) & depth.between(0.12, 0.40) & (F.col("mid_low") <= F.col("cup_low") * 1.05) & ((F.col("cup_high") - F.col("handle_low")) / F.col("cup_high") <= depth * 0.5) & (F.abs(F.col("r") - F.col("last_close")) / F.col("last_close") <= 0.08), F.lit(False)).alias("cup_handle"),
    )


def contractions(base: DataFrame) -> DataFrame:
    """symbol, n, vcp: pullbacks between successive five-bar pivots that are under 85 % of the one before and under 15 %."""
    at = Window.partitionBy("symbol", "n").orderBy("k")
    piv = base.filter("size >= 30").withColumn("p", (F.col("b_high") == F.max("b_high").over(at.rowsBetween(-5, 5))) & (F.count("b_high").over(at.rowsBetween(-5, 5)) == 11))
    # the low from one pivot to the next, both included: stretches are numbered by pivots seen so far
    piv = piv.withColumn("no", F.sum(F.col("p").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    seg = piv.filter("no > 0").groupBy("symbol", "n", "no").agg(F.min("b_low").alias("low"), F.max(F.when(F.col("p"), F.col("b_high"))).alias("top"), F.max(F.when(F.col("p"), F.col("b_low"))).alias("own_low"))
    w = Window.partitionBy("symbol", "n").orderBy("no")
    nxt = F.lead("own_low").over(w)
    pull = seg.select("symbol", "n", "no", F.when(nxt.isNotNull(), (F.col("top") - F.least("low", nxt)) / F.col("top")).alias("pull"))
    tight = (F.col("pull") < F.lag("pull").over(w) * 0.85) & (F.col("pull") < 0.15)
    return pull.withColumn("t", tight).groupBy("symbol", "n").agg(F.count_if("t").alias("vcp"))


def double_bottoms(base: DataFrame, nearest: float = -0.05, farthest: float = 0.04) -> DataFrame:
    """symbol, n with a W: two four-bar pivot lows within 4 %, five bars or more apart, a peak 5 % above between them, and
    a close near that peak or near the level. Pivot lows of one base are few, so the pairs stay inside it."""
    at = Window.partitionBy("symbol", "n").orderBy("k")
    b = base.filter("size >= 25")
    lows = b.withColumn("p", (F.col("b_low") == F.min("b_low").over(at.rowsBetween(-4, 4))) & (F.count("b_low").over(at.rowsBetween(-4, 4)) == 9)).filter("p").select("symbol", "n", "k", "b_low")
    bars = b.groupBy("symbol", "n", "r").agg(F.sort_array(F.collect_list(F.struct("k", "b_high"))).alias("highs"), F.max_by("b_close", "k").alias("last"))
    first, second = lows.select("symbol", "n", F.col("k").alias("k1"), F.col("b_low").alias("l1")), lows.select("symbol", "n", F.col("k").alias("k2"), F.col("b_low").alias("l2"))
    pair = first.join(second, ["symbol", "n"]).filter("k2 - k1 >= 5 and (greatest(l1, l2) - least(l1, l2)) / least(l1, l2) <= 0.04").join(bars, ["symbol", "n"])
    peak = F.array_max(F.transform(F.slice("highs", F.col("k1") + 2, F.col("k2") - F.col("k1") - 1), lambda x: x["b_high"]))
    dist = (F.col("r") - F.col("last")) / F.col("last")
    hit = pair.withColumn("peak", peak).filter((F.col("peak") - F.least("l1", "l2")) / F.least("l1", "l2") >= 0.05).filter((F.col("last") >= F.col("peak") * 0.97) | dist.between(nearest, farthest))
    return hit.select("symbol", "n").distinct()


def risk_plan(close: Column, r: Column, base_low: Column, stop: Column) -> list[Column]:
    """entry, stop, target, risk_pct, reward_pct, rr of a measured move; rr is null without risk."""
    target = r + (r - base_low)
    risk = close - stop
    return [
        rounded(close, 2).alias("entry"), rounded(stop, 2).alias("stop"), rounded(target, 2).alias("target"), rounded(risk / close * 100, 2).alias("risk_pct"),
        rounded((target - close) / close * 100, 2).alias("reward_pct"), F.when(risk > 0, rounded(F.try_divide(target - close, risk), 2)).alias("rr"),
    ]


def scanner_score(touches: Column, days: Column, higher_lows: Column, young: Column, vcr: Column, vdu: Column, dist: Column, above50: Column, above200: Column, rising: Column, rs: Column, rs_slope: Column, off_high: Column) -> Column:
    """0-100: base 25, contraction 10, dry-up 5, proximity 20, trend 15, strength 10, high 15."""
    unit = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    base = 25 * F.least(days / 120, F.lit(1.0)) * F.when(touches >= 5, 1.0).otherwise(F.least(0.75 + 0.075 * (touches - 2), F.lit(1.0)))
    base = F.when(higher_lows, F.least(base * 1.15, F.lit(25.0))).otherwise(base)
    base = F.when(young, F.greatest(base, F.lit(16.0))).otherwise(base)
    near = F.when(dist.between(-0.05, 0.04), 20 * F.greatest(1 - F.abs(dist) / 0.04, F.lit(0.0))).otherwise(0.0)
    five = lambda c: F.when(c, 5.0).otherwise(0.0)
    high = F.when(off_high <= 0.15, 15 * (1 - off_high / 0.15)).otherwise(0.0)
    return rounded(base + 10 * unit(vcr / 0.30) + 5 * unit(vdu / 0.20) + near + five(above50) + five(above200) + five(rising) + five(rs > 0) + five(rs_slope > 0) + high, 2)


def feature_score(f: dict[str, Column]) -> Column:
    """The same idea over feature columns: higher multipliers, an uncapped boost; a value of exactly 0.0 counts as missing
    in the trend and high blocks, so a close at its high scores nothing there."""
    unit = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    zero = lambda c: F.coalesce(f[c], F.lit(0.0))
    t = zero("touches")
    base = 25 * F.least(zero("base_days") / 120, F.lit(1.0)) * F.when(t >= 5, 1.05).when(t >= 4, 1.0).when(t >= 3, 0.85).when(t >= 2, 0.7).otherwise(0.5)
    base = F.when(zero("higher_lows") > 0, base * 1.15).otherwise(base)
    d = zero("dist_pct") / 100
    near = F.when(d.between(-0.03, 0.08), 20 * F.greatest(1 - F.abs(d) / 0.08, F.lit(0.0))).otherwise(0.0)
    five = lambda c: F.when(zero(c) > 0, 5.0).otherwise(0.0)
    off = F.coalesce(F.nullif(f["dist_52w_high_pct"], F.lit(0.0)), F.lit(100.0)) / 100
    high = F.when(off <= 0.15, 15 * (1 - off / 0.15)).otherwise(0.0)
    return base + 10 * unit(zero("vcr") / 0.30) + 5 * unit(zero("vdu") / 0.20) + near + five("dist_ema50_pct") + five("dist_ema200_pct") + five("ema200_slope_20") + five("rs_mansfield") + five("rs_slope_20") + high

"""Group indices, rotation ranks and breadth: one set of functions for sectors and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = {"1m": 20, "3m": 60, "6m": 130, "12m": 260}
MOMENTUM_WEIGHTS = {"1m": 0.15, "3m": 0.40, "6m": 0.30, "12m": 0.15}


def group_index(bars: DataFrame, members: DataFrame, min_members: int = 10, min_bars: int = 250) -> DataFrame:
    """grp, dt, level: equal-weight index. A member needs ``min_bars`` bars; a day without a member's bar counts as zero
    return; the divisor is the number of usable members."""
    w = Window.partitionBy("symbol").orderBy("dt")
    rets = bars.select("symbol", "dt", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("ret"), F.count("*").over(Window.partitionBy("symbol")).alias("n")).filter(F.col("n") >= min_bars)
    daily = (
        rets.join(members, "symbol").groupBy("grp", "dt")
        .agg(F.sum(F.coalesce("ret", F.lit(0.0))).alias("total"))
    )
    usable = rets.select("symbol").distinct().join(members, "symbol").groupBy("grp").agg(F.count("*").alias("members")).filter(F.col("members") >= min_members)
    path = Window.partitionBy("grp").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return daily.join(usable, "grp").select("grp", "dt", (F.product(1 + F.col("total") / F.col("members")).over(path) * 100).alias("level"))


def rotation_core(index: DataFrame, bench: DataFrame, snapshots: DataFrame) -> DataFrame:
    """label, grp, returns, moving-average flags, relative strength, blended momentum and rank at each snapshot (label, asof)."""

    def at(series: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("dt")
        cols = [((F.try_divide("level", F.lag("level", d).over(w)) - 1) * 100).alias(f"r_{k}") for k, d in HORIZONS.items()]
        for n in (50, 200):
            f = w.rowsBetween(1 - n, 0)
            cols.append(F.when(F.count("level").over(f) == n, (F.col("level") > F.avg("level").over(f)).cast("double")).alias(f"above_{n}dma"))
        rows = series.join(F.broadcast(snapshots), series["dt"] <= snapshots["asof"]).withColumn("rows", F.count("*").over(Window.partitionBy(*keys)))
        return rows.select(*keys, "dt", "rows", *cols).withColumn("last", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("dt").desc()))).filter("last = 1").drop("last", "dt")

    groups = at(index, ["label", "grp"]).filter("rows >= 260").drop("rows")
    market = at(bench, ["label"]).select("label", *[F.col(f"r_{k}").alias(f"b_{k}") for k in HORIZONS])
    rs = groups.join(F.broadcast(market), "label").select("*", *[(F.col(f"r_{k}") - F.col(f"b_{k}")).alias(f"rs_{k}") for k in HORIZONS])
    snap = Window.partitionBy("label")
    score = sum(MOMENTUM_WEIGHTS[k] * F.coalesce(F.try_divide(F.col(f"rs_{k}") - F.avg(f"rs_{k}").over(snap), F.nullif(F.stddev_samp(f"rs_{k}").over(snap), F.lit(0.0))), F.lit(0.0)) for k in HORIZONS)
    scored = rs.withColumn("mom_score", score).drop(*[f"b_{k}" for k in HORIZONS])
    return scored.withColumn("rank", F.coalesce(F.rank().over(Window.partitionBy("label").orderBy(F.round("mom_score", 9).desc())), F.lit(-1)))


def breadth(bars: DataFrame, members: DataFrame, least: int = 5) -> DataFrame:
    """grp, share of members (with 200 bars) above their 50- and 200-bar means at their last bar; null under ``least`` members."""
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("dt").desc()))
    near = bars.select("symbol", "close", age.alias("age")).filter("age <= 200")
    last = near.groupBy("symbol").agg(
        F.max(F.when(F.col("age") == 1, F.col("close"))).alias("close"), F.avg(F.when(F.col("age") <= 50, F.col("close"))).alias("m50"), F.avg("close").alias("m200"), F.count("*").alias("n"),
    ).filter("n >= 200")
    share = lambda m: F.when(F.count("*") >= least, F.avg((F.col("close") > F.col(m)).cast("double")) * 100)
    return last.join(members, "symbol").groupBy("grp").agg(share("m50").alias("breadth_above_50dma"), share("m200").alias("breadth_above_200dma"))


def snapshot_dates(index: DataFrame) -> DataFrame:
    """label, asof: the index's last day, and 10 and 40 days before it. One row in, three out; nothing is collected."""
    last = index.agg(F.max("dt").alias("last"))
    return last.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.date_sub("last", d).alias("asof")) for k, d in (("now", 0), ("5d", 10), ("20d", 40))])).alias("s")).select("s.*")


def rotation(bars: DataFrame, index: DataFrame, bench: DataFrame, members: DataFrame) -> DataFrame:
    """The full snapshot at the index's last day: core, rank changes against 10 and 40 days earlier, breadth."""
    snapshots = snapshot_dates(index)
    core = rotation_core(index, bench, snapshots)
    past = core.groupBy("grp").agg(*[F.max(F.when(F.col("label") == k, F.col("rank"))).alias(f"past_{k}") for k in ("5d", "20d")])
    now = core.filter("label = 'now'").drop("label").join(past, "grp", "left")
    out = now.select("*", *[(F.col(f"past_{k}") - F.col("rank")).alias(f"rank_chg_{k}") for k in ("5d", "20d")]).drop("past_5d", "past_20d")
    until = F.broadcast(snapshots.filter("label = 'now'").select("asof"))  # one row
    return out.join(breadth(bars.join(until, F.col("dt") <= F.col("asof")).drop("asof"), members), "grp", "left")


def leaderboard(rot: DataFrame, n: int = 5) -> DataFrame:
    """Best and worst ``n`` groups, tagged TOP and BOTTOM."""
    top = rot.orderBy("rank", "grp").limit(n).withColumn("section", F.lit("TOP"))
    return top.unionByName(rot.orderBy(F.col("rank").desc(), F.col("grp").desc()).limit(n).withColumn("section", F.lit("BOTTOM")))


def symbol_features(symbols: DataFrame, rot: DataFrame, members: DataFrame) -> DataFrame:
    """Rotation figures of each symbol's group; flags are 0 without a group."""
    ranked = rot.withColumn("groups", F.count("*").over(Window.partitionBy()))  # one row per group
    j = symbols.join(members, "symbol", "left").join(F.broadcast(ranked), "grp", "left")
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return j.select(
        "symbol", F.col("rank").cast("double").alias("rot_rank"), F.col("mom_score").alias("rot_mom_score"), F.col("rank_chg_5d").cast("double").alias("rot_chg_5d"), F.col("rank_chg_20d").cast("double").alias("rot_chg_20d"),
        F.col("breadth_above_50dma").alias("rot_breadth_50"), F.col("breadth_above_200dma").alias("rot_breadth_200"),
        flag(F.col("rank") <= 3).alias("rot_top3"), flag(F.col("rank") > F.col("groups") - 3).alias("rot_bottom3"), flag(F.col("rank_chg_5d") >= 2).alias("rot_in"),
    )

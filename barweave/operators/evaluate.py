"""Score evaluation: ranking metrics, bins, sweeps (rows: y 0/1, prob, r_multiple)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running


def by_score(scored: DataFrame) -> DataFrame:
    """One row per distinct score with its positives and rows: all that the ranking metrics need."""
    return scored.groupBy("prob").agg(F.sum("y").alias("pos"), F.count("*").alias("rows"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums, ties by average ranks."""
    up = running(by_score(scored), F.col("prob").cast("double"), ["prob"], {"upto": F.col("rows")})
    r = up.withColumn("rank", F.col("upto") - (F.col("rows") - 1) / 2)
    s = r.agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum(F.col("rows") - F.col("pos")).alias("n"))
    return s.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over distinct scores of precision times the step in recall."""
    r = running(by_score(scored), -F.col("prob").cast("double"), [F.col("prob").desc()], {"tp": F.col("pos"), "seen": F.col("rows")})
    return r.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("average_precision"))


def quantile_bin(scored: DataFrame, n: int = 10) -> DataFrame:
    """0-based bin of each score by n quantiles (right-closed, lowest included, equal edges merged)."""
    edges = scored.agg(F.percentile("prob", F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("e")).select(F.array_sort(F.array_distinct("e")).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return scored.join(F.broadcast(edges)).withColumn("decile", F.size(F.filter(inner, lambda e: e < F.col("prob")))).drop("edges")


def decile_table(scored: DataFrame) -> DataFrame:
    return quantile_bin(scored).groupBy("decile").agg(
        F.count("*").alias("n"), F.avg("y").alias("hit_rate"), F.avg("r_multiple").alias("mean_r"), F.median("r_multiple").alias("median_r"), F.avg("prob").alias("mean_prob")
    )


def fixed_bin(x, n: int = 10):
    """0-based right-closed bin of [0, 1] in n parts, by comparison with the literal edges."""
    return F.size(F.filter(F.array(*[F.lit(i / n) for i in range(1, n)]), lambda e: e < x))


def calibration_table(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("prob").between(0, 1)).groupBy(fixed_bin(F.col("prob")).alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("predicted"), F.avg("y").alias("actual"))


def sweep(scored: DataFrame, thresholds: list[float], least: int = 5) -> DataFrame:
    """Trades, hit rate, mean and total multiple at each threshold: one pass, every row explodes to the thresholds it reaches."""
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("prob"))
    g = scored.select("y", "r_multiple", F.explode(reached).alias("threshold")).groupBy("threshold")
    return g.agg(F.count("*").alias("n"), F.avg("y").alias("hit_rate"), F.avg("r_multiple").alias("mean_r"), F.sum("r_multiple").alias("total_r")).filter(F.col("n") >= least)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks."""
    out = rows
    for c in (a, b):
        counts = rows.groupBy(c).agg(F.count("*").alias("k"))
        upto = running(counts, F.col(c).cast("double"), [c], {"upto": F.col("k")})
        ranks = upto.select(c, (F.col("upto") - (F.col("k") - 1) / 2).alias(f"rank_{c}"))
        out = out.join(ranks, c)
    return out.agg(F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))


def top_k(scored: DataFrame, ks: list[int]) -> DataFrame:
    """k, n, hit_rate of the k highest scores, ties to the smaller id."""
    best = scored.orderBy(F.col("prob").desc(), "id").limit(max(ks)).select("y", "prob", "id")
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.col("prob").desc(), "id")))  # max(ks) rows
    reached = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("place"))
    return placed.select("y", F.explode(reached).alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.avg("y").alias("hit_rate"))


def holdout_report(scored: DataFrame, thresholds: list[float], ks: list[int]) -> DataFrame:
    """part, item, n, value: base rate, Brier, MAE, AUC and average precision; hit rates by decile, threshold and top k."""
    miss = F.col("y") - F.col("prob")
    plain = scored.agg(F.count("*").alias("n"), F.avg("y").alias("base_rate"), F.avg(F.pow(miss, 2)).alias("brier"), F.avg(F.abs(miss)).alias("mae"))
    ranked = plain.join(F.broadcast(auc(scored))).join(F.broadcast(average_precision(scored)))  # one row each
    names = ["base_rate", "brier", "mae", "auc", "average_precision"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in names]))
    out = ranked.select("n", pairs.alias("m")).select(F.lit("metric").alias("part"), "m.item", "n", "m.value")
    for part, table, key in (("decile", decile_table(scored), "decile"), ("sweep", sweep(scored, thresholds), "threshold"), ("top", top_k(scored, ks), "k")):
        out = out.unionByName(table.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("item"), "n", F.col("hit_rate").alias("value")))
    return out

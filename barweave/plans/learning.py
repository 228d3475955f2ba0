"""Learning queries on labelled bars. What they score they score out of fold, or on rows later than those they were fitted on. The
fits have no SQL form; tests hold them against plain Python."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..operators import boost, frames, isotonic, learn, training, validation
from ..operators.boost import Params
from ..operators.indicators import STAGES, staged
from ..sources import storage
from ..sources.fixtures import walk_bars
from .registry import query, r6

FEATURES = ["rsi14", "bbw", "vdu", "adx14", "dist"]
#: Stronger trends shouldn't hurt, as in the priors of ``training``.
SIGNS = {"adx14": 1}
#: Short fits; the defaults of ``training`` (``MAIN``, ``SYMMETRIC``) are those of a full training.
QUICK = Params(rounds=12, depth=3, leaves=8, rate=0.2, bins=64, least=20, patience=4)
QUICK_SYMMETRIC = replace(QUICK, rounds=8, symmetric=True, segments=4, l2=3.0)


def outcomes(close, high, low, atr, resistance, ahead: int = 10, confirm_within: int = 5):
    """label, the bars until the exit and the multiple of every bar: the triple barrier of ``operators.labels`` at its defaults, over one symbol's bars."""
    size = len(close)
    later = lambda x, i: np.concatenate([x[i:], np.full(min(i, size), np.nan)])[:size]
    top, bottom = close + 3.0 * atr, close - 1.0 * atr
    stop, goal, confirmed = np.zeros(size, int), np.zeros(size, int), np.zeros(size, bool)
    for i in range(ahead, 0, -1):  # the earliest hit comes last
        stop, goal = np.where(later(low, i) <= bottom, i, stop), np.where(later(high, i) >= top, i, goal)
        confirmed |= (i <= confirm_within) & (later(close, i) > resistance)
    stopped = (stop > 0) & ((goal == 0) | (stop <= goal))
    gained = (goal > 0) & ~stopped
    end = np.minimum(ahead, size - 1 - np.arange(size))
    days = np.where(stopped, stop, np.where(gained, goal, end))
    price = np.where(stopped, bottom, np.where(gained, top, close[np.arange(size) + end]))
    return np.where(stopped, -1.0, np.where(gained & confirmed, 1.0, 0.0)), days, (price - close) / (1.0 * atr)


def described(b):
    """The features of a symbol's bars, as the indicators of the same names, and their outcomes; label is null for bars without one."""
    ratio = lambda x, y: x / np.where(y == 0, np.nan, y)
    up, down, rise, fall = (frames.mean(b[c], 14, 14) for c in ("up", "dn", "pdm", "mdm"))
    ma50, ma200, atr = frames.mean(b["close"], 50, 50), frames.mean(b["close"], 200, 200), frames.mean(b["tr"], 20, 20)
    label, days, multiple = outcomes(b["close"], b["high"], b["low"], atr, frames.highest(b["close"], 50))
    label[~((b["n"] >= 21) & (atr > 0) & (days > 0))] = np.nan
    days = np.arange(len(days)) + days
    return {
        "rsi14": 100 - 100 / (1 + ratio(up, down)), "bbw": ratio(4 * frames.deviation(b["close"], 20, 20), frames.mean(b["close"], 20, 20)),
        "vdu": 1 - ratio(frames.mean(b["volume"], 10), frames.mean(b["volume"], 50, 50)), "adx14": frames.mean(ratio(100 * np.abs(rise - fall), rise + fall), 14, 14),
        "dist": ratio(b["close"], ma50) - 1, "above": np.where(np.isnan(ma200 + b["close"]), np.nan, b["close"] > ma200), "label": label, "multiple": multiple, "exit_day": b["day"][days],
    }


def labelled(spark, sf_dir):
    """id, asof, exit_date, y, weight, r_multiple, above and features of every labelled bar from the 210th of its symbol on."""
    bars = staged(walk_bars(spark, sf_dir), *STAGES[:2]).withColumn("day", F.unix_date("dt"))
    taken = ["n", "day", "close", "high", "low", "volume", "tr", "up", "dn", "pdm", "mdm"]
    made = [*FEATURES, "above", "label", "multiple", "exit_day"]
    rows = frames.by_symbol(bars.select("symbol", "dt", *taken), taken, described, ", ".join(f"{c} double" for c in made), 210)
    return rows.filter("label is not null").select(
        (F.col("symbol").cast("long") * 100_000 + F.col("n")).alias("id"), F.col("dt").alias("asof"), F.date_from_unix_date(F.col("exit_day").cast("int")).alias("exit_date"),
        (F.col("label") == 1).cast("int").alias("y"), F.lit(1.0).alias("weight"), F.expr(f"{r6('multiple')} AS r_multiple"), F.col("above").cast("boolean").alias("above"), *FEATURES,
    )


def weighted(spark, sf_dir, parts=None):
    """The labelled bars with uniqueness weights and the ``parts`` asked for; each row gets both where it lies."""
    rows = storage.written(labelled(spark, sf_dir), "labelled").drop("weight")
    rows = validation.with_weights(rows)
    return storage.written(parts(rows) if parts else rows, "weighted")


def purged(folds: int = 2):
    return lambda rows: validation.with_parts(rows, folds, 10)


def fitted(spark, sf_dir, p: Params = QUICK):
    return training.cross_validated(weighted(spark, sf_dir, purged()), None, FEATURES, p, SIGNS)


@query("m01_boosted_classifier")
def boosted(spark, sf_dir):
    """Out-of-fold scores of the constrained booster over purged folds, stopped early."""
    return fitted(spark, sf_dir).oof.select("id", "y", F.col("oof").alias("prob"))


@query("m02_isotonic_calibration")
def calibrated(spark, sf_dir):
    """Out-of-fold scores and what the calibration fitted on them makes of them."""
    f = fitted(spark, sf_dir)
    return isotonic.apply(f.oof, "oof", f.corners, "prob_cal").select("id", "y", F.col("oof").alias("prob"), "prob_cal")


@query("m03_stacked_models")
def stacked(spark, sf_dir):
    rows = weighted(spark, sf_dir, purged())
    main = training.cross_validated(rows, None, FEATURES, QUICK, SIGNS)
    s = training.stack(rows, None, FEATURES, main, QUICK_SYMMETRIC)
    return isotonic.apply(s.oof, "stacked", s.corners, "stacked_cal").select("id", "y", *s.BASES, "stacked", "stacked_cal")


@query("m04_regime_models")
def regimes(spark, sf_dir):
    """Every row is scored by its regime's calibrated model, or by a common one where the regime has too few rows; all fitted on the
    earlier four fifths, held_out tells the later rows."""
    rows = learn.by_time(weighted(spark, sf_dir))
    train = storage.written(rows.filter("part = 'train'"), "train")
    (common,) = boost.fit(train, FEATURES, QUICK, monotone=SIGNS)
    found = training.by_regime(train, "above", FEATURES, QUICK, SIGNS)
    out = found.score(boost.predict(rows, common, "_common"), "above", "prob", "_common")
    return out.select("id", training.regime_of("above").alias("regime"), "held_out", "prob")


@query("m05_multiple_regression")
def multiples(spark, sf_dir):
    """Out-of-fold trade multiples by absolute loss."""
    f = training.multiples(weighted(spark, sf_dir, purged()), None, FEATURES, replace(QUICK, rounds=6))
    return f.oof.select("id", "r_multiple", F.col("oof").alias("r_pred"))


@query("m06_blended_prediction")
def blended(spark, sf_dir):
    """All heads fitted on the earlier four fifths, every row predicted, held_out tells the later rows."""
    rows = learn.by_time(weighted(spark, sf_dir))
    train = storage.written(purged()(rows.filter("part = 'train'").drop("part", "held_out")), "train")
    folds = None  # train carries its parts
    p = replace(QUICK, rounds=6)
    main = training.cross_validated(train, folds, FEATURES, p, SIGNS)
    stack = training.stack(train, folds, FEATURES, main, replace(QUICK_SYMMETRIC, rounds=4))
    regime = training.by_regime(train, "above", FEATURES, p, SIGNS)
    multiple = training.multiples(train, folds, FEATURES, replace(p, rounds=3))
    out = training.predict(rows, main, stack, regime, multiple, "above")
    return out.select("id", "held_out", "prob_raw", "prob_calibrated", "prob_stack", "prob_regime", "prob_blend", "r_multiple_pred", "kelly_fraction")


@query("m10_learned_out_of_fold")
def learned_out_of_fold(spark, sf_dir):
    """Walk-forward folds overlap; the last fold that tests a row predicts it. Rows before the first test have none."""
    table = weighted(spark, sf_dir, lambda rows: validation.with_walk(rows, 540, 240, 180, 15))
    models = boost.fit(table, FEATURES, replace(QUICK, rounds=6), "parts", monotone=SIGNS)
    return training.fold_scores(table, models, "oof").filter("oof is not null").select("id", "y", "oof")


@query("a20_fold_metrics")
def fold_metrics(spark, sf_dir):
    """Mean and deviation of the metrics over purged folds, and the median best iteration."""
    table = weighted(spark, sf_dir, purged(3))
    models = boost.fit(table, FEATURES, QUICK, "parts", monotone=SIGNS)
    return training.summary(training.fold_metrics(table, models))


@query("m11_feature_importance")
def importance(spark, sf_dir):
    (model,) = boost.fit(weighted(spark, sf_dir), FEATURES, QUICK, monotone=SIGNS)
    found = [(c, gain, n) for c, (gain, n) in boost.importance(model).items()]
    return spark.createDataFrame(found, "feature string, gain double, splits int").orderBy(F.desc("gain"), "feature")


@query("m12_parameter_search")
def search(spark, sf_dir):
    """Four trials over two parameters, their history kept and read again; the operator's defaults are 50 trials over eleven."""
    rows = weighted(spark, sf_dir, purged())
    space = {c: training.SPACE[c] for c in ("least", "l2", "positive")} | {"rate": training.Axis(0.1, 0.5, log=True)}
    path = storage.scratch(spark, "search_history")
    found = training.search(rows, None, FEATURES, 4, replace(QUICK, rounds=4), space, SIGNS, path)
    return found.select("trial", "setting", F.size("folds").alias("folds"), "pruned", "score")

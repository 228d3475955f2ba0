"""Calibration by merging, out-of-fold training, stack, regimes, blend and the parameter search."""

import math
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from barweave.operators import boost, isotonic, training
from barweave.operators.boost import Params
from pyspark.sql import functions as F

FEATURES = ["a", "b"]
SMALL = Params(rounds=6, depth=2, leaves=4, rate=0.3, bins=16, least=5, patience=2)


def brute_pav(pairs):
    """Isotonic means by the max-min formula over distinct scores."""
    at = sorted({x for x, _, _ in pairs})
    w = [sum(p[2] for p in pairs if p[0] == x) for x in at]
    s = [sum(p[2] * p[1] for p in pairs if p[0] == x) for x in at]
    cw, cs = np.r_[0, np.cumsum(w)], np.r_[0, np.cumsum(s)]
    mean = lambda i, j: (cs[j + 1] - cs[i]) / (cw[j + 1] - cw[i])
    return {x: max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k, x in enumerate(at)}


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_isotonic_equals_brute_force(spark, parts):
    """With ties and weights, over any number of range partitions."""
    r = np.random.default_rng(parts)
    pairs = [(float(round(x, 2)), float(r.random() < x), float(r.integers(1, 4))) for x in r.random(300)]
    df = spark.createDataFrame([*pairs, (None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (0.5, None, 1.0), (0.5, 1.0, 0.0)], "p double, y double, w double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        blocks = isotonic.fit(df, "p", weight="w")
        got = sorted(map(tuple, blocks.collect()))
        corners = isotonic.steps(blocks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(got, got[1:], strict=False))
    want = brute_pav(pairs)
    scored = isotonic.apply(df.filter("p is not null and not isnan(p)"), "p", corners, "c").select("p", "c").distinct().collect()
    assert len(scored) == len(want) and all(x.c == pytest.approx(want[x.p], abs=1e-12) for x in scored)
    edge = isotonic.apply(spark.createDataFrame([(-5.0,), (9.0,), (None,)], "p double"), "p", corners, "c").collect()
    assert [edge[0].c, edge[1].c, edge[2].c] == [min(want.values()), max(want.values()), None]


def test_isotonic_of_nothing(spark):
    corners = isotonic.steps(isotonic.fit(spark.createDataFrame([], "p double, y double"), "p"))
    assert isotonic.apply(spark.createDataFrame([(0.5,)], "p double"), "p", corners, "c").first().c is None


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(360):
        a, b = float(r.normal()), float(r.normal())
        y = int(a + 0.3 * b + r.normal() > 0.3)
        rows.append((i, date(2020, 1, 1) + timedelta(days=i), None if i % 9 == 0 else a, math.inf if i % 50 == 1 else b, y, 1.0, None if i % 31 == 0 else float(y) * 2 - 1 + b, None if i % 40 == 0 else i % 3 != 0))
    df = spark.createDataFrame(rows, "id long, asof date, a double, b double, y int, weight double, r_multiple double, above boolean").repartition(4)
    folds = df.join(spark.range(3).select(F.col("id").cast("int").alias("fold"))).select("fold", "id", F.when(F.col("id") % 3 == F.col("fold"), "test").otherwise("train").alias("part"))
    return df, folds.filter("id % 10 <> 7 or part = 'train'")


def test_out_of_fold_scores(spark, table):
    """A row's score is that of the model whose fold tests it, fitted alone on the other folds; rows without one are null."""
    df, folds = table
    fitted = training.cross_validated(df, folds, FEATURES, SMALL)
    got = {r.id: r.oof for r in fitted.oof.collect()}
    assert len(got) == 360 and all((got[i] is None) == (i % 10 == 7) for i in got)
    for k in range(3):
        parts = F.array(F.when(F.col("id") % 3 != k, 1).when(F.col("id") % 10 != 7, 2).otherwise(0))
        (alone,) = boost.fit(df.withColumn("parts", parts), FEATURES, SMALL, "parts")
        for r in boost.predict(df.filter(f"id % 3 = {k} and id % 10 <> 7"), alone, "p").collect():
            assert got[r.id] == pytest.approx(r.p, abs=1e-12)
    assert len(fitted.model.trees) == max(1, int(np.median([m.best for m in fitted.folds])))
    known = [(got[r.id], float(r.y), 1.0) for r in df.collect() if got[r.id] is not None]
    want = brute_pav(known)
    at, value = fitted.corners
    assert all(np.interp(p, at, value) == pytest.approx(v, abs=1e-12) for p, v in want.items())
    metrics = training.fold_metrics(training.parted(df, folds)[0], fitted.folds).toPandas()
    assert metrics["best_iter"].tolist() == [m.best for m in fitted.folds] and (metrics["auc"] > 0.6).all() and metrics["n"].sum() == 324
    s = training.summary(training.fold_metrics(training.parted(df, folds)[0], fitted.folds)).toPandas().set_index("metric")
    assert s.loc["auc", "mean"] == pytest.approx(metrics["auc"].mean()) and s.loc["auc", "std"] == pytest.approx(metrics["auc"].std()) and s.loc["ap", "best_iter"] == metrics["best_iter"].median()


def test_all_heads_and_their_blend(spark, table):
    df, folds = table
    main = training.cross_validated(df, folds, FEATURES, SMALL)
    stacked = training.stack(df, folds, FEATURES, main, replace(SMALL, symmetric=True, segments=3, rounds=3))
    regimes = training.by_regime(df, "above", FEATURES, replace(SMALL, rounds=3), least=100)
    multiple = training.multiples(df, folds, FEATURES, replace(SMALL, rounds=2))
    assert stacked.oof.count() == 324 and sorted(regimes.models) == [0, 1]
    assert multiple.model.loss == "absolute" and multiple.corners is None and multiple.oof.count() == df.filter("r_multiple is not null").count()
    out = training.predict(df, main, stacked, regimes, multiple, "above").toPandas()
    assert len(out) == 360 and out.columns[: len(df.columns)].tolist() == df.columns
    heads = ["prob_calibrated", "prob_stack", "prob_regime"]
    assert out[heads].notna().all().all() and np.allclose(out["prob_blend"], out[heads].mean(axis=1))
    assert ((out[heads] >= 0) & (out[heads] <= 1)).all().all() and out["kelly_fraction"].between(0, 0.25).all()
    b = np.maximum(out["r_multiple_pred"].abs(), 0.5)
    assert np.allclose(out["kelly_fraction"], np.clip((out["prob_blend"] * b - (1 - out["prob_blend"])) / b, 0, 0.25))
    bare = training.predict(df, main, None, None, None, "above").toPandas()
    assert np.allclose(bare["prob_blend"], bare["prob_calibrated"]) and bare["kelly_fraction"].isna().all()


def test_regime_without_model_falls_back(spark, table):
    df, _ = table
    one = training.by_regime(df, "above", FEATURES, replace(SMALL, rounds=2), least=200)
    assert list(one.models) == [1]
    out = one.score(df.withColumn("common", F.lit(0.25)), "above", "p", "common").toPandas()
    bear = out["above"].eq(False)
    assert bear.sum() > 90 and (out.loc[bear, "p"] == 0.25).all() and out.loc[~bear, "p"].nunique() > 1 and out["p"].notna().all()
    none = training.by_regime(df, "above", FEATURES, SMALL, least=1000)
    assert none.models == {} and none.score(df, "above", "p").filter("p is not null").count() == 0


def test_multiples_skip_folds_of_few_rows(spark, table):
    df, folds = table
    few = df.withColumn("r_multiple", F.when((F.col("id") % 3 != 0) | (F.col("id") < 60), F.col("r_multiple")))
    fitted = training.multiples(few, folds, FEATURES, replace(SMALL, rounds=2))
    assert len(fitted.folds) == 2 and fitted.oof.filter("oof is not null and id % 3 = 0").count() == 0


def test_parzen_search_beats_random_draws():
    """On a fixed objective of two numbers and a choice, at equal trials; the same seed gives the same history."""
    space = {"x": training.Axis(0.0, 1.0), "y": training.Axis(1e-3, 10.0, log=True), "n": training.Axis(1, 50, whole=True), "c": training.Axis(choices=("u", "v", "w"))}

    def score(s):
        return -((s["x"] - 0.3) ** 2) - 0.1 * (math.log10(s["y"]) + 1) ** 2 - 0.0005 * (s["n"] - 20) ** 2 - (0.0 if s["c"] == "v" else 0.3)

    def run(seed, startup):
        history = []
        for t in range(50):
            s = training.propose(history, space, t, seed, startup)
            assert 0 <= s["x"] <= 1 and 1e-3 <= s["y"] <= 10 and 1 <= s["n"] <= 50 and s["c"] in "uvw"
            history.append((s, score(s)))
        return history

    best = lambda h: max(x for _, x in h)
    parzen, plain = [best(run(s, 10)) for s in range(9)], [best(run(s, 10**6)) for s in range(9)]
    assert np.median(parzen) > np.median(plain) and min(parzen) > -0.1
    assert run(3, 10) == run(3, 10)


def test_pruning():
    others = [[0.5, 0.6], [0.7, 0.8], [0.6, 0.6], [0.4], [0.9, 0.9], [0.5, 0.7]]
    assert training.is_pruned([0.1, 0.1], others, 1) and not training.is_pruned([0.9, 0.9], others, 1)
    assert not training.is_pruned([0.1], others, 2) and not training.is_pruned([0.1], others[:2], 1)


def test_search_resumes(spark, table, tmp_path):
    df, folds = table
    space = {"rate": training.Axis(0.05, 0.5, log=True), "depth": training.Axis(1, 3, whole=True)}
    base = replace(SMALL, rounds=2)
    whole = training.search(df, folds, FEATURES, 4, base, space).orderBy("trial").collect()
    path = f"file://{tmp_path}/history"
    training.search(df, folds, FEATURES, 2, base, space, path=path)
    again = training.search(df, folds, FEATURES, 4, base, space, path=path).orderBy("trial").collect()
    assert again == whole and spark.read.parquet(path).count() == 4
    assert all(len(r.folds) == 3 for r in whole) and training.best_setting(spark.createDataFrame(whole)).keys() == {"rate", "depth"}

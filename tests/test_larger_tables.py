"""What keeps figures in proportion on larger tables: work that is not asked for is not done, and parts grow with the input."""

import numpy as np
from barweave.operators import boost, detect, groups, training
from barweave.operators.boost import Tree
from barweave.plans import setups
from barweave.sources import fixtures, storage
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_final_model_is_fitted_only_when_asked_for(spark, monkeypatch):
    fits, fit = [], boost.fit
    monkeypatch.setattr(boost, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    rows = spark.createDataFrame([(i, i % 2, 1.0, float(i % 7)) for i in range(60)], "id long, y int, weight double, x double")
    folds = spark.createDataFrame([(k, i, "test" if i % 2 == k else "train") for i in range(60) for k in (0, 1)], "fold int, id long, part string")
    f = training.cross_validated(rows, folds, ["x"], boost.Params(rounds=2, depth=2, least=2))
    assert f.oof.filter("oof is not null").count() == 60 and f.corners is not None and len(fits) == 1
    assert f.model.features == ["x"] and f.model is f.model and len(fits) == 2


def test_leaves_by_table():
    t = Tree()
    a, b = t.split(0, 1, 100, True, 1.0)
    t.split(b, 0, 7, False, 1.0)
    bins = np.random.default_rng(1).integers(0, 256, (500, 2)).astype(np.uint8)
    bins[:50, 0] = bins[25:75, 1] = 0

    def walk(row):
        node = 0
        while t.feature[node] >= 0:
            x = row[t.feature[node]]
            left = t.missing_left[node] if x == 0 else x <= t.bin[node]
            node = t.left[node] if left else t.right[node]
        return node

    assert t.depth() == 2 and t.nodes(bins).tolist() == [walk(r) for r in bins]


def test_bars_have_parts_by_bytes(spark, monkeypatch):
    before = sorted(map(tuple, fixtures.walk_bars(spark, SF).collect()))
    monkeypatch.setattr(fixtures, "PART_BYTES", 10_000)
    bars = fixtures.walk_bars(spark, SF)
    assert bars.rdd.getNumPartitions() >= 10 and sorted(map(tuple, bars.collect())) == before


def test_symbol_scan_detects_once(spark, monkeypatch):
    runs, one = [], detect.detect
    monkeypatch.setattr(detect, "detect", lambda *a: runs.append(1) or one(*a))
    assert "coiled_spring_score" in setups.symbol_scan(spark, SF).columns and len(runs) == 1


def test_levels_are_clustered_once_for_the_pivots_in_sight(spark, monkeypatch):
    made, own = [], detect.level_candidates
    monkeypatch.setattr(detect, "level_candidates", lambda bars, sets, p: made.append((bars, sets)) or own(bars, sets, p))
    found = setups.replay_setups(spark, "/root/testdata/sf0.01")[0]
    (bars, sets), passed = made[0], F.expr("drop_reason is null and n >= 250")
    near = detect.lookback_pivots(bars, 750).selectExpr("symbol", "inline(near)").distinct()
    assert near.count() == bars.filter("pivot3").count()  # each pivot has one number, though two blocks see it
    assert sets.count() * 2 < bars.filter(passed).count() and found.count() > 1000


def test_scanner_makes_its_indicators_once(spark, monkeypatch):
    made, own = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, name: made.append(name) or own(df, name))
    rows = setups.scanner_rows(spark, SF)
    assert made == ["scanned", "setups", "bases"]
    assert "RowFrame, -251" not in rows._jdf.queryExecution().optimizedPlan().toString()  # strength is taken at the last bar only


def test_breadth_looks_at_the_last_bars_only(spark):
    days = [(s, d, 100.0 + (d if s < 4 else -d)) for s in range(6) for d in range(230)]
    bars = spark.createDataFrame(days, "symbol int, day int, close double").withColumn("dt", F.date_from_unix_date("day"))
    out = groups.breadth(bars, spark.createDataFrame([(s, "g") for s in range(6)], "symbol int, grp string"))
    assert [tuple(r) for r in out.collect()] == [("g", 4 / 6 * 100, 4 / 6 * 100)]
    assert "RowFrame, -199" not in out._jdf.queryExecution().optimizedPlan().toString()

"""The histogram booster against a plain-Python one, and what it promises: monotone scores, learned missing directions, early
stopping, medians, order independence."""

import math
from dataclasses import replace

import numpy as np
import pytest
from barweave.operators import boost, training
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c"]
SMALL = boost.Params(rounds=4, depth=3, leaves=6, rate=0.3, bins=16, least=5, l2=0.5)
SCHEMA = "id long, a double, b double, c double, y double, weight double"


def table(n=500, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) + r.normal(scale=0.5, size=n) > 0.2).astype(float)
    rows = []
    for i in range(n):
        a, b, c = (float(v) for v in x[i])
        a = None if i % 7 == 0 else float("nan") if i % 11 == 0 else math.inf if i % 97 == 0 else round(a, 2)
        rows.append((i, a, round(b, 2), -math.inf if i % 50 == 3 else round(c, 1), float(y[i]), 0.5 + (i % 4) / 4))
    return rows


def plain_bins(rows, cuts):
    def bin_of(v, c):
        return 0 if v is None or v != v else 1 + sum(x < v for x in c)

    return [[bin_of(r[1 + f], cuts[f]) for f in range(3)] for r in rows]


def plain_fit(rows, cuts, base, p, sign, shift):
    """Level by level over lists of rows, one candidate at a time."""
    bins, scale = plain_bins(rows, cuts), float(1 << shift)
    margin = [base] * len(rows)
    trees = []
    for _ in range(p.rounds):
        q = [1 / (1 + math.exp(-m)) for m in margin]
        g = [round((qi - r[4]) * r[5] * scale) for qi, r in zip(q, rows, strict=True)]
        h = [round(qi * (1 - qi) * r[5] * scale) for qi, r in zip(q, rows, strict=True)]
        nodes = {0: (list(range(len(rows))), -math.inf, math.inf)}
        splits, level, leaves, fresh = {}, [0], 1, 1

        def value(idx, lo, hi, g=g, h=h):
            return min(max(-(sum(g[i] for i in idx) / scale) / (sum(h[i] for i in idx) / scale + p.l2 + 1e-16), lo), hi)

        def score(idx, v, g=g, h=h):
            return -(sum(g[i] for i in idx) / scale * v + 0.5 * (sum(h[i] for i in idx) / scale + p.l2) * v * v)

        for _ in range(p.depth):
            found = []
            for node in level:
                idx, lo, hi = nodes[node]
                best = None
                for miss_left in (0, 1):
                    for f in range(3):
                        if miss_left and not any(bins[i][f] == 0 for i in idx):
                            continue
                        for cut in range(1, p.bins + 1):
                            left = [i for i in idx if (bins[i][f] <= cut if bins[i][f] else miss_left)]
                            right = [i for i in idx if not (bins[i][f] <= cut if bins[i][f] else miss_left)]
                            if len(left) < p.least or len(right) < p.least:
                                continue
                            vl, vr = value(left, lo, hi), value(right, lo, hi)
                            if sign[f] * (vr - vl) < 0:
                                continue
                            gain = score(left, vl) + score(right, vr) - score(idx, value(idx, lo, hi))
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, node, f, cut, miss_left, left, right, vl, vr)
                if best and best[0] > 1e-12:
                    found.append(best)
            found = sorted(found, key=lambda x: (-x[0], x[1]))[: p.leaves - leaves]
            level = []
            for _, node, f, cut, miss_left, left, right, vl, vr in found:
                _, lo, hi = nodes[node]
                mid = (vl + vr) / 2
                low, high = ((lo, mid), (mid, hi)) if sign[f] > 0 else ((mid, hi), (lo, mid)) if sign[f] < 0 else ((lo, hi), (lo, hi))
                splits[node] = (f, cut, bool(miss_left), fresh, fresh + 1)
                nodes[fresh], nodes[fresh + 1] = (left, *low), (right, *high)
                level += [fresh, fresh + 1]
                fresh, leaves = fresh + 2, leaves + 1
            if not level:
                break
        values = {n: p.rate * value(idx, lo, hi) for n, (idx, lo, hi) in nodes.items() if n not in splits}
        for n, v in values.items():
            for i in nodes[n][0]:
                margin[i] += v
        trees.append((splits, values))
    return trees, margin


@pytest.mark.parametrize("monotone", [{}, {"a": 1, "b": -1}])
def test_equals_plain_booster(spark, monotone):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    (m,) = boost.fit(df, FEATURES, SMALL, monotone=monotone)
    rate = sum(r[4] * r[5] for r in rows) / sum(r[5] for r in rows)
    assert m.base == pytest.approx(math.log(rate / (1 - rate)), abs=1e-7)
    trees, margin = plain_fit(rows, m.cuts, m.base, SMALL, [monotone.get(f, 0) for f in FEATURES], boost.SHIFT)
    for got, (splits, values) in zip(m.trees, trees, strict=True):
        assert {i: (got.feature[i], got.bin[i], got.missing_left[i], got.left[i], got.right[i]) for i, f in enumerate(got.feature) if f >= 0} == splits
        for n, v in values.items():
            assert got.values[0][n] == pytest.approx(v, abs=1e-9)
    scored = {r.id: r.prob for r in boost.predict(df, m, "prob").collect()}
    for i, x in enumerate(margin):
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-7)


def test_monotone_grid(spark):
    """Along a constrained feature the score never falls, whatever the others are, missing ones included."""
    rows = [(i, a, b, c, float((i * 7919) % 3 == 0 or (a or 0) > 0.5), 1.0) for i, a, b, c, _, _ in table(800)]
    (m,) = boost.fit(spark.createDataFrame(rows, SCHEMA), FEATURES, replace(SMALL, rounds=12), monotone={"b": 1, "c": -1})
    grid = np.linspace(-3, 3, 61)
    for a in (-1.0, 0.0, 0.7, np.nan):
        for other in (-2.0, 0.0, 2.0, np.nan):
            up = m.margins([np.full(61, a), grid, np.full(61, other)])
            down = m.margins([np.full(61, a), np.full(61, other), grid])
            assert (np.diff(up) >= 0).all() and (np.diff(down) <= 0).all()


def test_missing_values_are_learned(spark):
    r = np.random.default_rng(3)
    rows = [(i, None if (gone := i % 3 == 0) else float(r.normal()), float(r.normal()), float("nan") if i % 5 == 0 else math.inf, float(gone if i % 20 else not gone), 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    (m,) = boost.fit(df, FEATURES, replace(SMALL, rounds=5))
    s = [(x.prob, x.y) for x in boost.predict(df, m, "prob").collect()]
    good = sum((p > q) + 0.5 * (p == q) for p, y in s for q, z in s if y > z)
    assert good / (sum(y for _, y in s) * sum(1 - y for _, y in s)) > 0.9
    assert m.trees[0].feature[0] == 0 and not m.trees[0].missing_left[0]


def test_early_stopping_in_lockstep(spark):
    """Two folds fitted together equal each fitted alone; the best iteration is where the validation loss is least."""
    df = spark.createDataFrame(table(), SCHEMA)
    p = replace(SMALL, rounds=14, patience=3, rate=0.6)
    one, two = F.when(F.col("id") % 3 == 0, 2).otherwise(1), F.when(F.col("id") % 3 == 1, 2).otherwise(1)
    both = boost.fit(df.withColumn("parts", F.array(one, two)), FEATURES, p, parts="parts")
    for m, part in zip(both, (one, two), strict=True):
        (alone,) = boost.fit(df.withColumn("parts", F.array(part)).repartition(7), FEATURES, p, parts="parts")
        assert alone.trees == m.trees and alone.history == m.history
        assert m.best == int(np.argmin(m.history)) and len(m.trees) <= m.best + p.patience
        held = [r for r in boost.predict(df.withColumn("part", part), m, "prob").collect() if r.part == 2]
        loss = sum(-r.weight * math.log(r.prob if r.y else 1 - r.prob) for r in held) / sum(r.weight for r in held)
        assert loss == pytest.approx(min(m.history), abs=1e-6)


def test_absolute_loss(spark):
    """Base and leaf values are weighted medians of labels and residuals."""
    rows = [(i, a, b, c, round(3 * b + (50 if i % 40 == 0 else 0), 3), w) for i, a, b, c, _, w in table()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    p = replace(SMALL, loss="absolute", rounds=3)
    (m,) = boost.fit(df, FEATURES, p)

    def median(pairs):
        pairs, run = sorted(pairs), 0.0
        for v, w in pairs:
            run += w
            if run >= sum(w for _, w in pairs) / 2:
                return v

    assert m.base == median([(r[4], r[5]) for r in rows])
    bins = np.array(plain_bins(rows, m.cuts), np.uint8)
    margin = np.full(len(rows), m.base)
    for t in m.trees:
        leaf = t.nodes(bins)
        for n in set(leaf.tolist()):
            want = median([(rows[i][4] - margin[i], rows[i][5]) for i in np.flatnonzero(leaf == n)])
            assert t.values[0][n] == pytest.approx(p.rate * want, abs=1e-12)
        margin += np.asarray(t.values[0])[leaf]
    mad = lambda x: np.abs(np.array([r[4] for r in rows]) - x).mean()
    assert mad(margin) < 0.75 * mad(m.base)


def test_symmetric_ordered(spark):
    """One split a level; results don't depend on the order of rows; a row's own label never reaches its margin."""
    df = spark.createDataFrame(table(), SCHEMA)
    p = replace(SMALL, symmetric=True, segments=4)
    (m,) = boost.fit(df, FEATURES, p)
    (n,) = boost.fit(df.orderBy(F.col("b").desc()).repartition(9), FEATURES, p)
    assert m.trees == n.trees
    for t in m.trees:
        depth, level = {0: 0}, {}
        for i, f in enumerate(t.feature):
            if f >= 0:
                depth[t.left[i]] = depth[t.right[i]] = depth[i] + 1
                level.setdefault(depth[i], set()).add((f, t.bin[i], t.missing_left[i]))
        assert all(len(x) == 1 for x in level.values())
        assert len(t.values) == 5 and not any(t.values[0])
    # the values that a row of segment s sees come from the rows of the segments before it
    rows, t = table(), m.trees[0]
    mix = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    segment = (boost.mixed(np.array([mix[r[0]] for r in rows]), p.seed + 7) * 4).astype(int)
    leaf = t.nodes(np.array(plain_bins(rows, m.cuts), np.uint8))
    q = 1 / (1 + math.exp(-m.base))
    for s in range(5):
        for n in set(leaf.tolist()):
            own = [r for r, k, x in zip(rows, segment, leaf, strict=True) if k < s and x == n]
            want = -p.rate * sum((q - r[4]) * r[5] for r in own) / (sum(q * (1 - q) * r[5] for r in own) + p.l2)
            assert t.values[s][n] == pytest.approx(want, abs=1e-7)


def test_draws_and_json(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    p = replace(SMALL, row_share=0.7, feature_share=0.6, every=2, l1=0.1, least_gain=0.01)
    (m,) = boost.fit(df, FEATURES, p)
    (n,) = boost.fit(df.repartition(3), FEATURES, p)
    assert m.trees == n.trees and m.trees
    again = boost.Model.from_json(m.to_json())
    assert again == m
    assert sum(k for _, k in boost.importance(m).values()) == sum(f >= 0 for t in m.trees for f in t.feature)


def test_no_rows_and_one_label(spark):
    (m,) = boost.fit(spark.createDataFrame([], SCHEMA), FEATURES, SMALL)
    assert m.trees == [] and m.base == 0.0
    (m,) = boost.fit(spark.createDataFrame([(i, 1.0, 2.0, 3.0, 1.0, 1.0) for i in range(50)], SCHEMA), FEATURES, SMALL)
    assert m.trees == [] and m.base > 10


def test_trees_by_columns_and_by_table(monkeypatch):
    """Both ways to the leaves agree, missing values included; a pass keeps a feature's bins together."""
    r = np.random.default_rng(4)
    bins = r.integers(0, 20, (500, 3)).astype(np.uint8)
    t = boost.Tree()
    for node, feature, at, missing in [(0, 1, 255, False), (1, 0, 9, True), (3, 2, 4, False), (4, 1, 0, True), (7, 2, 12, True)]:
        t.split(node, feature, at, missing, 1.0)
    small = t.nodes(bins)
    assert small.dtype == np.uint8 and (small == t.nodes(np.asfortranarray(bins))).all() and len(set(small.tolist())) == 4
    monkeypatch.setattr(boost, "SMALL", 0)
    assert (t.nodes(bins) == small).all() and boost.binned([np.arange(5.0)] * 2, [[1.0], [2.0]]).flags.f_contiguous


def test_cuts_are_found_once_a_table(spark, monkeypatch):
    """The model on all rows takes the cuts of the folds' fit on the same table."""
    found, find = [], boost.find_cuts
    monkeypatch.setattr(boost, "find_cuts", lambda *a: found.append(1) or find(*a))
    df = spark.createDataFrame(table(), SCHEMA).withColumn("parts", F.expr("array(cast(1 + id % 2 as int), cast(2 - id % 2 as int))"))
    f = training.cross_validated(df, None, FEATURES, SMALL)
    assert f.model.cuts == f.folds[0].cuts and len(found) == 1
    assert f.model == boost.fit(df, FEATURES, replace(SMALL, rounds=f.model.best))[0]

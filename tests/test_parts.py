"""Parts, weights and blocks are made where each row lies: no shuffle by id, no record a row."""

from datetime import date, timedelta

import numpy as np
from barweave.operators import boost, training, validation
from barweave.sources import storage

START = date(2020, 1, 1)


def spans(spark, n=900, days=40):
    """Many rows a day, so that parts end inside days."""
    rows = [(i, START + timedelta(days=i * 7 % days), START + timedelta(days=i * 7 % days + i % 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, asof date, exit_date date")


def test_parts_equal_joined_folds(spark):
    rows, df = spans(spark)
    order = {r[0]: at for at, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    for k in (2, 3, 7):
        want = {r.id: r.parts for r in training.parted(df, validation.purged_folds(df, k, 3))[0].collect()}
        got = {r.id: r.parts for r in validation.with_parts(df, k, 3).collect()}
        assert got == want and len(got) == len(rows)
        size = [len(rows) // k + (f < len(rows) % k) for f in range(k)]
        edges = np.cumsum([0, *size])
        assert all(p.index(2) == np.searchsorted(edges, order[i], "right") - 1 for i, p in got.items())
    assert validation.with_parts(df.filter("id < 0"), 3).count() == 0
    args = (10, 8, 5, 2, 20, 5)
    want = {r.id: r.parts for r in training.parted(df, validation.walk_forward(df, *args))[0].collect()}
    assert {r.id: r.parts for r in validation.with_walk(df, *args).collect()} == want and len(want[0]) > 2


def test_parts_and_weights_join_nothing_by_id(spark):
    _, df = spans(spark)
    written = storage.written(df, "spans")
    plan = validation.with_parts(validation.with_weights(written), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(id" not in plan


def test_rows_are_kept_in_blocks(spark):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(r.normal()), float(i % 3 == 0), 1.0) for i in range(4000)], "id long, a double, y double, weight double").coalesce(2)
    seen = []
    count = boost._run

    def counted(state, work):
        seen.append((state.count(), state.selectExpr("sum(octet_length(y)) / 8").first()[0]))
        return count(state, work)

    boost._run = counted
    try:
        boost.fit(df, ["a"], boost.Params(rounds=1, depth=2, least=5))
    finally:
        boost._run = count
    assert seen and all(blocks <= 4 and rows == 4000 for blocks, rows in seen)

"""Overlapping spans by sweep line against counting every day; stream tables that keep no replaced files."""

import datetime as dt
import os

import numpy as np
import pytest
from barweave.operators import validation
from barweave.streaming import bars as streams
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)
SPANS = "id long, asof date, exit_date date"


def spans(seed, n, longest):
    r = np.random.default_rng(seed)
    out = [(i, DAY + dt.timedelta(days=int(r.integers(200))), None) for i in range(n)]
    return [(i, a, a + dt.timedelta(days=int(r.integers(longest)))) for i, a, _ in out]


@pytest.mark.parametrize("longest", [1, 9, 400])
def test_sweep_equals_counting_days(spark, longest):
    rows = [*spans(longest, 60, longest), (98, DAY + dt.timedelta(days=900), DAY + dt.timedelta(days=903)), (99, DAY + dt.timedelta(days=5), DAY)]
    days = {i: [min(a, z) + dt.timedelta(days=k) for k in range(abs((z - a).days) + 1)] for i, a, z in rows}
    load = {}
    for own in days.values():
        for d in own:
            load[d] = load.get(d, 0) + 1
    df = spark.createDataFrame([*rows, (100, None, DAY), (101, DAY, None)], SPANS).repartition(3)
    assert {r.day: r.load for r in validation.daily_load(df).collect()} == load
    want = {i: np.mean([1 / load[d] for d in own]) for i, own in days.items()}
    got = {r.id: r.raw for r in validation.span_means(df).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
    mean = np.mean(list(want.values()))
    assert {r.id: pytest.approx(r.weight, abs=1e-12) for r in validation.uniqueness_weights(df).collect()} == {i: v / mean for i, v in want.items()}


def test_sweep_makes_no_row_per_day(spark):
    """Spans of three centuries are two events each."""
    df = spark.createDataFrame([(i, dt.date(1700, 1, 1 + i), dt.date(2000, 1, 1)) for i in range(20)], SPANS)
    assert validation.sweep(df).count() == 21
    assert validation.span_means(df).count() == 20


def test_upserts_leave_no_replaced_files(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k long, v long, at long")
    plain, latest = f"{tmp_path}/plain", f"{tmp_path}/latest"
    one, two = streams.upsert_sink(plain, ["k"], "at"), streams.upsert_latest(latest, ["k"], "at", 4)
    for b in range(5):
        batch = make([(k, b * 10 + k, b) for k in range(b, b + 3)])
        one(batch, b)
        two(batch, b)
    two(make([(k, 40 + k, 4) for k in range(4, 7)]), 4)  # the same batch again
    want = {0: 0, 1: 11, 2: 22, 3: 33, 4: 44, 5: 45, 6: 46}
    assert sorted(os.listdir(plain)) == ["v3", "v4"] and {r.k: r.v for r in spark.read.parquet(f"{plain}/v4").collect()} == want
    assert sorted(os.listdir(tmp_path)) == ["latest", "plain"] and {r.k: r.v for r in spark.read.parquet(latest).select(F.col("k"), "v").collect()} == want

"""Frames as vectors are those of the window functions, to the last bit."""

from datetime import date, timedelta

import numpy as np
from barweave.operators import frames
from barweave.operators.indicators import BY, full, slope, tail
from barweave.plans import windows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_frames_equal_window_functions(spark):
    r = np.random.default_rng(3)
    rows = [(s, date(2020, 1, 1) + timedelta(days=i), None if r.random() < 0.1 and i > 3 else float(r.normal(100, 5)), 100.0 * i + s) for s in range(3) for i in range((150, 4, 61)[s])]
    bars = spark.createDataFrame(rows, "symbol int, dt date, x double, z double").selectExpr("*", f"row_number() OVER ({BY}) AS n")
    want = bars.selectExpr("symbol", "dt", f"{tail('avg', 'x', 10)} AS a", f"{full('avg', 'z', 50)} AS b", f"{full('stddev_samp', 'z', 20)} AS c", f"{tail('max', 'x', 50)} AS d", f"{slope('x', 'n', 30)} AS e")
    made = frames.by_symbol(
        bars.repartition(3), ["n", "x", "z"],
        lambda b: {"a": frames.mean(b["x"], 10), "b": frames.mean(b["z"], 50, 50), "c": frames.deviation(b["z"], 20, 20), "d": frames.highest(b["x"], 50), "e": frames.slope(b["x"], b["n"], 30)},
        "a double, b double, c double, d double, e double",
    )
    key = lambda d: sorted(map(tuple, d.select("symbol", "dt", *"abcde").collect()))
    assert key(made) == key(want) and made.filter("b is null").count() > 100


def test_slopes_add_up_no_sliding_frames(spark):
    plan = windows.slopes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regr_slope" not in plan and "-99" not in plan
    assert windows.slopes(spark, SF).filter(F.col("obv_s100") != 0).count() > 1000

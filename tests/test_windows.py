"""Hand-computed and pandas values of the window layer."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from barweave.functions.windows import ffd_weights, percentile_rank
from barweave.operators.indicators import NUMBERED, ema, full, slope, smoothed, staged, with_indicators
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)


def series(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(days=i), float(v) if v is not None else None) for i, v in enumerate(values)], "symbol string, dt date, x double").selectExpr("*", "row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n")


def values(df, expr):
    return [r[0] for r in df.select(F.expr(expr).alias("v"), "dt").orderBy("dt").collect()]


@pytest.mark.parametrize(("xs", "expr", "want"), [
    ([1, 2, 3, 4], full("avg", "x", 3), [None, None, 2, 3]),
    ([1, 2, 3], ema("v", "x", 3), [1, 5 / 3, 17 / 7]),
    ([1, 2, 3], smoothed("v", "x", "(CAST(2 AS DOUBLE) / 4)", 1), [1, 1.5, 2.25]),
    ([1, 2, 3, 4], slope("x", "n", 10), [0, 0, 0, 0]),
    ([1, 2, 3, 4, 5], slope("x", "n", 10), [0, 0, 0, 0, 1]),
])
def test_goldens(spark, xs, expr, want):
    df = series(spark, xs)
    got = values(df, expr) if isinstance(expr, str) else values(staged(df, NUMBERED, *expr), "v")
    assert [None if g is None else pytest.approx(g) for g in got] == want


def test_fractional_weights():
    w = ffd_weights(0.4)
    assert w[-4:] == pytest.approx([-0.064, -0.12, -0.4, 1]) and len(w) == 200 and len(ffd_weights(0.6)) == 140


def test_percentile_rank(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, None)], "k int, x double")
    assert [r[0] for r in df.select(percentile_rank("x", []), "k").orderBy("k").collect()] == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3, None])


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in ("A", "B"):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 320)))
        o = np.roll(c, 1)
        o[0] = c[0]
        rows += [(s, DAY + dt.timedelta(days=i), float(o[i]), float(max(o[i], c[i]) * 1.01), float(min(o[i], c[i]) * 0.99), float(c[i]), float(rng.integers(100, 900))) for i in range(320)]
    return spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, volume double")


def test_pandas_twins(walk):
    got = with_indicators(walk).filter("symbol = 'A'").orderBy("dt").toPandas()
    h, lo, c = got["high"], got["low"], got["close"]
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    d = c.diff()
    want = {
        "ma50": c.rolling(50).mean(), "sd20": c.rolling(20).std(), "atr14": tr.rolling(14).mean(), "ema200": c.ewm(span=200).mean(), "ema21r": c.ewm(span=21, adjust=False).mean(), "watr14": tr.ewm(alpha=1 / 14, adjust=False).mean(),
        "wup14": d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), "rsi14": 100 - 100 / (1 + d.clip(lower=0).rolling(14).mean() / (-d.clip(upper=0)).rolling(14).mean()), "obv": (np.sign(d.fillna(0)) * got["volume"]).cumsum(),
        "ema9r": c.ewm(span=9, adjust=False).mean(), "ema20": c.ewm(span=20).mean(), "ema50": c.ewm(span=50).mean(), "bbw": 4 * c.rolling(20).std() / c.rolling(20).mean(),
        "bb_pos": (c - (c.rolling(20).mean() - 2 * c.rolling(20).std())) / (4 * c.rolling(20).std()), "v20": got["volume"].rolling(20, min_periods=1).mean(), "lo252": lo.rolling(252, min_periods=1).min(),
        "hl20": ((h - lo) / c).rolling(20, min_periods=1).mean() * 100, "dv50": (c * got["volume"]).rolling(50).mean() / 1e7, "c30_mean": c.rolling(30, min_periods=1).mean(), "low20": lo.rolling(20, min_periods=1).min(),
        "hi252": h.rolling(252, min_periods=1).max(),
    }
    for k, w in want.items():
        np.testing.assert_allclose(got[k].astype(float), w, rtol=1e-9, err_msg=k)
    assert got["adx14"].first_valid_index() == 27


def test_exponential_means_of_a_long_series(spark):
    """15,000 bars: weights restart in blocks, so nothing overflows; every row equals pandas."""
    rng = np.random.default_rng(1)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 15_000)))
    pdf = pd.DataFrame({"symbol": "A", "dt": pd.date_range("1960-01-01", periods=15_000).date, "open": c, "high": c * (1 + rng.random(15_000) / 50), "low": c * 0.98, "close": c, "volume": 1.0})
    got = with_indicators(spark.createDataFrame(pdf)).select("dt", "ema20", "ema50", "ema200", "ema9r", "ema21r", "watr14", "wrsi14").orderBy("dt").toPandas()
    h, lo, c, d = pdf["high"], pdf["low"], pdf["close"], pdf["close"].diff()
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    wilder = lambda x: x.ewm(alpha=1 / 14, adjust=False).mean()
    want = {f"ema{n}": c.ewm(span=n).mean() for n in (20, 50, 200)} | {f"ema{n}r": c.ewm(span=n, adjust=False).mean() for n in (9, 21)}
    want |= {"watr14": wilder(tr), "wrsi14": 100 - 100 / (1 + wilder(d.clip(lower=0)) / wilder(-d.clip(upper=0)))}
    for k, w in want.items():
        skip = 50 if k == "wrsi14" else 0  # null here, 100 there, while no close has fallen
        np.testing.assert_allclose(got[k].astype(float)[skip:], w[skip:], rtol=1e-9, err_msg=k)


def test_no_look_ahead(walk):
    cols = [c for c in with_indicators(walk).columns if c not in ("bars_total", "pivot3", "pivot8", "swing_low3", "low11", "fwd_low5")]
    whole = with_indicators(walk).select(cols).filter("n <= 200").orderBy("symbol", "dt").toPandas()
    cut = with_indicators(walk.filter(F.col("dt") <= DAY + dt.timedelta(days=199))).select(cols).orderBy("symbol", "dt").toPandas()
    for c in cols[2:]:
        np.testing.assert_allclose(whole[c].astype(float), cut[c].astype(float), rtol=1e-9, err_msg=c)


def test_broad_pivots_are_tight_pivots(walk):
    assert with_indicators(walk).filter("pivot8 and not pivot3").count() == 0


def test_plateau_pivots(spark):
    rows = [("A", DAY + dt.timedelta(days=i), 1.0, float(v), 0.5, 1.0, 1.0) for i, v in enumerate([1, 2, 3, 4, 4, 3, 2, 1])]
    df = spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, volume double")
    assert [r["n"] for r in with_indicators(df, 2).filter("pivot3").orderBy("n").collect()] == [4, 5]


def test_one_exchange_for_all_stages(walk):
    plan = with_indicators(walk)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

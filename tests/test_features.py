"""Setup features as vectors of a symbol's bars are those of window functions and of base slices, without either."""

import numpy as np
import pytest
from barweave.operators import detect, features, frames
from barweave.operators.indicators import frame, slope
from barweave.plans import setups as plans

SF = "/root/testdata/sf0.001"

PAST = lambda x, k: f"({x} / nullif(lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1) * 100"
FLAG = lambda c: f"CAST(coalesce({c}, false) AS DOUBLE)"
WINDOWS = {
    "base_tightness_30d": "c30_sd / c30_mean * 100", "base_drift_slope_30d": "c30_slope / c30_mean * 100", "nr7": FLAG("n >= 8 AND rng < rng7max"), "atr_ratio": "atr14_10 / close * 100", "vdu": "1 - v10 / nullif(v50, 0)",
    "obv_slope_20": "obv_s20", "obv_slope_50": "obv_s50", "obv_divergence": FLAG("n >= 50 AND obv >= obv_max50 * 0.999 AND close < c50max * 0.99"), "bb_width": "bbw * 100", "bb_width_z": "bbw_z", "ttm_squeeze": FLAG("n >= 25 AND sq = 1"),
    "squeeze_density_20": "sq_density", "bars_in_squeeze": "sq_run", "bars_since_squeeze_release": "since_release", "rsi_14": "rsi14", "roc_60": PAST("close", 60), "dist_52w_high_pct": "(hi252 - close) / hi252 * 100", "adx_14": "adx14",
    "pct_of_52w_range": "coalesce((close - lo252) / nullif(hi252 - lo252, 0) * 100, 50)", "ema200_slope_20": "CASE WHEN n >= 200 THEN ema200_s20 ELSE 0 END", "rs_mansfield": "mans", "rs_slope_20": slope("mans_full", "n", 20), "rs_3m": PAST("ratio", 60), "hl_spread_pct": "hl20",
    "amihud_20": "amihud20", "bench_above_200dma": FLAG(f"b > avg(b) OVER {frame(200)}"), "sec_rs_slope_20": slope("close / g", "n", 20), "sec_dist_52w_high_pct": f"(max(g) OVER {frame(252)} - g) / max(g) OVER {frame(252)} * 100",
}


def test_features_equal_windows_and_slices(spark):
    setups, _, bars = plans.replay_setups(spark, SF)
    ind = plans.described_bars(spark, SF, bars)
    mans = f"(close / b / (avg(close / b) OVER {frame(252)}) - 1) * 100"
    wide = ind.selectExpr("*", "close / b AS ratio", f"{mans} AS mans", f"CASE WHEN count(b) OVER {frame(252)} = 252 THEN {mans} END AS mans_full").selectExpr("symbol", "n", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in WINDOWS.items()])
    base = detect.base_features(detect.base_slice(setups, ind)).selectExpr(
        "symbol", "n", "height_pct AS base_height_pct", "if(size >= 5, slope, 0.0) AS base_slope", "close_touches AS close_touches_R", "pierces AS high_pierces_R", "since_fail AS days_since_failed_bo", "spring AS wyckoff_spring", "CAST(higher_lows AS DOUBLE) AS higher_lows",
    )
    want = setups.select("symbol", "n").join(wide, ["symbol", "n"]).join(base, ["symbol", "n"]).toPandas().sort_values(["symbol", "n"])
    got = plans.feature_rows(spark, SF).toPandas().sort_values(["symbol", "n"])
    assert len(got) == len(want) > 50 and (got[["symbol", "n"]].to_numpy() == want[["symbol", "n"]].to_numpy()).all()
    for c in want.columns[2:]:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)
    scores = plans.feature_score(spark, SF).toPandas()
    assert sorted(scores["coiled_spring_score"]) == pytest.approx(sorted(got["coiled_spring_score"]), abs=1e-6)


@pytest.mark.parametrize("query", [plans.feature_builder, plans.feature_score, plans.symbol_scan])
def test_no_row_per_bar_of_a_base_and_no_wide_frames(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regr_slope" not in plan and "-251" not in plan and "CoGroups" in plan


def test_frames_at_places(spark):
    r = np.random.default_rng(5)
    x, at = r.normal(100, 20, 300), np.array([0, 3, 4, 50, 299])
    assert frames.trend_at(x, 20, at) == pytest.approx(frames.slope(x, np.arange(300.0), 20)[at]) and (frames.slope(x, np.arange(300.0), 20, at) == frames.slope(x, np.arange(300.0), 20)[at]).all()
    np.testing.assert_allclose(frames.deviation_at(x, 30, at), frames.deviation(x, 30)[at])
    assert frames.trend_at(np.full(300, 7.0), 20, at).tolist() == [0.0] * 5
    assert np.isnan(frames.weighted_at(x, np.ones(5), at)[:2]).all() and frames.weighted_at(x, np.ones(5), at)[3] == pytest.approx(x[46:51].sum())
    assert not features._rises(np.array([5.0] * 6)) and features._rises(np.array([5.0, 5, 5, 5, 6])) and not features._rises(np.array([5.0, 6, 7, 8]))

"""Detector, labels, splits and groups against plain Python and by their properties."""

import datetime as dt

import numpy as np
import pytest
from barweave.operators import detect, evaluate, features, groups, labels, relational, screens, validation
from barweave.operators.indicators import with_indicators
from barweave.plans import labels as label_plans
from barweave.plans import setups as plans
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)
SF = "/root/testdata/sf0.001"


def day(i):
    return DAY + dt.timedelta(days=i)


def test_greedy_clusters(spark):
    df = spark.createDataFrame([([100.0, 95.0, 89.0, 50.0],)], "v array<double>")
    got = df.select(detect.cluster_levels(F.col("v"), 0.10).alias("c")).first()["c"]
    assert [(round(c["level"], 3), c["cnt"]) for c in got] == [(94.667, 3), (50.0, 1)]


def reference_setup(pivots, close, top, today, p):
    """The rules of the detector, one as-of bar at a time."""
    clusters = []
    for lvl in sorted((h for _, h in pivots), reverse=True):
        for c in clusters:
            mean = sum(c) / len(c)
            if abs(lvl - mean) / mean <= p.band:
                c.append(lvl)
                break
        else:
            clusters.append([lvl])
    found = []
    for c in clusters:
        r = sum(c) / len(c)
        dist = (r - close) / close
        hits = [d for d, h in pivots if abs(h - r) / r <= p.band]
        if len(c) < p.touches or not p.nearest <= dist <= p.farthest or len(hits) < p.touches:
            continue
        if p.off_high is not None and abs(r - top) / top * 100 > p.off_high:
            continue
        start = min(hits)
        if (today - start).days < p.base_days:
            continue
        if p.base_most and (today - start).days > p.base_most:
            recent = [d for d in hits if (today - d).days <= p.base_most]
            if len(recent) < p.touches:
                continue
            start = min(recent)
        found.append({"r": r, "touches": len(hits), "base_start": start, "len": (today - start).days, "dist": dist, "high": r >= 0.98 * top})
    if not found:
        return None
    if not p.scanner:
        return min(found, key=lambda c: (not c["high"], -c["touches"], abs(c["dist"])))
    best = min(found, key=lambda c: (-c["touches"], -c["len"], abs(c["dist"])))
    strong = [c for c in found if c["r"] > best["r"] * 1.02 and c["touches"] >= max(2, int(best["touches"] * 0.8)) and c["len"] >= int(best["len"] * 0.8)]
    return max(strong, key=lambda c: c["r"]) if strong else best


@pytest.mark.parametrize("p", [detect.Setup(), detect.SCANNER])
def test_detector(spark, p):
    ind = with_indicators(plans.walk_bars(spark, SF)).select("symbol", "n", "dt", "high", "close", "pivot3").cache()
    got = {(r["symbol"], r["n"]): r for r in detect.detect(ind, F.expr("n >= 250 and n % 7 = 0"), p).collect()}
    bars = ind.orderBy("symbol", "n").toPandas()
    seen = 0
    for s, b in bars.groupby("symbol"):
        b = b.reset_index(drop=True)
        for i in range(249, len(b)):
            if (i + 1) % 7:
                continue
            lo = max(0, i + 1 - p.lookback)
            piv = [(b.dt[j], b.high[j]) for j in range(lo + 3, i - 2) if b.high[j] == b.high[j - 3 : j + 4].iloc[:7].max()]
            want = reference_setup(piv, b.close[i], b.high[lo : i + 1].max(), b.dt[i], p) if len(piv) >= p.touches else None
            r = got.get((s, i + 1))
            assert (r is None) == (want is None), (s, i)
            if r:
                seen += 1
                assert (r["touches"], r["base_start"], r["base_len_days"], r["is_high"]) == (want["touches"], want["base_start"], want["len"], want["high"]) and r["r"] == pytest.approx(want["r"])
    assert seen == len(got) > 20


def test_barriers(spark):
    def outcome(path, **kw):
        bars = spark.createDataFrame([("A", i + 1, day(i), float(h), float(lo), float(c)) for i, (h, lo, c) in enumerate([(100, 100, 100), *path])], "symbol string, n int, dt date, high double, low double, close double")
        e = spark.createDataFrame([("A", 1, DAY, 100.0, 1.0, 101.0)], "symbol string, n int, dt date, close double, atr double, resistance double")
        return labels.triple_barrier(e, bars, **kw).collect()

    assert outcome([(110, 90, 100)])[0][2:6:3] == (-1, -1.0)  # both pierced: the stop first
    r = outcome([(104, 100, 100.5)] + [(101, 100, 100.5)] * 6)[0]
    assert (r["label"], r["r_multiple"], r["days_held"]) == (0, 3.0, 1)  # a spike without a close over the level
    assert outcome([(104, 100, 102)])[0]["label"] == 1
    r = outcome([(101, 99.5, 100.5)])[0]
    assert (r["label"], r["days_held"]) == (0, 1) and outcome([]) == []


def test_labels_use_only_the_future(spark):
    e, bars = label_plans.entries(spark, SF)
    one = e.filter("n = 300")
    a = {r["symbol"]: r for r in labels.triple_barrier(one, bars).collect()}
    b = {r["symbol"]: r for r in labels.triple_barrier(one, bars.filter("n > 300")).collect()}
    assert a == b and len(a) == 10


def test_cooldown(spark):
    ev = spark.createDataFrame([("A", day(i)) for i in (0, 3, 14, 15, 20, 30, 31)], "symbol string, dt date")
    assert sorted(r["dt"] for r in labels.cooldown(ev, 15).collect()) == [day(0), day(15), day(30)]


def test_uniqueness_and_folds(spark):
    sp = spark.createDataFrame([(1, day(1), day(2)), (2, day(2), day(3))], "id int, asof date, exit_date date")
    assert [r["weight"] for r in validation.uniqueness_weights(sp).collect()] == pytest.approx([1, 1])
    rows = spark.createDataFrame([(i, day(i), day(i + i % 9)) for i in range(300)], "id int, asof date, exit_date date")
    f = validation.purged_folds(rows, 4, 5).join(rows, "id").toPandas()
    for _, g in f.groupby("fold"):
        test, train = g[g.part == "test"], g[g.part == "train"]
        assert not ((train["asof"] <= test["asof"].max()) & (train.exit_date >= test["asof"].min())).any() and len(test) == 75
    assert abs(np.mean([r["weight"] for r in validation.uniqueness_weights(rows).collect()]) - 1) < 1e-9


def test_group_index_counts_missing_days_as_zero(spark):
    bars = spark.createDataFrame([("A", day(0), 100.0), ("A", day(1), 110.0), ("B", day(0), 50.0)], "symbol string, dt date, close double")
    members = spark.createDataFrame([("A", "g"), ("B", "g")], "symbol string, grp string")
    assert [r["level"] for r in groups.group_index(bars, members, 2, 1).orderBy("dt").collect()] == pytest.approx([100, 105])


def test_upsert_is_idempotent_and_new_rows_win(spark):
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    once = relational.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, relational.upsert(once, new, ["k"]).collect()))


def test_higher_lows(spark):
    lows = [20.0] * 40 + [10, 15, 14, 13, 11, 13, 14, 13, 10.5, 13, 14, 15, 12, 15, 16, 15, 11.5, 16, 15.5]
    df = spark.createDataFrame([("A", day(i), float(v)) for i, v in enumerate(lows)], "symbol string, dt date, low double")
    r = screens.higher_lows(df).first()
    assert (r["hl_base"], r["hl_count"]) == (10.0, 2)


def test_scores(spark):
    one = spark.range(1)
    f = {c: F.lit(0.0) for c in ("touches", "base_days", "higher_lows", "dist_pct", "dist_52w_high_pct", "vcr", "vdu", "dist_ema50_pct", "dist_ema200_pct", "ema200_slope_20", "rs_mansfield", "rs_slope_20")}
    assert one.select(detect.feature_score(f)).first()[0] == 20.0  # a distance to the high of exactly zero scores nothing
    assert one.select(detect.feature_score(f | {"dist_52w_high_pct": F.lit(1.5)})).first()[0] == pytest.approx(33.5)


def test_feature_rows(spark):
    assert len(features.columns()) == len(set(features.columns())) == 110
    rows = plans.feature_rows(spark, SF)
    assert rows.columns[3:] == features.columns() and set(t for _, t in rows.dtypes[3:]) == {"double"}
    p = rows.toPandas()
    assert len(p) > 50 and not p.duplicated(["symbol", "n"]).any() and p["wk_rsi_14"].notna().mean() > 0.9 and p["vcr"].between(-5, 1).all()


def test_weekly_stack_and_ranks(spark):
    bars = plans.walk_bars(spark, SF)
    asofs = bars.withColumn("n", F.expr("row_number() OVER (PARTITION BY symbol ORDER BY dt)").cast("long")).filter("n >= 400 and n % 37 = 0")
    got = {(r["symbol"], r["n"]): r["wk_ema_stack"] for r in features.weekly(bars, asofs.select("symbol", "n", "dt")).collect()}
    p = bars.orderBy("symbol", "dt").toPandas()
    p["dt"] = p["dt"].astype("datetime64[ns]")
    want = {}
    for symbol, b in p.groupby("symbol"):
        b = b.reset_index(drop=True)
        for n in range(407, len(b) + 1, 37):
            c = b[:n].set_index("dt").close.resample("W-FRI").last().dropna()
            e10, e30 = (c.ewm(span=k).mean().iloc[-1] for k in (10, 30))
            want[symbol, n] = float(c.iloc[-1] > e10 > e30)
    assert got == want and set(got.values()) == {0.0, 1.0}
    ranks = plans.feature_rows(spark, SF).select("fund_marketCap_rank_sector", "fund_trailingPE_rank_all").toPandas()
    assert ranks.max().max() <= 1 and ranks.notna().any().all()


def test_weekly_rows_equal_pandas(spark):
    """All ten weekly columns of every as-of bar, from weeks resampled for each bar by itself."""
    bars = plans.walk_bars(spark, SF)
    asofs = bars.withColumn("n", F.expr("row_number() OVER (PARTITION BY symbol ORDER BY dt)").cast("long")).filter("n >= 60 and n % 41 = 0")
    got = {(r["symbol"], r["n"]): r for r in features.weekly(bars, asofs.select("symbol", "n", "dt")).collect()}
    p = bars.orderBy("symbol", "dt").toPandas()
    p["dt"] = p["dt"].astype("datetime64[ns]")
    seen = 0
    for symbol, b in p.groupby("symbol"):
        b = b.reset_index(drop=True)
        for n in range(82, len(b) + 1, 41):
            w = b[:n].set_index("dt").resample("W-FRI").agg({"high": "max", "low": "min", "close": "last", "volume": "sum"}).dropna()
            if len(w) < 30:
                assert (symbol, n) not in got
                continue
            c, h, low, v = w["close"], w["high"], w["low"], w["volume"]
            d, up, down = c.diff(), h.diff(), -low.diff()
            tr = np.maximum(h - low, np.maximum((h - c.shift()).abs().fillna(0), (low - c.shift()).abs().fillna(0)))
            pdm, mdm = up.where((up > down) & (up > 0), 0.0)[1:].rolling(14).mean(), down.where((down > up) & (down > 0), 0.0)[1:].rolling(14).mean()
            dx = 100 * (pdm - mdm).abs() / (pdm + mdm)
            e10, e30 = (c.ewm(span=k).mean().iloc[-1] for k in (10, 30))
            x = np.arange(12) - 5.5
            want = {
                "wk_rsi_14": 100 - 100 / (1 + d.clip(lower=0)[-14:].mean() / (-d.clip(upper=0))[-14:].mean()), "wk_adx_14": dx[-14:].mean(), "wk_ema_stack": float(c.iloc[-1] > e10 > e30),
                **{f"wk_roc_{k}": (c.iloc[-1] / c.iloc[-1 - k] - 1) * 100 for k in (4, 12, 26)}, "wk_dist_52w_high_pct": (h[-52:].max() - c.iloc[-1]) / h[-52:].max() * 100,
                "wk_vdu": 1 - v[-4:].mean() / v[-20:].mean(), "wk_higher_lows": float((x * c[-12:].to_numpy()).sum() > 0), "wk_ttm_squeeze": float(2 * c[-20:].std() < 1.5 * tr[-20:].mean()),
            }
            seen += 1
            for name, value in want.items():
                assert got[symbol, n][name] == pytest.approx(value, abs=1e-7), (symbol, n, name)
    assert seen > 50 and len(got) == seen


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, prob double")
    assert evaluate.auc(df).first()[0] == pytest.approx(0.875) and evaluate.average_precision(df).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)

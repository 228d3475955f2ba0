"""The screen with all its gates against plain Python."""

from collections import Counter

import datetime as dt

from barweave.plans import setups as plans
from barweave.sources.fixtures import fundamentals

SF = "/root/testdata/sf0.01"
ASOF = dt.date(1999, 6, 30)


def higher_lows(lows):
    base = lows.index(min(lows))
    top, found = lows[base], 0
    for i in range(max(3, base + 1), len(lows) - 3):
        if lows[i] <= min(lows[i - 3 : i]) and lows[i] <= min(lows[i + 1 : i + 4]) and lows[i] > top:
            top, found = lows[i], found + 1
    return found + (min(lows[-3:]) > top)


def reason(b, cap, index):
    year = b[b.dt >= ASOF - dt.timedelta(days=365)]
    close = list(b.close)
    pct = lambda x: (close[-1] - x) / x * 100
    if close[-1] < 45:
        return "price"
    if year.empty:
        return "no_52w_high"
    if not -21 <= pct(year.high.max()) <= -2:
        return "band52w"
    if pct(year.low.min()) <= 20:
        return "low52w"
    if pct(year.close.iloc[0]) > 54:
        return "runup"
    if len(close) >= 50 and pct(close[-50]) <= index:
        return "rs"
    if len(close) < 200:
        return "short_history"
    if close[-1] <= sum(close[-200:]) / 200:
        return "below_200dma"
    if higher_lows(list(b.low)[-50:]) < 2:
        return "no_higher_lows"
    return "no_mcap" if cap is None else None if 350 <= cap <= 34000 else "mcap"


def test_screen_with_all_gates(spark):
    bars = plans.walk_bars(spark, SF).filter(f"dt <= DATE '{ASOF}'").orderBy("symbol", "dt").toPandas()
    caps = {r["symbol"]: r["market_cap"] for r in fundamentals(spark, SF).collect()}
    ret = bars.assign(ret=bars.groupby("symbol").close.pct_change()).groupby("dt").ret.mean().dropna()
    level = list(100 + ret.sort_index().cumsum() * 100)
    index = (level[-1] / level[-50] - 1) * 100
    want = {s: reason(b, caps[s], index) for s, b in bars.groupby("symbol")}
    got = {r["symbol"]: r["drop_reason"] for r in plans.pct_down_full(spark, SF).collect()}
    assert got == want and "low52w" in got.values()
    loose = {r["symbol"]: r["drop_reason"] for r in plans.pct_down(spark, SF).collect()}
    assert Counter(loose.values()) != Counter(got.values())
    print(sorted(Counter(map(str, loose.values())).items()), sorted(Counter(map(str, got.values())).items()), index)

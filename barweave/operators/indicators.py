"""Bar indicators as window expressions, evaluated in stages over one ordering.

Every frame is over (symbol, dt), so Spark sorts once per symbol and all stages share the exchange.
A stage may use the columns of the stages before it. ``full`` gives null until a frame holds n
values; ``tail`` takes what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = "PARTITION BY symbol ORDER BY dt"
RUN = f"({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def frame(n: int, end: str = "CURRENT ROW") -> str:
    return f"({BY} ROWS BETWEEN {n - 1} PRECEDING AND {end})"


def tail(agg: str, x: str, n: int) -> str:
    return f"{agg}({x}) OVER {frame(n)}"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {agg}({x}) OVER {frame(n)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({BY})"


def roc(x: str, k: int) -> str:
    """Percent change over k rows, null in the first k."""
    return f"({x} / nullif({lag(x, k)}, 0) - 1) * 100"


def slope(y: str, x: str, n: int) -> str:
    """Least-squares slope of the last n values on their row number; 0 under five values."""
    return f"CASE WHEN count({y}) OVER {frame(n)} >= 5 THEN regr_slope({y}, {x}) OVER {frame(n)} ELSE CAST(0 AS DOUBLE) END"


#: Rows of a block of the exponential means. Inside a block weights are powers up to its length, which doubles hold
#: for spans of 9 to 50 (first size) and 200 (second); across blocks only the value at the end of the one before counts,
#: as the weight of any earlier one is below 1e-23.
BLOCKS = {"": 1344, "2": 16384}


def decayed(name: str, x: str, q: str, block: str = "") -> tuple[dict[str, str], dict[str, str], str]:
    """Stages of the sum of x * q**(rows ago): inside the row's block, carried from the block before, and both together."""
    size, k = BLOCKS[block], f"k{block}"
    inside = f"(PARTITION BY symbol, blk{block} ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    local = {f"{name}_in": f"pow({q}, {k}) * sum({x} * pow({q}, -{k})) OVER {inside}"}
    carry = {f"{name}_to": f"max_by({name}_in, CASE WHEN {k} = {size - 1} THEN n END) OVER {before}"}
    return local, carry, f"({name}_in + pow({q}, {k} + 1) * coalesce({name}_to, 0))"


def ema(name: str, x: str, span: int, block: str = "") -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Exponential mean with normalised weights (weights sum to one from the first row on)."""
    q = f"(CAST({span - 1} AS DOUBLE) / {span + 1})"
    local, carry, total = decayed(name, x, q, block)
    return local, carry, {name: f"{total} * (1 - {q}) / (1 - pow({q}, n))"}


def smoothed(name: str, x: str, alpha: str, first: int) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Recursive smoothing y = (1-alpha) y + alpha x that starts with the value of row ``first``."""
    local, carry, total = decayed(name, f"CASE WHEN n = {first} THEN {x} WHEN n > {first} THEN {alpha} * {x} END", f"(1 - {alpha})")
    return local, carry, {name: f"CASE WHEN n >= {first} THEN {total} END"}


NUMBERED = {f"blk{b}": f"CAST(floor((n - 1) / {size}) AS BIGINT)" for b, size in BLOCKS.items()} | {f"k{b}": f"(n - 1) % {size}" for b, size in BLOCKS.items()}
A14 = "(CAST(1 AS DOUBLE) / 14)"
_MEANS = [
    ema("ema20", "close", 20), ema("ema50", "close", 50), ema("ema200", "close", 200, "2"),
    smoothed("ema9r", "close", "(CAST(2 AS DOUBLE) / 10)", 1), smoothed("ema21r", "close", "(CAST(2 AS DOUBLE) / 22)", 1),
    smoothed("watr14", "tr", A14, 1), smoothed("wup14", "up", A14, 2), smoothed("wdn14", "dn", A14, 2),
]
LOCAL, CARRY, MEANS = ({k: v for m in _MEANS for k, v in m[i].items()} for i in range(3))

STAGES: list[dict[str, str]] = [
    {
        "n": f"row_number() OVER ({BY})", "bars_total": "count(*) OVER (PARTITION BY symbol)",
        "pc": lag("close"), "ph": lag("high"), "pl": lag("low"), "lag5": lag("close", 5),
    },
    {
        **NUMBERED,
        "dlt": "close - pc", "ret": "close / nullif(pc, 0) - 1", "rng": "high - low", "dv": "close * volume",
        "tr": "greatest(high - low, abs(high - pc), abs(low - pc))",
        "up": "CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END", "dn": "CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END",
        "pdm": "CASE WHEN ph IS NULL THEN NULL WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END",
        "mdm": "CASE WHEN ph IS NULL THEN NULL WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END",
        "sv": "CASE WHEN pc IS NULL THEN 0 ELSE sign(close - pc) * volume END",
        "down_v": "CASE WHEN close < pc THEN volume END", "up_day": "CASE WHEN close > pc THEN 1 ELSE 0 END",
        "pivot3": f"high = max(high) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AND count(high) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7",
        "pivot8": f"high = max(high) OVER ({BY} ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AND count(high) OVER ({BY} ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) = 17",
        "swing_low3": f"low <= min(low) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND low <= min(low) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AND count(low) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7",
        "low11": f"low = min(low) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AND count(low) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 11",
    },
    {
        **{f"ma{k}": full("avg", "close", k) for k in (10, 20, 50, 200)},
        "sd20": full("stddev_samp", "close", 20), "atr14": full("avg", "tr", 14), "atr20": full("avg", "tr", 20),
        "v5": tail("avg", "volume", 5), "v10": tail("avg", "volume", 10), "v20": tail("avg", "volume", 20), "v50": full("avg", "volume", 50), "v20_full": full("avg", "volume", 20),
        "up14": full("avg", "up", 14), "dn14": full("avg", "dn", 14), "pdm14": full("avg", "pdm", 14), "mdm14": full("avg", "mdm", 14),
        "obv": f"sum(sv) OVER {RUN}", **LOCAL,
        "hi252": tail("max", "high", 252), "lo252": tail("min", "low", 252), "chi252": tail("max", "close", 252), "clo252": tail("min", "close", 252), "c50max": tail("max", "close", 50), "c100max": tail("max", "close", 100),
        "rng7max": f"max(rng) OVER ({BY} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)", "down_v_max": f"max(down_v) OVER ({BY} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)",
        "base_v": f"avg(volume) OVER ({BY} ROWS BETWEEN 27 PRECEDING AND 3 PRECEDING)",
        "hl20": f"{tail('avg', 'rng / close', 20)} * 100", "dv50": f"{full('avg', 'dv', 50)} / 1e7", "amihud20": f"{tail('avg', 'abs(ret) / nullif(dv, 0)', 20)} * 1e7",
        "max_move5": tail("max", "abs(ret)", 5), "last_stop": f"max(CASE WHEN up_day = 0 THEN n END) OVER {RUN}",
        "c30_mean": tail("avg", "close", 30), "c30_sd": tail("stddev_samp", "close", 30), "c30_slope": slope("close", "n", 30), "low20": tail("min", "low", 20),
        "h15max": tail("max", "high", 15), "fwd_low5": f"min(close) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)",
    },
    CARRY,
    MEANS,
    {
        "rsi14": "100 - 100 / (1 + up14 / nullif(dn14, 0))", "wrsi14": "100 - 100 / (1 + wup14 / nullif(wdn14, 0))",
        "dx": "100 * abs(pdm14 - mdm14) / nullif(pdm14 + mdm14, 0)", "bbw": "4 * sd20 / nullif(ma20, 0)",
        "bb_pos": "(close - (ma20 - 2 * sd20)) / greatest(4 * sd20, 1e-9)",
        "sq": "CASE WHEN coalesce(ma20 + 2 * sd20 < ma20 + 1.5 * atr20 AND ma20 - 2 * sd20 > ma20 - 1.5 * atr20, false) THEN 1 ELSE 0 END",
        "atr14_10": tail("avg", "atr14", 10), "obv_max50": tail("max", "obv", 50),
        "obv_s10": slope("obv", "n", 10), "obv_s20": slope("obv", "n", 20), "obv_s50": slope("obv", "n", 50), "obv_s100": slope("obv", "n", 100),
        "ema200_s20": slope("ema200", "n", 20), "ma50_s20": slope("ma50", "n", 20), "ma200_s20": slope("ma200", "n", 20),
        "up_run": "least(n - coalesce(last_stop, 0), 15)",
    },
    {
        "adx14": full("avg", "dx", 14), "bbw_mean": tail("avg", "bbw", 100), "bbw_sd": tail("stddev_samp", "bbw", 100),
        "sq_density": tail("avg", "sq", 20), "last_off": f"max(CASE WHEN sq = 0 THEN n END) OVER {RUN}", "last_on": f"max(CASE WHEN sq = 1 THEN n END) OVER {RUN}",
    },
    {
        "bbw_z": "(bbw - bbw_mean) / (bbw_sd + 1e-9)", "sq_run": "least(n - coalesce(last_off, 0), 50)",
        "since_release": "CASE WHEN last_on IS NULL OR n - last_on >= 30 THEN 0 ELSE n - last_on END",
    },
]


def with_indicators(bars: DataFrame, stages: int | None = None) -> DataFrame:
    """``bars`` with the columns of all stages; unused ones are pruned by Catalyst."""
    return staged(bars, *STAGES[:stages])


def staged(rows: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of the stages added one after the other."""
    for stage in stages:
        rows = rows.select("*", *[F.expr(e).alias(a) for a, e in stage.items()])
    return rows


def staged_sql(source: str = "bars") -> str:
    """The same stages as common table expressions i1, i2, …; the last is ``ind``."""
    out, at = [], source
    for k, stage in enumerate(STAGES, 1):
        name = "ind" if k == len(STAGES) else f"i{k}"
        out.append(f"{name} AS (SELECT *, {', '.join(f'{e} AS {a}' for a, e in stage.items())} FROM {at})")
        at = name
    return ",\n".join(out)

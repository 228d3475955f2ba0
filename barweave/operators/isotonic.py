"""Isotonic calibration by pooling adjacent violators as a merge.

Pooling is associative over neighbouring stretches of the score line: a stretch is summed up by its pooled blocks, and pooling
the blocks of two neighbours gives what pooling their rows would. So every range partition pools its own scores, and the block
lists are merged in a tree of ``FAN`` neighbours a task until one list is left. Blocks are few: outcomes of 0 and 1 over n
rows make at most some n^(2/3).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16
MOST = 1_000_000  # blocks that are broadcast; beyond, blocks with the same rate to six digits are one
_BLOCKS = pa.schema([("part", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("w", pa.float64()), ("wy", pa.float64())])


def pool(blocks: Iterator[tuple[float, float, float, float]]) -> list[list[float]]:
    """Blocks (lo, hi, weight, weighted sum) in ascending order, neighbours pooled until their means ascend."""
    out: list[list[float]] = []
    for lo, hi, w, wy in blocks:
        out.append([lo, hi, w, wy])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, top, w2, wy2 = out.pop()
            last = out[-1]
            last[1], last[2], last[3] = top, last[2] + w2, last[3] + wy2
    return out


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, lo, hi, w, wy in order of part and lo; one part's blocks at a time."""

    def packed(part, held):
        columns = list(zip(*pool(iter(held)), strict=True))
        return pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.int32()), *(pa.array(c, pa.float64()) for c in columns)], schema=_BLOCKS)

    now, held = None, []
    for b in batches:
        for part, *block in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != now:
                if held:
                    yield packed(now, held)
                now, held = part, []
            held.append(block)
            if len(held) > 65536:
                held = pool(iter(held))
    if held:
        yield packed(now, held)


def fit(scored: DataFrame, col: str, label: str = "y", weight: str | None = None) -> DataFrame:
    """lo, hi, rate, w: blocks of ascending scores with ascending mean outcomes.

    Defined cases: rows with a null or NaN score, label or weight, or weight 0, take no part; equal scores are one; an empty
    table gives no blocks.
    """
    x, y, w = F.col(col).cast("double"), F.col(label).cast("double"), (F.col(weight) if weight else F.lit(1.0)).cast("double")
    usable = scored.filter(x.isNotNull() & ~F.isnan(x) & y.isNotNull() & w.isNotNull() & (w > 0))
    own = usable.groupBy(x.alias("lo")).agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = own.repartitionByRange(parts, "lo").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "lo")
    ddl = "part int, lo double, hi double, w double, wy double"
    blocks = ranged.select("part", "lo", F.col("lo").alias("hi"), "w", "wy").mapInArrow(_pooled, ddl)
    while parts > 1:
        parts = -(-parts // FAN)
        merged = blocks.withColumn("part", F.expr(f"part div {FAN}").cast("int")).repartition(parts, "part").sortWithinPartitions("part", "lo")
        blocks = merged.select("part", "lo", "hi", "w", "wy").mapInArrow(_pooled, ddl)
    return blocks.select("lo", "hi", (F.col("wy") / F.col("w")).alias("rate"), "w")


def steps(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The map's corners: scores and rates, of bounded number."""
    t = blocks.limit(MOST + 1).toArrow()
    if t.num_rows > MOST:
        same = blocks.groupBy(F.round("rate", 6).alias("r"))
        t = same.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum(F.col("rate") * F.col("w")) / F.sum("w")).alias("rate")).toArrow()
    lo, hi, rate = (t[c].to_numpy() for c in ("lo", "hi", "rate"))
    order = np.argsort(lo, kind="stable")
    at, value = np.stack([lo[order], hi[order]], axis=1).ravel(), np.repeat(rate[order], 2)
    keep = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    return at[keep], value[keep]


def apply(rows: DataFrame, col: str, corners: tuple[np.ndarray, np.ndarray], name: str) -> DataFrame:
    """``rows`` with the calibrated score: constant in a block, linear between blocks, flat beyond the scores seen; null for a
    null score or an empty map."""
    shared = rows.sparkSession.sparkContext.broadcast(corners)

    @F.pandas_udf("double")
    def calibrated(x: pd.Series) -> pd.Series:
        at, value = shared.value
        return pd.Series(np.where(x.isna(), np.nan, np.interp(x.to_numpy(float), at, value)) if len(at) else np.full(len(x), np.nan))

    return rows.withColumn(name, F.nanvl(calibrated(F.col(col).cast("double")), F.lit(None).cast("double")))

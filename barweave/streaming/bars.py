"""Streams of bars and events. The batch engine has none; these carry its incremental steps over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.relational import keep_one, upsert
from ..sources import storage


def upsert_sink(path: str, keys: list[str], tiebreak: str):
    """A foreachBatch function that merges every batch into a Parquet table, newer rows first. Tables are versioned folders,
    so a failed batch leaves the last one whole; versions before the one that a batch has read go once it is written. Every
    batch writes the whole table: for large ones take ``upsert_latest``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(fs_path)) if fs.exists(fs_path) else []
        versions = [v for v in versions if v < batch_id]
        new = batch.dropDuplicates(keys + [tiebreak])
        merged = upsert(spark.read.parquet(f"{path}/v{versions[-1]}"), new, keys, [F.col(tiebreak).desc()]) if versions else upsert(new.limit(0), new, keys, [F.col(tiebreak).desc()])
        merged.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        for v in versions[:-1]:
            storage.delete(spark, f"{path}/v{v}")

    return merge


def upsert_latest(path: str, keys: list[str], order: str, buckets: int = 16):
    """A foreachBatch function that keeps the newest row of each key in hash buckets, one folder each. A batch rewrites
    only the buckets it touches, from a staged copy, so a batch that fails is repeated with the same result."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
            new = new.unionByName(old.select(*new.columns))
        newest = keep_one(new, keys, [F.col(order).desc()])
        staged = f"{path}-batch-{batch_id}"
        newest.write.mode("overwrite").parquet(staged)
        out = spark.read.parquet(staged).write.mode("overwrite").partitionBy("bucket")
        out.option("partitionOverwriteMode", "dynamic").parquet(path)
        storage.delete(spark, staged)

    return merge


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a zone; wall-clock ones are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_totals(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Tumbling weeks that end on Friday midnight, late rows up to ``delay``."""
    w = F.window("ts", "7 days", "7 days", "2 days")
    return _timed(events).withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("week_start"), "event_type", "n", "total")


def first_seen(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Duplicates of an event dropped within the watermark (the first one stays)."""
    return _timed(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def cooldown(events: DataFrame, days: int = 15) -> DataFrame:
    """Per user, the events at least ``days`` days after the last one kept, with the kept time as state."""

    def keep(key, batches: Iterator[pd.DataFrame], state):
        last = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            if last is None or (r.ts.normalize() - last).days >= days:
                last = r.ts.normalize()
                out.append({"user_id": r.user_id, "event_id": r.event_id, "ts": r.ts})
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts"])

    return _timed(events).select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(keep, "user_id long, event_id long, ts timestamp", "last timestamp", "append", GroupStateTimeout.NoTimeout)

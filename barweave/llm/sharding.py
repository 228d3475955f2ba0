"""Sharding: contiguous byte-balanced shards from global prefix sums.

Documents are put into one global order (doc_id, then content), range-partitioned by it and
written once as narrow rows. Per-partition totals give every partition its offset; the running
sum inside a partition is a window over that partition only. A document goes to the shard in
which the middle of its byte interval falls when [0, total) is cut at equal targets, so every
shard misses its target by less than the largest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LAW = "bytes"


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards are contiguous in doc_id and near equal in bytes. A group of equal texts is
    not held together by it; its documents lie where their doc_ids place them.

    Defined cases: a null text has size ``overhead`` and the crc32 of nothing (0); a null doc_id
    sorts first; repeated rows are separate rows placed side by side; an empty table gives no rows;
    fewer documents than shards leave shards empty; other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),  # spreads rows that are equal in all else
    )
    order = ["doc_id", "text_crc32", "size", "at"]
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(
        narrow.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard_rows"
    )
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    everything = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        dealt.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(inside).alias("n"))
        .join(F.broadcast(offsets), "part")  # a row per shuffle partition
        .select(
            "doc_id", "size", "text_crc32",
            (F.col("rows_before") + F.col("n") - 1).alias("row"),
            F.expr(f"cast(least({n_shards - 1}, (2 * (bytes_before + upto) - size) * {n_shards} div (2 * total)) as int)").alias("shard"),
        )
    )
    placed = written(placed, "shard_placed")
    starts = placed.groupBy("shard").agg(F.min("row").alias("start"))  # n_shards rows at most
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("row") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

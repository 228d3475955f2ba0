"""Landed candles as a Spark data source, in batch and as a stream.

A fetch lands what it got as one batch: Parquet files below ``batch=<number>/grp=<group>`` of the landing folder, the group a hash of
the ticker. A batch is there once its ``_SUCCESS`` marker is, so an interrupted fetch is not seen. The batch reader makes a
partition per ticker group and reads only the groups and days that the query's filters leave; a ticker that was never landed is an
empty result. As a stream the offset is the number of the last batch read, so a load that was stopped goes on with the next batch,
without repeats or loss.
"""

from __future__ import annotations

import datetime as dt
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

SCHEMA = "ticker string, dt date, open double, high double, low double, close double, volume double, batch long"
COLUMNS = ["ticker", "dt", "open", "high", "low", "close", "volume"]
GROUPS = 8
_ARROW = pa.schema([("ticker", pa.string()), ("dt", pa.date32()), *((c, pa.float64()) for c in COLUMNS[2:]), ("batch", pa.int64())])


def group_of(ticker: str, groups: int = GROUPS) -> int:
    return zlib.crc32(ticker.encode()) % groups


def land(candles: DataFrame, path: str, batch: int, groups: int = GROUPS) -> None:
    """One batch of candles; the last row of a ticker and day in it stands. Landing a batch again replaces it."""
    rows = candles.filter("ticker is not null and dt is not null").select(*COLUMNS, F.pmod(F.crc32(F.col("ticker").cast("binary")), F.lit(groups)).cast("int").alias("grp"))
    rows.repartition("grp").write.mode("overwrite").partitionBy("grp").parquet(f"{path}/batch={batch}")


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def landed(path: str) -> list[int]:
    """The numbers of the batches that are complete."""
    fs, root = _at(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=False))
    names = {int(m[1]): f.path for f in found if (m := re.fullmatch(r"batch=(\d+)", f.base_name))}
    marks = fs.get_file_info([f"{p}/_SUCCESS" for p in names.values()]) if names else []
    return sorted(b for b, m in zip(names, marks, strict=True) if m.type == pafs.FileType.File)


class _Part(InputPartition):
    def __init__(self, batches: list[int], group: int):
        self.batches, self.group = batches, group


def _read(path: str, part: _Part, tests: list[tuple[str, str, object]]) -> Iterator[pa.RecordBatch]:
    """The rows of one group of some batches, a record batch at a time."""
    fs, root = _at(path)
    want = None
    for column, op, value in tests:
        f = ds.field(column)
        test = f.isin(value) if op == "in" else {"=": f == value, ">": f > value, ">=": f >= value, "<": f < value, "<=": f <= value}[op]
        want = test if want is None else want & test
    for b in part.batches:
        folder = f"{root}/batch={b}/grp={part.group}"
        if fs.get_file_info(folder).type != pafs.FileType.Directory:
            continue
        for chunk in ds.dataset(folder, filesystem=fs, format="parquet").to_batches(columns=COLUMNS, filter=want, batch_size=8192):
            if chunk.num_rows:
                columns = [pc.cast(chunk.column(c), _ARROW.field(c).type) for c in COLUMNS]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([b] * chunk.num_rows, pa.int64())], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, path: str, groups: int):
        self.path, self.groups, self.tests = path, groups, []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of ticker and day are done while reading; others go back to Spark."""
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("ticker",) and isinstance(f, EqualTo) or column == ("dt",) and type(f) in ops and isinstance(f.value, dt.date):
                self.tests.append((column[0], ops[type(f)], f.value))
            elif column == ("ticker",) and isinstance(f, In):
                self.tests.append(("ticker", "in", list(f.value)))
            else:
                yield f

    def partitions(self):
        groups = set(range(self.groups))
        for column, op, value in self.tests:
            if column == "ticker":
                groups &= {group_of(t, self.groups) for t in ([value] if op == "=" else value) if t is not None}
        batches = landed(self.path)
        return [_Part(batches, g) for g in sorted(groups)] if batches and groups else [_Part([], 0)]

    def read(self, partition: _Part):
        return _read(self.path, partition, self.tests)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, groups: int):
        self.path, self.groups = path, groups

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(landed(self.path), default=-1)}

    def partitions(self, start: dict, end: dict):
        batches = [b for b in landed(self.path) if start["batch"] < b <= end["batch"]]
        return [_Part(batches, g) for g in range(self.groups)]

    def read(self, partition: _Part):
        return _read(self.path, partition, [])


class CandleSource(DataSource):
    """``spark.read.format("candles").load(folder)``; option ``groups`` as the batches were landed with."""

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("groups", GROUPS)))

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], int(self.options.get("groups", GROUPS)))


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CandleSource)
    return spark


def read(spark: SparkSession, path: str, groups: int = GROUPS) -> DataFrame:
    """All landed rows with their batch."""
    return _registered(spark).read.format("candles").option("groups", groups).load(path)


def stream(spark: SparkSession, path: str, groups: int = GROUPS) -> DataFrame:
    return _registered(spark).readStream.format("candles").option("groups", groups).load(path)


def latest(rows: DataFrame) -> DataFrame:
    """The last batch's row of every ticker and day, in COLUMNS; repeats inside a batch go to the greatest row."""
    kept = Window.partitionBy("ticker", "dt").orderBy(F.desc("batch"), *[F.desc(c) for c in COLUMNS[2:]])
    return rows.withColumn("_k", F.row_number().over(kept)).filter("_k = 1").select(*COLUMNS)


def fetch(spark: SparkSession, path: str, tickers: list[str] | None, start: dt.date | None = None, end: dt.date | None = None, groups: int = GROUPS) -> DataFrame:
    """Candles of some tickers (None: all) from ``start`` to ``end``, repeats resolved; empty where nothing was landed."""
    rows = read(spark, path, groups)
    rows = rows.filter(F.col("ticker").isin(tickers)) if tickers is not None else rows
    rows = rows.filter(F.col("dt") >= F.lit(start)) if start else rows
    return latest(rows.filter(F.col("dt") <= F.lit(end)) if end else rows)


def load(spark: SparkSession, path: str, table: str, checkpoint: str, groups: int = GROUPS) -> None:
    """Append all batches that were landed since the last load to the Parquet table ``table``; a load that was stopped is
    finished by the next one over the same checkpoint."""
    q = stream(spark, path, groups).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

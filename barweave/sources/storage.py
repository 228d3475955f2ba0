"""Folders that executors share, and files by name for small artefacts."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; a temporary one only where the driver is its own executor."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barweave_")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet (with the writer's ``options``) below the shared folder and read back: its lineage ends with files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder with all in it, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def put_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small text as a folder with one part."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def typed_config(text: str) -> dict:
    """Nested ``key: value`` lines (two-space indents, comments, inline lists) as typed values: the YAML subset that
    the engine's settings use."""
    root: dict = {}
    stack = [(-1, root)]
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = _typed(value.strip())
        else:
            stack[-1][1][key.strip()] = {}
            stack.append((depth, stack[-1][1][key.strip()]))
    return root


def _typed(value: str):
    if value.startswith("[") and value.endswith("]"):
        return [_typed(x.strip()) for x in value[1:-1].split(",") if x.strip()]
    plain = {"true": True, "false": False, "null": None, "~": None, "yes": True, "no": False}
    if value.lower() in plain:
        return plain[value.lower()]
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value.strip("'\"")


def config(spark: SparkSession, path: str) -> dict:
    """A settings file as nested typed values."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]  # one small file
    return typed_config("\n".join(lines))


def flat(settings: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted key, JSON value) of every leaf."""
    out: list[tuple[str, str]] = []
    for k, v in settings.items():
        out += flat(v, f"{prefix}{k}.") if isinstance(v, dict) else [(f"{prefix}{k}", json.dumps(v))]
    return out


def save_group_index(index: DataFrame, path: str) -> None:
    """Index levels, a folder per group, so that a reader of few groups opens few files."""
    index.repartition("grp").sortWithinPartitions("grp", "dt").write.mode("overwrite").partitionBy("grp").parquet(path)


def load_group_index(spark: SparkSession, path: str, groups: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).select(F.col("grp").cast("string").alias("grp"), "dt", "level")
    return df if groups is None else df.filter(F.col("grp").isin(groups))


class Cache:
    """Tables kept for ``seconds``: a table younger than that is read, an older or missing one is made again."""

    def __init__(self, spark: SparkSession, root: str, seconds: float):
        self.spark, self.root, self.seconds = spark, root, seconds

    def get(self, name: str, now: float, make) -> DataFrame:
        stamps = f"{self.root}/{name}/stamp"
        if exists(self.spark, stamps):
            made, at = self.spark.read.parquet(stamps).select("made", "at").first()
            if now - made < self.seconds:
                return self.spark.read.parquet(at)
        at = f"{self.root}/{name}/v-{uuid.uuid4().hex}"
        make().write.parquet(at)
        self.spark.createDataFrame([(float(now), at)], "made double, at string").coalesce(1).write.mode("overwrite").parquet(stamps)
        return self.spark.read.parquet(at)

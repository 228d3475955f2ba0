"""Helpers that the operators share: written tables, checked broadcasts, Bloom filters."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes up to which a table may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: What a row takes in a broadcast table besides its values.
ROW_BYTES = 32


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a temporary folder serves a driver that is
    its own executor (tests); on a cluster executors could not see one, so it is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="barweave_")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage
    with a copy that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def row_bytes(df: DataFrame):
    """Bytes of a row as a column: text and binary by length, arrays by 8 a value."""

    def width(name: str, kind: str):
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        return F.coalesce(F.size(name) * 8, F.lit(0)) if kind.startswith("array") else F.lit(8 * (kind.count(":") or 1))

    return sum((width(*x).cast("long") for x in df.dtypes), F.lit(ROW_BYTES).cast("long"))


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether ``df`` (a written table, as it is read once for this) takes ``most`` bytes or less."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def checked(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it fits ``most`` bytes, else as it is."""
    return F.broadcast(df) if fits(df, most) else df


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer with good avalanche on uint64 arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unmix64(h: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        h = h ^ (h >> np.uint64(shift)) ^ (h >> np.uint64(2 * shift))
        h = h * np.uint64(pow(factor, -1, 1 << 64))
    return h


def bloom_bits(n: int, most: int = 29) -> int:
    """log2 of the bits of a filter for ``n`` hashes: 32 to 64 for each, up to 2**most (64 MB). A fuller
    filter lets more candidates pass and loses none."""
    return min(most, max(16, (32 * n).bit_length()))


def bloom_words(hashes: DataFrame, column: str, bits_log2: int) -> np.ndarray:
    """Bit array of 2**bits_log2 bits with the low bits of every hash set; bounded by ``bloom_bits``, so it
    may be collected and broadcast."""
    low = F.col(column).bitwiseAND(F.lit((1 << bits_log2) - 1))
    rows = (
        hashes.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(1 << (bits_log2 - 6), np.uint64)
    t = rows.toArrow()
    if t.num_rows:
        out[t["w"].to_numpy()] = t["b"].to_numpy().view(np.uint64)
    return out


def in_bloom(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which uint64 hashes may be in the filter (never false for a member)."""
    low = h & np.uint64(len(words) * 64 - 1)
    return (words[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) != 0


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def trimmed() -> None:
    """Give memory that a task has freed back to the system, as workers stay for later tasks of other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Views of at most ``rows`` rows, so that only their texts are held as Python objects at once; what is
    freed goes back to the system at the end."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    trimmed()


def rows_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")

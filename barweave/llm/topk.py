"""Exact top-k search by inner product.

Vectors become integers once, of 16, 32 or 64 bits as their block needs. Rows of a partition are packed into blocks of
bounded bytes, and blocks are dealt into groups, as many as their bytes need for a task to hold one. Every query tile meets
every block exactly once: tiles are streamed past the blocks of a group, one product at a time. A block keeps k
rows per query by partial selection (whole ties at the cut are kept and sorted by id), and the per-query lists
are merged as a tree: over the blocks of a group, then within groups of groups, then over these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, slices, written

#: Rows of a block and of a query tile; bytes of either.
BLOCK_ROWS, TILE_ROWS, BLOCK_BYTES = 8192, 512, 4 << 20
#: Bytes of a group's blocks, which its task holds; vectors are counted at 16 bits a component.
GROUP_BYTES = 64 << 20
#: Components from here on, whose multiple of 1024 no long holds, travel as decimal text.
WIDE = 2.0**52
_PACKED = "key long, kind int, n int, dim int, width int, ids binary, data binary"
_PACKED_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("grp", pa.int64())])


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as int64, or as Python integers where a component is WIDE."""
    if not (np.abs(x) >= WIDE).any():
        return np.floor(x * 1024).astype(np.int64)
    far = np.abs(x) >= WIDE  # such doubles are whole numbers
    out = np.empty(x.shape, object)
    out[far] = [int(v) * 1024 for v in x[far].tolist()]
    out[~far] = np.floor(x[~far] * 1024).astype(np.int64).tolist()
    return out


def _packer(rows: int, groups: int, kind: int):
    """Blocks of up to ``rows`` vectors and BLOCK_BYTES, each in a group by its ids; rows hold (vec_id, doubles)."""

    def block(ids: list[int], vecs: list[np.ndarray]) -> pa.RecordBatch:
        dim = max(map(len, vecs), default=0)
        x = np.zeros((len(vecs), dim))
        for r, v in enumerate(vecs):
            x[r, : len(v)] = v
        m, own = whole(x), np.asarray(ids, np.int64)
        if m.dtype == object:
            width, data = 0, " ".join(map(str, m.ravel().tolist())).encode()
        else:
            top = int(np.abs(m).max()) if m.size else 0
            width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
            data = m.astype(f"<i{width}").tobytes()
        key = int(np.bitwise_xor.reduce(own * np.int64(0x9E3779B1)) % groups)
        row = {"key": key, "kind": kind, "n": len(ids), "dim": dim, "width": width, "ids": own.tobytes(), "data": data}
        return pa.RecordBatch.from_pylist([row], schema=_PACKED_ARROW)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vecs: list[np.ndarray] = []
        longest = 0
        for b in batches:
            lists = b.column(1)
            values, at = lists.values.to_numpy().astype(float, copy=False), lists.offsets.to_numpy()
            for i, x, y in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                longest = max(longest, y - x)
                if ids and (len(ids) == rows or 8 * longest * (len(ids) + 1) > BLOCK_BYTES):
                    yield block(ids, vecs)
                    ids, vecs, longest = [], [], y - x
                ids.append(i)
                vecs.append(values[x:y])
        if ids:
            yield block(ids, vecs)

    return pack


def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """ids and matrix of a packed row."""
    if not r["width"]:
        data = np.array([int(x) for x in r["data"].split()] + [None], object)[:-1]
    else:
        data = np.frombuffer(r["data"], f"<i{r['width']}")
    return np.frombuffer(r["ids"], np.int64), data.reshape(r["n"], r["dim"])


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer product of two integer matrices, padded with zeros to one width: by
    float64 where no sum can reach 2**53, in exact integers (clipped to long) otherwise."""
    dim = max(q.shape[1], c.shape[1])
    # zeros of the matrix's own kind: np.pad would put numpy numbers among Python's
    q, c = (np.concatenate([x, np.zeros((len(x), dim - x.shape[1]), np.int64).astype(x.dtype)], 1) if x.shape[1] < dim else x for x in (q, c))
    top = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (q, c)]
    bound = top[0] * top[1] * max(dim, 1)
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best of one row, own id left out, by (-score, id)."""
    at = np.flatnonzero(ids != own)
    scores = scores[at]
    if len(at) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        at, scores = at[near], scores[near]
    order = np.lexsort((ids[at], ~scores))[:k]
    return at[order]


def _search(k: int):
    """Of rows sorted by group, blocks (kind 0) before tiles (kind 1): the k best of each query among the group's blocks."""

    def tile(q: tuple, blocks: list[tuple]) -> list[tuple]:
        qids, queries = q
        hits: list[list[tuple]] = [[] for _ in qids]
        for ids, c in blocks:  # one score matrix at a time
            scores = products(queries, c)
            for own, s, qid in zip(hits, scores, qids, strict=True):
                h = best(s, ids, qid, k)
                own.append((s[h], ids[h]))
        for qid, own in zip(qids, hits, strict=True):
            yield qid, *(np.concatenate(x) for x in zip(*own, strict=True))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks = None, []
        for b in slices(batches, 64):
            for r in b.to_pylist():
                if r["key"] != own:
                    own, blocks = r["key"], []
                if r["kind"] == 0:
                    blocks.append(unpacked(r))
                elif blocks:
                    found = []
                    for qid, s, ids in tile(unpacked(r), blocks):
                        h = best(s, ids, qid, k)
                        found.append((np.full(len(h), qid), ids[h], s[h]))
                    q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array(np.full(len(q), own))], schema=_FOUND)

    return search


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id, x (array of float or double) of valid rows, one row per id (the smallest vector if an id repeats)."""
    x = F.col(col) if dict(vectors.dtypes)[col] == "array<float>" else F.transform(col, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(fine)
        .groupBy("vec_id").agg(F.min("x").alias("x"))
    )


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for each row whose id is divisible by ``every``.

    Defined cases: vectors null or holding null or non-finite components take no part; vectors of
    unequal length are padded with zeros; an empty vector scores 0; rows that share an id count once
    (smallest vector); ties go to the smaller id; a query without other rows has no result rows; an empty
    table gives none; very long vectors fill blocks of fewer rows;
    finite components of any size count exactly, but a score beyond long is clipped to
    it, and scores clipped alike are ties; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(valid_vectors(vectors), "topk_rows")
    total = rows.agg(F.sum(F.size("x").cast("long") * 2 + 8)).first()[0] or 0
    groups = groups or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_BYTES))
    blocks = rows.mapInArrow(_packer(BLOCK_ROWS, groups, 0), _PACKED)
    tiles = rows.filter(F.col("vec_id") % every == 0).coalesce(max(1, groups // 4)).mapInArrow(_packer(TILE_ROWS, groups, 1), _PACKED)
    # every tile goes to every group
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("key")
    tiles = tiles.select(each, *[c for c in tiles.columns if c != "key"])
    dealt = blocks.unionByName(tiles).repartition(groups, "key").sortWithinPartitions("key", "kind")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long, grp long")
    by = [F.col("score").desc(), F.col("vec_id")]
    branch = Window.partitionBy("query_id", F.col("grp") % max(1, int(groups**0.5))).orderBy(*by)
    root = Window.partitionBy("query_id").orderBy(*by)
    merged = found.withColumn("r", F.row_number().over(branch)).filter(F.col("r") <= k).drop("r")
    out = merged.withColumn("rank", F.row_number().over(root)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = written(out, "topk")
    dropped(rows)
    return out

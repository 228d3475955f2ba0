"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts in an earlier document too.

1. Anchors: every window of ``length`` bytes has the smallest hash among its 24-byte grams as its
   key, a function of the window's bytes only. Documents that share a window share its key; the keys seen in
   two documents go into a Bloom filter sized by their count. Grams that are the key of very many places are
   hot: they become a window's key only where it has no other gram, so that what surrounds a
   frequent passage is dealt by its own bytes.
2. Contexts: stretches of windows with one such key are sent, as bytes, to the shard of the key, so a
   shard holds all windows with its keys. Equal contexts of a part are sent once, apart from the list of their
   places; the places of a shard with many of them are split over tasks that each get its contexts.
3. Per shard a suffix array by Larsson-Sadakane refinement in numpy, common prefixes by Kasai's rule
   (many text stretches side by side), and groups of suffixes that share ``length`` bytes. A shard over
   ``SHARD_BYTES`` is cut; the sorted windows of its parts are merged by binary search. Every window
   learns the smallest document it starts in. Places are then streamed against this.
4. Windows of a later document become spans, which travel packed by bucket of documents; spans of a
   document are united and cut from its text.

Whole copies of an earlier document need none of this: all their windows start there as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_bits, bloom_words, checked, dropped, in_bloom, mix64, slices, texts, unmix64, written

GRAM, PART_BYTES, SHARD_BYTES = 24, 2 << 20, 4 << 20
#: Least number of places of a hot key; places of a shard for one task; documents of a bucket of spans.
HOT, PLACES, BUCKET_DOCS = 200_000, 1_000_000, 1024
_TOP = np.uint64(1 << 63)


def words8(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a little-endian number (zeros beyond the end)."""
    p = np.concatenate([t, np.zeros(8, np.uint8)])
    return np.ndarray((len(t),), "<u8", p.data, 0, (1,)).copy()


def gram_hashes(t: np.ndarray) -> np.ndarray:
    w = words8(t)
    n = len(t)
    far = np.concatenate([w, np.zeros(GRAM, np.uint64)])
    h = w * np.uint64(0x9E3779B97F4A7C15) + far[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix64(h + far[16 : n + 16] * np.uint64(0x165667B19E3779F9))


def window_keys(t: np.ndarray, length: int, hot: np.ndarray | None = None) -> np.ndarray:
    """Key of the window from every position (meaningless where it passes the end). ``hot``: hashes of
    grams that give a key only where a window has no other."""
    n, h = len(t), gram_hashes(t)
    if hot is not None:
        table = np.zeros(1 << 16, bool)
        table[(hot & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
        on = maybe[np.isin(h[maybe], hot)]
        h &= ~_TOP
        h[on] |= _TOP
    span, m, size = length - GRAM + 1, h, 1
    while size < span:
        step = min(size, span - size)
        m = np.concatenate([np.minimum(m[: n - step], m[step:]), m[n - step :]]) if step < n else m
        size += step
    return mix64(m + np.uint64(1))  # minima crowd near zero: spread them again


def _parts(batches: Iterator[pa.RecordBatch], length: int):
    """Documents in groups of some PART_BYTES: ids, hashes, starts, bytes, which positions begin a window."""
    held: list[tuple] = []
    size = 0

    def part():
        bufs = [x[2] for x in held]
        t = np.frombuffer(b"".join(bufs), np.uint8)
        ends = np.cumsum([len(x) for x in bufs])
        ok = np.ones(len(t), bool)
        for e in ends:
            ok[max(0, e - length + 1) : e] = False
        ids, hs = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        return ids, hs, ends - [len(x) for x in bufs], t, ok

    for b in slices(batches):
        for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), texts(b), strict=True):
            held.append((i, h, t))
            size += len(t)
            if size >= PART_BYTES:
                yield part()
                held, size = [], 0
    if held:
        yield part()


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _anchors(length: int, shards_log2: int, hot):
    """shard, keys (sorted uint64), counts (places, int32), multi (1 where two documents of the part have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = hot.value if hot else None
        for _, _, starts, t, ok in _parts(batches, length):
            key = window_keys(t, length, grams)
            new = ok.copy()
            new[1:] &= (key[1:] != key[:-1]) | ~ok[:-1]
            at = np.flatnonzero(new)
            if not len(at):
                continue
            k, doc = key[at], np.searchsorted(starts, at, "right")
            order = np.argsort(k)
            k, doc = k[order], doc[order]
            e = _edges(k)
            multi = (np.minimum.reduceat(doc, e[:-1]) != np.maximum.reduceat(doc, e[:-1])).astype(np.uint8)
            k, n = k[e[:-1]], np.diff(e).astype(np.int32)
            shard = (k >> np.uint64(64 - shards_log2)).astype(np.int32)
            cut = _edges(shard)
            packed = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (k, n, multi)]
            columns = [pa.array(shard[cut[:-1]]), *[pa.array(x, pa.binary()) for x in packed]]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "counts", "multi"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, n: keys seen in two documents and their places, of rows sorted by shard."""
    own, held = None, []

    def flush():
        k, n, m = (np.concatenate([np.frombuffer(r[c], d) for r in held]) for c, d in (("keys", np.uint64), ("counts", np.int32), ("multi", np.uint8)))
        order = np.argsort(k)
        e = _edges(k[order])
        on = (np.diff(e) > 1) | (np.maximum.reduceat(m[order], e[:-1]) > 0)
        total = np.add.reduceat(n[order].astype(np.int64), e[:-1])
        return pa.RecordBatch.from_arrays([pa.array(k[order][e[:-1]][on].view(np.int64)), pa.array(total[on])], names=["h", "n"])

    for b in slices(batches):
        for r in b.to_pylist():
            if held and r["shard"] != own:
                yield flush()
                held = []
            own = r["shard"]
            held.append(r)
    if held:
        yield flush()


_CONTEXT = {"ctx": pa.binary(), "lens": pa.binary(), "low": pa.binary(), "which": pa.binary(), "docs": pa.binary(), "hs": pa.binary(), "at": pa.binary()}
_CONTEXTS = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("part", pa.int64()), *_CONTEXT.items()])
_CONTEXTS_SQL = "shard int, salt int, kind int, part long, " + ", ".join(f"{c} binary" for c in _CONTEXT)


def _contexts(length: int, shards_log2: int, filled, hot, splits: dict[int, int]):
    """Rows of kind 0: the distinct contexts of a part in a shard, their lengths and least doc_id, for every split of the
    shard; of kind 1: its places (which context, doc_id, h, start), for one split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = filled.value, hot.value if hot else None
        part = TaskContext.get().partitionId() << 32
        for ids, hs, starts, t, ok in _parts(batches, length):
            part += 1
            key = window_keys(t, length, grams)
            ok = ok & in_bloom(words, key)
            lo = ok.copy()
            lo[1:] &= (key[1:] != key[:-1]) | ~ok[:-1]
            hi = ok.copy()
            hi[:-1] &= (key[1:] != key[:-1]) | ~ok[1:]
            a, z = np.flatnonzero(lo), np.flatnonzero(hi) + length
            doc = np.searchsorted(starts, a, "right") - 1
            shard = (key[a] >> np.uint64(64 - shards_log2)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            a, z, doc, shard = a[order], z[order], doc[order], shard[order]
            raw, out = t.tobytes(), []
            cut = _edges(shard)
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                seen: dict[bytes, int] = {}
                pairs = zip(a[s:e].tolist(), z[s:e].tolist(), strict=True)
                which = np.array([seen.setdefault(raw[x:y], len(seen)) for x, y in pairs], np.int32)
                d, own = doc[s:e], int(shard[s])
                low = np.full(len(seen), np.iinfo(np.int64).max)
                np.minimum.at(low, which, ids[d])
                lens, n = np.array([len(x) for x in seen], np.int32), splits.get(own, 1)
                texts0 = {"ctx": b"".join(seen), "lens": lens.tobytes(), "low": low.tobytes()}
                place = {"which": which.tobytes(), "docs": ids[d].tobytes(), "hs": hs[d].tobytes(), "at": (a[s:e] - starts[d]).tobytes()}
                out += [{"shard": own, "salt": k, "kind": 0, "part": part, **texts0} for k in range(n)]
                out.append({"shard": own, "salt": part % n, "kind": 1, "part": part, **place})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_CONTEXTS)

    return run


def suffix_array(t: np.ndarray) -> np.ndarray:
    """All suffixes in order (Kasai's rule needs the whole order): sort by 8 bytes, then re-sort only
    groups not yet in order by the rank of the suffix h further on, doubling h."""
    n = len(t)
    w = words8(t).byteswap()
    sa = np.argsort(w, kind="stable")
    v = w[sa]
    head = np.concatenate([[True], v[1:] != v[:-1]])
    # zeros beyond the end equal zero bytes: the shorter suffix comes first
    rank = np.empty(n, np.int64)
    h = 8
    while True:
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[sa] = start
        alone = head & np.concatenate([head[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            return sa
        far = sa[at] + h
        second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        key = (start[at] << 32) | second
        order = np.argsort(key, kind="stable")
        sa[at] = sa[at][order]
        key = key[order]
        head[at] = np.concatenate([[True], key[1:] != key[:-1]])
        h *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix, up to ``cap``, of each suffix in ``sa`` with the one before it. Kasai's rule: the
    prefix of suffix i+1 with its neighbour is at least that of i less one. Stretches of the text run side by side."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t, np.zeros(cap + 1, np.uint8)])
    plcp = np.zeros(n, np.int64)
    steps = -(-n // lanes)
    base = np.arange(0, n, steps)
    h = np.zeros(len(base), np.int64)
    for s in range(steps):
        i = base + s
        i = i[i < n]
        p, g = before[i], np.maximum(h[: len(i)] - 1, 0)
        live = np.flatnonzero(p >= 0)
        g[p < 0] = 0
        while len(live):
            x, y, z = i[live], p[live], g[live]
            live = live[(z < cap) & (np.maximum(x, y) + z < n) & (padded[x + z] == padded[y + z])]
            g[live] += 1
        plcp[i] = g
        h[: len(i)] = g
    return plcp[sa]


def earliest(t: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int, part_bytes: int = SHARD_BYTES) -> np.ndarray:
    """For windows that begin at ``at`` (ascending) in ``t`` and are known in ``doc``: the smallest doc of any equal window."""
    parts, step = [], 0
    while step < len(at):
        stop = int(np.searchsorted(at, at[step] + part_bytes, "left"))
        lo, hi = int(at[step]), int(at[stop - 1]) + length
        own = t[lo:hi]
        sa = suffix_array(own)
        group = np.cumsum(common_prefixes(own, sa, length) < length)
        slot = np.full(len(own), -1, np.int64)
        slot[at[step:stop] - lo] = np.arange(step, stop)
        mine = slot[sa]
        mine, group = mine[mine >= 0], group[mine >= 0]
        e = _edges(group)
        parts.append((mine, np.repeat(np.arange(len(e) - 1), np.diff(e)), mine[e[:-1]], np.minimum.reduceat(doc[mine], e[:-1])))
        step = stop
    lows = [low.copy() for *_, low in parts]
    if len(parts) > 1:  # the distinct windows of a part are sorted: find each in all other parts
        windows = np.lib.stride_tricks.sliding_window_view(t, length)
        strings = [windows[at[first]].reshape(-1).view(f"S{length}") for _, _, first, _ in parts]
        for i, own in enumerate(strings):
            for j, other in enumerate(strings):
                if i != j:
                    p = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    hit = other[p] == own
                    lows[i][hit] = np.minimum(lows[i][hit], parts[j][3][p[hit]])
    out = np.empty(len(at), np.int64)
    for (mine, group, *_), low in zip(parts, lows, strict=True):
        out[mine] = low[group]
    return out


class _Shard:
    """The contexts of one shard, then the least document of every window in them."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}
        self.here: dict[int, np.ndarray] = {}
        self.lows: list[np.ndarray] = []

    def add(self, r: dict) -> None:
        end = np.cumsum(np.frombuffer(r["lens"], np.int32)).tolist()
        ctx, seen = r["ctx"], self.seen
        here = [seen.setdefault(ctx[x:y], len(seen)) for x, y in zip([0, *end[:-1]], end, strict=True)]
        self.here[r["part"]] = np.array(here, np.int32)
        self.lows.append(np.frombuffer(r["low"], np.int64))

    def resolve(self, length: int, part_bytes: int) -> None:
        lens = np.array([len(x) for x in self.seen], np.int64)
        t = np.frombuffer(b"".join(self.seen), np.uint8)
        self.seen.clear()
        low = np.full(len(lens), np.iinfo(np.int64).max)
        np.minimum.at(low, np.concatenate(list(self.here.values())), np.concatenate(self.lows))
        self.lows.clear()
        self.n = lens - length + 1  # windows of each context
        self.first = np.cumsum(self.n) - self.n
        off = np.arange(self.n.sum()) - np.repeat(self.first, self.n)
        at = np.repeat(np.cumsum(lens) - lens, self.n) + off
        self.least = earliest(t, at, np.repeat(low, self.n), length, part_bytes)

    def spans(self, r: dict, length: int) -> Iterator[tuple[np.ndarray, ...]]:
        """doc_id, h, lo, hi of the runs of windows at the row's places that start in an earlier document."""
        docs, hs, at = (np.frombuffer(r[c], np.int64) for c in ("docs", "hs", "at"))
        which = self.here[r["part"]][np.frombuffer(r["which"], np.int32)]
        for s in range(0, len(which), 100_000):
            w, own = which[s : s + 100_000], slice(s, s + 100_000)
            m = self.n[w]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            place = np.repeat(np.arange(len(w)), m)
            gone = self.least[np.repeat(self.first[w], m) + inner] < docs[own][place]
            joined = gone[1:] & gone[:-1] & (place[1:] == place[:-1])
            a = np.flatnonzero(gone & ~np.concatenate([[False], joined]))
            z = np.flatnonzero(gone & ~np.concatenate([joined, [False]]))
            p = place[a]
            yield docs[own][p], hs[own][p], at[own][p] + inner[a], at[own][p] + inner[z] + length


def _spans(length: int, part_bytes: int, buckets: int):
    """bucket, docs, hs, spans (int64 pairs lo, hi), packed by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        rows = 0

        def flush():
            doc, h, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = (mix64(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = _edges(bucket[order])
            pairs = np.stack([lo, hi], 1)
            packed = [[x[order[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (doc, h, pairs)]
            columns = [pa.array(bucket[order][cut[:-1]]), *[pa.array(x, pa.binary()) for x in packed]]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "docs", "hs", "spans"])

        own, shard, ready = None, _Shard(), False
        for b in slices(batches, 64):
            for r in b.to_pylist():
                if (r["shard"], r["salt"]) != own:
                    own, shard, ready = (r["shard"], r["salt"]), _Shard(), False
                if r["kind"] == 0:
                    shard.add(r)
                    continue
                if not ready:
                    shard.resolve(length, part_bytes)
                    ready = True
                for x in shard.spans(r, length):
                    if len(x[0]):
                        found.append(x)
                        rows += len(x[0])
                if rows > 1_000_000:
                    yield flush()
                    found, rows = [], 0
        if found:
            yield flush()

    return run


def united(docs: np.ndarray, hs: np.ndarray, spans: np.ndarray):
    """(doc_id, h) once each, and the maximal runs of their (lo, hi) pairs as a list of arrays; runs that touch are one."""
    order = np.lexsort((spans[:, 0], hs, docs))
    docs, hs, spans = docs[order], hs[order], spans[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (hs[1:] != hs[:-1])])
    base = (np.cumsum(new) - 1) << 40  # documents one after the other, so that runs never meet across them
    lo, top = spans[:, 0] + base, np.maximum.accumulate(spans[:, 1] + base)
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > top[:-1]]))
    runs = np.stack([spans[first, 0], top[np.append(first[1:] - 1, len(lo) - 1)] - base[first]], 1)
    lead = np.flatnonzero(new)
    return docs[lead], hs[lead], np.split(runs, np.searchsorted(first, lead[1:]))


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, spans of rows sorted by bucket."""
    own, held = None, []

    def flush():
        doc, h, s = (np.concatenate([np.frombuffer(r[c], np.int64) for r in held]) for c in ("docs", "hs", "spans"))
        doc, h, runs = united(doc, h, s.reshape(-1, 2))
        packed = pa.array([x.tobytes() for x in runs], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), packed], names=["doc_id", "h", "spans"])

    for b in slices(batches):
        for r in b.to_pylist():
            if held and r["bucket"] != own:
                yield flush()
                held = []
            own = r["bucket"]
            held.append(r)
    if held:
        yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for t, s, copy in zip(texts(b), b.column("spans").to_pylist(), b.column("copy").to_pylist(), strict=True):
            t = t or b""
            spans = [(0, len(t))] if copy else np.frombuffer(s, np.int64).reshape(-1, 2).tolist() if s else []
            kept, at = [], 0
            for x, y in spans:
                kept.append(t[at:x])
                at = y
            kept.append(t[at:])
            rest = b"".join(kept)
            rows.append((len(t), len(t) - len(rest), len(spans), rest))
        n, gone, k, rest = zip(*rows, strict=True) if rows else ((), (), (), ())
        counts = [pa.array(x, pa.int64()) for x in (n, gone, k)]
        columns = [b.column("doc_id"), *counts, pa.array(rest, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _shared_keys(rest: DataFrame, length: int, log2: int, tasks: int, hot, name: str) -> DataFrame:
    anchors = rest.mapInArrow(_anchors(length, log2, hot), "shard int, keys binary, counts binary, multi binary")
    dealt = anchors.repartition(tasks, "shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(_shared, "h long, n long"), name)


def removed_spans(
    docs: DataFrame, length: int = 50, part_bytes: int = SHARD_BYTES, hot_places: int = HOT, task_places: int = PLACES
) -> tuple[DataFrame, DataFrame]:
    """Written tables: whole copies (doc_id, h), and spans (doc_id, h, spans as int64 pairs) of the other documents."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    long = long.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    md5, size = F.unhex(F.md5(F.col("text").cast("binary"))).alias("d"), F.octet_length("text").alias("size")
    digest = written(long.select("doc_id", "h", md5, size), "suffix_digests")
    rows, total = digest.agg(F.count("*"), F.sum("size")).first()
    # shards and buckets grow with the bytes and documents
    log2 = max(8, (8 * tasks - 1).bit_length(), ((total or 0) >> 21).bit_length())
    buckets = 1 + rows // BUCKET_DOCS
    many = digest.groupBy("d").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = written(many.select("d", "first"), "suffix_firsts")
    copies = written(digest.join(checked(first), "d").filter("doc_id > first").select("doc_id", "h").distinct(), "suffix_copies")
    rest = long.join(checked(copies), ["doc_id", "h"], "left_anti")

    shared, hot = _shared_keys(rest, length, log2, tasks, None, "suffix_keys"), None
    places, most = shared.agg(F.sum("n"), F.max("n")).first()
    limit = max(hot_places, (places or 0) // (4 * tasks))
    if (most or 0) > limit:  # fewer than 4 keys a task can be over the limit
        keys = shared.filter(F.col("n") > limit).select("h").toArrow()["h"].to_numpy()
        hot = spark.sparkContext.broadcast(np.sort(unmix64(keys.view(np.uint64)) - np.uint64(1)))
        dropped(shared)
        shared = _shared_keys(rest, length, log2, tasks, hot, "suffix_keys")
    words = bloom_words(shared, "h", bloom_bits(shared.count()))
    filled = spark.sparkContext.broadcast(words)
    load = shared.groupBy(F.shiftrightunsigned("h", 64 - log2).cast("int").alias("shard")).agg(F.sum("n").alias("n"))
    load = load.filter(F.col("n") > task_places)  # one row per task_places places at most
    splits = {r["shard"]: -(-r["n"] // task_places) for r in load.collect()}

    ctx = rest.mapInArrow(_contexts(length, log2, filled, hot, splits), _CONTEXTS_SQL)
    dealt = ctx.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = dealt.mapInArrow(_spans(length, part_bytes, buckets), "bucket long, docs binary, hs binary, spans binary")
    spans = found.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_unite, "doc_id long, h long, spans binary")
    out = written(spans, "suffix_spans")
    dropped(digest, first, shared)
    return copies, out


def cut_texts(
    docs: DataFrame, length: int = 50, part_bytes: int = SHARD_BYTES, hot_places: int = HOT, task_places: int = PLACES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) per row of ``docs`` (doc_id, text).

    Defined cases: a null text is empty; texts under ``length`` bytes stay whole; a null doc_id is neither earlier
    nor later than any and stays whole; rows that repeat a doc_id never remove each other;
    an empty table gives no rows; further columns are ignored.
    """
    copies, spans = removed_spans(docs, length, part_bytes, hot_places, task_places)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.join(checked(copies).withColumn("copy", F.lit(True)), ["doc_id", "h"], "left").join(checked(spans), ["doc_id", "h"], "left")
    kind = dict(docs.dtypes)["doc_id"]
    out = rows.select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    return out.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_substrings(docs: DataFrame, length: int = 50, **bounds: int) -> DataFrame:
    """The counts of ``cut_texts`` with the sha256 of the remaining bytes."""
    out = cut_texts(docs, length, **bounds)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

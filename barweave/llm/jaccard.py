"""N-gram Jaccard join: documents whose shingle sets are similar, as components.

1. Every text becomes its sorted array of distinct shingle hashes; documents with equal sets
   are one class from then on. A class keeps a hashed parity bitmap per size band: the number of
   differing bits of two bitmaps never exceeds the size of the symmetric difference, which bounds the
   overlap from above.
2. Tiles: two sets that are similar enough share a hash among the first ``n - ceil(t*n) + 1`` of
   each, in any one order. The order is by hash, but shingles that a sample shows to be frequent come
   last, the most frequent at the very end, so that boilerplate makes no tiles. A tile is a size band and such a
   hash; hashes seen once are dropped by a Bloom filter sized by count, tiles of hashes that are
   frequent all the same are cut into blocks that meet pairwise. Inside a tile pairs are tested by
   size and bitmap only, and a spanning forest of the survivors is kept, never all pairs.
3. Exact sorted-array intersection of the forest's pairs. Components in which a pair failed get
   further rounds: each takes the most promising surviving pairs, some for every two labels of a tile, until all
   that lie between unlike labels have been tested. So no link can be lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_bits, bloom_words, checked, dropped, fresh, in_bloom, mix64, slices, texts, written
from .components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MAX_BAND, BAND_BITS, BLOCK = 5, 512, 2048
#: Documents (or a hundredth, if that is more) in which shingles are counted for their order, and how many of them
#: make one frequent; most frequent shingles that are told apart (8 MB). These only order shingles: results don't depend on them.
SAMPLE, FREQUENT, MOST_FREQUENT = 8_000, 8, 1 << 20
#: Pairs of two labels that a tile gives in each further round; the last round gives all.
ROUNDS = (16, None)
#: Shared prefix hashes up to which a filter of 64 MB still has 16 bits for each; beyond, rows are chosen by a semi-join.
FILTER_KEYS = 1 << 25


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct uint64 hashes of the k-word shingles (with fewer words: of the whole sequence)."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    s = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(s)


def band_of(n: int) -> int:
    return min(MAX_BAND, max(0, (max(n, 1) - 1) // (2 * BAND_BITS)).bit_length())


def bitmap(s: np.ndarray, band: int) -> bytes:
    width = BAND_BITS << band
    at = (s * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - width.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def needed(n: int, num: int) -> int:
    """How many hashes of a set of n can come first without a shared one."""
    return n - (num * n + 99) // 100 + 1


_SETS = "doc_id long, h long, n long, d1 long, d2 long, tokens array<long>, bands array<struct<band:int,bits:binary>>"
_BAND = pa.struct([("band", pa.int32()), ("bits", pa.binary())])
_SETS_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "h", "n", "d1", "d2")), ("tokens", pa.list_(pa.int64())), ("bands", pa.list_(_BAND))])


_TILE = "band int, token long, rep long, n long, bits binary, label long"


def _sampled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            sets = [shingle_set(t, k) for t in texts(b)]
            token, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), [])
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], names=["token", "c"])

    return run


def frequent_shingles(docs: DataFrame, k: int, rows: int) -> np.ndarray:
    """Hashes of shingles found frequent in a sample, the most frequent last."""
    share = min(1.0, max(SAMPLE, rows / 100) / max(rows, 1))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "h"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = sample.mapInArrow(_sampled(k), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= FREQUENT)
    t = found.orderBy(F.col("c").desc(), "token").limit(MOST_FREQUENT).toArrow()
    return t["token"].to_numpy()[::-1].view(np.uint64) if t.num_rows else np.zeros(0, np.uint64)


class Order:
    """Order of shingles: by hash, frequent ones after all others in the order given."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent)
        self.sorted = frequent[self.rank]

    def first(self, s: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of a sorted set."""
        if not len(self.sorted):
            return s[:n]
        at = np.minimum(np.searchsorted(self.sorted, s), len(self.sorted) - 1)
        late = self.sorted[at] == s
        own, rest = s[~late], s[late]
        return own[:n] if len(own) >= n else np.concatenate([own, rest[np.argsort(self.rank[at[late]])][: n - len(own)]])


def _sets(k: int, num: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(frequent.value)
        for b in slices(batches):
            rows = []
            for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), texts(b), strict=True):
                s = shingle_set(t, k)
                n = len(s)
                own = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()) if n else bytes(16), np.int64)
                bands = sorted({band_of(n), band_of(n * 100 // num)}) if n else []
                first = order.first(s, needed(n, num)).view(np.int64) if n else []
                rows.append((i, h, n, int(own[0]), int(own[1]), first, [{"band": x, "bits": bitmap(s, x)} for x in bands]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SETS_ARROW, strict=True)], schema=_SETS_ARROW)

    return run


def _shared_tokens(words):
    """Of each class the tile rows whose hash may occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = words.value
        for b in batches:
            for r in b.to_pylist():
                t = np.asarray(r["tokens"], np.int64)
                for x in r["bands"]:
                    keys = mix64(t.view(np.uint64) + np.uint64(x["band"]))
                    on = t[in_bloom(filled, keys)]
                    if len(on):
                        m = len(on)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, x["band"], np.int32)), pa.array(on), pa.array(np.full(m, r["doc_id"])), pa.array(np.full(m, r["n"])), pa.array([x["bits"]] * m, pa.binary()), pa.array(np.full(m, r["label"]))],
                            names=["band", "token", "rep", "n", "bits", "label"],
                        )

    return run


def tile_rows(rows: DataFrame, multi: DataFrame, words) -> DataFrame:
    """band, token, rep, n, bits, label of the classes' prefix hashes that other classes have, too: by a Bloom filter in the tasks
    (a few more pass), or, without ``words``, by an exact semi-join of narrow rows, to which bitmaps are attached after it."""
    if words is not None:
        return rows.mapInArrow(_shared_tokens(words), _TILE)
    each = rows.select("doc_id", F.explode("bands.band").alias("band"), "tokens").select("doc_id", "band", F.explode("tokens").alias("token"))
    shared = each.join(multi.select("band", "token"), ["band", "token"], "left_semi")
    wide = rows.select("doc_id", "n", "label", F.explode("bands").alias("x")).select("doc_id", "n", "label", "x.band", "x.bits")
    return shared.join(wide, ["doc_id", "band"]).select("band", "token", F.col("doc_id").alias("rep"), "n", "bits", "label")


def _forest(i: np.ndarray, j: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """Positions of a minimum spanning forest among the pairs (i, j), by rounds of cheapest edges."""
    label, live, out = np.arange(n), np.argsort(cost, kind="stable"), []
    while True:
        a, b = label[i[live]], label[j[live]]
        live = live[a != b]
        if not len(live):
            return np.concatenate(out) if out else np.zeros(0, np.int64)
        a, b = label[i[live]], label[j[live]]
        first = np.full(n, len(live))
        np.minimum.at(first, a, np.arange(len(live)))
        np.minimum.at(first, b, np.arange(len(live)))
        pick = np.unique(first[first < len(live)])
        out.append(live[pick])
        a, b = a[pick], b[pick]
        while True:  # hook the larger label to the smaller until all picked pairs agree
            x, y = label[a], label[b]
            if (x == y).all():
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        # labels of rows follow their representative
        label = label[label]


def _leading(a: np.ndarray, b: np.ndarray, cost: np.ndarray, n: int | None) -> np.ndarray:
    """Positions of the ``n`` cheapest pairs (or all) of each two labels (a, b)."""
    if n is None:
        return np.arange(len(a))
    order = np.lexsort((cost, np.maximum(a, b), np.minimum(a, b)))
    lo, hi = np.minimum(a, b)[order], np.maximum(a, b)[order]
    new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return order[np.arange(len(new)) - start < n]


def _pairs(num: int, forest: bool, most: int | None = None):
    """Surviving pairs of the tiles: a spanning forest of each, or those of unlike label, ``most`` for each two labels."""

    def tested(cols: dict) -> pa.RecordBatch | None:
        tile, blk, n, rep, bits, label = (cols[c] for c in ("tile", "blk", "n", "rep", "bits", "label"))
        two = cols["two"]
        found = []
        at, step = np.arange(len(n)), 0
        while len(at):
            step += 1
            at = at[at + step < len(n)]
            o = at + step
            at = at[(tile[o] == tile[at]) & (100 * n[at] >= num * n[o])]  # sizes ascend inside a tile
            o = at + step
            on = (rep[at] != rep[o]) & (~two[at] | (blk[at] != blk[o]))
            if not forest:
                on &= label[at] != label[o]
            a, b = at[on], o[on]
            for s in range(0, len(a), 8192):
                x, y = a[s : s + 8192], b[s : s + 8192]
                d = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                # overlap <= (n + m - d) / 2 and (100 + num) * overlap >= num * (n + m) are both needed
                ok = (100 + num) * (n[x] + n[y] - d) >= 2 * num * (n[x] + n[y])
                if ok.any():
                    found.append(np.stack([x[ok], y[ok], d[ok]]))
        if not found:
            return None
        i, j, d = np.concatenate(found, 1)
        keep = _forest(i, j, d, len(n)) if forest else _leading(label[i], label[j], d, most)
        i, j = i[keep], j[keep]
        p = np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def columns(t: pa.Table) -> dict:
            c = {x: t[x].to_numpy() for x in ("band", "token", "bi", "bj", "blk", "n", "rep", "label")}
            change = np.zeros(len(c["n"]), bool)
            for x in ("band", "token", "bi", "bj"):
                change[1:] |= c[x][1:] != c[x][:-1]
            return c | {"tile": np.cumsum(change), "two": c["bi"] != c["bj"], "t": t}

        def split(t: pa.Table, last: bool):
            """Whole tiles tested band by band; the rows of the last tile stay unless it is over."""
            c = columns(t)
            cut = t.num_rows if last else int(np.searchsorted(c["tile"], c["tile"][-1]))
            for band in np.unique(c["band"][:cut]):
                on = np.flatnonzero(c["band"][:cut] == band)
                bits = b"".join(t["bits"].take(pa.array(on)).to_pylist())
                own = {x: c[x][on] for x in ("tile", "blk", "n", "rep", "label", "two")} | {"bits": np.frombuffer(bits, np.uint64).reshape(len(on), -1)}
                if (r := tested(own)) is not None:
                    yield r
            return t.slice(cut)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                rest = yield from split(pa.Table.from_batches(held), False)
                held, rows = rest.to_batches(), 0
        if held:
            yield from split(pa.Table.from_batches(held), True)

    return run


def _verify(k: int, num: int):
    """a, b, ok by exact intersection of the sorted arrays of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, np.ndarray] = {}
        for b in slices(batches):
            ok = []
            ids = [b.column("a").to_pylist(), b.column("b").to_pylist()]
            for i, j, x, y in zip(*ids, texts(b, "ta"), texts(b, "tb"), strict=True):
                both = []
                for own, t in ((i, x), (j, y)):
                    if (own, t) not in memo:  # a doc_id can have several texts
                        if len(memo) > 256:
                            memo.clear()
                        memo[own, t] = shingle_set(t, k)
                    both.append(memo[own, t])
                s, t = both
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * common >= num * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def _check(pairs: DataFrame, docs: DataFrame, k: int, num: int, name: str) -> DataFrame:
    ids = checked(written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}_ids"))
    near = written(docs.join(ids, "doc_id", "left_semi"), f"{name}_texts")
    a, b = near.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), near.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(k, num), "a long, b long, ok boolean"), name)


def _components(docs: DataFrame, k: int, num: int) -> DataFrame:
    """A written table of doc_id, h (hash of the text), n_shingles, component_id per row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, k, docs.count()))
    sets = written(docs.mapInArrow(_sets(k, num, frequent), _SETS), "jaccard_sets")
    full = sets.filter("n > 0")
    classes = written(full.filter("doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "jaccard_classes")
    extra = full.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).filter("doc_id <> rep").select("doc_id", "d1", "d2")
    copies = written(extra.distinct(), "jaccard_copies")
    one = full.filter("doc_id is not null").select("doc_id", "d1", "d2", "n", "tokens", "bands")
    one = one.join(checked(copies), ["doc_id", "d1", "d2"], "left_anti").drop("d1", "d2")
    seen = one.select("doc_id", F.explode("bands.band").alias("band"), "tokens").select("band", F.explode("tokens").alias("token"))
    multi = written(seen.groupBy("band", "token").agg(F.count("*").alias("c")).filter("c > 1"), "jaccard_tiles")
    keys, words = multi.count(), None
    if keys <= FILTER_KEYS:
        words = spark.sparkContext.broadcast(bloom_words(multi.mapInArrow(_keys, "h long"), "h", bloom_bits(keys)))
    hot = multi.filter(F.col("c") > BLOCK).select("band", "token", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    hot = written(hot, "jaccard_hot")
    plain = docs.filter("doc_id is not null").select("doc_id", "text")

    def round_pairs(rows: DataFrame, forest: bool, most: int | None, name: str) -> DataFrame:
        t = tile_rows(rows, multi, words).join(checked(hot), ["band", "token"], "left")
        t = t.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        t = t.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        t = t.select("band", "token", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk", "n", "rep", "label", "bits")
        key = ["band", "token", "bi", "bj"]
        dealt = t.repartition(parts, *key).sortWithinPartitions(*key, "n", "rep")
        return written(dealt.mapInArrow(_pairs(num, forest, most), "a long, b long").distinct(), name)

    forest = round_pairs(one.withColumn("label", F.col("doc_id")), True, None, "jaccard_forest")
    tested = _check(forest, plain, k, num, "jaccard_checked")
    linked = components(tested.filter("ok").select("a", "b"), "jaccard_linked")
    if tested.filter("not ok").limit(1).count():
        # tile components with a failed pair: their classes are tested again, between unlike labels
        maybe = components(forest, "jaccard_maybe")
        failed = tested.filter("not ok").select(F.col("a").alias("v")).join(maybe, "v").select("label").distinct()
        again = written(maybe.join(failed, "label").select("v"), "jaccard_again")
        for most in ROUNDS:
            label = F.coalesce("label", "v").alias("label")
            labels = written(again.join(linked, "v", "left").select(F.col("v").alias("doc_id"), label), "jaccard_labels")
            rows = one.join(checked(labels), "doc_id").select("doc_id", "n", "tokens", "bands", "label")
            found = round_pairs(rows, False, most, "jaccard_rest")
            new = written(found.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "jaccard_rest_new")
            if not new.limit(1).count():
                continue
            more = _check(new, plain, k, num, "jaccard_rest_checked")
            tested = written(tested.unionByName(more), "jaccard_checked")
            if more.filter("ok").limit(1).count():
                linked = components(tested.filter("ok").select("a", "b"), "jaccard_linked")
            dropped(labels, found, new, more)
    linked = linked.select(F.col("v").alias("rep"), "label")
    member = full.select("doc_id", "h", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").join(linked, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep")).alias("component_id")
    alone = sets.filter("n = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = written(member.select("doc_id", "h", F.col("n").alias("n_shingles"), component).unionByName(alone), "jaccard_components")
    dropped(sets, classes, copies, multi, hot, forest, tested)
    return out


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs`` (doc_id, text): documents whose sets of
    k-word shingles have a Jaccard similarity of at least ``num`` / 100 are linked, a component's id
    is its smallest doc_id.

    Defined cases: a text that is null or without words has an empty set and stands alone; with
    fewer than k words the whole sequence is the one shingle; rows that repeat a doc_id with one text
    are one document (the row is repeated in the result), and a copy is told by doc_id and text, so a
    doc_id's other texts keep their links; a null doc_id stays alone with
    component null; an empty table gives no rows; further columns are ignored. Equality of
    shingles is judged by 64-bit hashes, of whole sets by 128-bit ones.
    """
    return _components(docs, k, num).drop("h")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = mix64(b.column("token").to_numpy().view(np.uint64) + b.column("band").to_numpy().astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def keep_one(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with their columns, whatever their names.

    Defined cases: a doc_id's texts are told apart by their hash; a row without doc_id and a text without words stay;
    repeated rows stay or go together; very long texts are compared whole; an empty table gives no rows.
    """
    i, h = fresh(docs, "_id"), fresh(docs, "_h")
    other = _components(docs, k, num).filter("doc_id <> component_id").select(F.col("doc_id").alias(i), F.col("h").alias(h))
    drop = written(other.distinct(), "jaccard_drop")
    out = docs.join(checked(drop), (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_anti")
    return out.select(*[f"`{c}`" for c in docs.columns])

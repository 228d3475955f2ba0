"""Source divergence audit by systolic rotation.

Each language's groups (its sources) have a vector of term probabilities over the language's kept terms. A
divergence is a sum over terms, so the terms are dealt into tiles by a hash and every tile is audited by
itself: no vector, however large its group, is ever whole in one task. Within a tile a group's vector holds only the
terms that the group has (place and probability, delta-coded and deflated); all other kept terms share one probability.

The groups of a tile are cut into blocks by their packed bytes. Blocks stay resident in a slot, and the peers'
packed vectors circulate: in the rounds of a round-robin tournament any two blocks meet once, where both
directions of every pair are evaluated. A slot's task reads its residents, then its visitors in order of rounds, and
holds the residents and one visitor at a time. Rounds run in waves, each a job whose results are written, so that the
circulating copies never take more disk than a fixed number of rounds. Every tile keeps a heap of its leading
terms per group, and the heaps of a group's tiles are merged by rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, dropped, slices, texts, written

SCALE = 1_000_000_000
TILE = 1 << 18  # kept terms of a tile at most, on average
SPREAD, LEAST = 32, 1 << 10  # a language is cut into so many tiles even if it is smaller, as far as they have LEAST terms
BLOCK_BYTES = 4 << 20  # packed vectors of a block at most; about eight times that in a slot's memory
BLOCKS = 6  # blocks of a tile at least, as far as it has groups: small tiles are worked on in parallel, too
WAVE = 16  # rounds whose visitors are on disk together
HELD = 1 << 19  # terms that a task counts before it passes them on
TEXT_SLICE = 4 << 20

#: Separators become spaces, A-Z small letters; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text by slices that end between terms."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + TEXT_SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> partial counts per (lang, source, term): occurrences and documents. A group's first row has
    the empty term, so that groups without terms are known."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}

    def out():
        for (lang, source), terms in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()),
                    pa.array([x[0] for x in terms.values()], pa.int64()), pa.array([x[1] for x in terms.values()], pa.int64()),
                ], schema=_COUNTS,
            )
        held.clear()

    size = 0
    for b in slices(batches):
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b), strict=True):
            doc: Counter = Counter()
            for part in terms_of(text):
                doc.update(part)
            if (lang, source) not in held:
                held[lang, source] = {b"": [0, 0]}
            group = held[lang, source]
            before = len(group)
            for t, n in doc.items():
                if x := group.get(t):
                    x[0] += n
                    x[1] += 1
                else:
                    group[t] = [n, 1]
            size += len(group) - before
        if size >= HELD:
            yield from out()
            size = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs over all documents; one row with the empty term per group."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = named.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for counts of any size."""
    scaled = ((count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(31,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, (total + kept).cast("decimal(20,0)"))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) on int64 shares of at most SCALE + 1: the square stays below 2^60."""
    d = p - q
    return d * d // q


def pack(at: np.ndarray, p: np.ndarray) -> bytes:
    """Ascending places and shares as deflated 32-bit gaps and values."""
    gaps = np.diff(at, prepend=0).astype("<u4").tobytes()
    return zlib.compress(gaps + p.astype("<u4").tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zlib.decompress(data), "<u4")
    n = len(x) // 2
    return np.cumsum(x[:n], dtype=np.int64), x[n:].astype(np.int64)


_VECTORS = pa.schema([
    ("part", pa.string()), ("lang", pa.string()), ("tile", pa.int32()), ("source", pa.string()), ("packed", pa.binary()), ("item", pa.string()), ("value", pa.int64()),
])
_VECTORS_DDL = "part string, lang string, tile int, source string, packed binary, item string, value long"


def _packer(top: int):
    """lang, tile, source, at, p, q, term in order -> one packed vector per (lang, tile, source) and its leading terms."""

    def one(key, cols):
        lang, tile, source = key
        at, p, q = (np.concatenate([c[i].to_numpy() for c in cols]) for i in range(3))
        term = pa.chunked_array([c[3] for c in cols], pa.string())
        f = divergence(p, q)
        lead = np.flatnonzero(p > q)
        if len(lead) > top:  # ties go to the smaller place, which is the smaller term
            lead = lead[np.lexsort((lead, -f[lead]))[:top]]
        n = len(lead) + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["vector"] + ["term"] * (n - 1), pa.string()), pa.array([lang] * n, pa.string()), pa.array([tile] * n, pa.int32()), pa.array([source] * n, pa.string()),
                pa.array([pack(at, p)] + [None] * (n - 1), pa.binary()), pa.array([None, *term.take(pa.array(lead)).to_pylist()], pa.string()), pa.array([0, *f[lead].tolist()], pa.int64()),
            ], schema=_VECTORS,
        )

    def run(batches):
        now, cols = None, []
        for b in batches:
            if not b.num_rows:
                continue
            lang, tile, source = (b.column(i).to_pylist() for i in range(3))
            keys = list(zip(lang, tile, source, strict=True))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if keys[lo] != now:
                    if cols:
                        yield one(now, cols)
                    now, cols = keys[lo], []
                cols.append([b.column(i).slice(lo, hi - lo) for i in range(3, 7)])
        if cols:
            yield one(now, cols)

    return run


def meeting_round(i: Column, j: Column, blocks: Column) -> Column:
    """The round in which blocks i < j of a round-robin tournament meet (circle method; the last of an even number stays put)."""
    m = blocks + blocks % 2
    return F.when(j == m - 1, i).otherwise(F.pmod((i + j) * F.floor(m / 2), m - 1)).cast("int")


_MEETINGS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


class _Slot:
    """The resident groups of one block and tile."""

    def __init__(self, size: int):
        self.size, self.groups = size, []
        self.mine, self.theirs = np.zeros(size, np.int64), np.zeros(size, np.int64)

    def meet(self, source: str, packed: bytes | None, base: int, resident: bool) -> Iterator[tuple[str, str, int]]:
        at, p = unpack(packed) if packed else (np.empty(0, np.int64), np.empty(0, np.int64))
        for name, own_at, own_p, own_base in self.groups:
            # both vectors on the union of their places; 0 marks a term that a group doesn't have
            self.mine[own_at], self.theirs[at] = own_p, p
            union = np.concatenate([own_at, at[self.mine[at] == 0]])
            a, b = self.mine[union], self.theirs[union]
            self.mine[own_at], self.theirs[at] = 0, 0
            a[a == 0], b[b == 0] = own_base, base
            rest = self.size - len(union)
            d2 = (a - b) ** 2
            off = (own_base - base) ** 2
            yield name, source, int((d2 // b).sum()) + rest * (off // base)
            yield source, name, int((d2 // a).sum()) + rest * (off // own_base)
        if resident:
            self.groups.append((source, at, p, base))


def _rotation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, tile, slot, round, home, size, source, base, packed in order: residents (round -1) then visitors by round -> both
    directions of every pair. Residents meet among themselves only in the wave that has ``home``."""
    now, slot, out = None, None, []
    for b in batches:
        for lang, tile, at, rnd, home, size, source, base, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (lang, tile, at) != now:
                now, slot = (lang, tile, at), _Slot(size)
            if rnd < 0 and not home:
                slot.groups.append((source, *(unpack(packed) if packed else (np.empty(0, np.int64), np.empty(0, np.int64))), base))
                continue
            out += [(lang, *x) for x in slot.meet(source, packed, base, rnd < 0)]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MEETINGS, strict=True)], schema=_MEETINGS)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MEETINGS, strict=True)], schema=_MEETINGS)


def divergence_audit(docs: DataFrame, min_docs: int = 3, top: int = 200, tile: int = TILE, block_bytes: int = BLOCK_BYTES, wave: int = WAVE) -> DataFrame:
    """lang, source, part, item, value (long), rank (int): part ``pair`` has every other source of the language by its
    divergence from the group, part ``term`` the ``top`` terms that the group has more often than its language.

    Defined cases: null text, lang or source is the empty string, which is a language or source like others; a
    document is a row, so repeated rows count again; terms keep accents and other characters outside A-Z as they are; a
    group without kept terms still meets all others (with the share of an unseen term); a language without kept terms
    has value 0 for all its pairs and no term rows; a language with one source has no pairs; ties in value go to the
    smaller item by UTF-8 bytes; very long texts are counted by slices; an empty table gives no rows; other columns are ignored.
    """
    counts = written(term_counts(docs), "audit_counts")
    # kept terms with their place in a tile of the language; a tile's places ascend with the term
    kept = written(counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("d")).filter(F.col("d") >= min_docs).drop("d"), "audit_kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    langs = counts.select("lang").distinct().join(langs, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.coalesce("lang_n", F.lit(0)).cast("long").alias("lang_n"),
        F.greatest(F.lit(1), F.ceil(F.col("v") / tile), F.least(F.lit(SPREAD), F.ceil(F.col("v") / LEAST))).cast("int").alias("tiles"),
    )
    langs = written(langs, "audit_langs")
    dealt = kept.join(checked(langs), "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"))
    place = Window.partitionBy("lang", "tile")  # about ``tile`` rows
    dealt = dealt.select(
        "lang", "term", "tile", (F.row_number().over(place.orderBy("term")) - 1).alias("at"), F.count("*").over(place).cast("int").alias("size"),
        share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q"),
    )
    dealt = written(dealt, "audit_tiles")
    mine = written(counts.filter("term <> ''").select("lang", "source", "term", "n").join(dealt, ["lang", "term"]).select("lang", "source", "term", "tile", "at", "n", "q"), "audit_mine")
    sums = mine.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = counts.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", "v", "tiles", F.coalesce("own_n", F.lit(0)).cast("long").alias("own_n"),
        F.when(F.col("v") > 0, share(F.lit(0), F.coalesce("own_n", F.lit(0)), F.col("v"))).otherwise(F.lit(1)).cast("long").alias("base"),
    )
    groups = written(groups, "audit_groups")
    shares = mine.join(checked(groups.select("lang", "source", "own_n", "v")), ["lang", "source"]).select("lang", "tile", "source", "at", share(F.col("n"), F.col("own_n"), F.col("v")).alias("p"), "q", "term")
    ordered = shares.repartition("lang", "tile", "source").sortWithinPartitions("lang", "tile", "source", "at")
    packed = written(ordered.mapInArrow(_packer(top), _VECTORS_DDL), "audit_packed")
    # every group is in every tile of its language, with an empty vector where it has no term there
    sizes = dealt.groupBy("lang", "tile").agg(F.count("*").cast("int").alias("size"))
    seats = groups.select("lang", "source", "base", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    seats = seats.join(sizes, ["lang", "tile"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    vectors = seats.join(packed.filter("part = 'vector'").select("lang", "tile", "source", "packed"), ["lang", "tile", "source"], "left")
    weight = F.coalesce(F.octet_length("packed"), F.lit(0)) + 64
    row = Window.partitionBy("lang", "tile").orderBy("source")  # a row per group, without its vector
    narrow = vectors.select("lang", "tile", "source", weight.alias("w"))
    limit = F.least(F.lit(block_bytes), F.greatest(F.lit(1), F.sum("w").over(Window.partitionBy("lang", "tile")) / BLOCKS))
    seated = narrow.select("lang", "tile", "source", F.floor((F.sum("w").over(row) - F.col("w")) / limit).cast("int").alias("raw"))
    seated = seated.withColumn("block", (F.dense_rank().over(Window.partitionBy("lang", "tile").orderBy("raw")) - 1).cast("int")).drop("raw")
    seated = seated.withColumn("blocks", (F.max("block").over(Window.partitionBy("lang", "tile")) + 1).cast("int"))
    vectors = written(vectors.join(seated, ["lang", "tile", "source"]), "audit_vectors")
    most = vectors.agg(F.max("blocks")).first()[0] or 0
    rounds = max(0, most + most % 2 - 1)
    met = []
    for first in range(0, max(rounds, 1), wave):
        stay = vectors.select("lang", "tile", F.col("block").alias("slot"), F.lit(-1).alias("round"), F.lit(first == 0).alias("home"), "size", "source", "base", "packed")
        if first:
            stay = stay.filter(F.col("blocks") + F.col("blocks") % 2 - 1 > first)
        # of two blocks the smaller number is host where their sum is odd, so that visits are even
        peers = vectors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter(
            F.when((F.col("block") + F.col("slot")) % 2 == 1, F.col("slot") < F.col("block")).otherwise(F.col("slot") > F.col("block"))
        )
        peers = peers.withColumn("round", meeting_round(F.least("slot", "block"), F.greatest("slot", "block"), F.col("blocks"))).filter(F.col("round").between(first, first + wave - 1))
        moving = peers.select("lang", "tile", "slot", "round", F.lit(False).alias("home"), "size", "source", "base", "packed")
        order = ["lang", "tile", "slot", "round", "source"]
        met.append(written(stay.union(moving).repartition("lang", "tile", "slot").sortWithinPartitions(*order).mapInArrow(_rotation, "lang string, source string, item string, value long"), "audit_met"))
    pairs = met[0]
    for m in met[1:]:
        pairs = pairs.union(m)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    leading = packed.filter("part = 'term'").select("lang", "source", "item", "value", "part")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    both = pairs.union(leading.select(pairs.columns)).withColumn("rank", F.row_number().over(ranked).cast("int"))
    out = written(both.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank"), "audit")
    dropped(counts, kept, langs, dealt, mine, groups, packed, vectors, *met)
    return out

"""Prefix trie of conversations, merged family first.

A family is the conversations with one base id. All of a family's turns are co-grouped by the base id (one
shuffle of turn digests, never of texts) and arrive in its task as one sorted stream: the base's turns first, then
each member's. The stream rebuilds every conversation and folds it into the family's small trie. Only the
combined family nodes go into the next shuffle, which merges them by prefix digest over all families. The merged
counts return to the families, which sum their own share of every subtree bottom-up, and a last combine by
digest adds the shares.

A node belongs to the family of its smallest member, so each node is counted in exactly one family's sums. In a
family a node is named by (creator, depth), where the creator is the first conversation that reached it: each
creator's nodes are one chain, and chains in descending order of creator and depth visit children before parents
with a state of a few pending parents. Below ``MERGED`` turns a family no longer merges in memory: its rows leave at
once and meet in the global merge, so one conversation of any length streams through a task in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

SPAN, HEADS = 5, 9  # conversations of a base; h is below HEADS
MERGED = 4096  # depth to which a family's trie is merged in memory
BUCKET_BITS = 12  # ids of a range of 4,096 are joined as one piece of an id list
ROOT = bytes(16)
ROWS = 8192  # of an output batch

_NODES = pa.schema([
    ("base", pa.int64()), ("creator", pa.int64()), ("depth", pa.int64()), ("above", pa.int64()), ("digest", pa.binary()),
    ("bytes", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.list_(pa.int64())),
])
_NODES_DDL = "base long, creator long, depth long, above long, digest binary, bytes long, n long, least long, ends array<long>"
_SHARES = pa.schema([
    ("digest", pa.binary()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
])
_SHARES_DDL = "digest binary, children long, leaves long, saved long, conv_id long, depth long, parent_conv_id long, n_convs long"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class _Family:
    """The trie of one family while its turns stream past. A node is [creator, depth, above, digest, bytes, n, least, ends]."""

    def __init__(self, base: int, merged: int):
        self.base, self.merged, self.first, self.nodes, self.conv = base, merged, [], {}, None

    def start(self, conv: int) -> None:
        self.conv, self.seen, self.tail = conv, 0, None
        self.at = self._reach(ROOT, 0, None, 0)

    def _reach(self, digest: bytes, depth: int, above: int | None, size: int) -> list:
        node = self.nodes.get(digest)
        if node is None:
            node = self.nodes[digest] = [self.conv, depth, above, digest, size, 0, self.conv, []]
        node[5] += 1
        node[6] = min(node[6], self.conv)
        return node

    def push(self, turn: bytes, size: int) -> list | None:
        """One more turn of the current conversation; a finished row, if one leaves at once."""
        creator, depth, digest = self.at[0], self.at[1] + 1, hashlib.blake2b(self.at[3] + turn, digest_size=16).digest()
        if depth <= self.merged:
            self.at = self._reach(digest, depth, creator, size)
            return None
        done, self.tail = self.tail, [self.conv, depth, creator, digest, size, 1, self.conv, []]
        self.at = self.tail
        return done

    def end(self) -> list | None:
        if self.conv is None:
            return None
        self.at[7].append(self.conv)
        done, self.tail = self.tail, None
        return done


def _tries(heads: int, merged: int):
    """base, conv_id, h, digest, bytes in order of family, conversation (base first) and turn -> family nodes."""

    def rows(batches):
        fam = None
        for base, conv, h, turn, size in _streamed(batches):
            if fam is None or base != fam.base:
                if fam:
                    yield fam.end(), fam
                    yield from ((n, fam) for n in fam.nodes.values())
                fam = _Family(base, merged)
            if conv != fam.conv:
                yield fam.end(), fam
                fam.start(conv)
                if conv != base:
                    for t, s in fam.first[:h]:
                        yield fam.push(t, s), fam
            if conv == base and fam.seen < heads - 1:
                fam.first.append((turn, size))
            if conv == base or fam.seen >= h:
                yield fam.push(turn, size), fam
            fam.seen += 1
        if fam:
            yield fam.end(), fam
            yield from ((n, fam) for n in fam.nodes.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(((fam.base, *node) for node, fam in rows(batches) if node), _NODES)

    return run


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """base, creator, depth, above, digest, bytes, least and the merged conv_id, n_convs, n_ends, children before
    parents within a family -> the family's share of each node's sums."""

    def rows():
        family, waiting = None, {}
        for base, creator, depth, above, digest, size, least, conv, n, ends in _streamed(batches):
            if base != family:
                family, waiting = base, {}
            children, leaves, saved, below = waiting.pop((creator, depth), (0, 0, 0, []))
            for r in below:
                yield (*r[:6], conv, r[7])
            own = least == conv
            if own:
                leaves += ends == n
                saved += (n - 1) * size
            row = (digest, children, leaves, saved, conv if own else None, depth if own else None, None, n if own else None)
            if above is None:
                yield row
                continue
            up = waiting.setdefault((above, depth - 1), [0, 0, 0, []])
            up[0] += own
            up[1] += leaves
            up[2] += saved
            if own:
                up[3].append(row)
            elif children or leaves or saved:
                yield row

    yield from _packed(rows(), _SHARES)


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, piece in order -> digest, SHA-256 of the pieces joined by commas; one hash state at a time."""

    def rows():
        now, state = None, None
        for digest, piece in _streamed(batches):
            if digest != now:
                if now is not None:
                    yield now, state.hexdigest()
                now, state = digest, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if now is not None:
            yield now, state.hexdigest()

    yield from _packed(rows(), pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())]))


def family_turns(convs: DataFrame, span: int = SPAN, heads: int = HEADS) -> DataFrame:
    """base, late, conv_id, turn, h, digest (16 bytes), bytes: what the families need of each turn, JVM-side."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    base = F.col("conv_id") - F.expr(f"conv_id % {span}L")
    return convs.filter("conv_id IS NOT NULL").select(
        base.alias("base"), (base != F.col("conv_id")).alias("late"), F.col("conv_id").cast("long").alias("conv_id"), "turn",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("h"),
        F.substring(F.unhex(F.sha2(framed.cast("binary"), 256)), 1, 16).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )


def prefix_trie(convs: DataFrame, span: int = SPAN, heads: int = HEADS, merged: int = MERGED) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (long), ends_sha256.

    Conversation c is rebuilt from the first h turns of its base c - c % span and its own turns after its
    first h, with h = crc32(decimal c) % heads.

    Defined cases: a null turn comes first; turns with equal numbers follow the digest of role and text, so
    reruns agree, and repeated rows are turns of their own; null role or text is empty; rows without conv_id belong
    to no conversation and are left out; a conversation without a turn after rebuilding is a member of the root
    only; an empty table has no nodes; very long texts travel as digests and very long conversations stream (rows
    below depth ``merged`` are merged globally only); other columns are ignored, whatever their names.
    """
    turns = family_turns(convs, span, heads).repartition("base").sortWithinPartitions("base", "late", "conv_id", F.asc_nulls_first("turn"), "digest")
    nodes = written(turns.select("base", "conv_id", "h", "digest", "bytes").mapInArrow(_tries(heads, merged), _NODES_DDL), "trie_families")
    merged_nodes = written(
        nodes.groupBy("digest").agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.size("ends")).alias("n_ends")), "trie_merged"
    )
    # two scans joined by shuffle: a prefix that many families have (the root, a common first turn) is split by AQE
    back = nodes.drop("ends", "n").join(merged_nodes, "digest").select(
        "base", "creator", "depth", "above", "digest", "bytes", "least", "conv_id", "n_convs", "n_ends"
    )
    upward = back.repartition("base").sortWithinPartitions("base", (F.col("creator") != F.col("base")).desc(), F.desc("creator"), F.desc("depth"))
    summed = upward.mapInArrow(_shares, _SHARES_DDL).groupBy("digest").agg(
        *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")], *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")]
    )
    # lists of ids: pieces of an id range are sorted and joined in parallel, one task only streams a node's pieces
    pieces = (
        nodes.filter(F.size("ends") > 0).select("digest", F.explode("ends").alias("c"))
        .groupBy("digest", F.shiftright("c", BUCKET_BITS).alias("bucket"))
        .agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("piece"))
    )
    hashes = pieces.repartition("digest").sortWithinPartitions("digest", "bucket").select("digest", "piece").mapInArrow(_id_hashes, "digest binary, ends_sha256 string")
    out = summed.join(hashes, "digest", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    out = written(out, "trie")
    dropped(nodes, merged_nodes)
    return out

"""Gradient boosting on histograms, fitted in Spark.

Features become byte bins once (0 for a missing value), and rows are kept in blocks: a record holds the bins, labels, weights, parts and
margins of some thousand rows as packed vectors, so that a pass costs Spark a record a block. Every level of a tree is one aggregation over the rows: tasks
add up gradients, Hessians and counts per (model, node, feature, bin), Spark sums them by key, and the driver sees only
those histograms. The sums are fixed-point integers, so they are the same whatever the partitioning, and a sibling's
histogram is its parent's minus the other child's. Several models (the folds of a split) grow in lockstep over
the same passes, each with its own training and validation rows.

- A missing value goes to the side that gains more; infinities fall into the outer bins. Nothing is filled.
- Monotone features: a split whose child values break the sign is refused, and the middle between the
  children's values bounds all that grows below them.
- Early stopping: the pass of a tree's root also sums the loss of the validation rows after the trees before.
- ``symmetric`` trees take one split for a whole level. With ``segments`` they are boosted in order: rows
  are dealt into segments by hash, and a row's margin only uses leaf values estimated on earlier segments, never its own label.
- Absolute loss: leaf values become weighted medians of the residuals, found exactly by four passes of 16 bits
  over the order-preserving form of a double; a pass merges by addition.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage

TRAIN, VALID = 1, 2
SMALL = 64  # nodes of a tree that is evaluated by whole columns
KEEP = 8  # trees that passes evaluate again before margins are written
SHIFT = 32  # fixed-point bits of a sum, fewer where the total weight is large


@dataclass(frozen=True)
class Params:
    rounds: int = 100
    depth: int = 5
    leaves: int = 31
    rate: float = 0.03
    bins: int = 64
    least: int = 50  # rows of a leaf
    l1: float = 0.0
    l2: float = 1.0
    least_gain: float = 0.0
    feature_share: float = 1.0
    row_share: float = 1.0
    every: int = 1  # rounds for which a draw of rows holds
    patience: int = 100
    positive: float = 1.0  # weight of a positive row
    loss: str = "binary"  # or "absolute"
    symmetric: bool = False
    segments: int = 1
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number, the root 0; a leaf has feature -1. ``values`` has a row per segment and the final one last."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    values: list[list[float]] = field(default_factory=lambda: [[0.0]])

    def split(self, node: int, feature: int, at: int, missing_left: bool, gain: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node], self.right[node], self.gain[node] = feature, at, missing_left, a, a + 1, gain
        for _ in range(2):
            self.feature.append(-1), self.bin.append(0), self.missing_left.append(False), self.left.append(0), self.right.append(0), self.gain.append(0.0)
            for v in self.values:
                v.append(0.0)
        return a, a + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a bin matrix. Small trees compare whole columns, the children before their parents; for others a table of
        (node, bin) gives the next node, leaves stay where they are."""
        if len(self.feature) == 1:
            return np.zeros(len(bins), np.uint8)
        if len(self.feature) <= SMALL:
            return self._by_columns(bins)
        feature, at, miss, left, right = (np.asarray(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        inner, b = feature >= 0, np.arange(256)
        down = np.where(np.where(b == 0, miss[:, None], b <= at[:, None]), left[:, None], right[:, None])
        step = np.where(inner[:, None], down, np.arange(len(feature))[:, None]).ravel()
        split, flat, row = np.where(inner, feature, 0), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        node = np.zeros(len(bins), np.int64)
        for _ in range(self.depth()):
            node = step[(node << 8) + flat[row + split[node]]]
        return node

    def _by_columns(self, bins: np.ndarray) -> np.ndarray:
        found: list = [np.uint8(i) for i in range(len(self.feature))]
        for i in reversed(range(len(self.feature))):
            if (f := self.feature[i]) >= 0:
                b, at = bins[:, f], np.uint8(self.bin[i])
                goes = b <= at if self.missing_left[i] else b - np.uint8(1) < at  # 0 becomes 255
                left, right = found[self.left[i]], found[self.right[i]]
                # all bits of a row that goes left, then those in which the children differ
                bits = np.negative(goes.view(np.uint8))
                bits &= left ^ right
                bits ^= right
                found[i], found[self.left[i]], found[self.right[i]] = bits, None, None
        return found[0]

    def depth(self) -> int:
        """Splits on the longest path; children have higher numbers than their parents."""
        deep = [0] * len(self.feature)
        for i, f in enumerate(self.feature):
            if f >= 0:
                deep[self.left[i]] = deep[self.right[i]] = deep[i] + 1
        return max(deep)


@dataclass
class Model:
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    loss: str
    best: int  # trees at the least validation loss; all without validation rows
    history: list[float] = field(default_factory=list)

    def margins(self, columns: list[np.ndarray], trees: int | None = None) -> np.ndarray:
        bins = binned(columns, self.cuts)
        out = np.full(len(bins), self.base)
        for t in self.trees[: self.best if trees is None else trees]:
            out += np.asarray(t.values[-1])[t.nodes(bins)]
        return out

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"trees": [t.__dict__ for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        return Model(**(d | {"trees": [Tree(**t) for t in d["trees"]]}))


def binned(columns: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    """Bin numbers, a feature's together: 0 for NaN, else 1 + the number of cuts below the value."""
    out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8, "F")
    for i, (x, c) in enumerate(zip(columns, cuts, strict=True)):
        out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.asarray(c), x, "left"))
    return out


def _floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def find_cuts(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 distinct quantiles per feature, of values that are finite; one aggregation for all features."""
    shares = [i / bins for i in range(1, bins)]
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < F.lit(math.inf), F.col(c).cast("double"))
    found = rows.agg(*[F.percentile_approx(finite(c), shares, 10_000).alias(f"c{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(x or [])) for x in found]


#: A block of rows: their packed columns (those of a feature or a model together) and their summed weight.
_STATE = pa.schema([*((c, pa.binary()) for c in ("mix", "bins", "y", "w", "parts", "margins")), ("total", pa.float64())])
_STATE_DDL = "mix binary, bins binary, y binary, w binary, parts binary, margins binary, total double"
#: Bytes of a Parquet row group of blocks; a reader holds one at a time.
GROUP_BYTES = 16 << 20


def _block(*columns: np.ndarray, total: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes("F")], pa.binary()) for x in columns), pa.array([total], pa.float64())], schema=_STATE)


def _blocks_written(blocks: DataFrame) -> DataFrame:
    return storage.written(blocks, "boost_rows", {"parquet.block.size": str(GROUP_BYTES)})


def _start(n_features: int, cuts: list[list[float]], models: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = binned([_floats(b.column(i)) for i in range(n_features)], cuts)
                parts = b.column(n_features)
                marks = parts.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(b.num_rows, models)
                y, w = _floats(b.column(n_features + 2)), _floats(b.column(n_features + 3))
                yield _block(b.column(n_features + 1).to_numpy(), bins, y, w, marks, np.zeros((b.num_rows, models)), total=float(w.sum()))

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes and a salt."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    if p.loss == "absolute":
        return np.sign(margin - y) * w, w
    q, w = _sigmoid(margin), np.where(y > 0.5, p.positive * w, w)
    return (q - y) * w, q * (1 - q) * w


def losses(y: np.ndarray, margin: np.ndarray, loss: str) -> np.ndarray:
    if loss == "absolute":
        return np.abs(margin - y)
    return np.logaddexp(0.0, np.where(y > 0.5, -margin, margin))


def fixed(x: np.ndarray, shift: int) -> np.ndarray:
    """Whole numbers, as doubles that ``bincount`` adds exactly."""
    return np.rint(x * float(1 << shift))


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Doubles as uint64 in the same order."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63))


def from_key(k: int) -> float:
    u = k & (2**63 - 1) if k >> 63 else ~k & (2**64 - 1)
    return float(np.array([u], np.uint64).view(np.float64)[0])


@dataclass
class _Pass:
    """What a pass over the rows needs; ``mode`` says what it adds up."""

    mode: str  # "hist", "segment", "median" or "write"
    params: Params
    n_features: int
    shift: int
    bases: list[float]
    done: list[list[Tree]]  # per model: trees that margins don't have yet
    now: list[Tree]  # per model: the tree that grows
    wanted: list[list[int]]  # per model: nodes to add up
    used: list[list[int]]  # per model: features of this tree
    salt: int = 0
    prefix: dict = field(default_factory=dict)  # median: (model, leaf) -> bits found so far
    bits: int = 0

    def segment(self, mix: np.ndarray) -> np.ndarray:
        return (mixed(mix, self.params.seed + 7) * self.params.segments).astype(np.int64)

    def blocks(self, batches: Iterator[pa.RecordBatch]):
        """Of each block the columns, with margins as they stand after the trees that are done, and the summed weight."""
        for b in batches:
            for i in range(b.num_rows):
                yield *self.rows(*(np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in enumerate((np.int64, np.uint8, np.float64, np.float64, np.uint8, np.float64)))), b.column(6)[i].as_py()

    def rows(self, mix, bins, y, w, parts, old):
        models = len(self.bases)
        bins, parts, old = bins.reshape(self.n_features, len(mix)).T, parts.reshape(models, len(mix)).T, old.reshape(models, len(mix)).T
        margins = old.copy("F")
        segment = self.segment(mix) if self.params.segments > 1 else None
        for m, trees in enumerate(self.done):
            for t in trees:
                v, leaf = np.asarray(t.values), t.nodes(bins)
                # training rows see the values of the segments before theirs, others the final ones
                own = v[-1].take(leaf) if segment is None else np.where(parts[:, m] == TRAIN, v[segment, leaf], v[-1].take(leaf))
                margins[:, m] += own
        return mix, bins, y, w, parts, margins

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if self.mode == "write":
            for *columns, total in self.blocks(batches):
                yield _block(*columns, total=total)
            return
        held: dict[int, np.ndarray] = {}
        seen: dict[int, np.ndarray] = {}
        p, width = self.params, 256
        for mix, bins, y, w, parts, margins, _ in self.blocks(batches):
            drawn = mixed(mix, p.seed * 1000 + self.salt // p.every) < p.row_share if p.row_share < 1 else True
            for m, tree in enumerate(self.now):
                margin = margins[:, m] + self.bases[m]
                if self.mode == "hist" and len(tree.feature) == 1 and (valid := parts[:, m] == VALID).any():
                    x = held.setdefault(-1 - m, np.zeros(3, np.int64))
                    x[0] += int(fixed(losses(y[valid], margin[valid], p.loss) * w[valid], self.shift).sum())
                    x[1] += int(fixed(w[valid], self.shift).sum())
                    x[2] += int(valid.sum())
                if not self.wanted[m]:
                    continue
                leaf = tree.nodes(bins)
                place = np.full(len(tree.feature), -1)
                place[self.wanted[m]] = np.arange(len(self.wanted[m]))
                take = np.flatnonzero((parts[:, m] == TRAIN) & drawn & (place[leaf] >= 0))
                if not len(take):
                    continue
                at = place[leaf[take]]
                if self.mode == "median":
                    key = ordered_keys(y[take] - margin[take])
                    first = np.array([self.prefix.get((m, n), 0) for n in self.wanted[m]], np.uint64)[at]
                    in_it = np.ones(len(take), bool) if not self.bits else (key >> np.uint64(64 - self.bits)) == first
                    digit = (key >> np.uint64(48 - self.bits)) & np.uint64(0xFFFF)
                    wide = at[in_it].astype(np.int64) << 16 | digit[in_it].astype(np.int64)
                    if m not in held:
                        held[m], seen[m] = np.zeros(len(self.wanted[m]) << 16, np.int64), np.zeros(len(self.wanted[m]) << 16, bool)
                    np.add.at(held[m], wide, fixed(w[take][in_it], self.shift).astype(np.int64))
                    seen[m][wide] = True
                    continue
                g, h = (fixed(x, self.shift) for x in gradients(y[take], w[take], margin[take], p))
                if self.mode == "segment":
                    size = len(self.wanted[m]) * p.segments
                    cell = at * p.segments + self.segment(mix[take])
                else:  # feature by feature
                    nodes, first = len(self.wanted[m]), at * width
                    if m not in held:
                        held[m] = np.zeros((3, nodes * self.n_features * width), np.int64)
                    cells = held[m].reshape(3, nodes, self.n_features, width)
                    for f in self.used[m]:
                        cell = first + bins[:, f].take(take)
                        for i, x in enumerate((g, h, None)):
                            cells[i, :, f] += np.bincount(cell, x, nodes * width).astype(np.int64).reshape(nodes, width)
                    continue
                if m not in held:
                    held[m] = np.zeros((3, size), np.int64)
                acc = held[m]
                acc[0] += np.bincount(cell, g, size).astype(np.int64)
                acc[1] += np.bincount(cell, h, size).astype(np.int64)
                acc[2] += np.bincount(cell, minlength=size)
        for m, acc in held.items():
            if m < 0:
                yield _sums([m], [0], [acc[0]], [acc[1]], [acc[2]])
            elif m in seen:
                if len(k := np.flatnonzero(seen[m])):
                    yield _sums(np.full(len(k), m), k, acc[k], np.zeros(len(k), np.int64), np.zeros(len(k), np.int64))
            elif len(k := np.flatnonzero(acc[2])):
                yield _sums(np.full(len(k), m), k, *(x[k] for x in acc))


_SUMS = pa.schema([("m", pa.int32()), ("k", pa.int64()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])


def _sums(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMS, strict=True)], schema=_SUMS)


def _run(state: DataFrame, work: _Pass) -> dict[int, tuple[np.ndarray, ...]]:
    """The sums of one pass by model: keys with gradients, Hessians, counts."""
    summed = state.mapInArrow(work, "m int, k long, g long, h long, n long").groupBy("m", "k").agg(*[F.sum(c).alias(c) for c in "ghn"])
    t = summed.toArrow()
    m, *rest = (t[c].to_numpy() for c in "mkghn")
    return {int(x): tuple(c[m == x] for c in rest) for x in np.unique(m)}


@dataclass
class _Node:
    g: int
    h: int
    n: int
    low: float = -math.inf
    high: float = math.inf
    hist: np.ndarray | None = None


def leaf_value(g, h, p: Params, low=-math.inf, high=math.inf):
    """The value that minimises the second-order loss within bounds; arrays or numbers."""
    shrunk = np.sign(g) * np.maximum(np.abs(g) - p.l1, 0.0)
    return np.clip(-shrunk / (h + p.l2 + 1e-16), low, high)


def node_score(g, h, v, p: Params):
    """What a node with value ``v`` takes off the loss."""
    return -(g * v + 0.5 * (h + p.l2) * v * v + p.l1 * np.abs(v))


def best_splits(node: _Node, p: Params, sign: np.ndarray, used: list[int], scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gains of all splits of a node by (missing side, feature, bin), -inf where refused, and the children's values and sums."""
    hist = node.hist[:, used].astype(float)  # 3, features, 256
    g, h, n = hist[0] / scale, hist[1] / scale, hist[2]
    total = np.array([node.g / scale, node.h / scale, node.n])
    below = np.stack([np.cumsum(x[:, 1:], axis=1) for x in (g, h, n)])  # without missing
    miss = np.stack([x[:, :1] for x in (g, h, n)])
    left = np.stack([below, below + miss])  # missing right, missing left
    right = total[None, :, None, None] - left
    value = lambda s: leaf_value(s[:, 0], s[:, 1], p, node.low, node.high)
    vl, vr = value(left), value(right)
    own = leaf_value(total[0], total[1], p, node.low, node.high)
    gain = node_score(left[:, 0], left[:, 1], vl, p) + node_score(right[:, 0], right[:, 1], vr, p) - node_score(total[0], total[1], own, p)
    refused = (left[:, 2] < max(1, p.least)) | (right[:, 2] < max(1, p.least)) | (sign[used][None, :, None] * (vr - vl) < 0)
    refused[1] |= miss[2] == 0  # without missing values both sides are one split
    return np.where(refused, -np.inf, gain), vl, vr, left


class _Grower:
    """The tree of one model while it grows."""

    def __init__(self, p: Params, sign: np.ndarray, used: list[int], scale: float):
        self.p, self.sign, self.used, self.scale = p, sign, used, scale
        self.tree, self.nodes, self.level, self.open = Tree(), {}, [0], True
        self.pairs: list[tuple[int, int, int]] = []

    def wanted(self) -> list[int]:
        """Nodes whose histograms are to be added up: of two siblings the one with fewer rows."""
        if not self.open:
            return []
        return [0] if not self.nodes else [a if self.nodes[a].n <= self.nodes[b].n else b for _, a, b in self.pairs]

    def take(self, wanted: list[int], k: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, n_features: int) -> None:
        size = n_features * 256
        hist = np.zeros((3, len(wanted) * size), np.int64)
        hist[:, k] = g, h, n
        hist = hist.reshape(3, len(wanted), n_features, 256)
        for i, node in enumerate(wanted):
            if node == 0:
                f = self.used[0]
                self.nodes[0] = _Node(*(int(x) for x in hist[:, 0, f].sum(axis=1)))
            self.nodes[node].hist = hist[:, i]
        for parent, a, b in self.pairs:
            done, other = (a, b) if self.nodes[a].hist is not None else (b, a)
            self.nodes[other].hist = self.nodes[parent].hist - self.nodes[done].hist
            self.nodes[parent].hist = None
        self.grow()

    def grow(self) -> None:
        p, room = self.p, self.p.leaves - sum(f < 0 for f in self.tree.feature)
        found = {i: best_splits(self.nodes[i], p, self.sign, self.used, self.scale) for i in self.level}
        chosen: list[tuple[float, int, tuple]] = []
        if p.symmetric:
            # one split for the level: its gains add up over the nodes that it can split
            total = sum(np.where(np.isfinite(x[0]), np.maximum(x[0], 0.0), 0.0) for x in found.values())
            at = np.unravel_index(np.argmax(total), total.shape)
            if total[at] > p.least_gain:
                chosen = [(float(x[0][at]), i, at) for i, x in found.items() if np.isfinite(x[0][at])]
        else:
            for i, x in found.items():
                at = np.unravel_index(np.argmax(x[0]), x[0].shape)
                if x[0][at] > max(p.least_gain, 1e-12):
                    chosen.append((float(x[0][at]), i, at))
            chosen = sorted(chosen, key=lambda c: (-c[0], c[1]))[: max(0, room)]
        self.pairs = []
        for gain, i, at in chosen:
            _, vl, vr, _ = found[i]
            parent, feature, cut = self.nodes[i], self.used[at[1]], int(at[2]) + 1
            part = parent.hist[:, feature, 1 : cut + 1].sum(axis=1) + (parent.hist[:, feature, 0] if at[0] else 0)
            a, b = self.tree.split(i, feature, cut, bool(at[0]), gain)
            low = high = [parent.low, parent.high]
            if s := self.sign[feature]:
                middle = (vl[at] + vr[at]) / 2
                low, high = ([parent.low, middle], [middle, parent.high]) if s > 0 else ([middle, parent.high], [parent.low, middle])
            self.nodes[a] = _Node(*(int(x) for x in part), *low)
            self.nodes[b] = _Node(parent.g - int(part[0]), parent.h - int(part[1]), parent.n - int(part[2]), *high)
            self.pairs.append((i, a, b))
        self.level = [c for _, a, b in self.pairs for c in (a, b)]
        self.open = bool(self.level)

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.tree.feature) if f < 0]

    def settle(self) -> None:
        """Leaf values from the nodes' sums, times the learning rate."""
        v = [0.0] * len(self.tree.feature)
        for i in self.leaves():
            x = self.nodes[i]
            v[i] = self.p.rate * float(leaf_value(x.g / self.scale, x.h / self.scale, self.p, x.low, x.high))
        self.tree.values = [v]


def weighted_medians(state: DataFrame, work: _Pass) -> dict[tuple[int, int], float]:
    """(model, leaf) -> the least residual at which half of the leaf's weight is reached: 16 more bits of it in every pass."""
    half: dict[tuple[int, int], int] = {}
    prefix = {(m, n): 0 for m, nodes in enumerate(work.wanted) for n in nodes}
    for bits in (0, 16, 32, 48):
        sums = _run(state, replace(work, mode="median", prefix=prefix, bits=bits))
        found = {}
        for m, nodes in enumerate(work.wanted):
            if m not in sums:
                continue
            k, g, *_ = sums[m]
            order = np.argsort(k)
            k, g = k[order], g[order]
            for i, n in enumerate(nodes):
                lo, hi = np.searchsorted(k, [i << 16, (i + 1) << 16])
                if lo == hi:
                    continue
                run = np.cumsum(g[lo:hi])
                need = half.get((m, n), (int(run[-1]) + 1) // 2)
                j = min(int(np.searchsorted(run, need, "left")), hi - lo - 1)
                half[m, n] = need - (int(run[j - 1]) if j else 0)
                found[m, n] = prefix[m, n] << 16 | (int(k[lo + j]) & 0xFFFF)
        prefix = found
        work = replace(work, wanted=[[n for n in nodes if (m, n) in prefix] for m, nodes in enumerate(work.wanted)])
    return {key: from_key(v) for key, v in prefix.items()}


def fit(
    rows: DataFrame, features: list[str], params: Params = Params(), parts: str | None = None, label: str = "y", weight: str = "weight",
    key: str = "id", monotone: dict[str, int] | None = None, limits: list[int] | None = None, cuts: list[list[float]] | None = None,
) -> list[Model]:
    """One model per entry of ``parts`` (an array column: 1 trains the model, 2 validates it, 0 does neither); without it, one
    model trained on all rows. ``limits`` ends models after so many trees each. ``cuts`` are those
    of a fit on the same rows. Results depend on rows and parameters only, not on partitioning.

    Defined cases: null, NaN and infinite features are values like others; rows with null label or weight, or an infinite label,
    train nothing; a model without training rows, or whose rows all have one label, has no trees; without validation
    rows all rounds are used; ``key`` deals rows to draws and segments, so rows with equal keys stay together.
    """
    p = params
    y = F.col(label).cast("double")
    known = rows.filter(y.isNotNull() & F.col(weight).isNotNull() & (F.abs(y) < F.lit(math.inf)))
    cuts = cuts or find_cuts(known, features, min(p.bins, 255))
    spread = known.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], (F.col(parts) if parts else F.array(F.lit(TRAIN))).alias("parts"), F.xxhash64(F.col(key)).alias("mix"), y.alias("y"), F.col(weight).cast("double").alias("w"))
    models = known.select(F.size(parts).alias("n")).first() if parts else (1,)
    if models is None:
        return []
    models = models[0]
    state = _blocks_written(spread.mapInArrow(_start(len(features), cuts, models), _STATE_DDL))
    total = state.agg(F.sum("total")).first()[0] or 0.0
    shift = max(8, min(SHIFT, 60 - math.ceil(math.log2(total + 2))))
    scale, nf = float(1 << shift), len(features)
    sign = np.array([(monotone or {}).get(c, 0) for c in features], float)
    none = [[] for _ in range(models)]
    blank = lambda **k: _Pass("hist", p, nf, shift, [0.0] * models, none, [Tree() for _ in range(models)], [[0]] * models, [[0]] * models, **k)
    bases = [0.0] * models
    whole = replace(p, row_share=1.0)
    if p.loss == "absolute":
        for (m, _), v in weighted_medians(state, replace(blank(), params=whole)).items():
            bases[m] = v
    else:
        for m, (_, g, h, n) in _run(state, replace(blank(), params=whole)).items():
            if m >= 0 and h.sum():  # at margin 0 a row's Hessian is a quarter of its weight, its gradient half or minus half of it
                share = float(0.5 - g.sum() / scale / (4 * h.sum() / scale))
                bases[m] = math.log(share / (1 - share)) if 1e-9 < share < 1 - 1e-9 else math.copysign(20.0, share - 0.5)
    out = [Model(features, cuts, b, [], p.loss, 0) for b in bases]
    least, active = [(math.inf, 0)] * models, [True] * models
    pending: list[list[Tree]] = [[] for _ in range(models)]

    def validated(sums: dict) -> None:
        for m in range(models):
            if active[m] and -1 - m in sums:
                _, g, h, _ = sums[-1 - m]
                out[m].history.append(float(g[0]) / max(1.0, float(h[0])))
                least[m] = min(least[m], (out[m].history[-1], len(out[m].trees)))
                active[m] = len(out[m].trees) - least[m][1] < p.patience

    for r in range(p.rounds):
        active = [a and (limits is None or len(x.trees) < limits[m]) for m, (a, x) in enumerate(zip(active, out, strict=True))]
        draw = np.random.default_rng([p.seed, r])
        used = sorted(draw.permutation(nf)[: max(1, math.ceil(nf * p.feature_share))].tolist())
        growers = [_Grower(p, sign, used, scale) if a else None for a in active]
        for level in range(p.depth):
            wanted = [g.wanted() if g else [] for g in growers]
            if not any(wanted):
                break
            work = _Pass("hist", p, nf, shift, bases, pending, [g.tree if g else Tree() for g in growers], wanted, [used] * models, salt=r)
            sums = _run(state, work)
            if level == 0:
                validated(sums)
                growers = [g if a else None for g, a in zip(growers, active, strict=True)]
            for m, g in enumerate(growers):
                if g and wanted[m]:
                    if m in sums:
                        g.take(wanted[m], *sums[m], nf)
                    else:
                        g.open = False
        for m, g in enumerate(growers):
            if g and len(g.tree.feature) == 1:  # nothing left to gain
                active[m], growers[m] = False, None
        if not any(growers):
            break
        for g in growers:
            if g:
                g.settle()
        settled = _Pass("segment", p, nf, shift, bases, pending, [g.tree if g else Tree() for g in growers], [g.leaves() if g else [] for g in growers], [used] * models, salt=r)
        if p.loss == "absolute":
            for (m, leaf), v in weighted_medians(state, settled).items():
                growers[m].tree.values[0][leaf] = p.rate * v
        elif p.segments > 1:
            sums = _run(state, settled)
            for m, g in enumerate(growers):
                if g:
                    cells = np.zeros((2, len(settled.wanted[m]) * p.segments))
                    cells[:, sums[m][0]] = sums[m][1] / scale, sums[m][2] / scale
                    cells = cells.reshape(2, -1, p.segments)
                    final = g.tree.values[-1]
                    g.tree.values = []
                    for s in range(p.segments):
                        v = [0.0] * len(final)
                        before = cells[:, :, :s].sum(axis=2)
                        for i, leaf in enumerate(settled.wanted[m]):
                            x = g.nodes[leaf]
                            v[leaf] = p.rate * float(leaf_value(before[0, i], before[1, i], p, x.low, x.high)) if s else 0.0
                        g.tree.values.append(v)
                    g.tree.values.append(final)
        for m, g in enumerate(growers):
            if g:
                out[m].trees.append(g.tree)
                pending[m].append(g.tree)
        if max(map(len, pending)) >= KEEP:
            before = state
            state = _blocks_written(state.mapInArrow(replace(settled, mode="write"), _STATE_DDL))
            storage.dropped(before)
            pending = [[] for _ in range(models)]
    if any(active) and limits is None and any(m.history for m in out):  # the loss after the last tree
        work = _Pass("hist", p, nf, shift, bases, pending, [Tree() for _ in range(models)], none, none)
        validated(_run(state, work))
    storage.dropped(state)
    for m, x in enumerate(out):
        x.best = least[m][1] if x.history else len(x.trees)
    return out


def predict(rows: DataFrame, model: Model, name: str, trees: int | None = None) -> DataFrame:
    """``rows`` with the model's probability (or value, for absolute loss) as ``name``; Arrow batches of the features only."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        m = shared.value
        margin = m.margins([x[c].to_numpy(float) for c in x.columns], trees)
        return pd.Series(margin if m.loss == "absolute" else _sigmoid(margin))

    return rows.withColumn(name, score(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(model.features)])))


def importance(model: Model) -> dict[str, tuple[float, int]]:
    """feature -> gain and number of splits over the trees in use."""
    out = dict.fromkeys(model.features, (0.0, 0))
    for t in model.trees[: model.best]:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                gain, n = out[model.features[f]]
                out[model.features[f]] = gain + g, n + 1
    return out

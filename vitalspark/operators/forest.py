"""Random forests grown level by level from histograms, all trees at once, for imputation.

Features are cut into a fixed number of bins at their quantiles, or by value where there are few. A level of all trees is one
job: tasks send their rows down the trees so far, add up target sums by (tree, node, feature, bin), and hand on those of the
nodes that they saw; a shuffle by (tree, node) adds them up and finds each node's best split where it lands. Only splits come
to the driver, and a forest is arrays of at most trees x 2^(depth + 1) nodes, whatever the rows. Bootstrap samples are Poisson
weights from a digest of (tree, row), so no sample is written; the features that a node may split by are a digest of its name.

Where the features have few combinations of bins, rows of one combination go the same way in every tree. Then the rows are read
once: tasks add up the target sums of each (tree, combination), and a tree grows from its table where that lands.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, rows of a task whose sums go out together, and rows that go through the trees at a time.
BINS, CHUNK_ROWS, BLOCK_ROWS = 32, 1_000_000, 20_000
#: Numbers that a task may hold as sums by tree and combination of bins; beyond, forests grow a level a job. Combinations whose
#: predictions are worked out beforehand.
CELL_NUMBERS, LOOKUP = 8 << 20, 1 << 16
#: Steps of a target's span.
STEPS = 1 << 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: The same as numbers of 53 bits, and the weight of each start of 16 bits, 255 where the other bits decide.
_BOUNDS = np.array([math.ceil(b * (1 << 53)) for b in _POISSON], np.uint64)
_STARTS = np.searchsorted(_BOUNDS, np.arange(1 << 16, dtype=np.uint64) << np.uint64(37), side="right").astype(np.uint8)
_STARTS[np.minimum(_BOUNDS >> np.uint64(37), np.uint64(0xFFFF)).astype(int)] = 255


def _mixed(x: np.ndarray) -> np.ndarray:
    """Digests of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def _salted(ids: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(ids + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    return (_salted(ids, salt) >> np.uint64(11)) / float(1 << 53)


def weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's sample."""
    x = _salted(ids, seed * 65_537 + tree + 1)
    w = _STARTS[x >> np.uint64(48)]
    open_ = np.flatnonzero(w == 255)
    w[open_] = np.searchsorted(_BOUNDS, x[open_] >> np.uint64(11), side="right")
    return w


def allowed(trees: np.ndarray, nodes: np.ndarray, features: int, some: int, seed: int) -> np.ndarray:
    """(nodes, features): the `some` features of smallest digest that each node may split by."""
    if some >= features:
        return np.ones((len(nodes), features), bool)
    name = (trees.astype(np.uint64) << np.uint64(32) | nodes.astype(np.uint64)) * np.uint64(features)
    u = np.stack([_uniform(name + np.uint64(f), seed + 7) for f in range(features)], 1)
    return u <= np.partition(u, some - 1, axis=1)[:, some - 1 : some]


@dataclass(frozen=True)
class Forest:
    """Nodes are numbered as in a heap; a row goes left if its bin is at most the node's. Leaves have feature -1."""

    feature: np.ndarray  # (trees, nodes)
    bin: np.ndarray
    value: np.ndarray  # (trees, nodes, targets): mean, or shares of the classes

    def nodes(self, bins: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """The node of each row after at most `depth` steps."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, rows = self.feature[tree], self.bin[tree], np.arange(len(bins))
        for _ in range(depth):
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            own = at[inner]
            at[inner] = 2 * own + 1 + (bins[rows[inner], f[inner]] > cut[own])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Mean over trees; of classes the one with the largest mean share."""
        depth = int(math.log2(self.feature.shape[1] + 1))
        total = np.zeros((len(bins), self.value.shape[2]))
        for t in range(len(self.feature)):
            total += self.value[t][self.nodes(bins, t, depth)]
        return total[:, 0] / len(self.feature) if total.shape[1] == 1 else total.argmax(1).astype(float)


def score(sums: np.ndarray, classes: int) -> np.ndarray:
    """What a split maximises, summed over its sides: squared sum of the target by weight, or of classes by weight."""
    total = sums[..., 0] if not classes else sums.sum(-1)
    top = sums[..., 1] ** 2 if not classes else (sums**2).sum(-1)
    return np.divide(top, total, out=np.zeros_like(top), where=total > 0)


def best_splits(sums: np.ndarray, may: np.ndarray, classes: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(feature or -1, bin) of nodes with sums (nodes, features, bins, stats); ties go to the first feature and bin."""
    left = np.cumsum(sums, 2)[:, :, :-1]
    whole = sums[:, 0].sum(1)
    right = whole[:, None, None] - left
    n = (lambda s: s.sum(-1)) if classes else (lambda s: s[..., 0])
    base = score(whole, classes)
    gain = score(left, classes) + score(right, classes) - base[:, None, None]
    gain = np.where((n(left) >= least) & (n(right) >= least) & may[:, :, None], gain, -np.inf).reshape(len(sums), -1)
    at = gain.argmax(1)
    good = gain[np.arange(len(sums)), at] > 1e-12 * np.abs(base) + 1e-300
    return np.where(good, at // (BINS - 1), -1), np.where(good, at % (BINS - 1), 0)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _cell(stats: int) -> np.dtype:
    """A cell of a node's table: its number (feature x bins + bin) and its sums."""
    return np.dtype([("at", "<u2"), ("sums", "<f8", (stats,))])


def level_sums(forest: Forest, level: int, bins: np.ndarray, stats: np.ndarray, ids: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each tree: the nodes of a level that some of these rows are in, the filled cells of each, and where they end.

    The cells are a list and not a table, because deep nodes have few rows.
    """
    first, (n, p), k = (1 << level) - 1, bins.shape, stats.shape[1]
    table = p * BINS
    for t in range(len(forest.feature)):
        sums = np.zeros((k, (1 << level) * table))
        for s in range(0, n, BLOCK_ROWS):
            part = bins[s : s + BLOCK_ROWS]
            w = weights(ids[s : s + BLOCK_ROWS], t, seed)
            node = forest.nodes(part, t, level) - first  # rows in leaves of upper levels are below 0
            keep = np.flatnonzero((w > 0) & (node >= 0))
            own = stats[s : s + BLOCK_ROWS][keep] * w[keep, None]
            cell = ((node[keep] * table)[:, None] + np.arange(p) * BINS + part[keep]).ravel()
            for j in range(k):
                sums[j] += np.bincount(cell, np.repeat(own[:, j], p), sums.shape[1])
        filled = np.flatnonzero(sums.any(0))
        node, start = np.unique(filled // table, return_index=True)
        out = np.empty(len(filled), _cell(k))
        out["at"], out["sums"] = filled % table, sums[:, filled].T
        yield t, node + first, out, np.r_[start[1:], len(filled)]


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return bins, batch.column("y").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64)


def _level(rows: DataFrame, forest: Forest, level: int, width: int, stats_of: Callable[[np.ndarray], np.ndarray], classes: int, some: int, least: float, seed: int) -> pa.Table:
    """(tree, node, feature, bin, sums left, sums right) of all nodes of a level, feature -1 for leaves."""
    kind = _cell(classes or 2)
    stats = kind["sums"].shape[0]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give() -> Iterator[pa.RecordBatch]:
            bins, y, ids = (np.concatenate(x) for x in zip(*held))
            for t, nodes, cells, ends in level_sums(forest, level, bins, stats_of(y), ids, seed):
                offsets = pa.py_buffer(np.r_[0, ends * kind.itemsize].astype("<i4").tobytes())
                raw = pa.Array.from_buffers(pa.binary(), len(nodes), [None, offsets, pa.py_buffer(cells.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), t, np.int32)), pa.array(nodes.astype(np.int32)), raw], names=["tree", "node", "cells"])

        for batch in batches:
            held.append(_columns(batch, width))
            if sum(len(x[1]) for x in held) >= CHUNK_ROWS:
                yield from give()
                held = []
        if held and sum(len(x[1]) for x in held):
            yield from give()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        open_ = np.zeros((width, BINS, stats))

        def give(trees: np.ndarray, nodes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            feature, cut = best_splits(sums, allowed(trees, nodes, width, some, seed), classes, least)
            whole, every = sums[:, 0].sum(1), np.arange(len(sums))
            own = np.cumsum(sums[every, np.maximum(feature, 0)], 1)[every, cut]
            left = np.where(feature[:, None] >= 0, own, whole)
            return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (trees, nodes, feature, cut)), _lists(left), _lists(whole - left)], names=["tree", "node", "feature", "bin", "left", "right"])

        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                tree, node = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "node"))
                raw = part.column("cells").to_pylist()
                new = np.r_[True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])]
                group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
                cells = np.frombuffer(b"".join(raw), kind)
                at = np.repeat(group, [len(r) // kind.itemsize for r in raw]) * width * BINS + cells["at"]
                sums = np.stack([np.bincount(at, cells["sums"][:, j], len(starts) * width * BINS) for j in range(stats)], 1).reshape(len(starts), width, BINS, stats)
                if last == (tree[0], node[0]):
                    sums[0] += open_
                elif last is not None:
                    yield give(np.array([last[0]]), np.array([last[1]]), open_[None])
                last, open_ = (tree[-1], node[-1]), sums[-1].copy()
                if len(starts) > 1:
                    yield give(tree[starts[:-1]], node[starts[:-1]], sums[:-1])
        if last is not None:
            yield give(np.array([last[0]]), np.array([last[1]]), open_[None])

    parts = rows.mapInArrow(local, "tree int, node int, cells binary")
    ordered = parts.repartition("tree", "node").sortWithinPartitions("tree", "node")
    return ordered.mapInArrow(split, "tree int, node int, feature int, bin int, left array<double>, right array<double>").toArrow()  # a row a node


def combinations(sizes: Sequence[int]) -> np.ndarray:
    """(combinations, features): the bins of each combination, the last feature's running fastest."""
    return np.stack(np.unravel_index(np.arange(math.prod(sizes)), sizes), 1).astype(np.uint8)


def add_cells(sums: np.ndarray, bins: np.ndarray, stats: np.ndarray, ids: np.ndarray, sizes: Sequence[int], seed: int) -> None:
    """Add to sums (trees, stats, combinations) the weighted stats of rows, by their combination of bins."""
    cell = np.ravel_multi_index(tuple(bins.T), sizes)
    for t, own in enumerate(sums):
        w = weights(ids, t, seed)
        for j in range(len(own)):
            own[j] += np.bincount(cell, stats[:, j] * w, own.shape[1])


def grow(bins: np.ndarray, sums: np.ndarray, tree: int, classes: int, depth: int, least: float, some: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """A level at a time: nodes, features, bins and sums on the left and right of a tree whose rows are (bins, sums)."""
    (n, p), k = bins.shape, sums.shape[1]
    node, slots = np.zeros(n, np.int64), np.arange(p) * BINS
    for _ in range(depth):
        names, own = np.unique(node, return_inverse=True)
        cell = ((own * p * BINS)[:, None] + slots + bins).ravel()
        table = np.stack([np.bincount(cell, np.repeat(sums[:, j], p), len(names) * p * BINS) for j in range(k)], 1).reshape(len(names), p, BINS, k)
        feature, cut = best_splits(table, allowed(np.full(len(names), tree), names, p, some, seed), classes, least)
        whole, every = table[:, 0].sum(1), np.arange(len(names))
        left = np.where(feature[:, None] >= 0, np.cumsum(table[every, np.maximum(feature, 0)], 1)[every, cut], whole)
        yield names, feature, cut, left, whole - left
        inner = feature[own] >= 0
        if not inner.any():
            break
        node, bins, sums, own = node[inner], bins[inner], sums[inner], own[inner]
        node = 2 * node + 1 + (bins[np.arange(len(own)), feature[own]] > cut[own])


def _whole(rows: DataFrame, sizes: Sequence[int], stats_of: Callable[[np.ndarray], np.ndarray], classes: int, trees: int, depth: int, some: int, least: float, seed: int) -> pa.Table:
    """(tree, node, feature, bin, sums left, sums right) of all nodes of all trees, in one job that reads the rows once."""
    width, k, n = len(sizes), classes or 2, math.prod(sizes)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trees, k, n))
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_ROWS):
                bins, y, ids = _columns(batch.slice(s, BLOCK_ROWS), width)
                add_cells(sums, bins, stats_of(y), ids, sizes, seed)
        for t in range(trees):
            filled = np.flatnonzero(sums[t].any(0))
            if len(filled):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([filled.astype("<i4").tobytes()], pa.binary()), pa.array([sums[t][:, filled].tobytes()], pa.binary())], names=["tree", "cells", "sums"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, cells, raw in zip(*(batch.column(c).to_pylist() for c in ("tree", "cells", "sums"))):
                at = np.frombuffer(cells, "<i4")
                held.setdefault(t, np.zeros((k, n)))[:, at] += np.frombuffer(raw).reshape(k, -1)
        every = combinations(sizes)
        for t, sums in held.items():
            filled = np.flatnonzero(sums.any(0))
            for names, feature, cut, left, right in grow(every[filled], sums[:, filled].T, t, classes, depth, least, some, seed):
                ints = (np.full(len(names), t), names, feature, cut)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in ints), _lists(left), _lists(right)], names=["tree", "node", "feature", "bin", "left", "right"])

    parts = rows.mapInArrow(local, "tree int, cells binary, sums binary").repartition("tree")
    return parts.mapInArrow(grown, "tree int, node int, feature int, bin int, left array<double>, right array<double>").toArrow()  # a row a node


def reads_once(sizes: Sequence[int], classes: int, trees: int) -> bool:
    """Whether the combinations of bins are so few that `fit_forest` reads its rows once."""
    return bool(sizes) and math.prod(sizes) * trees * (classes or 2) <= CELL_NUMBERS


def fit_forest(rows: DataFrame, width: int, classes: int = 0, span: tuple[float, float] = (0.0, 1.0), trees: int = 100, depth: int = 10, least: float = 1.0, some: int | None = None, seed: int = 5, sizes: Sequence[int] | None = None) -> Forest:
    """rows(id long, bins binary, y double) with `width` features → a forest.

    sizes: number of bins of each feature, if known; with few combinations of them the rows are read once and not once a level.

    classes: number of classes, whose codes y holds; 0 for a mean, of targets within `span`, which are counted in 2^20 steps
    of it: sums are then exact and the same in any order. least: weight of a leaf at least; some: features that a node may
    split by, by default all, or for classes the root of their number.
    """
    some = (math.ceil(math.sqrt(width)) if classes else width) if some is None else some
    low, step = span[0], max(span[1] - span[0], 1e-300) / STEPS
    stats_of = lambda y: np.eye(classes)[y.astype(int)] if classes else np.stack([np.ones(len(y)), np.rint((y - low) / step)], 1)
    value = lambda s: s / s.sum(1, keepdims=True) if classes else low + step * s[:, 1:] / s[:, :1]
    size = (1 << depth + 1) - 1
    forest = Forest(np.full((trees, size), -1, np.int16), np.zeros((trees, size), np.uint8), np.zeros((trees, size, max(1, classes)), np.float32))
    once = depth > 0 and reads_once(sizes or (), classes, trees)
    for level in range(1 if once else depth):
        found = _whole(rows, sizes, stats_of, classes, trees, depth, some, least, seed) if once else _level(rows, forest, level, width, stats_of, classes, some, least, seed)
        if not found.num_rows:
            break
        t, n, f, b = (found[c].to_numpy() for c in ("tree", "node", "feature", "bin"))
        left, right = (found[c].combine_chunks().flatten().to_numpy().reshape(len(t), -1) for c in ("left", "right"))
        if not level:
            root = np.flatnonzero(n == 0)
            forest.value[t[root], n[root]] = value(left[root] + right[root])
        inner = np.flatnonzero(f >= 0)
        t, n = t[inner], n[inner]
        forest.feature[t, n], forest.bin[t, n] = f[inner], b[inner]
        forest.value[t, 2 * n + 1], forest.value[t, 2 * n + 2] = value(left[inner]), value(right[inner])
        if not len(inner):
            break
    return forest


def edges(df: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of the bins of each column but the last: its values where there are no more than bins, else quantiles."""
    shares = [k / BINS for k in range(1, BINS)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{k}") for k, c in enumerate(columns)], *[F.approx_count_distinct(c).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    out = []
    for k, c in enumerate(columns):
        own = np.unique(np.array(row[f"q{k}"] or [], float))
        if row[f"n{k}"] <= BINS // 2:
            own = np.array(sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("double")).distinct().limit(BINS + 1).collect()), float)  # few values
            own = own[:-1] if len(own) <= BINS else np.unique(np.array(row[f"q{k}"], float))
        out.append(own)
    return out


def binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(rows, features) bins: the number of cuts that a value is above."""
    return np.stack([np.searchsorted(c, x, side="left") for x, c in zip(columns, cuts)], 1).astype(np.uint8) if columns else np.zeros((0, 0), np.uint8)

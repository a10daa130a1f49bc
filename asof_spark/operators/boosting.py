"""Histogram boosting with leaf-wise trees, many configurations at once.

Rows are binned once and kept as blocks of arrays, spread over the executors. A round is one Spark job for all
configurations: each block sums gradients, hessians and rows by (configuration, leaf, feature, bin), sums are combined by
configuration, and only the best split of each leaf reaches the driver. A round evaluates every leaf that the best-first tree
can still come to split, so a tree takes as many rounds as it is deep, not as it has leaves. Rows that fill one block alone
need no exchange of sums: there one job grows all trees, a configuration a task, and a split sums its smaller side alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks

BINS = 255
#: Rows of a block, some 23 MB of bins of eleven columns; the task of a fit over one block of that size held 370 MB.
BLOCK_ROWS = 1 << 21
#: Held-out rows of a task, enough that going through thousands of trees is work on rows.
HELD_ROWS = 1 << 16
#: Rows that are summed at a time, so that their cells and gradients stay in cache.
CHUNK_ROWS = 1 << 14
LEAST_ROWS, LEAST_HESSIAN = 20, 1e-3
BLOCK = "n long, x binary, y binary"
#: Iterations after which the state is written, so that its lineage stays short.
KEEP_EVERY = 20


@dataclass
class Fit:
    """One configuration and its trees so far."""

    learning_rate: float
    leaves: int
    l2: float
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)


@dataclass
class _Node:
    sums: tuple[float, float, float] | None = None
    #: gain, feature, bin, sums of the left side; None: no split
    split: tuple | None = None
    #: least gain on the way here
    key: float = -1.0
    children: tuple[int, int] | None = None
    above: float = math.inf


def edges_of(rows: DataFrame, columns: tuple[str, ...], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of each column: distinct quantiles of its values. Two passes; nulls are left out."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 100 * bins).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(x if x is not None else [], float)) for x in found]


def _binned(rows: DataFrame, columns: tuple[str, ...], label: str, edges: list[np.ndarray]) -> DataFrame:
    """n, x (bytes of n x columns bins) and y (bytes) of every block."""

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            x = np.stack([np.searchsorted(e, f[c].to_numpy(float), "left").astype(np.uint8) for c, e in zip(columns, edges)], 1)
            held.append((x, f[label].to_numpy(float).astype(np.uint8)))
            size += len(f)
            if size >= BLOCK_ROWS:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    def block(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        x, y = (np.concatenate(a) for a in zip(*held))
        return pd.DataFrame({"n": [len(y)], "x": [x.tobytes()], "y": [y.tobytes()]})

    return rows.select(*columns, label).mapInPandas(blocks, BLOCK)


def _leaf_of(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Node of each row in a tree (feature or -1, bin, left, right, ...)."""
    feature, cut, left, right = tree[:4]
    node, row = np.zeros(len(x), np.int32), np.arange(len(x))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        node = np.where(inner, np.where(x[row, np.maximum(f, 0)] <= cut[node], left[node], right[node]), node)


def _add_tree(raw: np.ndarray, x: np.ndarray, tree: tuple[np.ndarray, ...]) -> None:
    """Adds the leaf values of a tree to raw. x: bins by column."""
    feature, cut, left, right, value = tree
    at = [(0, np.arange(len(raw)))]
    while at:
        i, rows = at.pop()
        if feature[i] < 0:
            raw[rows] += value[i]
        elif len(rows):
            goes = x[feature[i]][rows] <= cut[i]
            at += [(left[i], rows[goes]), (right[i], rows[~goes])]


def _sums_at(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, leaves: int) -> np.ndarray:
    """Gradient, hessian and rows by (leaf, feature, bin) of the rows that are at a leaf (else -1). A feature at a time, so that its cells stay in cache."""
    mine = np.flatnonzero(at >= 0)
    if len(mine) < len(at):
        x, g, h, at = x[mine], g[mine], h[mine], at[mine]
    base, size = at.astype(np.intp) * (BINS + 1), leaves * (BINS + 1)
    out = np.empty((3, leaves, x.shape[1], BINS + 1))
    for f in range(x.shape[1]):
        cells = base + x[:, f]
        for k, w in enumerate((g, h, None)):
            out[k, :, f] = np.bincount(cells, w, size).reshape(leaves, BINS + 1)
    return out


def _packed(x: np.ndarray) -> list[tuple[np.ndarray, dict[int, int]]]:
    """Columns of bins, and the features and their numbers of bins that each holds: features of few bins share a column.

    Sums over two bins alone wait for each other, and a shared column is one pass for several features.
    """
    out, size = [], BINS + 1
    for f, bins in sorted(enumerate(x.max(0).tolist() if len(x) else [0] * x.shape[1]), key=lambda b: b[1]):
        bins += 1
        if size * bins <= BINS + 1:
            column, features = out[-1]
            out[-1] = (column * np.uint8(bins) + x[:, f], features | {f: bins})
            size *= bins
        else:
            out.append((np.ascontiguousarray(x[:, f]), {f: bins}))
            size = bins
    return out


def _sums_of(packed: list[tuple[np.ndarray, dict[int, int]]], g: np.ndarray, h: np.ndarray, rows: np.ndarray | None, counts: np.ndarray | None = None) -> np.ndarray:
    """Gradient, hessian and rows by (feature, bin) of these rows, or of all; counts: the rows by (feature, bin) if they are known."""
    sums = np.zeros((3, len(packed), BINS + 1))
    for at in range(0, len(g) if rows is None else len(rows), CHUNK_ROWS):
        here = slice(at, at + CHUNK_ROWS) if rows is None else rows[at : at + CHUNK_ROWS]
        weights = (g[here], h[here], None)[: 3 if counts is None else 2]
        for i, (column, _) in enumerate(packed):
            cells = column[here].astype(np.intp)
            for k, w in enumerate(weights):
                sums[k, i] += np.bincount(cells, w, BINS + 1)
    out = np.zeros((3, sum(len(features) for _, features in packed), BINS + 1))
    for i, (_, features) in enumerate(packed):
        shape = tuple(features.values())
        cube = sums[:, i, : math.prod(shape)].reshape(3, *shape)
        for j, (f, bins) in enumerate(features.items(), 1):
            out[:, f, :bins] = cube.sum(tuple(a for a in range(1, cube.ndim) if a != j))
    if counts is not None:
        out[2] = counts
    return out


def _best_first(x: np.ndarray, packed: list[tuple[np.ndarray, dict[int, int]]], g: np.ndarray, h: np.ndarray, counts: np.ndarray, fit: Fit) -> tuple[tuple[np.ndarray, ...], dict[int, np.ndarray]]:
    """A tree over all of these rows, split by split, and the rows of each leaf. x: bins by column.

    Of a split the smaller side is summed and the other is what is left of the whole; a cell without rows is exactly 0.
    """
    nodes, rows = [_Node()], {0: np.arange(len(g))}
    sums = {0: _sums_of(packed, g, h, None, counts)}
    _settle(nodes, [0], best_splits(sums[0][:, None], fit.l2))
    heap, used = [(-nodes[0].split[0], 0)] if nodes[0].split else [], set()
    while heap and len(used) < fit.leaves - 1:
        i = heapq.heappop(heap)[1]
        used.add(i)
        node, whole, mine = nodes[i], sums.pop(i), rows.pop(i)
        _, feature, cut, left = node.split
        node.children = pair = (len(nodes), len(nodes) + 1)
        goes = x[feature][mine] <= cut
        rows |= zip(pair, (mine[goes], mine[~goes]))
        nodes += [_Node(sums=left), _Node(sums=tuple(a - b for a, b in zip(node.sums, left)))]
        wanted = [c for c in pair if len(rows[c]) >= 2 * LEAST_ROWS]
        if not wanted or len(used) == fit.leaves - 1:
            continue
        small, large = sorted(pair, key=lambda c: len(rows[c]))
        sums[small] = _sums_of(packed, g, h, rows[small])
        whole -= sums[small]
        whole[:2, whole[2] == 0] = 0
        sums[large] = whole
        _settle(nodes, wanted, best_splits(np.stack([sums[c] for c in wanted], 1), fit.l2))
        for c in wanted:
            if nodes[c].split:
                heapq.heappush(heap, (-nodes[c].split[0], c))
    return _arrays(nodes, used, fit), rows


def _slots(nodes: int, wanted: list[int]) -> np.ndarray:
    slot = np.full(nodes, -1)
    slot[wanted] = np.arange(len(wanted))
    return slot


def _histograms(x: np.ndarray, y: np.ndarray, raw: np.ndarray, tree: tuple[np.ndarray, ...], wanted: list[int]) -> np.ndarray:
    """Gradient, hessian and rows by (wanted leaf, feature, bin)."""
    p = 1 / (1 + np.exp(-raw))
    return _sums_at(x, p - y, p * (1 - p), _slots(len(tree[0]), wanted)[_leaf_of(x, tree)], len(wanted))


def _step_down(x: np.ndarray, node: np.ndarray, nodes: list[_Node], since: int) -> np.ndarray:
    """Node of each row after the nodes from `since` on were added as children of its node or of another's."""
    at = [(i, n) for i, n in enumerate(nodes) if n.children is not None and n.children[0] >= since]
    if not at:
        return node
    feature, cut, left, right = (np.full(len(nodes), v, np.int32) for v in (-1, 0, 0, 0))
    for i, n in at:
        (_, feature[i], cut[i], _), (left[i], right[i]) = n.split, n.children
    row = np.flatnonzero(feature[node] >= 0)
    of, node = node[row], node.copy()
    node[row] = np.where(x[row, feature[of]] <= cut[of], left[of], right[of])
    return node


def _ends(nodes: list[_Node], used: set[int]) -> np.ndarray:
    """The leaf of the tree of the used splits in which each node lies."""
    end = np.arange(len(nodes))
    for i, n in enumerate(nodes):  # children come after their node
        if n.children is not None and i not in used:
            end[list(n.children)] = end[i]
    return end


def best_splits(sums: np.ndarray, l2: float) -> list[tuple]:
    """For each leaf its sums and its best split, or None: ties go to the first feature, then the first bin.

    Gains that differ by rounding alone are ties, so a tree does not depend on how its rows lie in blocks.
    """
    left = sums.cumsum(3)[..., :-1]
    total = sums[:, :, 0, :].sum(2)
    right = total[:, :, None, None] - left
    weight = lambda s: s[0] ** 2 / (s[1] + l2 + 1e-15)
    gain = weight(left) + weight(right) - weight(total)[:, None, None]
    fits = (left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    gain = np.where(fits, gain, -1.0).reshape(len(gain), -1)
    out = []
    for k, at in enumerate((gain >= gain.max(1, keepdims=True) * (1 - 1e-9)).argmax(1)):
        g, (f, b) = gain[k, at], divmod(int(at), left.shape[3])
        out.append((tuple(total[:, k].tolist()), (float(g), f, b, tuple(left[:, k, f, b].tolist())) if g > 1e-12 else None))
    return out


def _arrays(nodes: list[_Node], used: set[int] | None, fit: Fit) -> tuple[np.ndarray, ...]:
    """Tree as arrays; used: nodes that are split, or None for all that have children."""
    inner = [n.children is not None and (used is None or i in used) for i, n in enumerate(nodes)]
    ints = lambda x: np.array(x, np.int32)
    value = [0.0 if n.sums is None else -fit.learning_rate * n.sums[0] / (n.sums[1] + fit.l2 + 1e-15) for n in nodes]
    return (
        ints([n.split[1] if on else -1 for n, on in zip(nodes, inner)]),
        ints([n.split[2] if on else 0 for n, on in zip(nodes, inner)]),
        ints([n.children[0] if on else 0 for n, on in zip(nodes, inner)]),
        ints([n.children[1] if on else 0 for n, on in zip(nodes, inner)]),
        np.array(value),
    )


def _grow(nodes: list[_Node], leaves: int) -> list[int]:
    """Children of the nodes that may be among the leaves - 1 first splits; returns those to be evaluated."""
    keys = sorted((n.key for n in nodes if n.split), reverse=True)
    least = keys[leaves - 2] if len(keys) >= leaves - 1 else 0.0
    new = []
    for n in list(nodes):
        if n.split and n.children is None and n.key >= least:
            left = n.split[3]
            n.children = (len(nodes), len(nodes) + 1)
            for sums in (left, tuple(a - b for a, b in zip(n.sums, left))):
                if sums[2] >= 2 * LEAST_ROWS:
                    new.append(len(nodes))
                nodes.append(_Node(sums=sums, above=n.key))
    return new


def _chosen(nodes: list[_Node], leaves: int) -> set[int]:
    """The leaves - 1 nodes that best-first growth splits."""
    heap, used = [(-nodes[0].split[0], 0)] if nodes[0].split else [], set()
    while heap and len(used) < leaves - 1:
        i = heapq.heappop(heap)[1]
        used.add(i)
        for c in nodes[i].children:
            if nodes[c].split:
                heapq.heappush(heap, (-nodes[c].split[0], c))
    return used


def _settle(nodes: list[_Node], wanted: list[int], found: list[tuple]) -> None:
    """Sums and splits of the wanted leaves."""
    for i, (total, split) in zip(wanted, found):
        node = nodes[i]
        node.sums, node.split = total, split
        node.key = min(node.above, split[0]) if split else -1.0


def _round(state: RDD, fits: list[Fit], trees: list[list[_Node]], wanted: list[list[int]]) -> None:
    """One job: evaluates the wanted leaves of every fit."""
    asked = {k: (_arrays(trees[k], None, fits[k]), w) for k, w in enumerate(wanted) if w}
    l2 = [f.l2 for f in fits]

    def sums(block: tuple) -> Iterator[tuple[int, np.ndarray]]:
        own, x, y, raw = block
        for i, k in enumerate(own):
            if k in asked:
                yield k, _histograms(x, y, raw[i], *asked[k])

    found = state.flatMap(sums).reduceByKey(lambda a, b: a + b, min(len(fits), state.ctx.defaultParallelism))
    for k, best in found.map(lambda kv: (kv[0], best_splits(kv[1], l2[kv[0]]))).collect():  # a row a leaf
        _settle(trees[k], wanted[k], best)


def _advance(state: RDD, fits: list[Fit]) -> RDD:
    """State after one more tree of every fit, grown over all blocks."""
    trees, wanted = [[_Node()] for _ in fits], [[0] for _ in fits]
    while any(wanted):
        _round(state, fits, trees, wanted)
        wanted = [_grow(t, f.leaves) for t, f in zip(trees, fits)]
    for f, t in zip(fits, trees):
        f.trees.append(_arrays(t, _chosen(t, f.leaves), f))
    now = state.ctx.broadcast([f.trees[-1] for f in fits])

    def step(block: tuple) -> tuple:
        own, x, y, raw = block
        return own, x, y, np.stack([r + now.value[k][4][_leaf_of(x, now.value[k])] for k, r in zip(own, raw)])

    return state.map(step).persist(StorageLevel.MEMORY_AND_DISK)


def _grow_block(state: RDD, fits: list[Fit], times: int) -> None:
    """All trees of every fit where a block holds all rows; one job."""
    plain = [Fit(f.learning_rate, f.leaves, f.l2) for f in fits]

    def grow(block: tuple) -> Iterator[tuple[int, list[tuple[np.ndarray, ...]]]]:
        own, x, y, start = block
        packed, columns = _packed(x), np.ascontiguousarray(x.T)
        counts = _sums_of(packed, y, y, None)[2]
        for i, k in enumerate(own):
            raw, trees = start[i].copy(), []
            for _ in range(times):
                p = 1 / (1 + np.exp(-raw))
                tree, rows = _best_first(columns, packed, p - y, p * (1 - p), counts, plain[k])
                for leaf, mine in rows.items():
                    raw[mine] += tree[4][leaf]
                trees.append(tree)
            yield k, trees

    for k, trees in state.flatMap(grow).collect():  # trees of bounded size
        fits[k].trees += trees


def _dealt(blocks: DataFrame, groups: int) -> RDD:
    """(group, block) for every group and block of a table of blocks, each a task of its own, groups in order."""
    pairs = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).rdd.zipWithIndex()
    pairs = pairs.map(lambda r: (r[1], r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    return pairs.partitionBy(max(1, pairs.count()), int).values()


def boost(tune: DataFrame, val: DataFrame, fits: list[Fit], columns: tuple[str, ...], iterations: int, at: tuple[int, ...], label: str = "home_win") -> dict[tuple[int, int], float]:
    """Fits all configurations side by side; log loss on val by (fit, iterations) for each number of iterations in `at`.

    Trees grow best first up to fit.leaves, with leaf values of -learning_rate G / (H + l2), from the log odds of the label on.
    Null features are an error of the caller (load_split drops them). With no row or one class every loss is of that constant.
    """
    spark, sc = tune.sparkSession, tune.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sinks.folder(spark, "boosting"))
    rate = tune.agg(F.avg(label), F.count(F.lit(1))).first()
    mean = min(max(rate[0] if rate[0] is not None else 0.5, 1e-6), 1 - 1e-6)
    start, blocks = math.log(mean / (1 - mean)), max(1, -(-rate[1] // BLOCK_ROWS))
    edges = edges_of(tune, columns)
    path = sinks.folder(spark, "binned")
    _binned(tune.repartition(blocks), columns, label, edges).write.parquet(path)
    # few blocks: fits are dealt over the tasks as well, the longest first
    longest = sorted(range(len(fits)), key=lambda k: -fits[k].leaves)
    groups = len(fits) if blocks == 1 else max(1, min(len(fits), sc.defaultParallelism // blocks))
    dealt = [longest[g::groups] for g in range(groups)]
    width = len(columns)

    def unpack(row: tuple) -> tuple:
        own, x, y = dealt[row.g], np.frombuffer(row.x, np.uint8).reshape(-1, width), np.frombuffer(row.y, np.uint8).astype(float)
        return own, x, y, np.full((len(own), len(y)), start)

    state = _dealt(spark.read.schema(BLOCK).parquet(path), groups).map(unpack)
    if blocks == 1:
        _grow_block(state, fits, iterations)
    else:
        state.persist(StorageLevel.MEMORY_AND_DISK)
        for done in range(1, iterations + 1):
            state = _advance(state, fits)
            if done % KEEP_EVERY == 0:
                state.checkpoint()  # the lineage starts anew; earlier states are cleaned up with their last reference
    kept = sinks.folder(spark, "held-out")
    _binned(val.repartition(max(1, -(-val.count() // HELD_ROWS))), columns, label, edges).write.parquet(kept)
    return _losses(spark.read.schema(BLOCK).parquet(kept), fits, start, width, tuple(n for n in at if n <= iterations))


def scores(x: np.ndarray, fit: Fit, start: float) -> np.ndarray:
    """Chance of the label by all trees of a fit, from bins."""
    raw, columns = np.full(len(x), start), np.ascontiguousarray(x.T)
    for tree in fit.trees:
        _add_tree(raw, columns, tree)
    return 1 / (1 + np.exp(-raw))


def _losses(held: DataFrame, fits: list[Fit], start: float, width: int, at: tuple[int, ...]) -> dict[tuple[int, int], float]:
    """Log loss by (fit, iterations), in one job over the held-out blocks: a task takes a block and a fit."""
    now = held.sparkSession.sparkContext.broadcast(fits)

    def partial(row: tuple) -> Iterator[tuple[tuple[int, int], tuple[float, int]]]:
        x, y = np.ascontiguousarray(np.frombuffer(row.x, np.uint8).reshape(-1, width).T), np.frombuffer(row.y, np.uint8)
        raw, trees, done = np.full(len(y), start), now.value[row.g].trees, 0
        for n in sorted(at):
            for tree in trees[done:n]:
                _add_tree(raw, x, tree)
            done = n
            p = np.clip(1 / (1 + np.exp(-raw)), 1e-15, 1 - 1e-15)
            yield (row.g, n), (float(-np.log(np.where(y == 1, p, 1 - p)).sum()), len(y))

    sums = _dealt(held, len(fits)).flatMap(partial).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect()  # a row a fit and number
    return {k: total / n for k, (total, n) in sums}

"""Histogram trees over binned rows, as NumPy steps that run inside Spark tasks on one block of rows.

A tree is a set of flat arrays indexed by node: ``feature`` (-1 at a leaf), ``bin`` (up to which rows go left), ``side`` (whether rows
without the feature go left) and ``leaf``. Node k has children 2k and 2k + 1; the root is node 1.

The quantile loss has two gradients only, so a histogram is two counts per bin: rows, and rows above the current prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Least gain of a split.
LEAST_GAIN = 1e-9


class Tree:
    """The flat arrays of one tree."""

    def __init__(self, depth: int):
        nodes = 2 ** (depth + 1)
        self.feature = np.full(nodes, -1, np.int16)
        self.bin = np.zeros(nodes, np.int16)
        self.side = np.zeros(nodes, bool)
        self.leaf = np.zeros(nodes)

    def split(self, node: int, feature: int, bin_: int, side: bool) -> None:
        self.feature[node], self.bin[node], self.side[node] = feature, bin_, side

    def nodes(self) -> np.ndarray:
        """Numbers of the nodes that rows can come to, and 0."""
        held = np.zeros(len(self.leaf), bool)
        split = np.flatnonzero(self.feature >= 0)
        held[[0, 1]] = held[2 * split] = held[2 * split + 1] = True
        return np.flatnonzero(held).astype(np.int32)


def packed(trees: Sequence[Tree]) -> dict[str, np.ndarray]:
    """The trees' nodes behind each other, an array per field and one of the nodes' numbers. Number 0, which no row comes to, begins a tree.

    A tree has two entries and two more per split. A split needs rows on either side, so models of short series are short.
    """
    nodes = [tree.nodes() for tree in trees]
    fields = {name: np.concatenate([getattr(tree, name)[n] for tree, n in zip(trees, nodes)]) for name in ("feature", "bin", "side", "leaf")}
    return {"node": np.concatenate(nodes), **fields}


def unpacked(node: np.ndarray, feature: np.ndarray, bin_: np.ndarray, side: np.ndarray, leaf: np.ndarray, nodes: int) -> list[np.ndarray]:
    """What ``packed`` made, as arrays with a row of ``nodes`` entries per tree."""
    tree = np.cumsum(node == 0) - 1
    out = []
    for field, none in ((feature, -1), (bin_, 0), (side, False), (leaf, 0.0)):
        whole = np.full((tree[-1] + 1, nodes), none, field.dtype)
        whole[tree, node] = field
        out.append(whole)
    return out


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Per feature the number of edges below the value; one more than there are bins where it is missing."""
    missing = slots_of(edges) - 1
    out = np.empty(values.shape, np.uint16)
    for f, edge in enumerate(edges):
        out[:, f] = np.where(np.isnan(values[:, f]), missing, np.searchsorted(edge, values[:, f]))
    return out


def slots_of(edges: list[np.ndarray]) -> int:
    """Bins of a histogram, that of missing values (the last) included; the same for all features of a series."""
    return max((len(e) for e in edges), default=0) + 2


def step_down(bins: np.ndarray, node: np.ndarray, missing: int, feature: np.ndarray, bin_: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The nodes of rows one level further down; rows at a leaf stay."""
    at = feature[node]
    held = bins[np.arange(len(node)), np.maximum(at, 0)]
    left = np.where(held == missing, side[node], held <= bin_[node])
    return np.where(at < 0, node, 2 * node + np.where(left, 0, 1))


def histograms(bins: np.ndarray, up: np.ndarray, cell: np.ndarray, cells: int, slots: int) -> np.ndarray:
    """Counts (cell, feature, slot, 2): rows, and rows that are ``up``. A row's ``cell`` is -1 where it does not count."""
    features = bins.shape[1]
    rows = np.flatnonzero(cell >= 0)
    code = (cell[rows, None] * features + np.arange(features)) * slots + bins[rows]
    size = cells * features * slots
    both = np.bincount(code.ravel(), minlength=size), np.bincount(code[up[rows]].ravel(), minlength=size)
    return np.stack(both, axis=-1).reshape(cells, features, slots, 2)


def best_splits(counts: np.ndarray, level: float, min_leaf: int) -> dict[str, np.ndarray]:
    """Per cell the split of highest gain: arrays ``gain`` (0 where there is none), ``feature``, ``bin``, ``side``, ``left`` and ``right`` (rows).

    Of equal gains the first feature wins, then the first bin, then missing values on the left.
    """
    cells, features, slots, _ = counts.shape
    n, up = counts[..., 0].astype(float), counts[..., 1].astype(float)
    all_n, all_up = n.sum(2)[..., None, None], up.sum(2)[..., None, None]
    # last axis: with the missing ones on the left, without
    some = np.array([1.0, 0.0])
    left_n = np.cumsum(n[..., :-1], 2)[..., None] + n[..., -1, None, None] * some
    left_up = np.cumsum(up[..., :-1], 2)[..., None] + up[..., -1, None, None] * some
    right_n, right_up = all_n - left_n, all_up - left_up

    def strength(count, above):
        pull = (1.0 - level) * count - above
        return pull * pull / np.maximum(count, 1.0)

    gain = strength(left_n, left_up) + strength(right_n, right_up) - strength(all_n, all_up)
    allowed = (left_n >= min_leaf) & (right_n >= min_leaf) & (gain > LEAST_GAIN)
    gain = np.where(allowed, gain, 0.0).reshape(cells, -1)
    best = gain.argmax(1)
    feature, rest = np.divmod(best, (slots - 1) * 2)
    bin_, off = np.divmod(rest, 2)
    pick = np.arange(cells), best
    return {
        "gain": gain[pick],
        "feature": feature,
        "bin": bin_,
        "side": off == 0,
        "left": left_n.reshape(cells, -1)[pick].astype(np.int64),
        "right": right_n.reshape(cells, -1)[pick].astype(np.int64),
    }


def leaf_values(residual: np.ndarray, node: np.ndarray, level: float, nodes: int) -> np.ndarray:
    """The quantile of the residuals in each node, linear between the nearest ranks; 0 in nodes without rows."""
    out = np.zeros(nodes)
    if not len(node):
        return out
    order = np.lexsort((residual, node))
    sorted_nodes, values = node[order], residual[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_nodes[1:] != sorted_nodes[:-1])))
    rank = (np.diff(np.append(starts, len(node))) - 1) * level
    low, high = starts + np.floor(rank).astype(int), starts + np.ceil(rank).astype(int)
    below, above = values[low], values[high]
    out[sorted_nodes[starts]] = np.where(below == above, below, below + (above - below) * (rank - np.floor(rank)))
    return out


def grow(bins: np.ndarray, target: np.ndarray, base: float, level: float, config, slots: int) -> list[Tree]:
    """All rounds of one model whose rows are one block.

    Of two sibling nodes the smaller is counted, the other is what is left of their parent.
    """
    predicted = np.full(len(target), base)
    trees = []
    for _ in range(config.rounds):
        tree = Tree(config.depth)
        up = target > predicted
        node = np.ones(len(target), np.int64)
        cells = np.array([1])
        counts = histograms(bins, up, np.zeros(len(target), np.int64), 1, slots)
        for depth in range(config.depth):
            best = best_splits(counts, level, config.min_leaf)
            found = np.flatnonzero(best["gain"] > 0)
            if not len(found):
                break
            for c in found:
                tree.split(cells[c], best["feature"][c], best["bin"][c], best["side"][c])
            node = step_down(bins, node, slots - 1, tree.feature, tree.bin, tree.side)
            if depth + 1 == config.depth:
                break
            again = found[np.maximum(best["left"][found], best["right"][found]) >= 2 * config.min_leaf]
            if not len(again):
                break
            small = 2 * cells[again] + (best["left"][again] > best["right"][again])
            place = np.full(len(tree.leaf), -1, np.int64)
            place[small] = np.arange(len(small))
            counted = histograms(bins, up, place[node], len(small), slots)
            cells = np.concatenate((small, small ^ 1))
            counts = np.concatenate((counted, counts[again] - counted))
            large = counts[:, 0, :, 0].sum(1) >= 2 * config.min_leaf
            cells, counts = cells[large], counts[large]
        tree.leaf = leaf_values(target - predicted, node, level, len(tree.leaf))
        predicted = predicted + config.learning_rate * tree.leaf[node]
        trees.append(tree)
    return trees


def add_up(bins: np.ndarray, base: float, feature: np.ndarray, bin_: np.ndarray, side: np.ndarray, leaf: np.ndarray, rate: float, depth: int, missing: int) -> np.ndarray:
    """What the trees of a model (a row of the arrays each) predict for binned rows."""
    total = np.full(len(bins), base)
    for r in range(len(feature)):
        node = np.ones(len(bins), np.int64)
        for _ in range(depth):
            node = step_down(bins, node, missing, feature[r], bin_[r], side[r])
        total = total + rate * leaf[r][node]
    return total

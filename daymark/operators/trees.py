"""Boosted regression trees on absolute error for many targets of one window at once.

The trees of all hours of a window share its inputs. "Input is at most this edge" is kept as one
bit per training row and candidate split, so the rows and the signs of residuals on the left of
every split of a node are counted by masking these bits, 64 rows at a time. Trees are complete: a
node that does not split sends all rows to the left. Leaves take the median of the residuals of
their rows.

A fit holds one training window, whose length is a parameter, never a whole series; Spark spreads
the windows (series, run of refit blocks) over tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class TreeParams:
    """``trees`` rounds of depth ``depth``, each scaled by ``rate``; inputs are cut at up to
    ``bins - 1`` quantiles; a leaf keeps ``min_leaf`` rows or more."""

    trees: int = 200
    depth: int = 4
    rate: float = 0.1
    bins: int = 16
    min_leaf: int = 20

    def __post_init__(self) -> None:
        if min(self.trees, self.depth, self.min_leaf) < 1 or self.bins < 2 or not 0 < self.rate <= 1:
            raise ValueError(f"tree parameters out of range: {self}")


@dataclass
class Boosted:
    """Trees of ``m`` targets. Node i of a level-ordered tree has children 2i+1 (input at most the
    threshold) and 2i+2; ``feature`` is -1 where a node does not split."""

    base: np.ndarray        # m
    feature: np.ndarray     # m x trees x inner nodes
    threshold: np.ndarray   # the same shape
    value: np.ndarray       # m x trees x leaves, already scaled
    cover: np.ndarray       # training rows of each leaf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row: m x trees x rows."""
        m, trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        out = np.zeros((m, trees, len(x)), np.int32)
        rows, every = np.arange(len(x)), np.arange(trees)[:, None]
        for j in range(m):
            node = np.zeros((trees, len(x)), np.int64)
            for _ in range(depth):
                at, cut = self.feature[j][every, node], self.threshold[j][every, node]
                node = 2 * node + 1 + ((x[rows, at] > cut) & (at >= 0))
            out[j] = node - inner
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """rows x m."""
        leaf = self.leaves(x)
        return self.base + np.take_along_axis(self.value, leaf, axis=2).sum(axis=1).T


class Cuts:
    """Candidate splits of one window's inputs, shared by all fits on it."""

    def __init__(self, x: np.ndarray, bins: int):
        edges, owner = [], []
        for f in range(x.shape[1]):
            seen = np.unique(x[:, f])
            if len(seen) > bins:
                cut = np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower"))
                cut = cut[cut < seen[-1]]
            else:
                cut = seen[:-1]
            edges.append(cut)
            owner.append(np.full(len(cut), f))
        self.edge, self.owner = np.concatenate(edges), np.concatenate(owner)
        seen = x.T[self.owner]
        self.over = seen > self.edge[:, None]
        below = seen <= self.edge[:, None]
        self.below = np.ascontiguousarray(_words(below).T)
        self.whole = below.sum(axis=1, dtype=np.float32)

    def counted(self, rows: np.ndarray) -> np.ndarray:
        """How many of the marked rows are at most each edge; one line per line of ``rows``."""
        out = np.empty((len(rows), len(self.edge)), np.float32)
        wide = np.uint16 if rows.shape[1] < 1 << 16 else np.uint32
        both, bits = np.empty_like(self.below), np.empty(self.below.shape, np.uint8)
        for line, marks in zip(out, _words(rows), strict=True):
            np.bitwise_and(self.below, marks[:, None], out=both)
            np.bitwise_count(both, out=bits)
            line[:] = bits.sum(axis=0, dtype=wide)
        return out


def _words(flags: np.ndarray) -> np.ndarray:
    """Lines of flags packed 64 to a word: (lines, words)."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _medians(values: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and size of every group; an empty group has median 0."""
    order = np.argsort(values)
    few = group.astype(np.min_scalar_type(n_groups))
    order = order[np.argsort(few[order], kind="stable")]
    ranked, size = values[order], np.bincount(group, minlength=n_groups)
    start = np.cumsum(size) - size
    low, high = start + np.maximum(size - 1, 0) // 2, start + size // 2
    last = max(len(ranked) - 1, 0)
    middle = (ranked[np.minimum(low, last)] + ranked[np.minimum(high, last)]) / 2
    return np.where(size > 0, middle, 0.0), size


def fit_boosted(cuts: Cuts, y: np.ndarray, params: TreeParams,
                watch: Callable[[int, np.ndarray], None] | None = None) -> Boosted:
    """Trees for every column of ``y``. ``watch(round, residuals)`` is told of every round."""
    n, m = y.shape
    inner, n_leaves = (1 << params.depth) - 1, 1 << params.depth
    feature = np.full((m, params.trees, inner), -1, np.int32)
    threshold = np.zeros((m, params.trees, inner))
    value = np.zeros((m, params.trees, n_leaves))
    cover = np.zeros((m, params.trees, n_leaves), np.int64)
    base = np.median(y, axis=0)
    left = np.ascontiguousarray((y - base).T)
    targets, rows = np.arange(m)[:, None], np.arange(n)
    for t in range(params.trees):
        sign = np.sign(left)
        node = np.zeros((m, n), np.int64)
        told = None  # rows and sums of signs at most each edge: m x nodes x edges
        for level in range(params.depth if len(cuts.edge) else 0):
            width = 1 << level
            # Left children are counted, right ones are what remains of the parent.
            lefts = np.arange(0, width, 2)[:, None]
            made = _of_signs(cuts, node[:, None] == lefts, sign, whole=level == 0)
            told = made if told is None else [
                np.stack([a, b - a], axis=2).reshape(m, width, -1)
                for a, b in zip(made, told, strict=True)]
            group = (targets * width + node).ravel()
            total = [np.bincount(group, weight, m * width).reshape(m, width)
                     for weight in (None, sign.ravel())]
            best, gain = _best_splits(*told, *total, params.min_leaf)
            splits = gain > 1e-6
            at = feature[:, t, width - 1:2 * width - 1]
            at[:] = np.where(splits, cuts.owner[best], -1)
            threshold[:, t, width - 1:2 * width - 1] = np.where(splits, cuts.edge[best], 0.0)
            right = cuts.over[best[targets, node], rows] & splits[targets, node]
            node = 2 * node + right
        group = (targets * n_leaves + node).ravel()
        middle, size = _medians(left.ravel(), group, m * n_leaves)
        value[:, t] = params.rate * middle.reshape(m, n_leaves)
        cover[:, t] = size.reshape(m, n_leaves)
        left = left - value[targets, t, node]
        if watch is not None:
            watch(t, left.T)
    return Boosted(base, feature, threshold, value, cover)


def _of_signs(cuts: Cuts, rows: np.ndarray, sign: np.ndarray, whole: bool) -> list[np.ndarray]:
    """Of the marked rows of every (target, node), or of the ``whole`` window: rows and sum of
    signs at most each edge."""
    m, nodes, n = rows.shape
    count = lambda marked: cuts.counted(marked.reshape(-1, n)).reshape(m, nodes, -1)
    below = np.broadcast_to(cuts.whole, (m, 1, len(cuts.whole))) if whole else count(rows)
    signs = 2 * count(rows & (sign > 0)[:, None]) - below
    # Residuals of 0 are rare: only the nodes that hold some are counted once more.
    still = rows & (sign == 0)[:, None]
    some = still.any(axis=-1)
    if some.any():
        signs[some] += cuts.counted(still[some])
    return [below, signs]


def _best_splits(n_left: np.ndarray, s_left: np.ndarray, count: np.ndarray, sign: np.ndarray,
                 min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Best edge of every (target, node) and what it gains: the squared sums of signs of the two
    sides over their rows, less that of the node."""
    n_right = count[..., None].astype(np.float32) - n_left
    allowed = (n_left >= min_leaf) & (n_right >= min_leaf)
    gain = s_left * s_left
    gain /= np.maximum(n_left, 1)
    s_right = sign[..., None].astype(np.float32) - s_left
    s_right *= s_right
    s_right /= np.maximum(n_right, 1, out=n_right)
    gain += s_right
    gain[~allowed] = -1.0
    best = gain.argmax(axis=-1)
    top = np.take_along_axis(gain, best[..., None], axis=-1)[..., 0].astype(np.float64)
    return best, np.where(top < 0, 0.0, top - sign * sign / np.maximum(count, 1))


@dataclass
class Paths:
    """What leads to each leaf of one target's trees: up to ``depth`` features, each with the
    range it must lie in and the share of training rows that pass all its splits. Unused slots
    hold any value and have share 1."""

    feature: np.ndarray  # leaves x depth, -1 where unused
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray    # leaves

    @classmethod
    def of(cls, trees: Boosted, j: int) -> Paths:
        feature, cut = trees.feature[j], trees.threshold[j]
        n_trees, inner = feature.shape
        n_leaves = inner + 1
        depth = n_leaves.bit_length() - 1
        shape = (n_trees, n_leaves, depth)
        out = cls(np.full(shape, -1), np.full(shape, -np.inf), np.full(shape, np.inf),
                  np.ones(shape), trees.value[j].copy())
        # Rows below each node, from the leaves up.
        cover = np.zeros((n_trees, inner + n_leaves))
        cover[:, inner:] = trees.cover[j]
        for i in range(inner - 1, -1, -1):
            cover[:, i] = cover[:, 2 * i + 1] + cover[:, 2 * i + 2]
        every = np.arange(n_trees)
        for leaf in range(n_leaves):
            node = np.zeros(n_trees, np.int64)
            for step in range(depth):
                right = leaf >> (depth - 1 - step) & 1
                child = 2 * node + 1 + right
                f, c = feature[every, node], cut[every, node]
                share = cover[every, child] / np.maximum(cover[every, node], 1)
                used = f >= 0
                # The slot of a feature is that of its first split on the path.
                same = out.feature[:, leaf, :step + 1] == f[:, None]
                slot = np.where(same.any(1), same.argmax(1), step)
                at = (every[used], leaf, slot[used])
                out.feature[at] = f[used]
                out.share[at] *= share[used]
                bound = out.low if right else out.high
                pick = np.maximum if right else np.minimum
                bound[at] = pick(bound[at], c[used])
                if right:  # nothing goes right of a node that does not split
                    out.value[~used, leaf] = 0.0
                node = child
        flat = lambda a: a.reshape(n_trees * n_leaves, -1)
        return cls(flat(out.feature), flat(out.low), flat(out.high), flat(out.share),
                   out.value.ravel())

    def attributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Exact path-dependent Shapley values, rows x features, and the expected value.

        A leaf is a product game: a known feature counts 1 or 0, an unknown one its share. Its
        values weight, for every coalition size, the product polynomial of the other features.
        """
        n, depth = len(x), self.feature.shape[1]
        hit = [np.where(self.feature[:, i] >= 0,
                        (x[:, self.feature[:, i]] > self.low[:, i])
                        & (x[:, self.feature[:, i]] <= self.high[:, i]), 1.0)
               for i in range(depth)]
        weight = [1.0 / depth]
        for k in range(1, depth):
            weight.append(weight[-1] * k / (depth - k))
        out = np.zeros(x.shape)
        for i in range(depth):
            used = np.flatnonzero((self.feature[:, i] >= 0) & (self.value != 0))
            if not len(used):
                continue
            poly = [np.ones((n, len(used)))]
            for j in range(depth):
                if j != i:
                    z, h = self.share[used, j], hit[j][:, used]
                    grown = [p * z for p in poly] + [np.zeros_like(poly[0])]
                    for k, p in enumerate(poly):
                        grown[k + 1] += p * h
                    poly = grown
            mixed = sum(w * p for w, p in zip(weight, poly, strict=True))
            part = self.value[used] * (hit[i][:, used] - self.share[used, i]) * mixed
            owner = np.zeros((len(used), x.shape[1]))
            owner[np.arange(len(used)), self.feature[used, i]] = 1.0
            out += part @ owner
        return out, float((self.value * self.share.prod(axis=1)).sum())

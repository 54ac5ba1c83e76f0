"""Decision trees over binned features: histograms, splits, routing. Small helpers of the Spark jobs in ``boosting`` and ``forests``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A feature has so many bins at most; bin b holds the values above cut b - 1 and up to cut b.
BINS = 256
# A gain up to this is none.
LEAST_GAIN = 1e-6


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value; NaN has no place."""
    if np.isnan(x).any():
        raise ValueError("features hold NaN")
    out = np.empty(x.shape, np.uint8)
    for f, own in enumerate(cuts):
        out[:, f] = np.searchsorted(own, x[:, f], side="left")
    return out


@dataclass
class Tree:
    """Node i splits ``feature[i]`` after bin ``cut[i]`` into ``left[i]`` and the node after it, or is a leaf (feature -1) with ``value[i]``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def root(cls) -> Tree:
        return cls(np.array([-1]), np.array([0]), np.array([-1]), np.array([0.0]))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        node = np.zeros(len(bins), np.int64)
        going = np.arange(len(bins)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(going):
            at = node[going]
            node[going] = at = self.left[at] + (bins[going, self.feature[at]] > self.cut[at])
            going = going[self.feature[at] >= 0]
        return node

    def split(self, nodes: np.ndarray, features: np.ndarray, cuts: np.ndarray) -> None:
        """Give each of the leaves ``nodes`` two children."""
        if not len(nodes):
            return
        n = len(self.feature)
        self.feature[nodes], self.cut[nodes], self.left[nodes] = features, cuts, n + 2 * np.arange(len(nodes))
        more = 2 * len(nodes)
        self.feature, self.cut = np.r_[self.feature, np.full(more, -1)], np.r_[self.cut, np.zeros(more, np.int64)]
        self.left, self.value = np.r_[self.left, np.full(more, -1)], np.r_[self.value, np.zeros(more)]

    def graft(self, node: int, other: Tree) -> None:
        """Put ``other`` in the place of the leaf ``node``."""
        shift = len(self.feature) - 1  # other's node i > 0 becomes shift + i
        self.feature[node], self.cut[node], self.value[node] = other.feature[0], other.cut[0], other.value[0]
        moved = np.where(other.left > 0, other.left + shift, -1)
        self.left[node] = moved[0]
        self.feature, self.cut = np.r_[self.feature, other.feature[1:]], np.r_[self.cut, other.cut[1:]]
        self.left, self.value = np.r_[self.left, moved[1:]], np.r_[self.value, other.value[1:]]

    def compact(self) -> Tree:
        """The grown tree in 11 to 17 bytes a node, with values in its leaves only."""
        value = np.where(self.feature < 0, self.value, 0.0)
        small = value.astype(np.float32)
        feature = self.feature.astype(np.int16 if self.feature.max() < 1 << 15 else np.int32)
        return Tree(feature, self.cut.astype(np.uint8), self.left.astype(np.int32), small if (small == value).all() else value)

    def depth(self) -> int:
        level, n = np.array([0]), -1
        while len(level):
            level = self.left[level[self.feature[level] >= 0]]
            level, n = np.r_[level, level + 1], n + 1
        return n


def histograms(bins: np.ndarray, node: np.ndarray, nodes: int, *weights: np.ndarray) -> np.ndarray:
    """Sums of each weight by (node, feature, bin): an array (weights, nodes, features, BINS)."""
    n, width = bins.shape
    out = np.empty((len(weights), nodes, width, BINS))
    base, columns = node * BINS, np.ascontiguousarray(bins.T)
    for f in range(width):
        place = base + columns[f]
        for i, w in enumerate(weights):
            out[i, :, f] = np.bincount(place, w, nodes * BINS).reshape(nodes, BINS)
    return out


def best_gain(sums: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, ...]:
    """Best second-order split of each node from its histograms (2, nodes, features, BINS) of gradients and second derivatives.

    ``gain, feature, cut``, and the node's two sums. Ties go to the first feature and bin; no split has a gain of ``LEAST_GAIN`` at most.
    """
    # Totals from the first feature, as all features add up to the same.
    g_all, h_all = sums[0, :, 0].sum(-1), sums[1, :, 0].sum(-1)
    g, h = np.cumsum(sums[0], -1)[..., :-1], np.cumsum(sums[1], -1)[..., :-1]
    gr, hr = g_all[:, None, None] - g, h_all[:, None, None] - h
    gain = g * g / (h + penalty) + gr * gr / (hr + penalty) - (g_all * g_all / (h_all + penalty))[:, None, None]
    gain[(h < least) | (hr < least)] = -np.inf
    flat = gain.reshape(len(g_all), -1)
    # Sums of doubles differ in their last digits with the order of rows; gains so close are ties.
    top = flat.max(-1)
    best = np.argmax(flat >= (top - 1e-9 * np.maximum(np.abs(top), 1))[:, None], -1)
    return top / 2, best // (BINS - 1), best % (BINS - 1), g_all, h_all


def gini_split(ones: np.ndarray, all_: np.ndarray) -> tuple[float, int]:
    """``impurity, cut``: the least weighted Gini impurity of one feature's bins, infinite where it can't be split."""
    n1, n = np.cumsum(ones)[:-1], np.cumsum(all_)[:-1]
    rest, rest1 = all_.sum() - n, ones.sum() - n1
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = n1 * (n - n1) / n + rest1 * (rest - rest1) / rest
    impurity[(n <= 0) | (rest <= 0)] = np.inf
    at = int(np.argmin(impurity))
    return float(impurity[at]), at


def gini_splits(node: np.ndarray, own: np.ndarray, w: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``node, impurity, cut`` as ``gini_split`` has them, of every node that can be split on the feature whose bins the rows have in ``own``.

    Only bins that occur in a node are looked at: rows are sorted by node and bin, with weight and label in the low bits.
    """
    bits = int(w.max()).bit_length() + 1
    top = (int(node.max()) + 1) * BINS << bits
    key = node.astype(np.uint32 if top <= 1 << 32 else np.uint64)
    for shift, low in ((8, own), (bits - 1, w), (1, y)):
        key <<= key.dtype.type(shift)
        key |= low.astype(key.dtype)
    key.sort()
    cell = key >> key.dtype.type(bits)
    weight = ((key & key.dtype.type((1 << bits) - 1)) >> key.dtype.type(1)).astype(np.int64)
    last = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True])
    n, n1 = np.cumsum(weight)[last], np.cumsum(weight * (key & key.dtype.type(1)).astype(np.int64))[last]
    cell = cell[last].astype(np.int64)
    node = cell >> 8
    # The last bin of a node has its sums, which give the starts and ends of the nodes' running sums.
    ends = np.flatnonzero(np.r_[node[1:] != node[:-1], True])
    sizes = np.diff(np.r_[-1, ends])
    before, before1 = (np.repeat(np.r_[0, c[ends[:-1]]], sizes) for c in (n, n1))
    all_, ones = (np.repeat(c[ends], sizes) - b for c, b in ((n, before), (n1, before1)))
    inner = np.ones(len(node), bool)
    inner[ends] = False
    node, cut = node[inner], cell[inner] & (BINS - 1)
    if not len(node):
        return node, np.zeros(0), cut
    n, n1, all_, ones = (c[inner].astype(np.float64) for c in (n - before, n1 - before1, all_, ones))
    rest, rest1 = all_ - n, ones - n1
    impurity = n1 * (n - n1) / n + rest1 * (rest - rest1) / rest
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    least = np.minimum.reduceat(impurity, starts)
    hits = np.flatnonzero(impurity == np.repeat(least, np.diff(np.r_[starts, len(node)])))
    hits = hits[np.r_[True, node[hits[1:]] != node[hits[:-1]]]]
    return node[hits], least, cut[hits]


def drawn(seed: int, tree: int, path: int, width: int) -> np.ndarray:
    """All features in the order in which this node of this tree tries them, whoever grows it."""
    return np.random.default_rng([seed, tree, path & 0xFFFFFFFF, path >> 32 & 0xFFFFFFFF]).permutation(width)


def child_path(path: int, right: bool) -> int:
    """Number of a child's place, spread over 64 bits so that deep trees don't run out of them."""
    return ((path * 2 + 1 + right) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF


class Grower:
    """Grows Gini trees level by level, all open nodes of a level together, so that children stand side by side.

    ``y`` is 0 or 1, and weights are whole numbers.
    """

    def __init__(self, bins: np.ndarray, y: np.ndarray, seed: int, tries: int, depth: int | None):
        self.bins, self.y, self.seed, self.tries, self.depth = bins, y.astype(np.int64), seed, tries, depth

    def tree(self, number: int, weight: np.ndarray, path: int = 1, level: int = 0) -> Tree:
        """Down to pure leaves, or ``depth``; ``path`` and ``level`` say where a subtree hangs."""
        out = Tree.root()
        # Rows in the open nodes, which of these each is in, and the nodes' paths; open nodes are the last of the tree.
        rows, paths = np.flatnonzero(weight > 0), [path]
        node, weight = np.zeros(len(rows), np.int64), weight.astype(np.int64)
        while paths:
            w, y = weight[rows], self.y[rows]
            n, ones = np.bincount(node, w, len(paths)), np.bincount(node, w * y, len(paths))
            first = len(out.feature) - len(paths)
            out.value[first:] = np.divide(ones, n, out=np.zeros(len(paths)), where=n > 0)
            mixed = (ones > 0) & (ones < n) & (self.depth is None or level < self.depth)
            feature, cut = np.full(len(paths), -1), np.zeros(len(paths), np.int64)
            inside = mixed[node]
            place = np.cumsum(mixed) - 1
            order = np.array([drawn(self.seed, number, paths[i], self.bins.shape[1]) for i in np.flatnonzero(mixed)])
            rows, node = rows[inside], node[inside]
            feature[mixed], cut[mixed] = self._best(order, rows, place[node], w[inside], y[inside])
            split = feature >= 0
            out.split(first + np.flatnonzero(split), feature[split], cut[split])
            inside = split[node]
            rows, node = rows[inside], node[inside]
            right = self.bins[rows, feature[node]] > cut[node]
            node = 2 * (np.cumsum(split) - 1)[node] + right
            paths = [child_path(paths[i], side) for i in np.flatnonzero(split) for side in (False, True)]
            level += 1
        return out

    def _best(self, order: np.ndarray, rows: np.ndarray, node: np.ndarray, w: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``feature, cut`` of each node: the best of ``tries`` features drawn; more are drawn as long as none can be split, and -1 says that none can."""
        best, feature, cut = np.full(len(order), np.inf), np.full(len(order), -1), np.zeros(len(order), np.int64)
        for i in range(self.bins.shape[1]):
            if i >= self.tries:
                left = (feature < 0)[node]
                rows, node, w, y = rows[left], node[left], w[left], y[left]
            if not len(rows):
                break
            at, impurity, where = gini_splits(node, self.bins[rows, order[node, i]], w, y)
            better = impurity < best[at]
            at = at[better]
            best[at], feature[at], cut[at] = impurity[better], order[at, i], where[better]
        return feature, cut

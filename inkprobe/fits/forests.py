"""Random forests of unlimited depth: nodes are split by distributed histograms until a task can hold their rows, then finished there."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprobe.fits.binning import BINNED_VALUES, bin_matrix, binned_table, feature_cuts
from inkprobe.fits.table import class_counts, runs_of, summed
from inkprobe.fits.trees import BINS, Grower, Tree, binned, child_path, drawn, gini_split
from inkprobe.session import stage

# Trees of a run that are grown in one task where a task can hold all rows of the run.
BLOCK = 10
# Shares of draws 0, 1, 2, ... of a row in a sample as large as the table, drawn with replacement.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class ForestSpec:
    """``depth`` None: down to pure leaves. ``tries`` None: the root of the number of features."""

    trees: int = 300
    depth: int | None = None
    tries: int | None = None
    seed: int = 42


@dataclass
class Forest:
    """The mean of the leaf shares of class 1."""

    cuts: list[np.ndarray]
    trees: list[Tree]

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        total = np.zeros(len(bins))
        for tree in self.trees:
            total += tree.value[tree.leaves(bins)]
        return total / len(self.trees)


def bootstrap(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row; it depends on the row's key, seed and tree alone."""
    mixed = key.view(np.uint64) ^ np.uint64((seed * 1_000_003 + tree * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    return np.searchsorted(_POISSON, (mixed >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def _tries(spec: ForestSpec, width: int) -> int:
    return spec.tries or max(1, math.isqrt(width))


def _in_tasks(rows: DataFrame, width: int, spec: ForestSpec, runs: int) -> dict[int, list[Tree]]:
    """Runs that a task can hold: each goes to a task for every block of its trees."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key, block = table["key"].to_numpy(), table["block"][0].as_py()
        grower = Grower(bin_matrix(table["bins"].combine_chunks(), width), table["label"].to_numpy(), spec.seed, _tries(spec, width), spec.depth)
        trees = [grower.tree(t, bootstrap(key, spec.seed, t)).compact() for t in range(block * BLOCK, min((block + 1) * BLOCK, spec.trees))]
        return pa.table([pa.array([table["run"][0].as_py()], pa.int32()), pa.array([block], pa.int32()), pa.array([pickle.dumps(trees, 5)], pa.binary())], names=["run", "block", "trees"])

    blocks = -(-spec.trees // BLOCK)
    dealt = rows.select(F.explode("runs").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "key", "label", "bins")
    # With so many partitions, few blocks meet in a task.
    most = runs * blocks
    dealt = dealt.repartition(max(2 * most, min(16 * most, 1024)), "run", "block")
    found: dict[int, dict[int, list[Tree]]] = {}
    # Staged, as an iterator over a plan would run its tasks one after another; a forest can be too large for one result.
    for r in stage(dealt.groupBy("run", "block").applyInArrow(run, "run int, block int, trees binary"), "trees").toLocalIterator():
        found.setdefault(r.run, {})[r.block] = pickle.loads(r.trees)
    return {number: [tree for block in range(blocks) for tree in own[block]] for number, own in found.items()}


def _top_level(rows: DataFrame, width: int, spec: ForestSpec, trees: dict, open_: dict) -> DataFrame:
    """``run, tree, node, feature, cut, ones, n`` of the open nodes of all trees: one job, sums keyed by (run, tree, node)."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((trees, open_), 5))
    tries = _tries(spec, width)

    def partial(batches):
        trees, open_ = pickle.loads(shared.value)
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            bins, y, key = bin_matrix(batch.column(3), width), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for run, own in runs_of(batch):
                for t, nodes in open_.get(run, {}).items():
                    w = bootstrap(key[own], spec.seed, t)
                    leaf = trees[run][t].leaves(bins[own])
                    for node in nodes:
                        at = np.flatnonzero((leaf == node) & (w > 0))
                        sums = np.empty((width, 2, BINS))
                        for f in range(width):
                            b = bins[own[at], f]
                            sums[f] = np.bincount(b, w[at] * y[own[at]], BINS), np.bincount(b, w[at], BINS)
                        place = (run, t, node)
                        total[place] = total[place] + sums if place in total else sums
        if total:
            columns = list(zip(*total))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["run", "tree", "node", "values"])

    def finish(key, values):
        _, open_ = pickle.loads(shared.value)
        run, t, node = key
        sums = values.reshape(width, 2, BINS)
        ones, n = sums[0].sum(-1)
        best, split = np.inf, (-1, 0)
        for i, f in enumerate(drawn(spec.seed, t, open_[run][t][node], width)):
            if i >= tries and split[0] >= 0:
                break
            impurity, cut = gini_split(*sums[f])
            if impurity < best:
                best, split = impurity, (int(f), cut)
        right = float(sums[split[0], 1, split[1] + 1 :].sum()) if split[0] >= 0 else 0.0
        return [(*key, *split, float(ones), float(n), right)]

    parts = rows.mapInArrow(partial, "run int, tree int, node int, values binary")
    return summed(parts, finish, "run int, tree int, node int, feature int, cut int, ones double, n double, right double", 3)


def _by_levels(rows: DataFrame, width: int, spec: ForestSpec, runs: list[int], task_values: int) -> dict[int, list[Tree]]:
    """Split the largest nodes of all trees together, then finish each remaining node in a task of its own."""
    trees = {run: {t: Tree.root() for t in range(spec.trees)} for run in runs}
    open_: dict[int, dict[int, dict[int, int]]] = {run: {t: {0: 1} for t in range(spec.trees)} for run in runs}
    ready: dict[int, dict[int, dict[int, tuple[int, int]]]] = {run: {t: {} for t in range(spec.trees)} for run in runs}
    level = 0
    while any(open_.values()):
        following: dict[int, dict[int, dict[int, int]]] = {run: {} for run in runs}
        for r in _top_level(rows, width, spec, trees, open_).collect():
            tree, path = trees[r.run][r.tree], open_[r.run][r.tree][r.node]
            tree.value[r.node] = r.ones / r.n if r.n else 0.0
            if r.feature < 0 or r.ones in (0, r.n) or (spec.depth is not None and level >= spec.depth):
                continue
            first = len(tree.feature)
            tree.split(np.array([r.node]), np.array([r.feature]), np.array([r.cut]))
            for node, right, n in ((first, False, r.n - r.right), (first + 1, True, r.right)):
                if n * width > task_values:
                    following[r.run].setdefault(r.tree, {})[node] = child_path(path, right)
                else:
                    ready[r.run][r.tree][node] = (child_path(path, right), level + 1)
        open_, level = following, level + 1
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((trees, ready), 5))
    names = ["run", "tree", "node", "key", "label", "weight", "bins"]

    def deal(batches):
        trees, ready = pickle.loads(shared.value)
        for batch in batches:
            bins, key = bin_matrix(batch.column(3), width), batch.column(0).to_numpy()
            for run, own in runs_of(batch):
                for t, tree in trees[run].items():
                    w, leaf = bootstrap(key[own], spec.seed, t), tree.leaves(bins[own])
                    at = np.flatnonzero((w > 0) & np.isin(leaf, list(ready[run][t])))
                    take = pa.array(own[at])
                    columns = [pa.array(np.full(len(at), run), pa.int32()), pa.array(np.full(len(at), t), pa.int32()), pa.array(leaf[at].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(take), batch.column(1).take(take), pa.array(w[at]), batch.column(3).take(take)], names=names)

    def finish(table: pa.Table) -> pa.Table:
        _, ready = pickle.loads(shared.value)
        table = table.sort_by("key")
        run, t, node = (table[c][0].as_py() for c in ("run", "tree", "node"))
        path, at = ready[run][t][node]
        grower = Grower(bin_matrix(table["bins"].combine_chunks(), width), table["label"].to_numpy(), spec.seed, _tries(spec, width), spec.depth)
        subtree = grower.tree(t, table["weight"].to_numpy(), path, at)
        return pa.table([*(pa.array([v], pa.int32()) for v in (run, t, node)), pa.array([pickle.dumps(subtree, 5)], pa.binary())], names=["run", "tree", "node", "subtree"])

    dealt = rows.mapInArrow(deal, "run int, tree int, node int, key long, label int, weight double, bins binary")
    grown = dealt.groupBy("run", "tree", "node").applyInArrow(finish, "run int, tree int, node int, subtree binary")
    for r in grown.toLocalIterator():
        trees[r.run][r.tree].graft(r.node, pickle.loads(r.subtree))
    return {run: [own[t].compact() for t in range(spec.trees)] for run, own in trees.items()}


def fit_forests(train: DataFrame, spec: ForestSpec, task_values: int = BINNED_VALUES) -> dict[int, Forest]:
    """Forests of Gini trees on bootstrap samples, for every run, from ``key, label, runs, x``; as deep as the rows ask for.

    Features are cut into quantile bins once. A row's draws depend on its key and the tree, and a node's features on seed, tree and place, so a forest does not
    depend on partitions or on who grows it. Runs of up to ``task_values`` values go to a task for each block of trees. In larger runs the nodes of all trees
    are split together by sums over (run, tree, node, feature, bin) until each holds few enough rows; then each is finished by the task that gets its rows. NaN features raise.
    """
    cuts = feature_cuts(train)
    width = len(cuts)
    rows = binned_table(train, cuts)
    sizes = {run: sum(own.values()) for run, own in class_counts(rows).items()}
    small = [run for run, n in sizes.items() if n * width <= task_values]
    large = [run for run in sizes if run not in set(small)]
    only = lambda some: F.filter("runs", lambda r: r.isin(some))
    trees: dict[int, list[Tree]] = {}
    if small:
        trees |= _in_tasks(rows.withColumn("runs", only(small)), width, spec, len(small))
    if large:
        trees |= _by_levels(rows.withColumn("runs", only(large)), width, spec, large, task_values)
    return {run: Forest(cuts, own) for run, own in trees.items()}

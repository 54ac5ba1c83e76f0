"""Second-order gradient boosting of many runs at once over quantile histograms."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprobe.fits.binning import BINNED_VALUES, bin_matrix, binned_table, feature_cuts
from inkprobe.fits.table import class_counts, runs_of, summed
from inkprobe.fits.trees import LEAST_GAIN, Tree, best_gain, binned, histograms
from inkprobe.session import stage

# Rounds after which the margins of all rows are written anew, so that a round applies few trees.
KEEP_ROUNDS = 8


@dataclass(frozen=True)
class BoostSpec:
    """``penalty`` is the L2 weight of leaves, ``least`` the second derivatives that a child has at least."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 6
    penalty: float = 1.0
    least: float = 1.0
    subsample: float = 1.0
    seed: int = 42


@dataclass
class Booster:
    """Trees whose leaf values add up to the log odds of class 1."""

    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(margins(self.trees, binned(x, self.cuts)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def margins(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for tree in trees:
        out += tree.value[tree.leaves(bins)]
    return out


def _taken(key: np.ndarray, round_: int, spec: BoostSpec) -> np.ndarray:
    """1 for the rows that this round learns from: a draw that depends on row, seed and round alone."""
    if spec.subsample >= 1:
        return np.ones(len(key))
    mixed = (key.view(np.uint64) ^ np.uint64((spec.seed * 1_000_003 + round_) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(11)) / float(1 << 53) < spec.subsample).astype(float)


def _grown(tree: Tree, open_: np.ndarray, gain: np.ndarray, feature: np.ndarray, cut: np.ndarray, g: np.ndarray, h: np.ndarray, spec: BoostSpec, last: bool) -> np.ndarray:
    """Set the values of the open nodes and split those that gain; the new open nodes."""
    tree.value[open_] = -spec.rate * g / (h + spec.penalty)
    split = np.zeros(len(open_), bool) if last else gain > LEAST_GAIN
    n = len(tree.feature)
    tree.split(open_[split], feature[split], cut[split])
    return np.arange(n, len(tree.feature))


def _children(columns: np.ndarray, rows: np.ndarray, place: np.ndarray, sums: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Histograms of the children of nodes with ``sums``, which stand side by side: the rows of the smaller child are added up, the other has the rest."""
    n = sums.shape[1]
    counts = np.bincount(place, minlength=2 * n).reshape(n, 2)
    smaller = np.arange(n) * 2 + (counts[:, 1] < counts[:, 0])
    taken = np.zeros(2 * n, bool)
    taken[smaller] = True
    at = np.flatnonzero(taken[place])
    rows, place = rows[at], place[at] >> 1
    own = histograms(columns[:, rows].T, place, n, g[rows], h[rows])
    out = np.empty((2, 2 * n, *sums.shape[2:]))
    out[:, smaller], out[:, smaller ^ 1] = own, sums - own
    return out


def boost_rows(bins: np.ndarray, y: np.ndarray, key: np.ndarray, spec: BoostSpec) -> list[Tree]:
    """All rounds of one run whose rows are at hand."""
    trees, z = [], np.zeros(len(y))
    columns = np.ascontiguousarray(bins.T)
    for round_ in range(spec.rounds):
        p = _sigmoid(z)
        use = _taken(key, round_, spec)
        g, h = (p - y) * use, p * (1 - p) * use
        tree, open_, leaf = Tree.root(), np.array([0]), np.zeros(len(y), np.int64)
        # Rows in open nodes, and the places of these nodes among the open ones.
        rows, place = np.arange(len(y)), leaf
        for level in range(spec.depth + 1):
            if level == spec.depth:
                # The last level needs totals only.
                nothing = np.zeros(len(open_), np.int64)
                _grown(tree, open_, nothing, nothing, nothing, *(np.bincount(place, w[rows], len(open_)) for w in (g, h)), spec, True)
                break
            sums = _children(columns, rows, place, sums[:, split], g, h) if level else histograms(columns.T, place, 1, g, h)
            before, open_ = open_, _grown(tree, open_, *best_gain(sums, spec.penalty, spec.least), spec, False)
            if not len(open_):
                break
            split = tree.feature[before] >= 0
            inside = split[place]
            rows, at = rows[inside], before[place[inside]]
            leaf[rows] = at = tree.left[at] + (columns[tree.feature[at], rows] > tree.cut[at])
            place = at - open_[0]
        trees.append(tree)
        z += tree.value[leaf]
    return trees


def _in_tasks(rows: DataFrame, width: int, spec: BoostSpec, runs: int) -> dict[int, list[Tree]]:
    """Runs that a task can hold, each in one, all in one job."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        bins = bin_matrix(table["bins"].combine_chunks(), width)
        trees = boost_rows(bins, table["label"].to_numpy(), table["key"].to_numpy(), spec)
        return pa.table([pa.array([table["run"][0].as_py()], pa.int32()), pa.array([pickle.dumps(trees, 5)], pa.binary())], names=["run", "trees"])

    # With so many partitions, few runs meet in a task.
    grouped = rows.select(F.explode("runs").alias("run"), "key", "label", "bins").repartition(max(2 * runs, min(16 * runs, 1024)), "run").groupBy("run")
    return {r.run: pickle.loads(r.trees) for r in grouped.applyInArrow(run, "run int, trees binary").collect()}


def _level(rows: DataFrame, spec: BoostSpec, width: int, round_: int, recent: dict[int, list[Tree]], growing: dict[int, Tree], open_: dict[int, np.ndarray], totals: bool) -> DataFrame:
    """``run, node, gain, feature, cut, g, h`` of the open nodes of all runs, from ``key, label, runs, bins, margin``."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((recent, growing, open_), 5))

    def partial(batches):
        recent, growing, open_ = pickle.loads(shared.value)
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            bins, y, key = bin_matrix(batch.column(3), width), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            start = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]
            listed = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            for run, own in runs_of(batch):
                if run not in open_:
                    continue
                b = bins[own]
                # The margin of a row stands where the run stands in the row's list.
                z = np.array([start[at[i] + int(np.flatnonzero(listed[at[i] : at[i + 1]] == run)[0])] for i in own]) + margins(recent[run], b)
                p, use = _sigmoid(z), _taken(key[own], round_, spec)
                leaf = growing[run].leaves(b)
                place = np.searchsorted(open_[run], leaf)
                inside = (place < len(open_[run])) & (open_[run][np.minimum(place, len(open_[run]) - 1)] == leaf)
                b = b[inside][:, :1] if totals else b[inside]
                sums = histograms(b, place[inside], len(open_[run]), ((p - y[own]) * use)[inside], (p * (1 - p) * use)[inside])
                total[run] = total[run] + sums if run in total else sums
        out = [(run, int(node), sums[:, i].tobytes()) for run, sums in total.items() for i, node in enumerate(open_[run])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["run", "node", "values"])

    def finish(key, values):
        found = best_gain(values.reshape(2, 1, -1, 256), spec.penalty, spec.least)
        return [(*key, *(c[0].item() for c in found))]

    parts = rows.mapInArrow(partial, "run int, node int, values binary")
    return summed(parts, finish, "run int, node int, gain double, feature long, cut long, g double, h double", 2)


def _by_levels(rows: DataFrame, width: int, spec: BoostSpec, runs: list[int]) -> dict[int, list[Tree]]:
    """Runs of any size together: one job a level adds up the histograms of all their open nodes."""
    trees: dict[int, list[Tree]] = {run: [] for run in runs}
    kept = 0
    rows = stage(rows.withColumn("margin", F.expr("transform(runs, r -> 0D)")), "margins")
    for round_ in range(spec.rounds):
        recent = {run: trees[run][kept:] for run in runs}
        growing, open_ = {run: Tree.root() for run in runs}, {run: np.array([0]) for run in runs}
        for level in range(spec.depth + 1):
            found: dict[int, list] = {}
            for r in _level(rows, spec, width, round_, recent, growing, open_, level == spec.depth).collect():
                found.setdefault(r.run, []).append(tuple(r)[1:])
            for run in list(open_):
                columns = zip(*sorted(found.get(run, [])))
                nodes, *best = (np.array(c) for c in columns) if run in found else (np.zeros(0, np.int64),) * 6
                open_[run] = _grown(growing[run], nodes, *best, spec, level == spec.depth) if len(nodes) else np.zeros(0, np.int64)
                if not len(open_[run]):
                    del open_[run]
            if not open_:
                break
        for run in runs:
            trees[run].append(growing[run])
        if round_ - kept + 1 == KEEP_ROUNDS and round_ + 1 < spec.rounds:
            rows, kept = _with_margins(rows, width, {run: trees[run][kept:] for run in runs}), round_ + 1
    return trees


def _with_margins(rows: DataFrame, width: int, recent: dict[int, list[Tree]]) -> DataFrame:
    """The table with the margins after the ``recent`` trees, staged."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(recent, 5))

    def run(batches):
        own = pickle.loads(shared.value)
        for batch in batches:
            bins, z = bin_matrix(batch.column(3), width), batch.column(4).flatten().to_numpy(zero_copy_only=False).copy()
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            listed, row = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths)
            for number in np.unique(listed):
                at = np.flatnonzero(listed == number)
                z[at] += margins(own[number], bins[row[at]])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(z))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=batch.schema.names)

    return stage(rows.mapInArrow(run, rows.schema), "margins")


def fit_boosters(train: DataFrame, spec: BoostSpec, task_values: int = BINNED_VALUES) -> dict[int, Booster]:
    """Boosted trees of depth ``spec.depth`` on the log loss, for every run, from ``key, label, runs, x``.

    Features are cut into quantile bins once, over all rows. A node's best split maximises G_l^2 / (H_l + L2) + G_r^2 / (H_r + L2) - G^2 / (H + L2),
    where G and H are sums of first and second derivatives; a leaf is -rate G / (H + L2). Runs of up to ``task_values`` values go to a task each, all in one
    job. Larger runs grow together, level by level: each task adds up histograms by (run, node, feature, bin), these are added by key, and the driver gets one
    split a node. Both ways take the same splits. NaN features raise.
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
        trees |= _by_levels(rows.withColumn("runs", only(large)), width, spec, large)
    return {run: Booster(cuts, own) for run, own in trees.items()}

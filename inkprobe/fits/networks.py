"""Multilayer networks of many runs at once, with batch normalisation, dropout and decoupled weight decay."""

from __future__ import annotations

import pickle
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprobe.fits.table import class_counts, matrix
from inkprobe.session import stage

# Bytes of the rows of a run that are held in memory; more are read from a file.
_IN_MEMORY = 1 << 28
# Rows that are scored at a time.
_SCORED = 4096
# Weights of a network that takes its steps together with others.
_SMALL_NETWORK = 100_000
# Tasks that runs are dealt to, at least.
_TASKS = 64
_EPSILON = 1e-5
_MOMENTUM = 0.1
# Weights that are moved at a time, so that their moments stay in the processor's cache.
_BLOCK = 1 << 15
# Steps after which moments that have faded away become 0: numbers next to 0 are slow to compute with.
_FADED, _FADED_EVERY = 1e-30, 256
# Multiplications of a product that the processor's library takes as it lies.
_SMALL = 600_000
# Replicas that are averaged in one task.
_FAN = 8


@dataclass(frozen=True)
class NetworkSpec:
    """``patience`` epochs without a better loss on the ``validation`` share end the training with the best weights (0: none is held back)."""

    hidden: tuple[int, ...] = (1024, 512, 128)
    dropouts: tuple[float, ...] = (0.4, 0.3, 0.0)
    rate: float = 1e-5
    decay: float = 1e-5
    epochs: int = 100
    batch: int = 32
    validation: float = 0.0
    patience: int = 20
    seed: int = 42


class Network:
    """Linear layers with normalisation, ReLU and dropout between, two outputs. All weights live in one vector."""

    def __init__(self, width: int, spec: NetworkSpec):
        self.spec = spec
        sizes = [width, *spec.hidden, 2]
        rng = np.random.default_rng(spec.seed)
        self.shapes = []
        for a, b in zip(sizes, sizes[1:]):
            self.shapes += [(a, b), (b,)] + ([(b,), (b,)] if len(self.shapes) < 4 * len(spec.hidden) else [])
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes]).tolist()
        self.places = [(first, last, shape) for first, last, shape in zip([0, *ends], ends, self.shapes)]
        self.weights = np.zeros(ends[-1], np.float32)
        views = self._views(self.weights)
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            bound = 1 / np.sqrt(a)
            views[4 * i][:] = rng.uniform(-bound, bound, (a, b))
            views[4 * i + 1][:] = rng.uniform(-bound, bound, b)
            if i < len(spec.hidden):
                views[4 * i + 2][:] = 1
        self.means = [np.zeros(b, np.float32) for b in spec.hidden]
        self.variances = [np.ones(b, np.float32) for b in spec.hidden]
        # The moments of the gradient, the second times 10: the fading sum of squares of a tenth of it.
        self.first, self.second, self.steps = np.zeros_like(self.weights), np.zeros_like(self.weights), 0

    def _views(self, flat: np.ndarray) -> list[np.ndarray]:
        return [flat[first:last].reshape(shape) for first, last, shape in self.places]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, a = self._views(self.weights), x.astype(np.float32)
        for i in range(len(self.spec.hidden)):
            z = a @ w[4 * i] + _wide(w[4 * i + 1])
            a = np.maximum((z - _wide(self.means[i])) / np.sqrt(_wide(self.variances[i]) + _EPSILON) * _wide(w[4 * i + 2]) + _wide(w[4 * i + 3]), 0)
        return a @ w[-2] + _wide(w[-1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x).astype(np.float64)
        return np.exp(-np.logaddexp(0, z[:, 0] - z[:, 1]))

    def loss(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> float | np.ndarray:
        """The sum over ``rows``, some at a time."""
        total = 0.0
        for i in range(0, len(rows), _SCORED):
            at = rows[i : i + _SCORED]
            z = self.logits(x[..., at, :]).astype(np.float64)
            total = total + np.logaddexp(0, np.where(y[at] == 1, z[..., 0] - z[..., 1], z[..., 1] - z[..., 0])).sum(-1)
        return total

    def step(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, space: tuple | None = None) -> None:
        """One gradient step on a batch; ``space`` is what ``_space`` gave, for many steps.

        A unit has its values of the batch side by side (unit, row): the products then take half the time. A bias before a normalisation
        cancels out, so only the running mean sees it. Gradients are a tenth of what they are, as the first moment adds them up.
        """
        gradient, w, g = space or self._space()
        kind, kept = self.weights.dtype, []
        a = np.ascontiguousarray(x.swapaxes(-1, -2), kind)
        n = a.shape[-1]
        one, share = np.ones(n, kind), np.full(n, 1 / n, kind)
        for i, drop in enumerate(self.spec.dropouts):
            z = w[4 * i].swapaxes(-1, -2) @ a
            mean = z @ share
            z -= mean[..., None]
            variance = np.square(z) @ share
            self.means[i] += _MOMENTUM * (mean + w[4 * i + 1] - self.means[i])
            self.variances[i] += _MOMENTUM * (variance * (n / max(n - 1, 1)) - self.variances[i])
            scale = 1 / np.sqrt(variance + _EPSILON)
            z *= scale[..., None]
            more = 1 / (1 - drop)
            slope = w[4 * i + 2] * more
            out = z * slope[..., None]
            out += (w[4 * i + 3] * more)[..., None]
            mask = out > 0
            if drop > 0:
                mask &= rng.random(out.shape[-2:], np.float32) >= drop
            out *= mask
            kept.append((a, z, mask, scale * slope, more))
            a = out
        z = w[-2].swapaxes(-1, -2) @ a + w[-1][..., None]
        miss = (0.5 + 0.5 * np.tanh((z[..., 1, :] - z[..., 0, :]) / 2) - y.astype(kind)) * (0.1 / n)
        back = np.stack([-miss, miss], axis=-2)
        np.matmul(a, back.swapaxes(-1, -2), out=g[-2])
        g[-1][:] = back @ one
        back = w[-2] @ back
        for i in range(len(kept) - 1, -1, -1):
            a, normal, mask, slope, more = kept[i]
            back *= mask
            leaning, shift = (back * normal) @ one, back @ one
            g[4 * i + 2][:], g[4 * i + 3][:] = leaning * more, shift * more
            normal *= (leaning / n)[..., None]
            back -= normal
            back -= (shift / n)[..., None]
            back *= slope[..., None]
            np.matmul(a, back.swapaxes(-1, -2), out=g[4 * i])
            g[4 * i + 1][:] = back @ one
            if i:
                back = _product(w[4 * i], back)
        self._move(gradient, 1.0)

    def _space(self) -> tuple:
        """Room for a gradient, and the weights and the gradient by layers."""
        gradient = np.empty_like(self.weights)
        return gradient, self._views(self.weights), self._views(gradient)

    def _move(self, gradient: np.ndarray, share: float = 0.1) -> None:
        """Decoupled decay and Adam, a block of weights after another; ``gradient`` is used up. ``share`` of it is a tenth of the gradient."""
        spec = self.spec
        self.steps += 1
        spread = np.sqrt(0.1 / (1 - 0.999**self.steps))
        rate = np.float32(spec.rate / (1 - 0.9**self.steps) / spread)
        least, decay = np.float32(1e-8 / spread), np.float32(1 - spec.rate * spec.decay)
        for at in range(0, len(gradient), _BLOCK):
            own = slice(at, at + _BLOCK)
            w, first, second, g = self.weights[own], self.first[own], self.second[own], gradient[own]
            first *= np.float32(0.9)
            if share != 1:
                g *= np.float32(share)
            first += g
            g *= g
            second *= np.float32(0.999)
            second += g
            np.sqrt(second, out=g)
            g += least
            np.divide(first, g, out=g)
            g *= rate
            if decay != 1:
                w *= decay
            w -= g
            if self.steps % _FADED_EVERY == 0:
                first[np.abs(first) < _FADED] = 0
                second[second < _FADED] = 0

    def epoch(self, x: np.ndarray, y: np.ndarray, number: int, rows: np.ndarray | None = None) -> None:
        """Every row, or each of ``rows``, once, in batches in an order that depends on seed and epoch."""
        rng = np.random.default_rng([self.spec.seed, number])
        order = rng.permutation(len(y)) if rows is None else rows[rng.permutation(len(rows))]
        space = self._space()
        for i in range(0, len(order), self.spec.batch):
            at = order[i : i + self.spec.batch]
            if len(at) > 1 or len(order) == 1:  # a batch of one row has no variance
                self.step(x[..., at, :], y[at], rng, space)


class Stack(Network):
    """Networks that train on the same rows, each on its own column of them, in the same steps: small ones cost more calls than arithmetic.

    Their draws are the same, as those of a network alone are. Arrays have the network as first axis.
    """

    def __init__(self, networks: list[Network]):
        first = networks[0]
        self.many, self.spec, self.shapes, self.places, self.steps = len(networks), first.spec, first.shapes, first.places, first.steps
        for name in ("weights", "first", "second"):
            setattr(self, name, np.concatenate([getattr(net, name) for net in networks]))
        for name in ("means", "variances"):
            setattr(self, name, [np.stack([getattr(net, name)[i] for net in networks]) for i in range(len(getattr(first, name)))])

    def _views(self, flat: np.ndarray) -> list[np.ndarray]:
        rows = flat.reshape(self.many, -1)
        return [rows[:, first:last].reshape(self.many, *shape) for first, last, shape in self.places]

    def one(self, i: int) -> Network:
        out = Network.__new__(Network)
        out.spec, out.shapes, out.places, out.steps = self.spec, self.shapes, self.places, self.steps
        for name in ("weights", "first", "second"):
            setattr(out, name, getattr(self, name).reshape(self.many, -1)[i].copy())
        for name in ("means", "variances"):
            setattr(out, name, [v[i].copy() for v in getattr(self, name)])
        return out


def _wide(values: np.ndarray) -> np.ndarray:
    """A value for each unit, beside an axis for rows."""
    return values[..., None, :]


def _product(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``w @ b``, some rows at a time where the whole would be copied together before it's multiplied."""
    if w.ndim > 2:
        return w @ b
    rows, columns = w.shape
    some = next((m for m in (32, 16) if rows > m and rows % m == 0 and m * columns * b.shape[1] <= _SMALL), rows)
    return np.matmul(w.reshape(-1, some, columns), b).reshape(rows, -1)


def _held_back(key: np.ndarray, share: float) -> np.ndarray:
    mixed = (key.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(11)) / float(1 << 53) < share


def _averaged(replicas: list[tuple[Network, int]]) -> Network:
    """The mean of replicas that began the epoch alike, weighted by rows."""
    total = sum(n for _, n in replicas)
    out = replicas[0][0]
    mean = lambda get: sum(get(net) * np.float32(n / total) for net, n in replicas)
    out.weights, out.first, out.second = (mean(lambda net, k=k: getattr(net, k)) for k in ("weights", "first", "second"))
    out.means = [mean(lambda net, i=i: net.means[i]) for i in range(len(out.means))]
    out.variances = [mean(lambda net, i=i: net.variances[i]) for i in range(len(out.variances))]
    return out


def _split(key: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows to train on and rows held back; without either kind, all are trained on."""
    held = _held_back(key, share) if share else np.zeros(len(key), bool)
    if held.all():
        held[:] = False
    return np.flatnonzero(~held), np.flatnonzero(held)


def train_rows(network: Network, x: np.ndarray, y: np.ndarray, key: np.ndarray, first: int, last: int) -> Network:
    """Epochs ``first`` to ``last`` on rows at hand, with early stopping where the spec holds rows back."""
    return train_together([network], x[None], y, key, first, last)[0]


def train_together(networks: list[Network], x: np.ndarray, y: np.ndarray, key: np.ndarray, first: int, last: int) -> list[Network]:
    """``train_rows`` for networks with rows of the same keys and labels; ``x`` has the network as first axis. One that stops leaves the others."""
    own, held = _split(key, networks[0].spec.validation)
    out, best_loss, since, live = list(networks), [np.inf] * len(networks), [0] * len(networks), list(range(len(networks)))
    join = lambda some: Stack(some) if len(some) > 1 else some[0]
    alone = lambda i: stack.one(i) if len(live) > 1 else stack
    at = lambda: x if len(live) > 1 else x[0]
    stack = join(networks)
    for number in range(first, last):
        stack.epoch(at(), y, number, own)
        if not len(held):
            continue
        stays = []
        for i, (run, loss) in enumerate(zip(live, np.atleast_1d(stack.loss(at(), y, held)))):
            since[run] += 1
            if loss < best_loss[run]:
                out[run], best_loss[run], since[run] = pickle.loads(pickle.dumps(alone(i), 5)), loss, 0
            elif since[run] >= stack.spec.patience:
                continue
            stays.append(i)
        if not stays:
            break
        if len(stays) < len(live):
            stack, x, live = join([alone(i) for i in stays]), x[stays], [live[i] for i in stays]
    if not len(held):
        out = [alone(i) for i in range(len(live))]
    return out


def _room(rows: int, width: int) -> np.ndarray:
    """A matrix for rows; a large one lies in a file without name, of which memory holds what it has room for."""
    if rows * width * 4 <= _IN_MEMORY:
        return np.empty((rows, width), np.float32)
    return np.memmap(tempfile.TemporaryFile(), np.float32, "w+", shape=(rows, width))


def fit_networks(train: DataFrame, spec: NetworkSpec, task_values: int | None = None, task_work: int | None = None) -> dict[int, Network]:
    """Networks of the same form for every run, from ``key, label, runs, x``; all of them advance in the same jobs.

    All epochs of a run follow each other in one task, batch by batch, whatever its number of rows; the runs train at the same time, each in a task of its own, the largest first.
    Small networks of more runs than cores take their steps together in a task where their rows have the same keys and labels; the draws are the same then.
    Every run starts from the weights that ``spec.seed`` gives and takes its rows in the order of their keys, so a network equals the one fitted alone.

    Only a caller who asks for it gets another training: a run with more than ``task_values`` values, or with more work in an epoch than ``task_work`` (rows by weights), is then
    dealt to shards. A job is an epoch there: each shard trains a replica from the same weights, and replicas are averaged by rows, by key, weights moving once an epoch and
    rows never. Rows are held back and the training stops early as in one task.
    """
    sizes = {run: sum(own.values()) for run, own in class_counts(train).items()}
    width = train.select(F.max(F.size("x"))).first()[0]
    weights = len(Network(width, spec).weights) if sizes else 0
    parts = lambda have, most: 1 if most is None else -(-have // most)
    shards = {run: max(1, parts(n * width, task_values), parts(n * weights, task_work)) for run, n in sizes.items()}
    rows = train.select(F.explode("runs").alias("run"), "key", "label", "x")
    models: dict[int, bytes] = {}
    names, schema = ["run", "n", "network", "place", "loss", "held"], "run int, n long, network binary, place long, loss double, held long"
    number = lambda of: F.element_at(F.create_map(*[F.lit(v) for pair in of.items() for v in pair]), F.col("run"))

    def made(run: int, n: int, network: Network, place: int, loss: float = 0.0, held: int = 0) -> list[pa.Array]:
        numbers = pa.array([place], pa.int64()), pa.array([loss], pa.float64()), pa.array([held], pa.int64())
        return [pa.array([run], pa.int32()), pa.array([n]), pa.array([pickle.dumps(network, 5)], pa.binary()), *numbers]

    def whole(batches):
        """Rows sorted by run and key to the networks of a team, or of the runs where their rows differ."""
        data, at, run = [], 0, None
        for batch in batches:
            own = batch.column(0).to_numpy()
            for first, last in zip(starts := [0, *(np.flatnonzero(np.diff(own)) + 1).tolist()] if len(own) else [], [*starts[1:], len(own)]):
                if run != int(own[first]):
                    run, at = int(own[first]), 0
                    n = sizes[run]
                    if not data:
                        x = _room(n * len(teams[run]), width).reshape(-1, n, width)
                    data.append((run, np.empty(n, np.int64), np.empty(n, np.int64)))
                some = slice(at, at + last - first)
                data[-1][1][some], data[-1][2][some] = batch.column(1).to_numpy()[first:last], batch.column(2).to_numpy()[first:last]
                x[len(data) - 1, some] = matrix(batch.column(3).slice(first, last - first))
                at = some.stop
                if at == n and len(data) == len(teams[run]):
                    key, y = data[0][1:]
                    fresh = [Network(width, spec) for _ in data]
                    if all(np.array_equal(key, k) and np.array_equal(y, v) for _, k, v in data[1:]):
                        trained = train_together(fresh, x, y, key, 0, spec.epochs)
                    else:
                        trained = [train_rows(net, x[i], v, k, 0, spec.epochs) for i, (net, (_, k, v)) in enumerate(zip(fresh, data))]
                    for network, (number, *_) in zip(trained, data):
                        network.first = network.second = np.zeros(0, np.float32)
                        yield pa.RecordBatch.from_arrays(made(number, n, network, 0), names=names)
                    data = []

    def packed(table: pa.Table) -> pa.Table:
        """A shard as one row, so that it's read by one task."""
        table = table.sort_by("key")
        x = matrix(table["x"].combine_chunks()).astype(np.float32)
        data = [pa.array([d.tobytes()], pa.binary()) for d in (x, table["label"].to_numpy().astype(np.int64), table["key"].to_numpy())]
        return pa.table([table["run"][:1], table["shard"][:1], pa.array([len(x)]), *data], names=["run", "shard", "n", "x", "label", "key"])

    def mean(table: pa.Table) -> pa.Table:
        network = _averaged([(pickle.loads(d), n) for n, d in zip(table["n"].to_pylist(), table["network"].to_pylist())])
        total = lambda c: sum(table[c].to_pylist())
        return pa.table(made(table["run"][0].as_py(), total("n"), network, table["place"][0].as_py(), total("loss"), total("held")), names=names)

    single, several = sorted((r for r in shards if shards[r] == 1), key=lambda r: -sizes[r]), [r for r in shards if shards[r] > 1]
    if single:
        chosen = rows.filter(F.col("run").isin(single))
        cores = train.sparkSession.sparkContext.defaultParallelism
        teams = {run: [run] for run in single}
        if weights <= _SMALL_NETWORK and len(single) > cores:
            # Runs whose rows seem to be the same; the task makes sure.
            mark = F.xxhash64("key", "label")
            seen: dict[tuple, list[int]] = {}
            for r in chosen.groupBy("run").agg(F.bit_xor(mark).alias("low"), F.bit_xor(F.xxhash64(mark)).alias("high")).collect():
                seen.setdefault((sizes[r.run], r.low, r.high), []).append(r.run)
            for alike in seen.values():
                most = max(1, min(-(-len(single) // cores), _IN_MEMORY // max(1, 4 * width * sizes[alike[0]])))
                for i in range(0, len(alike), most):
                    team = sorted(alike)[i : i + most]
                    teams |= dict.fromkeys(team, team)
        place = {run: i for i, run in enumerate(dict.fromkeys(teams[run][0] for run in single))}
        placed = chosen.repartitionById(max(_TASKS, len(place)), number({run: place[teams[run][0]] for run in single}))
        # Staged, as an iterator over a plan would run its tasks one after another.
        for row in stage(placed.sortWithinPartitions("run", "key").mapInArrow(whole, schema).select("run", "network"), "networks").toLocalIterator():
            models[row.run] = bytes(row.network)
    if several:
        dealt = rows.filter(F.col("run").isin(several)).withColumn("shard", F.pmod(F.xxhash64("key"), number(shards)).cast("int"))
        # With so many partitions, few shards meet in a task.
        most = sum(shards[run] for run in several)
        dealt = dealt.repartition(max(2 * most, min(16 * most, 1024)), "run", "shard").groupBy("run", "shard")
        packs = stage(dealt.applyInArrow(packed, "run int, shard int, n long, x binary, label binary, key binary"), "network-rows")
        going, best, since = set(several), {}, dict.fromkeys(several, 0)
        for epoch in range(spec.epochs + bool(spec.validation)):  # the last one only tells the loss
            began = train.sparkSession.sparkContext.broadcast({run: models[run] for run in going if run in models})

            def work(batches, epoch=epoch, began=began):
                for batch in batches:
                    for row in batch.to_pylist():
                        x = np.frombuffer(row["x"], np.float32).reshape(row["n"], -1)
                        y, key = np.frombuffer(row["label"], np.int64), np.frombuffer(row["key"], np.int64)
                        network = pickle.loads(began.value[row["run"]]) if row["run"] in began.value else Network(x.shape[1], spec)
                        own, held = _split(key, spec.validation)
                        loss = network.loss(x, y, held)
                        if epoch < spec.epochs:
                            network.epoch(x, y, epoch, own)
                        yield pa.RecordBatch.from_arrays(made(row["run"], len(own), network, row["shard"], loss, len(held)), names=names)

            replicas = packs.filter(F.col("run").isin(list(going))).mapInArrow(work, schema)
            left = max(shards[run] for run in going)
            while left > 1:  # a tree: replicas meet in groups until one is left
                replicas, left = replicas.withColumn("place", F.floor(F.col("place") / _FAN)).groupBy("run", "place").applyInArrow(mean, schema), -(-left // _FAN)
            for row in stage(replicas.select("run", "network", "loss", "held"), "networks").toLocalIterator():
                if epoch and row.held:
                    since[row.run] += 1
                    if row.loss < best.get(row.run, (np.inf, b""))[0]:
                        best[row.run], since[row.run] = (row.loss, models[row.run]), 0
                    elif since[row.run] >= spec.patience:
                        going.discard(row.run)
                models[row.run] = bytes(row.network)
            began.destroy()
            if not going:
                break
        models |= {run: network for run, (_, network) in best.items()}
    return {run: pickle.loads(data) for run, data in models.items()}

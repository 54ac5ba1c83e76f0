"""Toxicity scores by a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkprobe.llm.arrow import SLICE_BYTES, utf8_slices, without
from inkprobe.llm.wordhash import ALPHANUMERIC, LOWER, hash_prefixes, hash_runs, words
from inkprobe.session import discard, stage


@dataclass(frozen=True)
class CnnSpec:
    """Shape and training of the network.

    A word is three hashed vectors side by side: two by independent hashes of the word, so that two words
    seldom share both, and one by its first ``prefix`` bytes.
    """

    buckets: int = 1 << 17
    dim: int = 8
    prefix: int = 5
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    # Passes over the texts: so many that ``visits`` texts are seen, within these bounds.
    visits: int = 40_000
    epochs: tuple[int, int] = (6, 25)
    batch: int = 64
    rate: float = 0.1
    seed: int = 3
    # Most labelled rows of each class that are fitted on, chosen by hash (None: all).
    fit_positive: int | None = None
    fit_negative: int | None = None
    # Rows and bytes of text that one task trains on. Beyond that, shards train replicas, which meet after each pass.
    shard_rows: int = 8192
    shard_bytes: int = 16 << 20
    # Share of the fitted rows that calibrates and is not trained on.
    calibration: float = 0.2


PARTS = 3
# Words whose responses are held at once.
_ROWS = 1 << 16
# Word vectors of a piece in which what a replica learned travels.
_PIECE = 4096
# Logits are counted in steps of 1/256 for the calibration.
_STEPS = 256
# Labels that are joined to the documents without a shuffle of texts: 32 MB as a table of ids.
_BROADCAST_LABELS = 2_000_000


def hashed_words(data: np.ndarray, offsets: np.ndarray, spec: CnnSpec) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, words by parts, and the number of words of each text."""
    low = LOWER[data]
    # Upper-case letters of the Latin-1 supplement: second byte after 0xC3.
    high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    low[high] += 0x20
    starts, ends, counts = words(data, offsets, ALPHANUMERIC)
    whole = hash_runs(low, starts, ends)
    first = hash_prefixes(low, starts, ends, spec.prefix)
    n = np.uint64(spec.buckets)
    out = np.empty((len(starts), PARTS), dtype=np.int32)
    out[:, 0] = whole % n
    out[:, 1] = (whole >> np.uint64(32)) % n + n
    out[:, 2] = first % n + n + n
    return out, counts


@dataclass
class Cnn:
    """Embedding rows, filters and output weights; scores are ``sigmoid(scale * logit + shift)``."""

    spec: CnnSpec
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)
    threshold: float = 0.5

    @classmethod
    def fresh(cls, spec: CnnSpec) -> Cnn:
        rng = np.random.default_rng(spec.seed)
        width = PARTS * spec.dim
        # The last row stands for no word and stays zero.
        embedding = rng.normal(0, 0.05, (PARTS * spec.buckets + 1, spec.dim)).astype(np.float32)
        embedding[-1] = 0
        filters = [rng.normal(0, 1 / np.sqrt(w * width), (w, width, spec.filters)).astype(np.float32) for w in spec.widths]
        n = len(spec.widths) * spec.filters
        return cls(spec, embedding, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)

    def _padded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each text, then as many empty rows as the widest filter needs; first row of each text."""
        pad = max(self.spec.widths)
        first = np.concatenate([[0], np.cumsum(counts + pad)])
        rows = np.full((first[-1], PARTS), len(self.embedding) - 1, dtype=np.int32)
        at = np.arange(len(ids)) + np.repeat(np.arange(len(counts)) * pad, counts)
        rows[at] = ids
        return rows, first

    def _responses(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors, and the filters' responses at every row from which no window reaches the next text."""
        x = self.embedding[rows].reshape(len(rows), -1)
        out = np.zeros((len(rows), len(self.bias)), dtype=np.float32)
        n = self.spec.filters
        for k, (width, f) in enumerate(zip(self.spec.widths, self.filters)):
            for j in range(width):
                out[: len(rows) - j, k * n : (k + 1) * n] += x[j:] @ f[j]
        for k in range(1, max(self.spec.widths)):
            out[first[1:] - k] = -np.inf
        return x, out

    def pooled(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text."""
        rows, first = self._padded(ids, counts)
        _, out = self._responses(rows, first)
        return np.maximum(np.maximum.reduceat(out, first[:-1], axis=0) + self.bias, 0)

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One number per text. A text beyond ``_ROWS`` words goes in overlapping pieces whose maxima meet."""
        if len(ids) <= _ROWS or len(counts) == 0:
            return self.pooled(ids, counts) @ self.out + self.out_bias
        ends = np.cumsum(counts)
        out = np.empty(len(counts), dtype=np.float32)
        begin = 0
        while begin < len(counts):
            at = ends[begin - 1] if begin else 0
            end = max(int(np.searchsorted(ends, at + _ROWS, side="right")), begin + 1)
            part = ids[at : ends[end - 1]]
            if end == begin + 1 and len(part) > _ROWS:
                tops = []
                for i in range(0, len(part), _ROWS):
                    piece = part[i : i + _ROWS + max(self.spec.widths) - 1]
                    responses = self._responses(*self._padded(piece, np.array([len(piece)])))[1]
                    # Windows of the overlap belong to the next piece, the empty rows to the last one.
                    tops.append((responses[:_ROWS] if i + _ROWS < len(part) else responses).max(axis=0))
                out[begin] = np.maximum(np.max(tops, axis=0) + self.bias, 0) @ self.out + self.out_bias
            else:
                out[begin:end] = self.pooled(part, counts[begin:end]) @ self.out + self.out_bias
            begin = end
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, counts = hashed_words(data, offsets, self.spec)
        return 1 / (1 + np.exp(-(self.scale * self.logits(ids, counts).astype(np.float64) + self.shift)))

    def sums(self) -> dict[str, list[np.ndarray]]:
        """Sums of squared gradients, at first; ``e`` are those of the word vectors."""
        square = lambda v: np.full(np.shape(v), 1e-4, np.float32)
        return {"e": [square(self.embedding)], "f": [square(f) for f in self.filters], "b": [square(self.bias)], "o": [square(self.out)], "ob": [square([0.0])]}

    def passes(self, n: int) -> int:
        return min(max(self.spec.visits // max(n, 1), self.spec.epochs[0]), self.spec.epochs[1])

    def train(self, texts: list[tuple[np.ndarray, int]], seen: dict[str, list[np.ndarray]], passes: int, rng: np.random.Generator) -> None:
        """Adagrad on the log loss, touching only rows that win a maximum; ``seen`` goes on from pass to pass."""
        spec = self.spec
        n, pad = spec.filters, max(spec.widths)
        (seen_e,), seen_f, (seen_b,), (seen_o,), (seen_ob,) = (seen[k] for k in ("e", "f", "b", "o", "ob"))
        order = np.arange(len(texts))
        for _ in range(passes):
            rng.shuffle(order)
            for start in range(0, len(order), spec.batch):
                part = [texts[i] for i in order[start : start + spec.batch]]
                y = np.array([label for _, label in part], np.float32)
                rows, first = self._padded(np.concatenate([t for t, _ in part]), np.array([len(t) for t, _ in part]))
                x, responses = self._responses(rows, first)
                x = np.vstack([x, np.zeros((pad, x.shape[1]), np.float32)])
                top = np.maximum.reduceat(responses, first[:-1], axis=0)
                hidden = np.maximum(top + self.bias, 0)
                error = (1 / (1 + np.exp(-(hidden @ self.out + self.out_bias))) - y) / len(y)
                back = error[:, None] * self.out[None, :] * (hidden > 0)
                texts_at, filters_at = np.nonzero(back)
                # First row of each text where the filter reaches its maximum.
                where = np.empty(len(texts_at), dtype=np.int64)
                for i in range(len(part)):
                    own = texts_at == i
                    where[own] = first[i] + np.argmax(responses[first[i] : first[i + 1]][:, filters_at[own]], axis=0)
                weight = back[texts_at, filters_at]
                touched, steps = [], []
                for k, width in enumerate(spec.widths):
                    own = (filters_at >= k * n) & (filters_at < (k + 1) * n)
                    f_at, g = filters_at[own] - k * n, weight[own]
                    for j in range(width):
                        at = where[own] + j
                        grad = np.zeros_like(self.filters[k][j])
                        np.add.at(grad.T, f_at, g[:, None] * x[at])
                        inside = at < len(rows)
                        touched.append(rows[at[inside]])
                        steps.append((g[:, None] * self.filters[k][j].T[f_at])[inside])
                        seen_f[k][j] += grad**2
                        self.filters[k][j] -= spec.rate * 0.3 * grad / np.sqrt(seen_f[k][j])
                if touched:
                    ids = np.concatenate(touched).ravel()
                    grads = np.concatenate(steps).reshape(-1, spec.dim)
                    unique, inverse = np.unique(ids, return_inverse=True)
                    total = np.zeros((len(unique), spec.dim), np.float32)
                    np.add.at(total, inverse, grads)
                    total[unique == len(self.embedding) - 1] = 0
                    seen_e[unique] += total**2
                    self.embedding[unique] -= spec.rate * total / np.sqrt(seen_e[unique])
                g_out, g_bias, g_ob = hidden.T @ error, back.sum(axis=0), float(error.sum())
                seen_o += g_out**2
                self.out -= spec.rate * 0.3 * g_out / np.sqrt(seen_o)
                seen_b += g_bias**2
                self.bias -= spec.rate * 0.3 * g_bias / np.sqrt(seen_b)
                seen_ob += g_ob**2
                self.out_bias -= float(spec.rate * 0.3 * g_ob / np.sqrt(seen_ob[0]))

    def narrow(self, seen: dict[str, list[np.ndarray]]) -> np.ndarray:
        """All that is learned but the word vectors and their sums, as one vector."""
        parts = [*self.filters, self.bias, self.out, [self.out_bias], *seen["f"], *seen["b"], *seen["o"], *seen["ob"]]
        return np.concatenate([np.ravel(p) for p in parts]).astype(np.float64)

    def set_narrow(self, seen: dict[str, list[np.ndarray]], values: np.ndarray) -> None:
        """Take over what ``narrow`` gave."""
        at = 0
        for part in (*self.filters, self.bias, self.out, None, *seen["f"], *seen["b"], *seen["o"], *seen["ob"]):
            if part is None:
                self.out_bias, at = float(values[at]), at + 1
            else:
                part[...] = values[at : at + part.size].reshape(part.shape)
                at += part.size

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> None:
        """Logistic scale of the scores, then the threshold of the best F1; ``counts`` rows each, ``weights`` for all of these."""
        a, b = 1.0, 0.0
        # Targets a little inside 0 and 1 keep the scale finite on separable rows.
        n1, n0 = max((counts * labels).sum(), 1), max((counts * (1 - labels)).sum(), 1)
        target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

        def loss(a: float, b: float) -> float:
            z = a * logits + b
            return float((weights * (np.logaddexp(0, z) - target * z)).sum() + 0.5e-3 * (a - 1) ** 2)

        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * logits + b, -35, 35)))
            g, h = weights * (p - target), weights * np.maximum(p * (1 - p), 1e-9)
            grad = np.array([(g * logits).sum() + 1e-3 * (a - 1), g.sum()])
            hess = np.array([[(h * logits**2).sum() + 1e-3, (h * logits).sum()], [(h * logits).sum(), h.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-9))
            # Full steps overshoot where one class weighs much more.
            for _ in range(30):
                if loss(a - step[0], b - step[1]) <= loss(a, b):
                    a, b = a - step[0], b - step[1]
                    break
                step /= 2
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        self.threshold = self.best_threshold(logits, labels, weights, 0.5)

    def best_threshold(self, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, fallback: float) -> float:
        """The threshold of the best F1 on scores as calibrated."""
        return _best_threshold(1 / (1 + np.exp(-(self.scale * logits + self.shift))), labels, weights, fallback)


def _best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, fallback: float) -> float:
    """Middle of the widest gap among the cuts of the best F1."""
    if not labels.any() or labels.all():
        return fallback
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], weights[order]
    hit, taken = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (taken + (w * y).sum())
    lower = np.append(s[1:], 0.0)
    cut = np.where(s > lower, f1, -1)
    best = np.flatnonzero(cut >= cut.max() - 1e-12)
    gap = best[np.argmax(s[best] - lower[best])]
    return float((s[gap] + lower[gap]) / 2)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", spec: CnnSpec = CnnSpec(), stands_for: dict[int, float] | None = None) -> Cnn:
    """Train on all labelled rows, or on as many of each label as ``spec.fit_positive`` and ``spec.fit_negative`` allow, smallest hash of the id first.

    Up to ``spec.shard_rows`` rows train in one task. More are dealt to shards; each pass, every shard trains a replica, and replicas meet: a word vector moves by the mean
    of the shards that touched it, all else by the mean of all shards. Calibration and thresholds come from all rows held back from the training.
    Where ``labelled`` is itself a sample, ``stands_for`` gives for each label how many rows one of its rows stands for (1).
    Scores and thresholds hold for the label shares of all rows.
    Rows without label don't count; a null text is empty. Language only chooses thresholds. Without rows of both
    classes, the model gives every text the share of label 1 (a half without rows).
    """
    rows = labelled.select(
        F.xxhash64(F.lit(spec.seed), F.col(id_col).cast("string")).alias("h"), F.coalesce(text_col, F.lit("")).alias("text"),
        F.col(label_col).cast("int").alias("y"), F.col(lang_col).cast("string").alias("lang"),
    ).filter("y IS NOT NULL")
    found = {r.y: (r.n, r.size) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    counts = {label: n * (stands_for or {}).get(label, 1) for label, (n, _) in found.items()}
    model = Cnn.fresh(spec)
    if not counts.get(0) or not counts.get(1):
        total = sum(counts.values())
        share = counts.get(1, 0) / total if total else 0.5
        model.out[:] = 0
        model.scale, model.shift = 1.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return model
    parts = [
        own if most is None else own.orderBy("h", F.xxhash64("text")).limit(most)
        for own, most in ((rows.filter(F.col("y") == label), most) for label, most in ((1, spec.fit_positive), (0, spec.fit_negative)))
    ]
    taken = {label: n if most is None else min(n, most) for (label, most), n in (((k, m), found[k][0]) for k, m in ((1, spec.fit_positive), (0, spec.fit_negative)))}
    size = sum(s / n * taken[label] for label, (n, s) in found.items() if label in taken)
    shards = max(1, -(-sum(taken.values()) // spec.shard_rows), int(-(-size // spec.shard_bytes)))
    # By id, as one text may have many copies; equal texts fall on the same side of the calibration split.
    dealt = parts[0].unionByName(parts[1]).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    packs = stage(dealt.repartition(max(2 * shards, min(16 * shards, 1024)), "shard").groupBy("shard").applyInArrow(lambda t: _packed(t, spec), _PACK), "fit-rows")
    numbers = [F.sum(c).alias(c) for c in ("n", "ones", "held", "held_ones")]
    n, ones, held, held_ones = packs.agg(*numbers).first()
    split = held < n and 0 < ones - held_ones < n - held
    trains = lambda own: ~own if split else np.ones(len(own), bool)
    seen, epochs, passed = model.sums(), model.passes(n - held if split else n), []
    for number in range(epochs if shards > 1 else 1):
        began = labelled.sparkSession.sparkContext.broadcast((model, seen))
        learned = stage(packs.mapInArrow(_replica(began, trains, number, epochs if shards == 1 else 1), _LEARNED).groupBy("piece").applyInArrow(_met, _LEARNED), "learned")
        for r in learned.toLocalIterator():
            _take_over(model, seen, r)
        passed.append(learned)
        began.destroy()
    discard(*passed)
    del seen, passed
    held_back = split and held_ones >= 5 and held - held_ones >= 5
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    logits = stage(packs.select("sizes", "data", "label", "langs", "held_back").mapInArrow(_logits(shared, held_back), "lang string, y int, step int, n long").groupBy("lang", "y", "step").agg(F.sum("n").alias("n")), "logits")
    weight = {label: counts[label] / taken[label] for label in (0, 1)}
    table = lambda df: tuple(np.array(c, np.float64) for c in zip(*df.select("step", "y", "n").toLocalIterator()))
    step, y, many = table(stage(logits.groupBy("y", "step").agg(F.sum("n").alias("n")), "all-logits"))
    w = many * np.where(y == 1, weight[1], weight[0])
    scale = many.sum() / w.sum()
    model.calibrate(step / _STEPS, y, many, w * scale)
    of = lambda label: F.sum(F.when(F.col("y") == label, F.col("n")).otherwise(F.lit(0)))
    for r in logits.groupBy("lang").agg(of(1).alias("ones"), of(0).alias("zeros")).filter("ones >= 5 AND zeros >= 5").collect():
        step, y, many = table(logits.filter(F.col("lang").eqNullSafe(F.lit(r.lang))))
        model.thresholds[r.lang] = model.best_threshold(step / _STEPS, y, scale * many * np.where(y == 1, weight[1], weight[0]), model.threshold)
    return model


_PACK = "shard int, n long, ones long, held long, held_ones long, sizes binary, data binary, label binary, langs array<string>, held_back binary"
_LEARNED = "piece int, shard int, n long, rows binary, moved binary, sums binary"


def _packed(table: pa.Table, spec: CnnSpec) -> pa.Table:
    """A shard as one row, so that one task reads it; label 1 first, then by hash."""
    table = table.sort_by([("y", "descending"), ("h", "ascending"), ("text", "ascending")])
    texts = [t.encode() for t in table["text"].to_pylist()]
    y = table["y"].to_numpy().astype(np.int64)
    held = np.array([_text_share(np.frombuffer(t, np.uint8)) < spec.calibration for t in texts])
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers = [len(y), int((y == 1).sum()), int(held.sum()), int((y[held] == 1).sum())]
    data = [sizes.tobytes(), b"".join(texts), y.tobytes()]
    columns = [table["shard"][:1], *[pa.array([v]) for v in numbers], *[pa.array([d], pa.binary()) for d in data]]
    names = [f.split(" ")[0] for f in _PACK.split(", ")]
    return pa.table([*columns, pa.array([table["lang"].to_pylist()], pa.list_(pa.string())), pa.array([held.tobytes()], pa.binary())], names=names)


def _unpacked(row: dict, spec: CnnSpec) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed words of each text, labels, and which texts are held back."""
    data = np.frombuffer(row["data"], np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
    ids, first = [], 0
    while first < len(offsets) - 1:
        last = max(int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1, first + 1)
        words, counts = hashed_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], spec)
        ends = np.cumsum(counts)
        ids += [words[i:j] for i, j in zip([0, *ends[:-1]], ends)]
        first = last
    return ids, np.frombuffer(row["label"], np.int64), np.frombuffer(row["held_back"], bool)


def _rows_of(batches):
    """Rows one at a time: each is a shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _replica(began, trains, number: int, passes: int):
    """Train a copy of the model on a shard; give how word vectors moved, piece by piece, and all else (piece -1)."""

    def run(batches):
        for row in _rows_of(batches):
            old, old_seen = began.value
            model, seen = pickle.loads(pickle.dumps((old, old_seen), 5))
            ids, y, held = _unpacked(row, model.spec)
            texts = [(ids[i], int(y[i])) for i in np.flatnonzero(trains(held))]
            if not texts:
                continue
            model.train(texts, seen, passes, np.random.default_rng(model.spec.seed if passes > 1 else [model.spec.seed, number, row["shard"]]))
            touched = np.flatnonzero((model.embedding != old.embedding).any(1) | (seen["e"][0] != old_seen["e"][0]).any(1))
            moved, sums = model.embedding[touched] - old.embedding[touched], seen["e"][0][touched] - old_seen["e"][0][touched]
            pieces = [(-1, b"", model.narrow(seen).tobytes(), b"")]
            for own in np.split(np.arange(len(touched)), np.flatnonzero(np.diff(touched // _PIECE)) + 1):
                if len(own):
                    pieces.append((int(touched[own[0]] // _PIECE), touched[own].tobytes(), moved[own].tobytes(), sums[own].tobytes()))
            for piece, *data in pieces:
                numbers = [pa.array([piece], pa.int32()), pa.array([row["shard"]], pa.int32()), pa.array([len(texts)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*numbers, *[pa.array([d], pa.binary()) for d in data]], names=[f.split(" ")[0] for f in _LEARNED.split(", ")])

    return run


def _met(table: pa.Table) -> pa.Table:
    """What all shards learned of one piece: of a word vector, the mean of the shards that touched it."""
    table = table.sort_by("shard")
    n, moved = table["n"].to_numpy(), table["moved"].to_pylist()
    if table["piece"][0].as_py() < 0:
        data = [b"", sum(np.frombuffer(d, np.float64) * (k / n.sum()) for d, k in zip(moved, n)).tobytes(), b""]
    else:
        rows = np.concatenate([np.frombuffer(d, np.int64) for d in table["rows"].to_pylist()])
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
        many = np.diff(np.r_[starts, len(rows)])[:, None]
        mean = lambda parts: (np.add.reduceat(np.concatenate([np.frombuffer(d, np.float32) for d in parts]).reshape(len(rows), -1)[order], starts) / many).astype(np.float32)
        data = [rows[order][starts].tobytes(), mean(moved).tobytes(), mean(table["sums"].to_pylist()).tobytes()]
    return pa.table([table["piece"][:1], table["shard"][:1], pa.array([int(n.sum())]), *[pa.array([d], pa.binary()) for d in data]], names=table.column_names)


def _take_over(model: Cnn, seen: dict[str, list[np.ndarray]], row) -> None:
    """Add what the shards learned of a piece."""
    if row.piece < 0:
        model.set_narrow(seen, np.frombuffer(bytes(row.moved), np.float64))
        return
    at = np.frombuffer(bytes(row.rows), np.int64)
    for values, data in ((model.embedding, row.moved), (seen["e"][0], row.sums)):
        values[at] += np.frombuffer(bytes(data), np.float32).reshape(len(at), -1)


def _logits(shared, held_back: bool):
    """Rows by language, label and logit in steps, of those held back or of all."""

    def run(batches):
        for row in _rows_of(batches):
            model = shared.value
            ids, y, held = _unpacked(row, model.spec)
            use = np.flatnonzero(held) if held_back else np.arange(len(y))
            if len(use):
                logits = model.logits(np.concatenate([ids[i] for i in use]), np.array([len(ids[i]) for i in use]))
                steps = np.rint(np.clip(logits, -1e6, 1e6) * _STEPS).astype(np.int64).tolist()
                counted = Counter((row["langs"][i], int(y[i]), step) for i, step in zip(use, steps))
                lang, label, step = zip(*counted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(label, pa.int32()), pa.array(step, pa.int32()), pa.array(list(counted.values()), pa.int64())], names=["lang", "y", "step", "n"]
                )

    return run


def _text_share(data: np.ndarray) -> float:
    """A number in [0, 1) that depends on the text alone."""
    return float(hash_runs(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(11)) / float(1 << 53)


def score(docs: DataFrame, model: Cnn, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``toxicity`` (0 to 1) to ``docs``; only the text goes into it.

    Null and empty texts get the score of a text without words. Very long texts are scored whole, in pieces that
    overlap by the widest filter. A column named ``toxicity`` is replaced; ``keep`` names the columns to return (all).
    """
    docs = without(docs, ["toxicity"])
    kept = docs.columns if keep is None else keep
    at = docs.columns.index(text_col)
    order = [docs.columns.index(c) for c in kept]
    schema = StructType([docs.schema.fields[i] for i in order] + [StructField("toxicity", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(at)
            scores = [own.scores(data, offsets) for _, _, data, offsets in utf8_slices(texts)]
            added = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in order] + [added], names=schema.names)

    return docs.mapInArrow(run, schema)


def flagged(model: Cnn, lang_col: str = "lang"):
    """Whether ``toxicity`` reaches the threshold of the row's language (the general one for other languages)."""
    limit = F.lit(model.threshold)
    for lang, value in model.thresholds.items():
        limit = F.when(F.col(lang_col).eqNullSafe(F.lit(lang)), F.lit(value)).otherwise(limit)
    return F.col("toxicity") >= limit


def learn(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", spec: CnnSpec = CnnSpec()) -> Cnn:
    """Fit on labelled documents of three of four parts: crc32 of the id, modulo 4, is not 2.

    All of them are fitted on, unless ``spec`` bounds the rows of a class: those are then chosen from the narrow label table first, and
    the share of its rows that was chosen goes along.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL")
    known = known.filter(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) != 2)
    chosen, stands_for = known, None
    if spec.fit_positive is not None or spec.fit_negative is not None:
        parts = [
            own if most is None else own.orderBy(F.xxhash64(F.lit(spec.seed), F.col("doc_id").cast("string"))).limit(most)
            for own, most in ((known.filter(F.col("y") == label), most) for label, most in ((1, spec.fit_positive), (0, spec.fit_negative)))
        ]
        chosen = stage(parts[0].unionByName(parts[1]), "fit-sample")
        all_rows, chosen_rows = ({r.y: r["count"] for r in rows.groupBy("y").count().collect()} for rows in (known, chosen))
        stands_for = {label: all_rows[label] / n for label, n in chosen_rows.items()}
    small = chosen.limit(_BROADCAST_LABELS + 1).count() <= _BROADCAST_LABELS
    # Read twice, for the numbers of rows and for the shards.
    labelled = documents.select("doc_id", "text", "lang").join(F.broadcast(chosen) if small else chosen, "doc_id")
    labelled = labelled if small else stage(labelled, "labelled")
    model = fit(labelled, label_col="y", spec=spec, stands_for=stands_for)
    if not small:
        discard(labelled)
    return model

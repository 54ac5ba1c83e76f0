"""Metrics of count models, context by context: each position moves once, packed, to the bucket of its context.

All positions of a context meet in one bucket, whatever they train or score, so their counts, the counts of counts and the metrics
come from sorted arrays there, and what leaves the bucket are sums by text. A record is 37 bytes plus 8 for each weight.

A context with so many positions that a bucket can't hold them is *hot*: there are few, whatever the data. Their positions go to buckets by
context and token, added up by text before they move, and their metrics by count come from a table (context, n) that is
aggregated beforehand and shipped to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from inkprobe.operators import countmodel as cm
from inkprobe.operators.tokens import ANY, END_HASH, START_HASH, draw_weights
from inkprobe.session import stage

# Records that a task has in hand at a time; a longer text has more.
BLOCK = 400_000
# Records of a bucket, on average.
BUCKET = 500_000
# A context with fewer positions is never hot; of all positions, a hot one has at least one in HOT_SHARE.
HOT_LEAST, HOT_SHARE = 1_000_000, 1_000

_TRAINS, _SCORED = 4, 8


@dataclass(frozen=True)
class Work:
    """What the contexts are: ``causal``, ``masked``, or the ``draws`` of a grid (mask_ratio, num_samples)."""

    contexts: str
    seed: int
    grid: tuple[tuple[float, int], ...] = ()

    @property
    def records(self) -> int:
        """Records of a position."""
        return 4 if self.contexts == "draws" else 1


def mix(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of some columns of 64-bit numbers."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        x = (out * np.uint64(0x9E3779B97F4A7C15)) ^ column.astype(np.int64, copy=False).view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out = x ^ (x >> np.uint64(31))
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _blocks(batches, work: Work) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some texts at a time, with their numbers of tokens; a longer text is a block of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        first = 0
        while first < len(lengths):
            last = max(int(np.searchsorted(ends, ends[first] - lengths[first] + BLOCK // work.records, side="right")), first + 1)
            yield batch.slice(first, last - first), lengths[first:last]
            first = last


def _shown(block: pa.RecordBatch, lengths: np.ndarray, work: Work, weighed: bool) -> Iterator[tuple]:
    """``left, right, token, row, kind, weights`` of all positions in the contexts that they train or are scored in."""
    token = block.column("tokens").flatten().to_numpy(zero_copy_only=False)
    n = len(token)
    if not n:
        return
    row = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    some = lengths > 0
    left, right, free = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, ANY, np.int64)
    left[1:], right[:-1] = token[:-1], token[1:]
    left[(ends - lengths)[some]], right[ends[some] - 1] = START_HASH, END_HASH
    kind = block.column("kind").to_numpy(zero_copy_only=False).astype(np.uint8)[row]
    if work.contexts == "causal":
        rest = np.ones(n, bool)
        rest[(ends - lengths)[some]] = False
        yield left[rest], free[rest], token[rest], row[rest], kind[rest], None
    elif work.contexts == "masked":
        yield left, right, token, row, kind, None
    else:
        weights = draw_weights(block.column("key").to_pylist(), lengths, work.grid, work.seed) if weighed else None
        for code in range(4):
            own = left if not code & 1 else free, right if not code & 2 else free, token, row
            if weights is None:
                yield *own, kind, None
            else:
                seen = np.where(weights[code].any(axis=1), kind, kind & ~np.uint8(_SCORED))
                use = (seen & (_TRAINS | _SCORED)) != 0
                yield *[c[use] for c in own], seen[use], weights[code][use]


def _added_up(columns: list[np.ndarray], c: np.ndarray, weights: np.ndarray | None) -> tuple:
    """Rows with equal columns as one, their counts and weights added."""
    order = np.lexsort(columns)
    columns = [x[order] for x in columns]
    at = np.flatnonzero(_changes(*columns))
    return [x[at] for x in columns], np.add.reduceat(c[order], at), None if weights is None else np.add.reduceat(weights[order], at, axis=0)


def _packs(work: Work, buckets: int, hot):
    """Texts to ``bucket, data``: the records of a block that go to a bucket, column by column."""

    def run(batches):
        for block, lengths in _blocks(batches, work):
            place = block.column("place").to_numpy(zero_copy_only=False)
            parts = []
            for left, right, token, row, kind, weights in _shown(block, lengths, work, True):
                columns, c, spot = [left, right, token, place[row], kind], np.ones(len(left), np.uint32), mix(left, right)
                is_hot = np.isin(spot, hot.value) if len(hot.value) else np.zeros(len(left), bool)
                if is_hot.any():
                    own, n, w = _added_up([x[is_hot] for x in columns], c[is_hot], None if weights is None else weights[is_hot])
                    parts.append((own, n.astype(np.uint32), w, mix(mix(own[0], own[1]).view(np.int64), own[2])))
                    columns, c, spot = [x[~is_hot] for x in columns], c[~is_hot], spot[~is_hot]
                    weights = None if weights is None else weights[~is_hot]
                parts.append((columns, c, weights, spot))
            if not parts:
                continue
            bucket = (np.concatenate([p[3] for p in parts]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            columns = [np.concatenate([p[0][k] for p in parts])[order] for k in range(5)] + [np.concatenate([p[1] for p in parts])[order]]
            if work.grid:
                weights = np.concatenate([p[2] for p in parts])[order]
                columns += [np.ascontiguousarray(weights[:, s]) for s in range(weights.shape[1])]
            bucket = bucket[order]
            starts = np.flatnonzero(_changes(bucket)) if len(bucket) else np.zeros(0, np.int64)
            data = [b"".join(x[a:b].tobytes() for x in columns) for a, b in zip(starts, np.r_[starts[1:], len(bucket)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def _unpacked(data: pa.ChunkedArray, settings: int) -> list[np.ndarray]:
    kinds = [np.int64] * 4 + [np.uint8, np.uint32] + [np.float64] * settings
    width = sum(np.dtype(k).itemsize for k in kinds)
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    for item in data:
        buffer = item.as_buffer()
        n, at = buffer.size // width, 0
        for kind, column in zip(kinds, columns):
            column.append(np.frombuffer(buffer, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in columns]


def _by_count(n: np.ndarray, contexts: np.ndarray, v: int, alpha: float, metrics: Sequence[str]) -> dict[str, np.ndarray]:
    """``metrics`` of pairs with counts ``n``; ``contexts`` says where a context starts. The formulas of ``countmodel.count_metrics``."""
    sizes = np.diff(np.r_[contexts, len(n)])
    spread = lambda x: np.repeat(x, sizes)
    total = np.add.reduceat(n, contexts)
    mass = spread(total + alpha * v)
    out = {"Mlog_prob": np.log(n + alpha) - np.log(mass)}
    if set(metrics) <= {"Mlog_prob"}:
        return out
    kinds = np.add.reduceat((n > 0).astype(np.int64), contexts)
    plogp = np.add.reduceat(np.where(n > 0, (n + alpha) * np.log(n + alpha), 0.0), contexts)
    out["Mentropy"] = np.log(mass) - (spread(plogp) + (v - spread(kinds)) * alpha * np.log(alpha)) / mass
    out["Mmax_log_prob"] = np.log(spread(np.maximum.reduceat(n, contexts)) + alpha) - np.log(mass)
    # By falling count within each context; pairs with one count share a run.
    which = spread(np.arange(len(contexts)))
    order = np.lexsort((-n, which))
    runs = np.flatnonzero(_changes(which[order], n[order]))
    lengths = np.diff(np.r_[runs, len(n)])
    begins = spread(contexts)[order]
    uses = np.cumsum(n[order])
    last = np.repeat(runs + lengths - 1, lengths)
    uses_ge, above, kinds_ge = (np.empty(len(n)) for _ in range(3))
    uses_ge[order] = uses[last] - (uses[begins] - n[order][begins])
    above[order] = np.repeat(runs, lengths) - begins
    kinds_ge[order] = last + 1 - begins
    out["Mrank"] = (above + 1) / v
    out["Mtop_p"] = np.where(n > 0, (uses_ge + alpha * kinds_ge) / mass, 1.0)
    out["Mrank_ge"] = np.where(n > 0, kinds_ge / v, 1.0)
    return out


def _sums(work: Work, v: int, alpha: float, metrics: Sequence[str], hot, table):
    """A bucket to ``place, weight, <metric>_<setting>``: sums by text."""
    settings = max(len(work.grid), 1)
    names = ["place", "weight", *[f"{m}_{s}" for m in metrics for s in range(settings)]]

    def run(packs: pa.Table) -> pa.Table:
        columns = _unpacked(packs["data"], len(work.grid))
        spot = mix(columns[0], columns[1])
        order = np.lexsort((columns[2], spot))
        left, right, token = (x[order] for x in columns[:3])
        spot = spot[order]
        if ((spot[1:] == spot[:-1]) & _changes(left, right)[1:]).any():  # two contexts with one hash
            order = np.lexsort((columns[2], columns[1], columns[0]))
            left, right, token = (x[order] for x in columns[:3])
        place, kind, c = (x[order] for x in columns[3:6])
        new_context = _changes(left, right)
        new_pair = new_context | _changes(token)
        pairs = np.flatnonzero(new_pair)
        pair = np.cumsum(new_pair) - 1
        contexts = np.flatnonzero(new_context[pairs])
        is_hot = np.isin(mix(left[pairs], right[pairs]), hot.value) if len(hot.value) else np.zeros(len(pairs), bool)
        values = np.zeros((len(place), len(metrics)))
        for part in range(cm.PARTS):
            trains = (kind & _TRAINS != 0) & (kind >> 1 & 1 == part)
            scored = (kind & _SCORED != 0) & (kind & 1 == part)
            if not scored.any():
                continue
            n = np.add.reduceat(np.where(trains, c, 0).astype(np.int64), pairs)
            found = _by_count(n, contexts, v, alpha, metrics)
            found = np.stack([found[m] for m in metrics], axis=1)
            asked = is_hot & np.logical_or.reduceat(scored, pairs)
            if asked.any():
                found[asked] = _looked_up(table.value, part, left[pairs][asked], right[pairs][asked], n[asked])
            values[scored] = found[pair[scored]]
        used = np.flatnonzero(kind & _SCORED != 0)
        if not len(used):
            return pa.table({k: pa.array([], pa.int64() if k == "place" else pa.float64()) for k in names})
        used = used[np.argsort(place[used], kind="stable")]
        weights = [x[order][used] for x in columns[6:]] or [c[used].astype(float)]
        at = np.flatnonzero(_changes(place[used]))
        out = [place[used][at], np.add.reduceat(weights[0], at)]
        out += [np.add.reduceat(values[used, m] * w, at) for m in range(len(metrics)) for w in weights]
        return pa.table([pa.array(x) for x in out], names=names)

    return run, ", ".join(f"{n} {'long' if n == 'place' else 'double'}" for n in names)


# ---- hot contexts


def _candidates(work: Work, frequent: np.ndarray):
    """Contexts of frequent neighbours alone, with their numbers of positions."""

    def run(batches):
        for block, lengths in _blocks(batches, work):
            for left, right, *_ in _shown(block, lengths, work, False):
                near = np.isin(left, frequent) & np.isin(right, frequent)
                if near.any():
                    (a, b), n, _ = _added_up([left[near], right[near]], np.ones(int(near.sum()), np.int64), None)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["left", "right", "n"])

    return run


def _hot_pairs(work: Work, hot):
    """``part, left, right, token, n, uses`` of hot contexts."""

    def run(batches):
        for block, lengths in _blocks(batches, work):
            for left, right, token, row, kind, _ in _shown(block, lengths, work, False):
                near = np.isin(mix(left, right), hot.value)
                if not near.any():
                    continue
                (k, t, b, a), n, _ = _added_up([x[near] for x in (kind, token, right, left)], np.ones(int(near.sum()), np.int64), None)
                none = np.zeros(len(n), np.int64)
                two = lambda x: np.concatenate([x, x])
                part = np.concatenate([k >> 1 & 1, k & 1]).astype(np.int32)
                counts = [np.concatenate([np.where(k & _TRAINS, n, 0), none]), np.concatenate([none, np.where(k & _SCORED, n, 0)])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, two(a), two(b), two(t), *counts)], names=[*cm.PAIR, "n", "uses"])

    return run


def _lookup_table(rows: pa.Table, metrics: Sequence[str]) -> dict:
    part, left, right, n = (rows[c].to_numpy().astype(np.int64) for c in (*cm.CONTEXT, "n"))
    key = mix(part, left, right, n)
    order = np.argsort(key)
    return {"key": key[order], "at": np.stack([left, right, n, part], axis=1)[order], "values": np.stack([rows[m].to_numpy() for m in metrics], axis=1)[order]}


def _looked_up(table: dict, part: int, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    parts = np.full(len(n), part, np.int64)
    at = np.minimum(np.searchsorted(table["key"], mix(parts, left, right, n)), len(table["key"]) - 1)
    if (table["at"][at] != np.stack([left, right, n, parts], axis=1)).any():
        raise ValueError("counts of a hot context are missing, or two share a hash")
    return table["values"][at]


def _frequent(rows: DataFrame, least: int) -> list[int]:
    """Tokens used so often; at most one in ``HOT_SHARE`` of all."""
    uses = rows.select(F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return [r["token"] for r in uses.filter(F.col("n") >= least).select("token").collect()]


def text_sums(rows: DataFrame, total: int, work: Work, v: int, alpha: float, metrics: Sequence[str]) -> DataFrame:
    """``place, weight, <metric>_<setting>``: sums of ``metrics`` over the scored positions of each text, weighted by setting.

    ``rows`` has ``place, key, kind, tokens`` of texts with ``total`` tokens in all: the number of a text, its id as text, what it does
    (:func:`kind`) and its hashed tokens. It is read up to four times: pass staged tables.
    """
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast
    records = total * work.records
    hot, table = np.zeros(0, np.uint64), None
    least = max(HOT_LEAST, total // HOT_SHARE)
    if total >= least:
        frequent = np.array([ANY, START_HASH, END_HASH, *_frequent(rows, least)], np.int64)
        near = rows.mapInArrow(_candidates(work, frequent), "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
        found = near.filter(F.col("n") >= least).select("left", "right").collect()
        if found:
            hot = np.unique(mix(*(np.array([r[c] for r in found], np.int64) for c in ("left", "right"))))
    shared = share(hot)
    if len(hot):
        pairs = rows.mapInArrow(_hot_pairs(work, shared), "part int, left long, right long, token long, n long, uses long")
        pairs = stage(pairs.groupBy(*cm.PAIR).agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")), "hot-pairs")
        table = _lookup_table(cm.count_metrics(pairs, v, alpha, metrics).toArrow(), metrics)
    buckets = 16 + records // BUCKET
    packs = rows.mapInArrow(_packs(work, buckets, shared), "bucket int, data binary")
    run, schema = _sums(work, v, alpha, metrics, shared, share(table))
    names = [part.split()[0] for part in schema.split(", ")][1:]
    return packs.groupBy("bucket").applyInArrow(run, schema).groupBy("place").agg(*[F.sum(n).alias(n) for n in names])


def kind(scoring: Column, training: Column, trains: bool, scored: bool) -> Column:
    """What a text does: the parts that score and learn from it, and whether either happens."""
    return (scoring + 2 * training + F.lit(_TRAINS * trains + _SCORED * scored)).cast("int")

"""Isotonic regression of many runs at once: pooled blocks are merged in a reduction tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprobe.session import stage

# Distinct scores of a run that one task pools in the first round, and groups that one task merges in later rounds.
SLOT = 100_000
FAN = 16


def pool(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge adjacent blocks, in order of their scores, until their means ascend.

    Pooling is associative: blocks of parts, pooled again, are the blocks of the whole.
    """
    first, last, sums, weights = [], [], [], []
    for a, b, s, w in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist()):
        while sums and sums[-1] * w >= s * weights[-1]:
            a, s, w = first.pop(), s + sums.pop(), w + weights.pop()
            last.pop()
        first.append(a)
        last.append(b)
        sums.append(s)
        weights.append(w)
    return np.array(first), np.array(last), np.array(sums), np.array(weights)


@dataclass
class Curve:
    """Values between the ends of blocks are interpolated, those outside get the nearest one."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


def _pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["low"].to_numpy(), kind="stable")
        blocks = pool(*(table[c].to_numpy()[order] for c in ("low", "high", "total", "weight")))
        own = [pa.array(np.repeat(table[k].to_numpy()[:1], len(blocks[0]))) for k in ("run", "slot")]
        return pa.table([*own, *(pa.array(b, pa.float64()) for b in blocks)], names=["run", "slot", "low", "high", "total", "weight"])

    return rows.groupBy(*keys).applyInArrow(run, "run int, slot long, low double, high double, total double, weight double")


def fit_isotonic(rows: DataFrame, slot: int = SLOT) -> dict[int, Curve]:
    """The ascending curve of least squares of ``label`` over ``score`` for each ``run``.

    Equal scores are one point. Scores are cut at quantiles into slots of about ``slot`` distinct ones, which are pooled apart; then the blocks of ``FAN``
    neighbouring slots are pooled, and so on. Labels of 0 and 1 leave at most about n^(2/3) blocks of n rows, which is what the driver gets for a run.
    """
    points = stage(rows.groupBy("run", F.col("score").alias("low")).agg(F.sum("label").cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("weight")), "points")
    sizes = {r.run: r["count"] for r in points.groupBy("run").count().collect()}
    parts = max((-(-n // slot) for n in sizes.values()), default=1)
    cut = points.withColumn("high", F.col("low")).withColumn("slot", F.lit(0).cast("long"))
    if parts > 1:
        share = [i / parts for i in range(1, parts)]
        cuts = {r.run: sorted(set(r.cuts)) for r in points.groupBy("run").agg(F.percentile_approx("low", share, 20_000).alias("cuts")).collect()}
        place = F.lit(0).cast("long")
        for run, own in cuts.items():
            inside = F.size(F.filter(F.array(*[F.lit(float(c)) for c in own]), lambda c: c < F.col("low"))).cast("long")
            place = F.when(F.col("run") == run, inside).otherwise(place)
        cut = cut.withColumn("slot", place)
    blocks = _pooled(cut.select("run", "slot", "low", "high", "total", "weight"), ["run", "slot"])
    while parts > 1:
        parts = -(-parts // FAN)
        blocks = _pooled(stage(blocks, "blocks").withColumn("slot", F.floor(F.col("slot") / FAN)), ["run", "slot"])
    found: dict[int, list[tuple]] = {}
    for r in blocks.collect():
        found.setdefault(r.run, []).append((r.low, r.high, r.total / r.weight))
    curves = {}
    for run, own in found.items():
        own.sort()
        x, y = np.array([v for a, b, _ in own for v in (a, b)]), np.repeat([m for *_, m in own], 2)
        keep = np.r_[True, x[1:] > x[:-1]]
        curves[run] = Curve(x[keep], y[keep])
    return curves

"""Quantile cuts of all features in one job, and the binned table of a fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprobe.fits.table import TASK_VALUES, matrix
from inkprobe.fits.trees import BINS, binned
from inkprobe.session import stage

# Trees may grow in one task on at most this many values, which are bytes once binned: 64 MB, as for other fits.
BINNED_VALUES = 8 * TASK_VALUES


def feature_cuts(train: DataFrame) -> list[np.ndarray]:
    """Up to ``BINS - 1`` cuts of each feature at its quantiles, taken over all rows; values that occur, so that equal ones stay together."""
    share = [i / BINS for i in range(1, BINS)]
    values = train.select(F.posexplode("x").alias("feature", "value"))
    cuts = values.groupBy("feature").agg(F.percentile_approx("value", share, 10_000).alias("cuts"), F.max("value").alias("top"))
    rows = sorted(cuts.collect(), key=lambda r: r.feature)
    return [np.array(sorted({c for c in r.cuts if c < r.top}), np.float64) for r in rows]


def binned_table(train: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``key, label, runs, bins``: a byte for each feature, staged."""

    def run(batches):
        for batch in batches:
            rows = binned(matrix(batch.column(3)), cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "label", "runs", "bins"])

    return stage(train.select("key", "label", "runs", "x").mapInArrow(run, "key long, label int, runs array<int>, bins binary"), "bins")


def bin_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)

"""Population-variance standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def standard_scale(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - mean) / std`` of ``other`` with mean and std of ``train`` (ddof 0).

    A column without variance is divided by 1, so it becomes 0. The statistics are one
    row and are joined as such; nothing else moves.
    """
    stats = train.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}__std") for c in columns]
    )
    scaled = {
        c: (F.col(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std"))
        for c in columns
    }
    names = [f"{c}__{s}" for c in columns for s in ("mean", "std")]
    return other.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*names)

"""The table that fits read, and the pieces that all of them share.

A *run* is one fit: a fold, a column, a setting. Training rows are ``key long, label int, runs array<int>, x array<double>``: which runs learn from a row,
and its features. A row is stored once however many folds use it. Models have ``scores(x)``: the probability of class 1.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# A run of at most this many values (rows by features) may be given to one task: 64 MB as doubles.
TASK_VALUES = 8_000_000
# Models go to every task; a larger set of them is refused.
MODEL_BYTES = 1 << 30


def runs_of(batch: pa.RecordBatch, column: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """``run, rows of the batch`` from the column with lists of runs."""
    lists = batch.column(column)
    run = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    order = np.argsort(run, kind="stable")
    run, row = run[order], row[order]
    for part in np.split(np.arange(len(run)), np.flatnonzero(np.diff(run)) + 1):
        if len(part):
            yield int(run[part[0]]), row[part]


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def class_counts(train: DataFrame) -> dict[int, dict[int, int]]:
    """Rows of each label in each run."""
    out: dict[int, dict[int, int]] = {}
    for r in train.select(F.explode("runs").alias("run"), "label").groupBy("run", "label").count().collect():
        out.setdefault(r.run, {})[r.label] = r["count"]
    return out


def summed(partials: DataFrame, finish: Callable[[tuple, np.ndarray], list[tuple]], schema: str, keys: int) -> DataFrame:
    """Add up vectors of doubles by key and give what ``finish(key, sum)`` makes of each.

    ``partials`` has ``keys`` integer columns, then ``values binary``. A task holds one sum at a time, whatever number of partial vectors there is.
    """
    names = partials.columns[:keys]

    def run(batches):
        at, total = None, None
        for batch in batches:
            out = []
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]]
            for i in range(batch.num_rows):
                key = tuple(int(c[i]) for c in columns)
                values = np.frombuffer(batch.column(keys)[i].as_buffer(), np.float64)
                if key != at:
                    if at is not None:
                        out += finish(at, total)
                    at, total = key, values.copy()
                else:
                    total += values
            if out:
                yield out
        if at is not None:
            yield finish(at, total)

    fields = partials.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def rows(batches):
        for out in run(batches):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], names=arrow.names)

    return partials.repartition(*names).sortWithinPartitions(*names).mapInArrow(rows, fields)


def shared(df: DataFrame, models: Mapping[int, Any]):
    """The models as a broadcast of checked size."""
    size = sum(len(pickle.dumps(model, protocol=5)) for model in models.values())
    if size > MODEL_BYTES:
        raise ValueError(f"the fitted models take {size} bytes, more than {MODEL_BYTES}: bound their depth or number")
    return df.sparkSession.sparkContext.broadcast(dict(models))


def scored(rows: DataFrame, models: Mapping[int, Any]) -> DataFrame:
    """``run, text_id, label, score`` from ``text_id, label, runs, x``: each row by the models of its runs."""
    data = shared(rows, models)
    schema = rows.select(F.lit(0).alias("run"), "text_id", "label", F.lit(0.0).alias("score")).schema

    def run(batches):
        own = data.value
        for batch in batches:
            x = matrix(batch.column(3))
            for number, at in runs_of(batch):
                score = own[number].scores(x[at])
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), number, np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(score, pa.float64())],
                    names=["run", "text_id", "label", "score"],
                )

    return rows.select("text_id", "label", "runs", "x").mapInArrow(run, schema)

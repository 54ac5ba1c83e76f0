"""Small helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

# Rows and bytes that one slice of an Arrow batch holds at most; a longer text is a slice of its own.
SLICE_ROWS = 4096
SLICE_BYTES = 1024 * 1024


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add (a clashing column is replaced)."""
    lowered = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered])


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], fields: list[StructField]) -> DataFrame:
    """Apply ``work`` batch by batch; it gives the rows of the schema ``fields``, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := work(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, StructType(fields))


def utf8_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)`` of a string array in bounded slices; nulls are empty.

    ``offsets`` are relative to ``bytes`` and one longer than the slice has rows.
    """
    texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), first + SLICE_ROWS, len(texts))
        part = offsets[first : end + 1]
        yield first, end, data[part[0] : part[-1]], part - part[0]
        first = end

"""Pool token vectors (``text_id, pos, vec``) to one vector per text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from inkprobe.operators.lookup import skew_safe_join
from inkprobe.session import stage

# A vector table is shipped to every task only while rows * dimension * 8 stays below this.
BROADCAST_BYTES = 128 * 1024 * 1024


def pool_last(vectors: DataFrame, by: Sequence[str] = ("text_id",)) -> DataFrame:
    """Vector of the last token."""
    return vectors.groupBy(*by).agg(F.max_by("vec", "pos").alias("embedding"))


def pool_first(vectors: DataFrame, by: Sequence[str] = ("text_id",)) -> DataFrame:
    """Vector of the first token."""
    return vectors.groupBy(*by).agg(F.min_by("vec", "pos").alias("embedding"))


def pool_mean(vectors: DataFrame, weight: str = "w", by: Sequence[str] = ("text_id",)) -> DataFrame:
    """``sum(vec * w) / max(sum(w), 1)``; one vector per text and task is shuffled."""
    w = F.col(weight).cast("double")
    # The summarizer skips weightless rows; a zero vector keeps their text in the result.
    nothing = F.array_repeat(F.lit(0.0), F.size("vec"))
    weighted = vectors.select(
        *by,
        w.alias("_w"),
        F.when(w != 0, w).otherwise(F.lit(1.0)).alias("_use"),
        array_to_vector(F.when(w != 0, F.col("vec").cast("array<double>")).otherwise(nothing)).alias("_vec"),
    )
    sums = weighted.groupBy(*by).agg(
        Summarizer.sum(F.col("_vec"), F.col("_use")).alias("_sum"), F.greatest(F.sum("_w"), F.lit(1.0)).alias("_floor")
    )
    return sums.select(*by, F.transform(vector_to_array("_sum"), lambda s: s / F.col("_floor")).alias("embedding"))


def token_vectors(tokens: DataFrame, table: DataFrame, key: str = "vec_id") -> DataFrame:
    """Look up ``vec`` by ``key`` for every row of ``tokens``.

    The table is broadcast only after its size is checked; a larger one goes through the
    skew-proof join, as one frequent token may own a third of all rows.
    """
    rows, width = table.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if rows * (width or 0) * 8 <= BROADCAST_BYTES:
        return tokens.join(F.broadcast(table), key)
    uses = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    return skew_safe_join(tokens, table.join(uses, key), [key])


def pool_mean_by_id(used: DataFrame, table: DataFrame, key: str = "vec_id", weight: str = "w", block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``text_id, embedding``: ``pool_mean`` of the vectors that ``used`` (``text_id, vec_id, w``) names by ``key``, numbered from 0 in ``table``.

    Ids and weights meet by text, and vectors are looked up and added where a text is: a row of the shuffle is an id and a weight, never a vector.
    The table goes to the tasks in blocks of bounded size, one pass over the texts each; with several, a text's partial sums are added up.
    """
    rows, width = table.agg(F.max(key) + 1, F.max(F.size("vec"))).first()
    rows, width = rows or 0, width or 0
    size = max(1, block_bytes // max(8 * width, 1))
    fields = used.select("text_id").schema.add("total", DoubleType()).add("embedding", ArrayType(DoubleType()))
    lists = used.select("text_id", F.col(key).cast("bigint").alias("id"), F.col(weight).cast("double").alias("w")).groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "w"))).alias("at")
    )
    several = rows > size
    lists = stage(lists, "lists") if several else lists

    def block(first: int) -> DataFrame:
        own = table.filter(F.col(key).between(first, first + size - 1)).select((F.col(key) - first).alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        matrix = np.zeros((max(0, min(size, rows - first)), width))
        for batch in own.toArrow().to_batches():
            matrix[batch.column(0).to_numpy()] = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        shared = used.sparkSession.sparkContext.broadcast(matrix)

        def add(batches):
            for batch in batches:
                at = batch.column(1)
                ids, w = (at.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                ends = np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))
                sums, totals = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows)
                for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                    totals[i] = w[a:b].sum()
                    own = np.arange(a, b) if not several else a + np.flatnonzero((ids[a:b] >= first) & (ids[a:b] < first + len(shared.value)))
                    own = own[w[own] != 0]
                    for c in range(0, len(own), 4096):
                        part = own[c : c + 4096]
                        sums[i] += w[part] @ shared.value[ids[part] - first]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals), vectors], names=["text_id", "total", "embedding"])

        return lists.mapInArrow(add, fields)

    parts = [block(first) for first in range(0, max(rows, 1), size)]
    sums = parts[0]
    if several:
        each = parts[0]
        for part in parts[1:]:
            each = each.unionByName(part)
        places = [F.sum(F.get("embedding", F.lit(i))) for i in range(width)]
        sums = each.groupBy("text_id").agg(F.first("total").alias("total"), F.array(*places).alias("embedding"))
    return sums.select("text_id", F.transform("embedding", lambda s: s / F.greatest(F.col("total"), F.lit(1.0))).alias("embedding"))

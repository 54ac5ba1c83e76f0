"""Exact copies of texts by two passes of Bloom filtering: only rows whose hash may repeat are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkprobe.llm.bloom import BloomFilter
from inkprobe.llm.frames import kept_columns, packed, unpacked
from inkprobe.operators.lookup import skew_safe_join
from inkprobe.session import stage

BLANKS = r"[\x20\x09-\x0D]+"
# Cells of the first filter for each row: a row without a copy shares its cell with another one in 64 to 128 times.
CELLS_PER_ROW = 64
ADDED = ["text_sha256", "keep_id", "group_size", "kept"]


def normalised(text: Column) -> Column:
    """The text with each run of blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``text_sha256`` of the normalised text, ``keep_id``, ``group_size`` and ``kept`` to every row of ``docs``.

    Rows are equal if their texts are after ``normalised``. Of equal rows the one with the smallest id is ``kept``, and all
    bear its id as ``keep_id``.

    0. One scan computes the digests and writes them with a row number and the columns to return (``keep``; all by default).
    1. First pass: a filter of one bit for each of 64 cells a row, spread over the cluster. Cells hit twice are counted out,
    combined before the shuffle; 8 bytes a row move at most.
    2. Second pass: the cells hit twice go into a Bloom filter of at most 64 MB, which is broadcast. A row that misses it has no copy and
    passes straight through. Only the others are shuffled by their whole digest, which settles false alarms. With more
    cells than the filter can tell apart, more rows are shuffled; the result stays the same.
    Texts that a large share of rows have are joined map-side, so no task gets a whole group.

    A null text is empty, and empty texts are equal. A null id comes after all others; ``keep_id`` is null if no equal row has an id. Rows that repeat
    id and text are told apart by their row number, so exactly one row of a group is kept. An empty table gives an empty result. Columns that clash with
    the added ones are replaced.
    """
    kept = kept_columns(docs, keep, ADDED)
    digest = F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256))
    rows = docs.select(packed(docs, kept).alias("carried"), F.col(f"`{id_col}`").alias("id"), digest.alias("digest"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "digests")

    cells = CELLS_PER_ROW << max(rows.count() - 1, 0).bit_length()
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)))
    twice = stage(rows.groupBy("cell").count().filter("count > 1").select("cell"), "cells")
    marked = BloomFilter(twice, "cell", twice.count()).mark(rows, "cell", "maybe").drop("cell")

    alone = marked.filter("NOT maybe").select(
        "carried", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    maybe = marked.filter("maybe").drop("maybe")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = maybe.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(groups.withColumn("uses", F.col("group_size")), "groups")
    met = skew_safe_join(maybe, groups, ["digest"]).select(
        "carried", "digest", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept")
    )
    return unpacked(alone.unionByName(met), "carried", kept, [F.lower(F.hex("digest")).alias("text_sha256"), *ADDED[1:]])

"""Skew-proof equi-lookup of a large fact table in a large key table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# At most this many keys can each hold 1/HOT_KEYS of all rows, so a table of such keys is
# bounded by arithmetic, whatever the data: a few dozen MB at the widths used here.
HOT_KEYS = 200_000


def hot_share(uses: DataFrame, uses_col: str = "uses") -> DataFrame:
    """One-row table with the row count from which a key counts as hot."""
    return uses.agg(F.greatest(F.ceil(F.sum(uses_col) / F.lit(HOT_KEYS)), F.lit(2)).cast("bigint").alias("hot_from"))


def skew_safe_join(facts: DataFrame, keyed: DataFrame, keys: Sequence[str], uses_col: str = "uses") -> DataFrame:
    """Inner join of ``facts`` to ``keyed`` (one row per key) that no hot key can stall.

    ``keyed`` must say in ``uses_col`` how many ``facts`` rows carry each key. Keys that
    hold at least 1/HOT_KEYS of all rows are joined map-side against their bounded table;
    what is left is shuffled, and there every key is small. No row is dropped.
    Both inputs are read twice, so pass staged tables.
    """
    split = keyed.crossJoin(F.broadcast(hot_share(keyed, uses_col)))
    hot = split.filter(F.col(uses_col) >= F.col("hot_from")).drop("hot_from", uses_col)
    cold = split.filter(F.col(uses_col) < F.col("hot_from")).drop("hot_from", uses_col)
    near = facts.join(F.broadcast(hot), list(keys))
    far = facts.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(cold, list(keys))
    return near.unionByName(far)
